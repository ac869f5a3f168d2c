"""Queries by name, each over whole tables, with SQL where SQL can express them.

The sample particles are spheres at 20 times the first three coordinates of each embedding.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from porespan.functions import convex
from porespan.functions import geometry as G
from porespan.functions import segments, stats
from porespan.functions.registered import register
from porespan.functions.sums import exact_sums
from porespan.operators import contacts as C
from porespan.operators import dense as D
from porespan.operators import large as L
from porespan.operators import percolation as P
from porespan.operators import transport as T
from porespan.plans import workflows as W
from porespan.policy import Domain
from porespan.sources.particles import Population, checked, embedding_particles

WIDE, BOX = Domain(16.0), Domain(8.0, (True, True, True))
THRESHOLD = 0.1


PARTICLES = """p as (select vec_id::int as idx, embedding[1]::double * 20.0 as cx, embedding[2]::double * 20.0 as cy, embedding[3]::double * 20.0 as cz,
 0.5::double + 0.1::double * (label % 4) as r from embeddings)"""
#: All periodic images within one cell of the wrapped sample spheres.
PERIODIC = (
    PARTICLES
    + """, w as (select idx, r, (-floor((cx + 4.0) / 8.0))::bigint as qx, (-floor((cy + 4.0) / 8.0))::bigint as qy, (-floor((cz + 4.0) / 8.0))::bigint as qz, cx, cy, cz from p),
 v as (select idx, r, qx, qy, qz, cx + qx * 8.0 as x, cy + qy * 8.0 as y, cz + qz * 8.0 as z from w),
 k as (select a.k as kx, b.k as ky, c.k as kz from (select unnest([-1, 0, 1]) as k) a, (select unnest([-1, 0, 1]) as k) b, (select unnest([-1, 0, 1]) as k) c),
 e as (select i.idx as i, j.idx as j, kx + j.qx - i.qx as sx, ky + j.qy - i.qy as sy, kz + j.qz - i.qz as sz,
   greatest(sqrt((i.x - j.x - 8.0 * kx) ** 2 + (i.y - j.y - 8.0 * ky) ** 2 + (i.z - j.z - 8.0 * kz) ** 2) - i.r - j.r, 0) as gap
   from v i join v j on i.idx < j.idx cross join k where gap <= 0.1 + 1e-9)"""
)
OPEN = PARTICLES + """, e as (select a.idx as i, b.idx as j, greatest(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) - a.r - b.r, 0) as gap from p a join p b on a.idx < b.idx where gap <= 0.1 + 1e-9)"""
REACH = """, b as (select i, j from e union all select j, i from e), reach as (select idx as node, idx as far from p union select reach.node, b.j from reach join b on reach.far = b.i),
 comp as (select node as idx, min(far)::bigint as component from reach group by node)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the sample particles and whether one joins both x faces."""
    return q_spanning_components(spark, sf_dir)


# ---------------------------------------------------------------- scalar geometry


def q_periodic_coordinates(spark, sf_dir):
    p = embedding_particles(spark, sf_dir)
    cols = []
    for k, a in enumerate("xyz"):
        c = F.col(f"c{a}")
        cols += [G.canonical_shift(c, BOX, k).alias(f"b{a}"), _r(G.wrap(c, BOX, k)).alias(f"w{a}"), _r(G.minimum_image(c - 1.0, BOX, k)).alias(f"m{a}")]
    return p.select("idx", *cols)


S_PERIODIC = "with " + PARTICLES + " select idx, " + ", ".join(
    f"(-floor((c{a} + 4.0) / 8.0))::bigint as b{a}, round(c{a} - floor((c{a} + 4.0) / 8.0) * 8.0, 6) + 0.0 as w{a}, round(c{a} - 1.0 - floor((c{a} - 1.0) / 8.0 + 0.5) * 8.0, 6) + 0.0 as m{a}" for a in "xyz"
) + " from p"


def q_body_gaps(spark, sf_dir):
    """Every sphere against a fixed sphere, cylinder, rectangle and segment; and its cylinder against a parallel one."""
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    p, r, up = embedding_particles(spark, sf_dir), F.col("radius"), lit(0, 0, 1)
    at = tuple(F.col(f"c{a}") for a in "xyz")
    return p.select(
        "idx",
        _r(G.sphere_sphere(at, r, lit(1, 1, 1), F.lit(0.5))).alias("sphere"),
        _r(G.point_cylinder(at, lit(0, 0, 0), up, F.lit(4.0), F.lit(1.0))).alias("point_cylinder"),
        _r(G.sphere_cylinder(at, r, lit(0, 0, 0), up, F.lit(4.0), F.lit(1.0))).alias("sphere_cylinder"),
        _r(G.point_rectangle(at, lit(-4, 0, 0), lit(0, 2, 3))).alias("point_rectangle"),
        _r(G.sphere_rectangle(at, r, lit(-4, 0, 0), lit(0, 2, 3))).alias("sphere_rectangle"),
        _r(G.parallel_cylinders(at, F.lit(2.0), r, lit(1, 1, 1), F.lit(3.0), F.lit(0.5), up)).alias("parallel_cylinders"),
        _r(G.point_segment(at, lit(-1, -1, -1), lit(2, 1, 1))).alias("segment"),
    )


S_BODY = "with " + PARTICLES + """, t as (select *, greatest(0, least(1, ((cx + 1) * 3 + (cy + 1) * 2 + (cz + 1) * 2) / 17.0)) as t from p),
 g as (select *, sqrt(greatest(abs(cz) - 2, 0) ** 2 + greatest(sqrt(cx ** 2 + cy ** 2) - 1, 0) ** 2) as pc, sqrt((cx + 4) ** 2 + greatest(abs(cy) - 2, 0) ** 2 + greatest(abs(cz) - 3, 0) ** 2) as pr from t)
select idx, round(greatest(sqrt((cx - 1) ** 2 + (cy - 1) ** 2 + (cz - 1) ** 2) - r - 0.5, 0), 6) as sphere, round(pc, 6) as point_cylinder, round(greatest(pc - r, 0), 6) as sphere_cylinder,
 round(pr, 6) as point_rectangle, round(greatest(pr - r, 0), 6) as sphere_rectangle,
 round(sqrt(greatest(abs(cz - 1) - 2.5, 0) ** 2 + greatest(sqrt((cx - 1) ** 2 + (cy - 1) ** 2) - r - 0.5, 0) ** 2), 6) as parallel_cylinders,
 round(sqrt((cx + 1 - 3 * t) ** 2 + (cy + 1 - 2 * t) ** 2 + (cz + 1 - 2 * t) ** 2), 6) as segment from g"""


def q_volumes(spark, sf_dir):
    p = embedding_particles(spark, sf_dir)
    v = G.sphere_volume(F.col("radius"))
    return p.groupBy(_r(F.col("radius"), 3).alias("radius")).agg(F.count("*").alias("n"), _r(F.sum(v)).alias("volume"), _r(F.sum(v) / WIDE.volume, 9).alias("fraction"), _r(F.sum(v * 2.5)).alias("cost"))


S_VOLUMES = "with " + PARTICLES + " select round(r, 3) as radius, count(*) as n, round(sum(4.0 / 3 * pi() * r ** 3), 6) as volume, round(sum(4.0 / 3 * pi() * r ** 3) / 4096.0, 9) as fraction, round(sum(4.0 / 3 * pi() * r ** 3 * 2.5), 6) as cost from p group by 1"


def q_count_for_fraction(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    v = G.cylinder_volume(F.lit(0.01) * F.col("p_size"), F.col("p_retailprice") / 1000)
    return part.select("p_partkey", *[G.count_for_fraction(F.lit(0.35), v, 1000.0, k).alias(k) for k in ("half_up", "ceil", "floor")])


S_COUNT = "with a as (select p_partkey, 0.35::double * 1000.0::double / (pi() * (0.01::double * p_size) * (0.01::double * p_size) * (p_retailprice / 1000)) as x from part) select p_partkey, round(x)::bigint as half_up, ceil(x)::bigint as ceil, floor(x)::bigint as floor from a"


def q_cylinder_gaps(spark, sf_dir):
    """A cylinder at each particle against one parallel to it and against a long one across, both by the certified solver; SQL has the closed forms."""
    p = embedding_particles(spark, sf_dir).select("idx", "cx", "cy", "cz")

    def run(batches):
        for pdf in batches:
            c, n = pdf[["cx", "cy", "cz"]].to_numpy(), len(pdf)
            along = lambda k: np.tile(np.eye(3)[k], (n, 1))
            same = lambda v: np.full(n, float(v))
            parallel = convex.cylinder_gaps(c, along(2), same(2), same(0.3), np.tile([1.0, 1.0, 1.0], (n, 1)), along(2), same(3), same(0.5))
            crossing = convex.cylinder_gaps(c, along(2), same(2), same(0.3), np.zeros((n, 3)), along(0), same(200), same(0.5))
            yield pdf[["idx"]].assign(parallel=parallel, crossing=np.where(np.abs(pdf["cz"]) < 1.0, crossing, np.nan))

    found = p.mapInPandas(run, "idx int, parallel double, crossing double")
    return found.select("idx", _r(F.col("parallel"), 5).alias("parallel"), _r(F.when(~F.isnan("crossing"), F.col("crossing")), 5).alias("crossing"))


S_CYLINDERS = "with " + PARTICLES + """ select idx, round(sqrt(greatest(abs(cz - 1) - 2.5, 0) ** 2 + greatest(sqrt((cx - 1) ** 2 + (cy - 1) ** 2) - 0.8, 0) ** 2), 5) as parallel,
 case when abs(cz) < 1.0 then round(greatest(abs(cy) - 0.8, 0), 5) end as crossing from p"""


def q_segment_gaps(spark, sf_dir):
    """A segment upwards from each particle against one along x and a box: closed forms of axis-parallel ones."""
    p, lit = embedding_particles(spark, sf_dir), lambda *v: tuple(F.lit(float(x)) for x in v)
    at = tuple(F.col(f"c{a}") for a in "xyz")
    top = G.moved(at, lit(0, 0, 2))
    mid, _, length = G.from_endpoints(at, top)
    p = segments.segment_gaps(p, at, top, lit(-3, 0, 1), lit(3, 0, 1)).drop("exact")
    p = segments.segment_box_hits(p, at, top, lit(1, 1, 1), lit(2, 2, 1)).drop("exact")
    return p.select(
        "idx", _r(F.col("gap")).alias("gap"), "meets", _r(mid[2]).alias("middle"), _r(length).alias("length"),
        _r(G.safe_product(F.lit(1e200), F.abs(at[0]) + 1, F.lit(1e-200))).alias("product"),
    )


S_SEGMENTS = "with " + PARTICLES + """ select idx, round(sqrt(greatest(abs(cx) - 3, 0) ** 2 + cy ** 2 + (case when cz > 1 then cz - 1 when cz + 2 < 1 then -1 - cz else 0 end) ** 2), 6) as gap,
 abs(cx - 1) <= 2 and abs(cy - 1) <= 2 and cz <= 2 and cz + 2 >= 0 as meets, round(cz + 1, 6) as middle, 2.0::double as length, round(abs(cx) + 1, 6) as product from p"""


# ---------------------------------------------------------------- contacts


def q_contacts(spark, sf_dir):
    return C.cell_contacts(embedding_particles(spark, sf_dir), WIDE, THRESHOLD).select("i", "j", _r(F.col("gap")).alias("gap"))


def q_contacts_bruteforce(spark, sf_dir):
    return C.theta_contacts(embedding_particles(spark, sf_dir), WIDE, THRESHOLD).select("i", "j", _r(F.col("gap")).alias("gap"))


S_CONTACTS = "with " + OPEN + " select i, j, round(gap, 6) as gap from e"


def q_periodic_contacts(spark, sf_dir):
    return C.cell_contacts(embedding_particles(spark, sf_dir), BOX, THRESHOLD).select("i", "j", "sx", "sy", "sz", _r(F.col("gap")).alias("gap"))


S_PERIODIC_CONTACTS = "with " + PERIODIC + " select i, j, sx, sy, sz, round(gap, 6) as gap from e"


def q_contact_parity(spark, sf_dir):
    """Contacts that only one of both joins finds, by flags of the axes: none."""
    p, rows = embedding_particles(spark, sf_dir), []
    for flags in ((False, False, False), (True, False, True), (True, True, True)):
        d = Domain(8.0, flags)
        rows.append((C.different_contacts(C.cell_contacts(p, d, THRESHOLD), C.theta_contacts(p, d, THRESHOLD)), "".join("T" if f else "F" for f in flags)))
    return spark.createDataFrame(rows, "different long, periodic string")


S_PARITY = "select unnest(['FFF', 'TFT', 'TTT']) as periodic, 0::bigint as different"


def q_contact_degree(spark, sf_dir):
    return D.degrees(embedding_particles(spark, sf_dir), BOX, THRESHOLD).select("idx", "degree", "overlaps", _r(F.col("widest")).alias("widest"))


S_DEGREE = "with " + PERIODIC + " select idx, count(*) as degree, count(*) filter (gap = 0) as overlaps, round(max(gap), 6) as widest from (select i as idx, gap from e union all select j, gap from e) group by idx"


def q_periodic_distance(spark, sf_dir):
    """The nearest image of each touching pair: the least gap, then the least steps; and how many images touch."""
    near = C.nearest_contacts(embedding_particles(spark, sf_dir), BOX, THRESHOLD)
    return near.select("i", "j", _r(F.col("gap")).alias("gap"), "sx", "sy", "sz", "images")


S_DISTANCE = "with " + PERIODIC + ", o as (select *, row_number() over (partition by i, j order by round(gap, 6), sx, sy, sz) as k, count(*) over (partition by i, j) as images from e) select i, j, round(gap, 6) as gap, sx, sy, sz, images from o where k = 1"


def q_search_counters(spark, sf_dir):
    """Pairs whose boxes touch and contacts, by both joins; all pairs are candidates and evaluations of the second one."""
    p, out = embedding_particles(spark, sf_dir), None
    for method in ("cell_list", "bruteforce"):
        c = C.search_counters(p, WIDE, THRESHOLD, method)
        all_pairs = method == "bruteforce"
        part = c.select(F.lit(method).alias("method"), F.col("candidates" if all_pairs else "boxes").alias("candidates_at_least"), "boxes", "evaluations", "contacts", (F.col("candidates") >= F.col("boxes")).alias("ordered"))
        out = part if out is None else out.unionByName(part)
    return out


S_COUNTERS = "with " + PARTICLES + """, q as (select greatest(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) - a.r - b.r, 0) <= 0.1 + 1e-9 as touch,
 greatest(abs(a.cx - b.cx), abs(a.cy - b.cy), abs(a.cz - b.cz)) <= a.r + b.r + 0.1 + 1e-9 as box from p a join p b on a.idx < b.idx),
 c as (select count(*) as n, count(*) filter (box) as boxes, count(*) filter (touch) as contacts from q)
select 'cell_list' as method, boxes as candidates_at_least, boxes, boxes as evaluations, contacts, true as ordered from c union all select 'bruteforce', n, boxes, n, contacts, true from c"""


def q_face_gaps(spark, sf_dir):
    e = C.electrodes(embedding_particles(spark, sf_dir), Domain(8.0, (False, True, False)), 0, THRESHOLD)
    return e.select("idx", _r(F.col("lower_gap")).alias("lower_gap"), _r(F.col("upper_gap")).alias("upper_gap"), "at_lower", "at_upper")


S_FACES = "with " + PARTICLES + """, g as (select idx, greatest(sqrt((cx + 4) ** 2 + greatest(abs(cz) - 4, 0) ** 2) - r, 0) as lo, greatest(sqrt((cx - 4) ** 2 + greatest(abs(cz) - 4, 0) ** 2) - r, 0) as up from p)
select idx, round(lo, 6) as lower_gap, round(up, 6) as upper_gap, lo <= 0.1 + 1e-9 as at_lower, up <= 0.1 + 1e-9 as at_upper from g"""


# ---------------------------------------------------------------- graphs


def q_components(spark, sf_dir):
    p = embedding_particles(spark, sf_dir)
    return P.components(p, C.cell_contacts(p, WIDE, THRESHOLD))


S_COMPONENTS = "with recursive " + OPEN + REACH + " select idx, component from comp"


def q_spanning_components(spark, sf_dir):
    return P.spanning_components(embedding_particles(spark, sf_dir), Domain(8.0), THRESHOLD)


S_SPANNING = "with recursive " + OPEN + REACH + """, f as (select idx, greatest(sqrt((cx + 4) ** 2 + greatest(abs(cy) - 4, 0) ** 2 + greatest(abs(cz) - 4, 0) ** 2) - r, 0) <= 0.1 + 1e-9 as lo,
 greatest(sqrt((cx - 4) ** 2 + greatest(abs(cy) - 4, 0) ** 2 + greatest(abs(cz) - 4, 0) ** 2) - r, 0) <= 0.1 + 1e-9 as up from p)
select component, count(*) as size, bool_or(lo) as at_lower, bool_or(up) as at_upper, bool_or(lo) and bool_or(up) as spans from comp join f using (idx) group by component"""


def q_spanning_depth(spark, sf_dir):
    depth = P.spanning_depth(embedding_particles(spark, sf_dir), Domain(8.0), THRESHOLD)
    return spark.createDataFrame([(depth,)], "particles_on_path int")


S_DEPTH = "with recursive " + OPEN + """, f as (select idx, greatest(sqrt((cx + 4) ** 2 + greatest(abs(cy) - 4, 0) ** 2 + greatest(abs(cz) - 4, 0) ** 2) - r, 0) <= 0.1 + 1e-9 as lo,
 greatest(sqrt((cx - 4) ** 2 + greatest(abs(cy) - 4, 0) ** 2 + greatest(abs(cz) - 4, 0) ** 2) - r, 0) <= 0.1 + 1e-9 as up from p), b as (select i, j from e union all select j, i from e),
 go as (select idx, 1 as depth from f where lo union select b.j, depth + 1 from go join b on go.idx = b.i where depth < 40) select min(depth)::int as particles_on_path from go join f using (idx) where up"""


def q_logical_nodes(spark, sf_dir):
    p = embedding_particles(spark, sf_dir).join(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("idx"), "label"), "idx")
    return P.logical_nodes(p.withColumn("parent_id", F.when(F.col("label") % 3 != 0, F.col("label").cast("string"))), large=True).select("idx", F.col("node").cast("long").alias("node"), F.col("first").cast("long").alias("first"))


S_NODES = "with a as (select vec_id::int as idx, case when label % 3 <> 0 then 'p' || label else 'i' || vec_id end as k from embeddings), b as (select idx, min(idx) over (partition by k) as first from a) select idx, dense_rank() over (order by first) - 1 as node, first::bigint as first from b"


def q_percolation(spark, sf_dir):
    """Face to face along each axis of one realization of any size, with the path's length."""
    out = None
    for k, found in enumerate(L.face_percolations(embedding_particles(spark, sf_dir), Domain(8.0), THRESHOLD, (0, 1, 2))):
        part = found.select(F.lit("xyz"[k]).alias("axis"), "percolates", "n_components", F.size("path").cast("long").alias("path_length"))
        out = part if out is None else out.unionByName(part)
    return out


def _percolation_sql() -> str:
    parts, rest = [], []
    for a, others in (("x", "yz"), ("y", "xz"), ("z", "xy")):
        at = lambda sign, a=a, others=others: f"greatest(sqrt((c{a} {sign} 4) ** 2 + " + " + ".join(f"greatest(abs(c{o}) - 4, 0) ** 2" for o in others) + ") - r, 0) <= 0.1 + 1e-9"
        parts.append(f"f{a} as (select idx, {at('+')} as lo, {at('-')} as up from p), g{a} as (select idx, 1 as depth from f{a} where lo union select b.j, depth + 1 from g{a} join b on g{a}.idx = b.i where depth < 40)")
        rest.append(f"select '{a}' as axis, count(*) > 0 as percolates, (select count(distinct component) from comp) as n_components, coalesce(min(depth), 0)::bigint as path_length from g{a} join f{a} using (idx) where up")
    return "with recursive " + OPEN + REACH + ", " + ", ".join(parts) + " " + " union all ".join(rest)


S_PERCOLATION = _percolation_sql()


def q_winding(spark, sf_dir):
    """Windings of one realization of any size, along each periodic axis."""
    out = None
    for k, found in enumerate(L.winding_percolations(embedding_particles(spark, sf_dir), BOX, THRESHOLD, (0, 1, 2))):
        part = found.select(F.lit("xyz"[k]).alias("axis"), "percolates", "n_components")
        out = part if out is None else out.unionByName(part)
    return out


def _winding_sql() -> str:
    """A component winds if a walk from its first particle comes to some particle in two cells; walks within three cells suffice here."""
    walks, rest = [], []
    for a in "xyz":
        walks.append(
            f"step{a} as (select i, j, s{a} as s from e union select j, i, -s{a} from e), w{a} as (select distinct component::int as idx, 0::bigint as off from comp union select t.j, off + t.s from w{a} w join step{a} t on t.i = w.idx where abs(off + t.s) <= 3)"
        )
        rest.append(f"select '{a}' as axis, (select count(*) > 0 from (select idx from w{a} group by idx having count(distinct off) > 1)) as percolates, (select count(distinct component) from comp) as n_components")
    return "with recursive " + PERIODIC + REACH + ", " + ", ".join(walks) + " " + " union all ".join(rest)


S_WINDING = _winding_sql()


# ---------------------------------------------------------------- transport


def q_conductances(spark, sf_dir):
    c = C.cell_contacts(embedding_particles(spark, sf_dir), WIDE, THRESHOLD)
    g = F.col("gap")
    return c.select("i", "j", G.constant_conductance(g, 2.0, 0.05).alias("constant"), _r(G.tunnelling_conductance(g, 1.5, 0.2, 0.08), 9).alias("tunnelling"))


S_CONDUCTANCES = "with " + OPEN + " select i, j, case when gap <= 0.05 then 2.0 else 0.0 end::double as constant, round(case when gap <= 0.08 then exp(ln(1.5::double) - 2 * (gap / 0.2::double)) else 0.0 end, 9)::double as tunnelling from e"


def q_series_parallel(spark, sf_dir):
    """Lines of an order as resistors of their quantity, in a row and side by side, both solved by Kirchhoff's laws."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = _table(spark, sf_dir, "lineitem").where("l_quantity > 0").withColumn("k", F.row_number().over(order)).withColumn("n", F.max("k").over(Window.partitionBy("l_orderkey")))
    at = lambda k: F.when(k == 0, F.col("n") - 1).when(k == F.col("n"), F.col("n")).otherwise(k - 1)
    one = rows.select(F.col("l_orderkey").alias("realization_id"), F.lit("series").alias("axis"), (F.col("n") - 1).alias("n_nodes"), at(F.col("k") - 1).alias("a"), at(F.col("k")).alias("b"), F.col("l_quantity").alias("g"))
    two = rows.select(F.col("l_orderkey").alias("realization_id"), F.lit("parallel").alias("axis"), F.lit(0).alias("n_nodes"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.col("l_quantity").alias("g"))
    s = T.solve(one.unionByName(two)).withColumn("resistors", F.size("currents").cast("long"))
    return s.groupBy(F.col("realization_id").alias("l_orderkey")).agg(*[_r(F.max(F.when(F.col("axis") == k, F.col("conductance")))).alias(k) for k in ("series", "parallel")], F.max("resistors").alias("resistors"))


S_SERIES = "select l_orderkey, round(1 / sum(1 / l_quantity), 6) as series, round(sum(l_quantity), 6) as parallel, count(*) as resistors from lineitem where l_quantity > 0 group by 1"


def q_series_networks(spark, sf_dir):
    """The same rows solved as networks by Kirchhoff's laws: node k - 1 to k for the k-th line of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = _table(spark, sf_dir, "lineitem").where("l_quantity > 0").withColumn("k", F.row_number().over(order))
    n = F.max("k").over(Window.partitionBy("l_orderkey"))
    # inner nodes 0 .. n - 2; the faces are n - 1 and n
    at = lambda k: F.when(k == 0, F.col("n") - 1).when(k == F.col("n"), F.col("n")).otherwise(k - 1)
    net = rows.withColumn("n", n).select(F.col("l_orderkey").alias("realization_id"), F.lit("x").alias("axis"), (F.col("n") - 1).alias("n_nodes"), at(F.col("k") - 1).alias("a"), at(F.col("k")).alias("b"), F.col("l_quantity").alias("g"))
    return T.solve(net).select(F.col("realization_id").alias("l_orderkey"), _r(F.col("conductance")).alias("series"))


S_SERIES_NETWORKS = "select l_orderkey, round(1 / sum(1 / l_quantity), 6) as series from lineitem where l_quantity > 0 group by 1"


def q_directional_sigma(spark, sf_dir):
    s = T.conductivity(embedding_particles(spark, sf_dir), Domain(8.0, (True, True, True)), T.Law(1.0, 0.1, 0.2), ("x", "y", "z"))
    return T.directional(s).select("realization_id", *[_r(F.col(f"sigma_{a}"), 9).alias(f"sigma_{a}") for a in "xyz"])


# ---------------------------------------------------------------- statistics


def _trials(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 97).alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))


def q_binomial_estimate(spark, sf_dir):
    k, n = F.col("k"), F.col("n")
    low, high = stats.wilson(k, n)
    return _trials(spark, sf_dir).select("grp", "n", "k", _r(k / n).alias("p"), _r(F.sqrt(k / n * (1 - k / n) / n)).alias("se"), _r(low).alias("low"), _r(high).alias("high"))


S_BINOMIAL = """with a as (select user_id % 97 as grp, count(*) as n, count(*) filter (value > 50) as k from events group by 1), b as (select *, k::double / n as p, 1.959963984540054::double as z from a),
 c as (select *, (p + z * z / (2 * n)) / (1 + z * z / n) as m, z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0::double * n * n)) as h from b)
select grp, n, k, round(p, 6) as p, round(sqrt(p * (1 - p) / n), 6) as se, round(case when k = 0 then 0 else m - h end, 6) as low, round(case when k = n then 1 else m + h end, 6) as high from c"""


def q_clopper_pearson(spark, sf_dir):
    """Exact intervals of small samples; SQL holds the binomial tails at their ends against the missing confidence."""
    small = _trials(spark, sf_dir).select("grp", (F.col("n") % 20 + 1).alias("n"), F.least(F.col("k") % 21, F.col("n") % 20 + 1).alias("k"))
    t = small.withColumn("ci", stats.clopper_pearson()("k", "n"))
    low, high = F.col("ci.low"), F.col("ci.high")
    return t.select("grp", "n", "k", _r(_tail(F.col("k"), F.col("n"), low, True), 9).alias("upper_tail"), _r(_tail(F.col("k"), F.col("n"), high, False), 9).alias("lower_tail"))


def _tail(k, n, p, upper: bool):
    """P(X >= k) or P(X <= k) of a binomial, by its sum."""
    fact = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int")), F.lit(1.0), lambda x, i: x * i)
    term = lambda i: fact(n) / (fact(i) * fact(n - i)) * F.pow(p, i.cast("double")) * F.pow(1 - p, (n - i).cast("double"))
    ends = (k, n) if upper else (F.lit(0).cast("long"), k)
    return F.aggregate(F.sequence(*ends), F.lit(0.0), lambda x, i: x + term(i))


S_CLOPPER = """with a as (select user_id % 97 as grp, count(*) as n0, count(*) filter (value > 50) as k0 from events group by 1), b as (select grp, n0 % 20 + 1 as n, least(k0 % 21, n0 % 20 + 1) as k from a)
select grp, n, k, case when k = 0 then 1.0 else 0.025 end::double as upper_tail, case when k = n then 1.0 else 0.025 end::double as lower_tail from b"""


def q_isotonic(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    grid = e.groupBy((F.dayofmonth("ts") * 24 + F.hour("ts")).alias("slot")).agg(F.avg("value").alias("value"), F.count("*").cast("double").alias("weight"))
    return stats.isotonic(grid, "slot", "value", "weight").select("slot", _r(F.col("fitted")).alias("fitted"))


S_ISOTONIC = """with a as (select day(ts) * 24 + hour(ts) as slot, avg(value) as v, count(*)::double as w from events group by 1), b as (select slot, v * w as s0, w as w0, sum(v * w) over (order by slot) as s, sum(w) over (order by slot) as c from a),
 m as (select x.slot as i, y.slot as j, (y.s - x.s + x.s0) / (y.c - x.c + x.w0) as m from b x join b y on x.slot <= y.slot),
 n as (select i, j, min(m) over (partition by i order by j desc) as low from m)
select j::int as slot, round(max(low), 6) as fitted from n group by j"""


def q_mean_se(spark, sf_dir):
    """Values of a kind of event as samples of an axis."""
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("axis"), F.col("event_id").alias("realization_id"), F.col("value").alias("sigma"))
    return W.summarize(e, samples=False).select(F.col("axis").alias("event_type"), F.col("trials").alias("n"), _r(F.col("mean")).alias("mean"), _r(F.col("standard_error")).alias("se"), F.col("conducting").alias("positive"))


S_MEAN = "select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value) / sqrt(count(*)), 6) as se, count(*) filter (value > 0) as positive from events group by 1"


def q_quartiles(spark, sf_dir):
    return stats.quartiles(_table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", *[_r(F.col(n)).alias(n) for n in ("q1", "median", "q3")])


S_QUARTILES = "select event_type, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q3 from events group by 1"


def q_nested_search(spark, sf_dir):
    """An order's lines join its faces from some prefix on: the first count of a grid at which it does, and how many orders do.

    Line k of an order is a link from the lower face to the upper one of age k if its discount is above 0.07.
    """
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("d"))
    n = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    rows = lines.withColumn("n", n).select(F.col("l_orderkey").alias("realization_id"), F.col("n").alias("n_nodes"), (F.col("l_linenumber") - 1).alias("x"), "n", (F.col("d") > 0.07).alias("hit"))
    sides = [rows.select("realization_id", "n_nodes", F.when(F.col("hit"), F.col("x")).alias("a"), F.when(F.col("hit"), F.col("n") + k).alias("b")) for k in (0, 1)]
    first = P.nested_first_counts(sides[0].unionByName(sides[1]), [1, 2, 4, 7])
    return first.groupBy(F.coalesce("first", F.lit(-1)).cast("long").alias("first")).agg(F.count("*").alias("orders"))


S_NESTED = """with a as (select l_orderkey, min(case when l_discount > 0.07 then l_linenumber end) as k from lineitem group by 1)
select case when k <= 1 then 0 when k <= 2 then 1 when k <= 4 then 2 when k <= 7 then 3 else -1 end::bigint as first, count(*) as orders from a group by 1"""


def q_mixture_candidates(spark, sf_dir):
    """All mixtures of three sizes with bounds, cheapest first, and the cheapest that reaches each brand's mean price."""
    need = _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg(F.col("p_retailprice")).alias("need"))
    pops = [Population(0.5, 0, None, 1.0), Population(0.3, 0, 2.0, 2.0), Population(1.0, 0, None, 0.5)]
    c = W.candidates(spark, pops, [(0, 9), (0, 9), (0, 9)]).select("counts", _r(F.col("cost"), 9).alias("cost"), (F.col("counts")[0] * 90 + F.col("counts")[1] * 110 + F.col("counts")[2] * 200).alias("gain"))
    fit = need.join(c, F.col("gain") >= F.col("need")).groupBy("p_brand").agg(F.min(F.struct("cost", "counts")).alias("m"))
    return fit.select("p_brand", "m.cost", *[F.col("m.counts")[k].alias(f"n{k}") for k in range(3)])


S_MIXTURE = """with need as (select p_brand, avg(p_retailprice) as need from part group by 1), n as (select unnest(range(10)) as n),
 c as (select a.n as n0, b.n as n1, c.n as n2, round(a.n * (4.0 / 3 * pi() * 0.125) + b.n * (pi() * 0.3::double * 0.3::double * 2 * 2) + c.n * (4.0 / 3 * pi() * 0.5), 9) as cost, a.n * 90 + b.n * 110 + c.n * 200 as gain from n a, n b, n c),
 o as (select p_brand, cost, n0, n1, n2, row_number() over (partition by p_brand order by cost, n0, n1, n2) as k from need join c on gain >= need) select p_brand, cost, n0, n1, n2 from o where k = 1"""


# ---------------------------------------------------------------- workflows


def q_mc_probability(spark, sf_dir):
    """A seeded run whose successes are recorded."""
    model = W.Model(Domain(10.0, (False, True, True)), 0.2)
    r = W.estimate(W.successes(spark, model, [Population(1.0, 70)], 160, 314159, (1, 0)), 160, 0.975)
    return spark.createDataFrame([(r["successes"], r["trials"], r["probability"], round(r["exact_low"], 9), round(r["exact_high"], 9), round(r["lower_bound"], 9), round(r["upper_bound"], 9))], "successes long, trials long, probability double, exact_low double, exact_high double, lower_bound double, upper_bound double")


S_PROBABILITY = "select 97::bigint as successes, 160::bigint as trials, 97 / 160.0::double as probability, round(0.5148766235291948::double, 9) as exact_low, round(0.6925569221422904::double, 9) as exact_high, round(0.5260253753741739::double, 9) as lower_bound, round(0.6824621318191664::double, 9) as upper_bound"


#: The lines of an order are spheres along x in a box of 10, at a fifth of their quantity.
LINE_BOX = Domain(10.0, (False, False, False), (5.0, 0.0, 0.0))
LINES = """l as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as idx, l_quantity / 5 as x from lineitem where l_quantity is not null)"""
_JOINED = "min(x) - 1.0 <= 0.5 and 10 - max(x) - 1.0 <= 0.5 and coalesce(max(x - px), 0) - 2.0 <= 0.5"


def _line_particles(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = _table(spark, sf_dir, "lineitem").where("l_quantity is not null").select(
        F.col("l_orderkey").cast("long").alias("realization_id"), (F.row_number().over(order) - 1).alias("idx"), (F.col("l_quantity") / 5).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz"), F.lit(1.0).alias("radius")
    )
    return checked(rows)


def q_order_percolation(spark, sf_dir):
    """How likely the lines of an order join both faces of their box, by priority of the order."""
    groups = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("realization_id"), "o_orderpriority")
    found = W.probabilities(_line_particles(spark, sf_dir), W.Model(LINE_BOX, 0.5), groups, ["o_orderpriority"])
    return found.select("o_orderpriority", "successes", "trials", *[_r(F.col(c), 9).alias(c) for c in ("probability", "wilson_low", "wilson_high")])


S_ORDERS = "with " + LINES + ", g as (select o, x, lag(x) over (partition by o order by x) as px from l), s as (select o, " + _JOINED + """ as ok from g group by o),
c as (select o_orderpriority, count(*) filter (coalesce(ok, false)) as k, count(*) as n from orders left join s on o_orderkey = o group by 1), z as (select *, k / n::double as p, 1.959963984540054 as q from c)
select o_orderpriority, k as successes, n as trials, round(p, 9) as probability,
 round(case when k = 0 then 0 else (p + q * q / (2 * n)) / (1 + q * q / n) - q / (1 + q * q / n) * sqrt(p * (1 - p) / n + q * q / (4 * n * n)) end, 9) as wilson_low,
 round(case when k = n then 1 else (p + q * q / (2 * n)) / (1 + q * q / n) + q / (1 + q * q / n) * sqrt(p * (1 - p) / n + q * q / (4 * n * n)) end, 9) as wilson_high from z"""


def q_order_loading(spark, sf_dir):
    """The least number of first lines from which on a twentieth of the orders join: searched in orders of odd keys, certified in those of even ones."""
    p = _line_particles(spark, sf_dir)
    odd = F.col("realization_id") % 2 == 1
    r = W.critical_prefix(p.where(odd), p.where(~odd), W.Model(LINE_BOX, 0.5), [1, 2, 3, 4, 5, 6, 7], target=0.05)
    rows = [(r["status"], r["critical_count"], phase, s["count"], s["successes"], s["trials"]) for phase in ("search", "certification") for s in r[phase]]
    return spark.createDataFrame(rows, "status string, critical_count long, phase string, count long, successes long, trials long")


#: A bound of an exact interval lies beyond the target if the binomial tail at the target is small enough.
S_LOADING = "with " + LINES + """, c as (select unnest([1, 2, 3, 4, 5, 6, 7]) as c), g as (select o, c, x, lag(x) over (partition by o, c order by x) as px from l join c on idx < c),
s as (select o % 2 as odd, o, c, """ + _JOINED + """ as ok from g group by o, c), h as (select odd, c, count(*) filter (ok) as k, count(*) as n from s group by 1, 2),
f as (select min(c) filter (odd = 1 and k / n::double >= 0.05) as crit from h),
t as (select c, k, n from h, f where odd = 0 and (c = coalesce(crit, 7) or (crit > 1 and c = crit - 1))),
m as (select count(*) as m from t),
tails as (select c, sum(p) filter (i >= k) as up, sum(p) filter (i <= k) as down from (select c, k, n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)) as p from t, unnest(range(n + 1)) u(i)) group by c),
d as (select coalesce(bool_and(up <= 0.05 / m) filter (c = crit), false) and coalesce(bool_and(down < 0.05 / m) filter (c < crit), true) as sure, coalesce(bool_and(down < 0.05 / m), false) as below from tails, f, m)
select case when crit is null then case when below then 'NO_CROSSING' else 'INCONCLUSIVE' end when sure then 'CERTIFIED' else 'INCONCLUSIVE' end as status, crit::bigint as critical_count, phase, c::bigint as count, k as successes, n as trials
from (select 'search' as phase, c, k, n from h where odd = 1 union all select 'certification', c, k, n from t), f, d"""


def q_critical_loading(spark, sf_dir):
    """The recorded search and certification over seven counts."""
    model = W.Model(Domain(10.0, (False, True, True)), 0.2)
    r = W.critical_loading(spark, model, Population(1.0, 0), list(range(40, 101, 10)), target=0.8, search_trials=100, certification_trials=160, seed=314159)
    rows = [(r["status"], r["critical_count"], phase, s["count"], s["successes"]) for phase in ("search", "certification") for s in r[phase]]
    return spark.createDataFrame(rows, "status string, critical_count long, phase string, count long, successes long")


S_CRITICAL = """select 'INCONCLUSIVE' as status, 80::bigint as critical_count, phase, count::bigint as count, successes::bigint as successes
from (values ('search', 40, 4), ('search', 50, 14), ('search', 60, 34), ('search', 70, 62), ('search', 80, 85), ('search', 90, 91), ('search', 100, 97), ('certification', 70, 97), ('certification', 80, 127)) t(phase, count, successes)"""


def q_optimize_mixture(spark, sf_dir):
    model = W.Model(Domain(6.0), 0.2)
    r = W.optimize_mixture(spark, model, [Population(1.0, 0, None, 1.0), Population(0.4, 0, 3.0, 2.0)], [(8, 10), (0, 1)], 0.2, 20, 40, seed=7)
    return spark.createDataFrame([{"status": r["status"], "phase": k, "counts": s["counts"], "cost": s["cost"], "successes": s["successes"]} for k in ("screening", "certification") for s in r[k]])


def q_conductivity_mc(spark, sf_dir):
    s = W.conductivity_samples(spark, Domain(4.0, (True, True, True)), [Population(0.75, 8), Population(0.4, 6, 2.0)], T.Law(1.0, 0.4, 0.2), trials=10, seed=2026)
    return W.summarize(s).select("axis", _r(F.col("mean"), 9).alias("mean"), _r(F.col("standard_error"), 9).alias("standard_error"), "conducting", "trials")


def q_link_fits(spark, sf_dir):
    """A logistic curve of each brand: how likely the size of a part exceeds a threshold that its key draws."""
    rows = _table(spark, sf_dir, "part").select("p_brand", "p_size", (F.col("p_partkey") * 37 % 50 < F.col("p_size")).cast("int").alias("hit"), F.lit(1).alias("one"))
    fits = stats.fit_links(rows, ["p_brand"], "p_size", "hit", "one")
    slope = F.col("slope") / F.col("x_scale")
    return fits.select("p_brand", F.col("trials").cast("long").alias("trials"), _r(F.col("intercept") - slope * F.col("x_center"), 5).alias("intercept"), _r(slope, 5).alias("slope"), _r(F.col("log_likelihood"), 5).alias("log_likelihood"), "converged")


def _newton_sql(rounds: int) -> str:
    """Newton's steps of logistic fits by brand, one table expression a step, on sizes moved and scaled to about -1 to 1."""
    steps = ["w0 as (select p_brand, 0.0::double as a, 0.0::double as b from d group by 1)"]
    for k in range(1, rounds + 1):
        steps.append(f"""s{k} as (select d.p_brand, a, b, sum(y - p) as g0, sum((y - p) * x) as g1, sum(p * (1 - p)) as h0, sum(p * (1 - p) * x) as h1, sum(p * (1 - p) * x * x) as h2
 from (select d.*, a, b, 1 / (1 + exp(-a - b * x)) as p from d join w{k - 1} using (p_brand)) d group by 1, 2, 3),
w{k} as (select p_brand, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) as a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) as b from s{k})""")
    return ", ".join(steps)


S_LINKS = "with d as (select p_brand, (p_size - 25) / 25.0::double as x, case when p_partkey * 37 % 50 < p_size then 1.0 else 0.0 end::double as y from part), " + _newton_sql(12) + """
select p_brand, count(*) as trials, round(any_value(a - b), 5) as intercept, round(any_value(b / 25), 5) as slope, round(sum(case when y > 0 then -ln(1 + exp(-a - b * x)) else -ln(1 + exp(a + b * x)) end), 5) as log_likelihood, true as converged
from d join w12 using (p_brand) group by 1"""


def q_exact_sums(spark, sf_dir):
    """By supplier: huge prices that cancel and tiny quantities that stay, exactly and in plain order of rows."""
    rows = _table(spark, sf_dir, "lineitem")
    x = F.explode(F.array(F.col("l_extendedprice") * 1e12, F.col("l_quantity") / 1048576, -F.col("l_extendedprice") * 1e12)).alias("x")
    return exact_sums(rows.select("l_suppkey", x), ["l_suppkey"], {"total": F.col("x")})


S_EXACT = "select l_suppkey, sum(l_quantity) / 1048576 as total from lineitem group by 1"


def q_oblique_cylinders(spark, sf_dir):
    """Slender cylinders of each part above one along x, at an angle, through the contact join: SQL has the axes' distance."""
    part = _table(spark, sf_dir, "part").where("p_size is not null and p_retailprice is not null")
    angle = F.lit(0.001) + F.col("p_size") / 100
    side = lambda k, u, z, length, r: part.select(
        F.col("p_partkey").cast("long").alias("realization_id"), F.lit(k).alias("idx"), F.lit("cylinder").alias("shape"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), z.alias("cz"),
        *[v.alias(f"u{a}") for v, a in zip(u, "xyz", strict=True)], F.lit(length).alias("length"), r.alias("radius"),
    )
    z = F.col("p_retailprice") / 1000
    rows = side(0, (F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(0.0), 1e6, F.lit(0.25)).unionByName(side(1, (F.cos(angle), F.sin(angle), F.lit(0.0)), z, 1e5, F.col("p_size") / 100))
    found = C.cell_contacts(checked(rows), Domain(4e6), 1.0)
    return found.select(F.col("realization_id").alias("p_partkey"), _r(F.col("gap")).alias("gap"))


S_OBLIQUE = "select p_partkey, round(greatest(p_retailprice / 1000 - 0.25 - p_size / 100, 0), 6) as gap from part where p_retailprice / 1000 - 0.25 - p_size / 100 <= 1.0 + 1e-6"


def q_periodic_contacts_sql(spark, sf_dir):
    """The periodic contacts in SQL: images by the table function, an equi-join on cells of the greatest reach, gaps by the session's functions."""
    register(spark)
    embedding_particles(spark, sf_dir).createOrReplaceTempView("porespan_particles")
    return spark.sql("""
      with p as (select idx, radius, cx, cy, cz, lattice_step(cx, -4D, 8D) as qx, lattice_step(cy, -4D, 8D) as qy, lattice_step(cz, -4D, 8D) as qz from porespan_particles),
      w as (select *, wrapped(cx, -4D, 8D) as x, wrapped(cy, -4D, 8D) as y, wrapped(cz, -4D, 8D) as z from p),
      near as (select w.*, k.*, x + kx * 8D as ix, y + ky * 8D as iy, z + kz * 8D as iz
               from w, lateral lattice_images(x, radius, -4D, 8D, y, radius, -4D, 8D, z, radius, -4D, 8D, 0.9D) k),
      cells as (select *, floor(x / 1.75D) as gx, floor(y / 1.75D) as gy, floor(z / 1.75D) as gz from w),
      around as (select near.*, floor(ix / 1.75D) + a.d as gx, floor(iy / 1.75D) + b.d as gy, floor(iz / 1.75D) + c.d as gz
                 from near lateral view explode(array(-1, 0, 1)) a as d lateral view explode(array(-1, 0, 1)) b as d lateral view explode(array(-1, 0, 1)) c as d),
      pairs as (select i.idx as i, j.idx as j, j.kx + j.qx - i.qx as sx, j.ky + j.qy - i.qy as sy, j.kz + j.qz - i.qz as sz, sphere_gap(i.x, i.y, i.z, i.radius, j.ix, j.iy, j.iz, j.radius) as gap
                from cells i join around j on i.gx = j.gx and i.gy = j.gy and i.gz = j.gz and i.idx < j.idx)
      select i, j, sx, sy, sz, round(gap, 6) + 0D as gap from pairs where gap <= 0.1D + contact_tolerance(1D)""")


def q_validation(spark, sf_dir):
    from porespan.validate import checks

    return spark.createDataFrame([(r["name"], r["passed"]) for r in checks(spark)], "name string, passed boolean")


S_VALIDATION = "select unnest(['parallel cylinders', 'exact interval', 'isotonic', 'series circuit', 'chain', 'broken chain', 'winding', 'contact parity']) as name, true as passed"


_SQL = {
    q_periodic_coordinates: S_PERIODIC, q_body_gaps: S_BODY, q_volumes: S_VOLUMES, q_count_for_fraction: S_COUNT, q_contacts: S_CONTACTS, q_contacts_bruteforce: S_CONTACTS, q_periodic_contacts: S_PERIODIC_CONTACTS,
    q_contact_parity: S_PARITY, q_contact_degree: S_DEGREE, q_periodic_distance: S_DISTANCE, q_search_counters: S_COUNTERS, q_face_gaps: S_FACES, q_components: S_COMPONENTS, q_spanning_components: S_SPANNING,
    q_spanning_depth: S_DEPTH, q_logical_nodes: S_NODES, q_conductances: S_CONDUCTANCES, q_series_parallel: S_SERIES, q_series_networks: S_SERIES_NETWORKS, q_binomial_estimate: S_BINOMIAL, q_isotonic: S_ISOTONIC,
    q_mean_se: S_MEAN, q_quartiles: S_QUARTILES, q_nested_search: S_NESTED, q_mixture_candidates: S_MIXTURE, q_percolation: S_PERCOLATION, q_winding: S_WINDING, q_clopper_pearson: S_CLOPPER,
    q_mc_probability: S_PROBABILITY, q_critical_loading: S_CRITICAL, q_cylinder_gaps: S_CYLINDERS, q_segment_gaps: S_SEGMENTS, q_validation: S_VALIDATION,
    q_order_percolation: S_ORDERS, q_order_loading: S_LOADING, q_link_fits: S_LINKS, q_exact_sums: S_EXACT, q_oblique_cylinders: S_OBLIQUE, q_periodic_contacts_sql: S_PERIODIC_CONTACTS,
}
_ROWS_ONLY = (q_directional_sigma, q_optimize_mixture, q_conductivity_mc)


def _name(f) -> str:
    return f.__name__.removeprefix("q_")


def queries() -> dict:
    return {_name(f): f for f in (*_SQL, *_ROWS_ONLY)}


def oracle_sql() -> dict[str, str]:
    return {_name(f): sql for f, sql in _SQL.items()}
