"""Percolation of one realization of any size: everything is a join or a grouped minimum, and each round is written.

Nodes are named by their first particle. ``percolation.analyze_percolation(large=True)`` comes here; grouped maps over many small
realizations stay there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porespan.operators import contacts as C
from porespan.operators import dense as D
from porespan.operators.graph import connected_components
from porespan.policy import Domain, Policy, SetupError, TrialError
from porespan.session import discard, materialize

STEPS = ("sx", "sy", "sz")


def nodes_of(particles: DataFrame) -> DataFrame:
    """``(idx, node)``: the least particle of a parent's fragments, or the particle itself."""
    first = particles.where("parent_id is not null").groupBy("parent_id").agg(F.min("idx").alias("__first"))
    return particles.select("idx", "parent_id").join(first, "parent_id", "left").select("idx", F.coalesce("__first", "idx").cast("long").alias("node"))


def _links(contacts: DataFrame, nodes: DataFrame, loops: bool = False) -> DataFrame:
    """``contacts`` with the nodes ``a`` and ``b`` of both particles, where they differ; with ``loops`` everywhere."""
    a, b = nodes.select(F.col("idx").alias("i"), F.col("node").alias("a")), nodes.select(F.col("idx").alias("j"), F.col("node").alias("b"))
    return contacts.join(a, "i").join(b, "j").where(F.lit(loops) | (F.col("a") != F.col("b")))


def breadth_first(links: DataFrame, start: DataFrame, goal: DataFrame, max_depth: int = 10_000) -> list[int] | None:
    """Nodes of a shortest path over ``links (a, b)`` from ``start`` to ``goal (node)``; of equal ones that of least nodes, level by level.

    A level's neighbours lie in it, in the one before or in the next, so each round looks at two levels only.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    levels = [materialize(start.select("node", F.lit(None).cast("long").alias("parent")).distinct(), "level")]
    try:
        for _ in range(max_depth):
            met = levels[-1].join(goal, "node", "left_semi").agg(F.min("node")).first()[0]
            if met is not None:
                path = [met]
                for level in reversed(levels[1:]):
                    path.append(level.where(F.col("node") == path[-1]).first()["parent"])
                return path[::-1]
            following = both.join(levels[-1].select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
            for level in levels[-2:]:
                following = following.join(level.select("node"), "node", "left_anti")
            levels.append(materialize(following, "level"))
            if not levels[-1].limit(1).count():
                return None
    finally:
        discard(both, *levels)
    raise TrialError("path longer than max_depth")


def weighted_components(links: DataFrame, axes: tuple[int, ...], max_rounds: int = 60) -> tuple[DataFrame, list[DataFrame]]:
    """(``node, component``; for each axis ``component, loop`` of those with a loop that winds along it, and its steps) of ``links (a, b, sx, sy, sz)``: b lies at a plus the steps.

    Alternating stars as in ``connected_components``, with steps along. Edges only change by a detour over others, so loops keep their winding;
    where two edges between the same nodes differ along the axis, or an edge leads back to its node with a step, the node is marked.
    """

    def oriented(edges: DataFrame) -> DataFrame:
        up = F.col("u") > F.col("v")
        return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), *[F.when(up, F.col(s)).otherwise(-F.col(s)).alias(s) for s in STEPS])

    def through(edges: DataFrame, least: DataFrame) -> DataFrame:
        """u - v becomes v - m, where m is the least neighbour of u."""
        return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m.v").alias("v"), *[(F.col(f"m.{s}") - F.col(s)).alias(s) for s in STEPS])

    loops = [f"loop{k}" for k in axes]

    def paired(edges: DataFrame) -> DataFrame:
        """One edge for each pair of nodes; for each axis whether others, or its way back to its node, wind."""
        by = {k: F.struct(F.col(STEPS[k]).alias("own"), *STEPS) for k in axes}
        ends = [end(by[k]).alias(f"{name}{k}") for k in axes for name, end in (("hi", F.max), ("lo", F.min))]
        out = edges.groupBy("u", "v").agg(F.min(F.struct(*STEPS)).alias("s"), *ends)

        def loop(k: int) -> Column:
            # two edges make a loop of their difference; an edge back to its node is one by itself
            hi, lo = (lambda s: F.col(f"hi{k}.{s}")), (lambda s: F.col(f"lo{k}.{s}"))
            pair = F.array(*[hi(s) - lo(s) for s in STEPS])
            back = F.array(*[F.when(lo("own") > 0, lo(s)).otherwise(-lo(s)) for s in STEPS])
            return F.when(hi("own") != lo("own"), pair).when((F.col("u") == F.col("v")) & (lo("own") != 0), back)

        return out.select("u", "v", *[F.col(f"s.{s}").alias(s) for s in STEPS], *[loop(k).alias(f"loop{k}") for k in axes])

    rounds = [materialize(paired(oriented(links.select(F.col("a").alias("u"), F.col("b").alias("v"), *STEPS))), "pairs")]
    mark = None
    for _ in range(max_rounds):
        edges = rounds[-1].where("u <> v").drop(*loops)
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            marks = None
            for pairs in rounds:
                part = pairs.where(F.coalesce(*loops).isNotNull()).select("u", *loops)
                marks = part if marks is None else marks.unionByName(part)
            ends = [edges.select(F.col("u").alias("node"), F.col("v").alias("component")), edges.select(F.col("v").alias("node"), F.col("v").alias("component")), marks.select(F.col("u").alias("node"), F.col("u").alias("component"))]
            label = materialize(ends[0].unionByName(ends[1]).unionByName(ends[2]).groupBy("node").agg(F.min("component").alias("component")), "label")
            least = [label.join(marks, F.col("node") == F.col("u")).where(F.col(c).isNotNull()).groupBy("component").agg(F.min(c).alias("loop")) for c in loops]
            wounds = [materialize(wound, "wound") for wound in least]
            discard(*rounds)
            return label, wounds
        mark = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *[(-F.col(s)).alias(s) for s in STEPS]))
        least = both.where("v < u").groupBy("u").agg(F.min(F.struct("v", *STEPS)).alias("m"))
        # large star: greater neighbours move to the least one; a node that is least among its neighbours keeps them
        greater = both.where("v > u")
        moved = greater.join(least, "u", "left")
        moved = moved.select(
            F.col("v").alias("u"), F.coalesce("m.v", "u").alias("v"), *[(F.coalesce(f"m.{s}", F.lit(0)) - F.col(s)).alias(s) for s in STEPS]
        )
        large = materialize(oriented(moved).distinct(), "large")
        # small star: lesser neighbours move to the least one
        down = large.where("u <> v")
        low = down.groupBy("u").agg(F.min(F.struct("v", *STEPS)).alias("m"))
        small = through(down, low).unionByName(low.select("u", F.col("m.v").alias("v"), *[F.col(f"m.{s}").alias(s) for s in STEPS])).unionByName(large.where("u = v"))
        rounds.append(materialize(paired(oriented(small)), "pairs"))
        discard(large)
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _one_row(particles: DataFrame, percolates: bool, n_nodes: int, n_components: int, path: list[int] | None, winding: list[int] | None = None) -> DataFrame:
    """As ``analyze_percolation`` returns it."""
    spark = particles.sparkSession
    rid = particles.select("realization_id").limit(1).collect()
    rows = [(r[0], percolates, n_nodes, n_components, path, winding) for r in rid]
    return spark.createDataFrame(rows, "realization_id long, percolates boolean, n_nodes long, n_components long, path array<int>, winding array<long>")


def face_percolation(particles: DataFrame, domain: Domain, threshold: float, axis: int, wrapped_parent: bool = False, method: str = "cell_list", policy: Policy = C.POLICY) -> DataFrame:
    return face_percolations(particles, domain, threshold, (axis,), wrapped_parent, method, policy)[0]


def face_percolations(particles: DataFrame, domain: Domain, threshold: float, axes: tuple[int, ...], wrapped_parent: bool = False, method: str = "cell_list", policy: Policy = C.POLICY) -> list[DataFrame]:
    """A result for each axis. Axes whose opened domains are equal share their links."""
    nodes, out, shared = materialize(nodes_of(particles), "nodes"), [], {}
    n = nodes.select("node").distinct().count()
    for axis in axes:
        opened = domain.opened(axis)
        if opened not in shared:
            rows = D.dealt(particles, opened, threshold, policy) if C._method(method) == "cell_list" else None
            held = None if rows is None else materialize(rows.join(nodes, "idx"), "held")
            found = C.find_contacts(particles, opened, threshold, method, policy) if held is None else D.spanning_links(particles, opened, threshold, policy)
            links = materialize(_links(found, nodes).select("a", "b").distinct(), "links")
            label = connected_components(links)
            shared[opened] = held, links, label.agg(F.count("*"), F.countDistinct("component")).first()
        held, links, (joined, count) = shared[opened]
        ends = materialize(C.electrodes(particles, domain, axis, threshold, wrapped_parent, policy).select("idx", "at_lower", "at_upper").join(nodes, "idx"), "ends")
        start, goal = (ends.where(c).select("node") for c in ("at_lower", "at_upper"))
        path = breadth_first(links, start, goal) if held is None else D.breadth_first(held, opened, threshold, policy, start, goal)
        discard(ends)
        out.append(_one_row(particles, path is not None, n, n - joined + count, path or []))
    discard(nodes, *[t for held, links, _ in shared.values() for t in (held, links) if t is not None])
    return out


def winding_percolation(particles: DataFrame, domain: Domain, threshold: float, axis: int, method: str = "cell_list", policy: Policy = C.POLICY) -> DataFrame:
    return winding_percolations(particles, domain, threshold, (axis,), method, policy)[0]


def winding_percolations(particles: DataFrame, domain: Domain, threshold: float, axes: tuple[int, ...], method: str = "cell_list", policy: Policy = C.POLICY) -> list[DataFrame]:
    """A result for each axis, from one search for links and one pass of rounds."""
    from porespan.operators.percolation import offset_problems, self_images

    if not all(domain.periodic[axis] for axis in axes):
        raise SetupError("winding needs a periodic axis")
    if offset_problems(particles, domain).limit(1).count():
        raise SetupError("offsets must be stated for all fragments of a parent or none, and be zero along open axes")
    nodes = materialize(nodes_of(particles), "nodes")
    own = particles.select("idx", *[F.coalesce(F.col(f"o{a}"), F.lit(0)).alias(f"o{a}") for a in "xyz"])
    at = lambda s: own.select(F.col("idx").alias(s), *[F.col(f"o{a}").alias(f"o{a}{s}") for a in "xyz"])
    found = D.spanning_links(particles, domain, threshold, policy) if C._method(method) == "cell_list" else C.find_contacts(particles, domain, threshold, method, policy)
    found = _links(found, nodes, loops=True).join(at("i"), "i").join(at("j"), "j")
    links = found.select("a", "b", *[(F.col(f"s{a}") + F.col(f"o{a}i") - F.col(f"o{a}j")).alias(f"s{a}") for a in "xyz"])
    loops = self_images(particles, domain, policy, nodes).select(F.col("node").alias("a"), F.col("node").alias("b"), *STEPS)
    links = materialize(links.unionByName(loops).where("a <> b or sx <> 0 or sy <> 0 or sz <> 0").distinct(), "links")
    label, wounds = weighted_components(links, axes)
    n = nodes.select("node").distinct().count()
    joined, count = label.agg(F.count("*"), F.countDistinct("component")).first()
    firsts = [wound.orderBy("component").select("loop").first() for wound in wounds]
    discard(nodes, links, label, *wounds)
    return [_one_row(particles, first is not None, n, n - joined + count, None, first and list(first[0])) for first in firsts]
