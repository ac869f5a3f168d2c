"""Golden values, closed forms and two ways to the same result."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from porespan.functions import convex, segments, stats, sums
from porespan.functions import geometry as G
from porespan.functions.registered import register
from porespan.operators import contacts as C
from porespan.operators import percolation as P
from porespan.operators import transport as T
from porespan.operators.graph import connected_components
from porespan.plans import workflows as W
from porespan.policy import DesignError, Domain, SetupError
from porespan.sources.config import load_config, loads_config
from porespan.sources.particles import Population, checked, generate, microstructure, populations_of, trial_keys, volume_fraction

BODY = "idx int, shape string, cx double, cy double, cz double, ux double, uy double, uz double, length double, radius double, parent_id string, ox long, oy long, oz long"


def bodies(spark, rows):
    return checked(spark.createDataFrame(rows, BODY))


def ball(i, x, y=0.0, z=0.0, r=1.0, parent=None, o=(None, None, None)):
    return (i, "sphere", float(x), float(y), float(z), None, None, None, None, float(r), parent, *o)


def rod(i, c, u, length, r):
    return (i, "cylinder", *map(float, c), *map(float, u), float(length), float(r), None, None, None, None)


def test_intervals():
    assert stats.exact_interval(4, 100) == pytest.approx((0.011004493986188201, 0.09925715671265992), abs=1e-13)
    assert stats.exact_interval(97, 160, 0.975) == pytest.approx((0.5148766235291948, 0.6925569221422904), abs=1e-12)
    assert stats.exact_interval(4, 100, 0.95, "lower")[0] == pytest.approx(0.013776612464856383, abs=1e-13)
    assert stats.wilson_interval(50, 100, 0.95) == pytest.approx((0.4038315303659956, 0.5961684696340044), abs=1e-14)
    assert stats.bonferroni(0.95, 20) == pytest.approx(0.9975)


def test_fits():
    assert stats.pava([0.3, 0.1, 0.2]) == pytest.approx([0.2] * 3)
    assert stats.pava([0, 1, 0], [1, 1, 2]) == pytest.approx([0, 1 / 3, 1 / 3])
    fit = stats.fit_link([1, 2, 3, 4, 5], [5, 20, 50, 80, 95], [100] * 5)
    assert fit["converged"] and stats.link_threshold(fit, 0.5) == pytest.approx(3.0, abs=1e-6)
    assert not stats.fit_link([1, 2, 3, 4], [0, 0, 9, 9], [9] * 4, "probit")["converged"]


def test_convex_gaps_against_sampling():
    rng = np.random.default_rng(3)
    n = 12
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    c1, c2, u1, u2 = rng.uniform(-2, 2, (n, 3)), rng.uniform(-2, 2, (n, 3)), unit(rng.normal(size=(n, 3))), unit(rng.normal(size=(n, 3)))
    length, radius = np.full(n, 1.5), np.full(n, 0.3)
    gap = convex.cylinder_gaps(c1, u1, length, radius, c2, u2, length, radius)
    for k in range(n):
        one = lambda x, k=k: np.repeat(x[k : k + 1], 4000, axis=0)
        p = convex.project_cylinder(c1[k] + rng.normal(size=(4000, 3)) * 2, one(c1), one(u1), one(length), one(radius))
        q = convex.project_cylinder(p, one(c2), one(u2), one(length), one(radius))
        assert gap[k] <= np.linalg.norm(p - q, axis=1).min() + 1e-7
    up = np.array([[0.0, 0.0, 1.0]])
    one = np.ones(1)
    assert convex.cylinder_gaps(np.zeros((1, 3)), up, 2 * one, 0.5 * one, np.array([[2.0, 0, 3.5]]), up, 2 * one, 0.5 * one)[0] == pytest.approx(math.hypot(1, 1.5), abs=1e-7)


#: Slender pairs: (centre, axis, length, radius) of both, and the gap.
SLENDER = [
    (((0, 0, 0), (1, 1e-16, 0), 1e9, 0.1), ((0, 1, 0), (1, -1e-16, 0), 1e9, 0.1), 0.8 - 1e-7),
    (((0, 0, 0), (1, 0, 0), 1e9, 0.012), ((-4.6e8, 0.019, 0), (1, 1e-12, 0), 25.0, 0.046), 0.0),
    (((0, 0, 0), (1, 0, 0), 1e9, 0.1), ((0, 1, 0), (1, 1e-9, 0), 1e9, 0.1), 0.3),
    (((0, 0, 0), (1, 0, 0), 2e9, 0.1), ((0, 50, 0), (1, 1e-7, 0), 2e9, 0.1), 0.0),
    (((0, 0, 0), (1, 0, 0), 2e6, 0.001), ((-4e5, 0.03, 0), (1, 1e-7, 0), 1e6, 0.004), 0.0),
    # an end's rim against the other's side, in one plane: 2 - 1e-7 * 5e6 - 0.03 - 0.2
    (((0, 0, 0), (1, 0, 0), 2e7, 0.03), ((1e6, 2, 0), (1, -1e-7, 0), 1e7, 0.2), 1.27),
    (((0, 0, 0), (0, 0, 1), 3.0, 1e8), ((0, 0, 4.0), (1e-9, 0, -1), 1.0, 1.0), 2.0),
    (((0, 0, 0), (0, 0, 1), 1e6, 0.5), ((5, 0, 0), (0.6, 0.8, 0), 1e6, 0.25), 3.25),
]


def test_slender_cylinders():
    unit = lambda u: np.array(u, float) / np.linalg.norm(u)
    columns = lambda k: [np.array(x, float) for x in zip(*[(p[k][0], unit(p[k][1]), *p[k][2:]) for p in SLENDER], strict=True)]
    want = [p[2] for p in SLENDER]
    for a, b in ((0, 1), (1, 0)):
        assert convex.cylinder_gaps(*columns(a), *columns(b)) == pytest.approx(want, abs=2e-9)
        lower, upper = convex.witnessed_gaps(*columns(a), *columns(b))
        assert upper == pytest.approx(want, abs=2e-9) and (upper - lower < 2e-8).all()


def test_witnesses_agree_with_projections():
    rng = np.random.default_rng(9)
    n = 60
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    sides = [(rng.uniform(-2, 2, (n, 3)), unit(rng.normal(size=(n, 3))), rng.uniform(0.1, 4, n), rng.uniform(0.05, 1, n)) for _ in "ab"]
    body = lambda x: (convex.project_cylinder, convex.support_cylinder, x)
    lower, upper = convex.witnessed_gaps(*sides[0], *sides[1])
    assert upper == pytest.approx(convex.certified_gaps(n, body(sides[0]), body(sides[1])), abs=1e-7)
    assert (upper - lower < 1e-6).all()


def test_support_points():
    c, u = np.array([[1.0, 2, 3]] * 4), np.array([[1.0, 0, 0]] * 4)
    n = np.array([[0.0, 1, 0], [1, 0, 0], [0, 0, 0], [-1, 0, 1]])
    found = convex.support_points(n, c, u, np.full(4, 10.0), np.full(4, 2.0))
    assert np.allclose(found, [[1, 4, 3], [6, 2, 3], [1, 2, 3], [-4, 2, 5]])


@pytest.mark.parametrize("flags", [(False, False, False), (True, False, True), (True, True, True)])
def test_contact_parity(spark, flags):
    d = Domain(6.0, flags)
    p = generate(trial_keys(spark, 2), d, [Population(0.5, 18), Population(0.3, 8, 2.0)], 1800)
    a, b = (x.select("realization_id", "i", "j", "sx", "sy", "sz").collect() for x in (C.cell_contacts(p, d, 0.2), C.theta_contacts(p, d, 0.2)))
    assert len(a) > 0 and sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("flags", [(False, False, False), (True, True, True), (False, True, False)])
def test_sizes_of_many_orders(spark, flags):
    """Bodies of very different sizes, long cylinders and centres outside of the box: both ways find the same, and large bodies make few candidates."""
    d = Domain((9.0, 7.0, 8.0), flags, (1.0, -2.0, 0.5))
    p = generate(trial_keys(spark, 2), d, [Population(0.03, 60), Population(0.4, 12), Population(2.5, 2), Population(0.1, 3, 14.0), Population(0.2, 5, 0.9)], 77)
    p = p.withColumns({"cx": p["cx"] + 18.0 * (p["idx"] % 3 - 1), "cy": p["cy"] - 7.0 * (p["idx"] % 2)}).persist()
    a, b = (sorted(map(tuple, x.select("realization_id", "i", "j", "sx", "sy", "sz").collect())) for x in (C.cell_contacts(p, d, 0.1), C.theta_contacts(p, d, 0.1)))
    assert a == b and len(a) == len(set(a)) > 0
    for method in ("cell_list", "bruteforce"):
        rows = {r.realization_id: r for r in C.search_counters(p, d, 0.1, method).collect()}
        assert {k: r.contacts for k, r in rows.items()} == {k: sum(x[0] == k for x in a) for k in (0, 1)} and all(r.candidates >= r.boxes >= r.contacts for r in rows.values())
    p.unpersist()


def test_large_and_small_spheres_make_few_candidates(spark):
    p = generate(trial_keys(spark, 1), Domain(50.0, True), [Population(0.1, 3000), Population(10.0, 3)], 42)
    found = C.search_counters(p, Domain(50.0, True), 0.0).first()
    assert found.candidates < 5 * found.contacts and found.compared < 60 * 3003
    with pytest.raises(SetupError):
        C.find_contacts(p, Domain(50.0), 0.0, "unknown")


def test_cells_follow_the_density(spark):
    """Small bodies within a wide threshold, dense and thin regions, more bodies than the sample tells apart."""
    rng = np.random.default_rng(4)
    for domain in (Domain(12.0, True), Domain(12.0), Domain((12.0, 9.0, 30.0), (False, True, True))):
        crowd, thin = rng.normal(0, 0.7, (150, 3)), rng.uniform(-20, 20, (150, 3))
        p = bodies(spark, [ball(i, *c, r=0.1) for i, c in enumerate([*crowd, *thin])] + [ball(300, 1, 1, 1, r=7.0), rod(301, (0, 0, 0), (0, 0.6, 0.8), 15, 0.2)])
        by = [sorted((r.i, r.j, r.sx, r.sy, r.sz) for r in f(p, domain, 0.5).collect()) for f in (C.cell_contacts, C.theta_contacts)]
        assert by[0] == by[1] and len(set(by[0])) == len(by[0])
    points = rng.uniform(0, 1000, (500, 3))
    cells = C.fit_cells(points - 0.5, points + 0.5, Domain(1000.0, True, 500.0), 5e6, 4096)
    bulk = rng.uniform(0, 1000, (200_000, 3))
    held = np.bincount(cells.of(bulk - 0.5, bulk + 0.5)[1]) * 25  # as if of five million
    assert held.max() < 3 * 4096 and held[held > 0].mean() > 400


def test_corner_image_and_threshold(spark):
    d = Domain(10.0, True)
    corner = C.cell_contacts(bodies(spark, [ball(0, -4.8, -4.8, -4.8, 0.5), ball(1, 4.8, 4.8, 4.8, 0.5)]), d, 0.0).first()
    assert (corner.sx, corner.sy, corner.sz, corner.gap) == (-1, -1, -1, 0.0)
    pair = bodies(spark, [ball(0, 0), ball(1, 3.8)])
    assert C.cell_contacts(pair, Domain(20.0), 1.8).count() == 1 and C.cell_contacts(pair, Domain(20.0), 1.8 - 2e-8).count() == 0


def test_face_percolation(spark):
    chain = P.analyze_percolation(bodies(spark, [ball(i, x) for i, x in enumerate((-4, -2, 0, 2, 4))]), Domain(10.0)).first()
    assert chain.percolates and list(chain.path) == [0, 1, 2, 3, 4] and chain.n_components == 1
    broken = P.analyze_percolation(bodies(spark, [ball(i, x) for i, x in enumerate((-4, -2, 2, 4))]), Domain(10.0)).first()
    assert not broken.percolates and broken.n_components == 2
    off = P.analyze_percolation(bodies(spark, [ball(0, -4.8, 8, 0, 0.5), ball(1, 4.8, 8, 0, 0.5)]), Domain(10.0), 1.0).first()
    assert not off.percolates


def test_winding(spark):
    d = Domain(10.0, True)
    loop = P.analyze_percolation(bodies(spark, [ball(i, x) for i, x in enumerate((-4, 0, 4))]), d, 2.0, 0, "periodic-wrap").first()
    assert loop.percolates and loop.winding[0] == 1
    steps = P.self_images(bodies(spark, [rod(0, (0, 0, 0), (1, 0, 0), 32, 0.2)]), d, C.POLICY).collect()
    assert {abs(r.sx) for r in steps} == {1, 2, 3}
    for r, wraps in ((5.0, True), (4.9, False)):
        assert P.analyze_percolation(bodies(spark, [ball(0, 0, r=r)]), d, 0.0, 0, "periodic_wrap").first().percolates is wraps
    with pytest.raises(SetupError):
        P.analyze_percolation(bodies(spark, [ball(0, 0)]), Domain(10.0), 0.0, 0, "periodic_wrap")


def test_large_realizations_as_small_ones(spark):
    """The joins for one realization of any size against the grouped maps: faces, windings, paths' lengths, numbers of nodes."""
    for seed, radius in ((3, 0.9), (6, 0.6)):
        p = generate(trial_keys(spark, 1), Domain(8.0, True), [Population(radius, 70), Population(0.3, 10, 2.5)], seed)
        p = p.withColumn("parent_id", F.when(F.col("idx") % 5 == 0, (F.col("idx") % 20).cast("string"))).persist()
        for axis in (2,):
            one, two = (P.analyze_percolation(p, Domain(8.0, True), 0.05, axis, large=x).first() for x in (False, True))
            assert (one.percolates, one.n_nodes, one.n_components, len(one.path)) == (two.percolates, two.n_nodes, two.n_components, len(two.path))
            one, two = (P.analyze_percolation(p, Domain(8.0, True), 0.05, axis, "periodic_wrap", large=x).first() for x in (False, True))
            assert (one.percolates, one.n_nodes, one.n_components) == (two.percolates, two.n_nodes, two.n_components)
            assert (two.winding[axis] > 0) if two.percolates else two.winding is None
        assert sorted(map(tuple, P.logical_nodes(p).collect())) == sorted(map(tuple, P.logical_nodes(p, large=True).collect()))
        p.unpersist()
    d = Domain(10.0, True)
    for xs, winds in (((-4, 0, 4), True), ((-4, 0), False)):
        assert P.analyze_percolation(bodies(spark, [ball(i, x) for i, x in enumerate(xs)]), d, 2.0, 0, "periodic_wrap", large=True).first().percolates is winds
    assert P.analyze_percolation(bodies(spark, [ball(i, x) for i, x in enumerate((-4, 0, 4))]), d, 2.0, 0, "wrap", large=True).first().winding == [1, 0, 0]
    assert P.analyze_percolation(bodies(spark, [rod(0, (0, 0, 0), (1, 0, 0), 32, 0.2)]), d, 0.0, 0, "wrap", large=True).first().percolates


def test_fragments_share_a_node(spark):
    p = bodies(spark, [ball(0, -4.8, r=0.5, parent="a"), ball(1, 4.8, r=0.5, parent="a")])
    assert P.analyze_percolation(p, Domain(10.0)).first().percolates
    assert C.cell_contacts(p, Domain(10.0, True), 0.0).count() == 0


def test_circuits():
    bridge = T.solve_network(5, np.array([0, 0, 1, 1, 2, 1]), np.array([1, 2, 2, 3, 3, 4]), np.ones(6), 0, 3)
    assert bridge["conductance"] == pytest.approx(1.0) and bridge["voltages"] == pytest.approx([1, 0.5, 0.5, 0, 0.5])
    apart = T.solve_network(4, np.array([0]), np.array([1]), np.ones(1), 0, 2, 2.0)
    assert apart["conductance"] == 0 and apart["voltages"] == [2.0, 2.0, 0.0, None]
    rng = np.random.default_rng(2000)
    for _ in range(8):
        n = 8
        a, b = np.triu_indices(n, 1)
        g = 10 ** rng.uniform(-3, 3, len(a))
        lap = np.zeros((n, n))
        for i, j, w in zip(a, b, g, strict=True):
            lap[[i, j], [i, j]] += w
            lap[[i, j], [j, i]] -= w
        v = np.r_[1.0, np.linalg.solve(lap[1:-1, 1:-1], -lap[1:-1, 0]), 0.0]
        assert T.solve_network(n, a, b, g, 0, n - 1)["conductance"] == pytest.approx(lap[0] @ v, rel=1e-10)


def test_networks_of_any_size(spark):
    """Edges instead of a dense system, and tables instead of arrays: both against the dense solution."""
    rng = np.random.default_rng(7)
    side = 24  # a grid with random conductances over four orders
    at = np.arange(side * side).reshape(side, side)
    a, b = np.r_[at[:, :-1].ravel(), at[:-1].ravel()], np.r_[at[:, 1:].ravel(), at[1:].ravel()]
    g = 10 ** rng.uniform(-2, 2, len(a))
    lap = np.zeros((side * side, side * side))
    for i, j, w in zip(a, b, g, strict=True):
        lap[[i, j], [i, j]] += w
        lap[[i, j], [j, i]] -= w
    inner = np.arange(1, side * side - 1)
    v = np.zeros(side * side)
    v[0] = 1.0
    v[inner] = np.linalg.solve(lap[np.ix_(inner, inner)], -lap[inner, 0])
    found = T.solve_network(side * side, a, b, g, 0, side * side - 1)
    assert found["conductance"] == pytest.approx(lap[0] @ v, rel=1e-9) and found["voltages"] == pytest.approx(v.tolist(), abs=1e-9)
    bridge = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 3, 2.0), (1, 4, 1.0), (7, 8, 1.0)], "a long, b long, g double")
    large = T.solve_large(bridge, 0, 3, 2.0)
    small = T.solve_network(9, np.array([0, 0, 1, 1, 2, 1, 7]), np.array([1, 2, 2, 3, 3, 4, 8]), np.array([1.0, 1, 1, 1, 2, 1, 1]), 0, 3, 2.0)
    assert large["conductance"] == pytest.approx(small["conductance"], rel=1e-9)
    assert {r.node: r.v for r in large["voltages"].collect()} == pytest.approx({k: x for k, x in enumerate(small["voltages"]) if x is not None}, abs=1e-8)
    assert T.solve_large(bridge, 0, 7)["conductance"] == 0


def test_nearest_images_of_any_pair(spark):
    d = Domain((10.0, 8.0, 9.0), (True, False, True))
    p = generate(trial_keys(spark, 1), d, [Population(0.5, 12), Population(0.3, 4, 3.0)], 21).persist()
    pairs = p.alias("a").join(p.alias("b"), F.expr("a.idx < b.idx")).select(F.lit(0).cast("long").alias("realization_id"), F.col("a.idx").alias("i"), F.col("b.idx").alias("j"))
    found = {(r.i, r.j): r for r in C.nearest_images(pairs, p, d).collect()}
    rows = p.orderBy("idx").collect()
    assert len(found) == 16 * 15 // 2
    for (i, j), r in found.items():
        a, b = rows[i], rows[j]
        if a.shape == b.shape == "sphere":
            best = min(math.dist((a.cx, a.cy, a.cz), (b.cx + 10 * x, b.cy, b.cz + 9 * z)) - 1.0 for x in range(-2, 3) for z in range(-2, 3))
            assert r.gap == pytest.approx(max(best, 0.0), abs=1e-9)
    near = {(r.i, r.j): r.gap for r in C.cell_contacts(p, d, 1.5).groupBy("i", "j").agg(F.min("gap").alias("gap")).collect()}
    assert near and all(found[k].gap == pytest.approx(g, abs=1e-7) for k, g in near.items())
    p.unpersist()


def test_segments_boxes_and_bases(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, v)) for v in rng.uniform(-2, 2, (200, 15))] + [(0.0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0, 5, 5, 5), (0.0, 0, 0, 0, 0, 0, 3, 4, 0, 3, 4, 0, 0, 0, 0)]
    names = [f"{k}{a}" for k in "pqrsc" for a in "xyz"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names))
    p, q, r, s, c = (tuple(F.col(f"{k}{a}") for a in "xyz") for k in "pqrsc")
    half = (F.lit(0.7), F.lit(0.5), F.lit(0.9))
    axis = G.unit(c)
    basis = G.plane_basis(axis)
    mid, u, length = G.from_endpoints(p, q)
    back = G.endpoints(mid, u, length)
    got = df.select(G.segment_segment(p, q, r, s).alias("d"), G.segment_meets_box(p, q, c, half).alias("meets"), G.dot(*basis).alias("o"), G.norm(basis[1]).alias("n"), G.norm(G.minus(back[1], q)).alias("back"), G.safe_product(F.lit(1e300), F.abs(p[0]) + 1, F.lit(1e-300)).alias("product")).collect()
    t = np.linspace(0, 1, 400)
    for x, row in zip(got, rows, strict=True):
        a, b, e, f, c = (np.array(row[3 * k : 3 * k + 3]) for k in range(5))
        one, two = a + t[:, None] * (b - a), e + t[:, None] * (f - e)
        least = np.linalg.norm(one[:, None] - two[None], axis=2).min()
        assert x.d <= least + 1e-12 and least - x.d < 0.02
        if (np.abs(one - c) <= [0.7, 0.5, 0.9]).all(axis=1).any():
            assert x.meets
        elif (np.abs(one - c) <= [0.72, 0.52, 0.92]).all(axis=1).sum() == 0:
            assert not x.meets
        if any(c):
            assert abs(x.o) < 1e-12 and abs(x.n - 1) < 1e-12
        assert not any(a - b) or x.back < 1e-12
        assert x.product == pytest.approx(abs(row[0]) + 1, rel=1e-12)
    cells = spark.createDataFrame([(-0.5,), (9.999999999,), (10.0,), (1e18,), (-1e17,)], "x double").select(G.exact_cell_floor(F.col("x"), Domain(10.0, True, 5.0), 0).alias("c")).collect()
    assert [int(r.c) for r in cells] == [-1, 0, 1, 10**17, -(10**16)]


def test_results_as_json(tmp_path, spark):
    from porespan.sources.results import dumps, plain, write_json

    value = {"a": np.float64(0.5), "b": (1, None, True), 3: np.arange(2), "d": Population(1.0, 2, None), "t": spark.range(2)}
    assert plain(value) == {"a": 0.5, "b": [1, None, True], "3": [0, 1], "d": {"radius": 1.0, "count": 2, "length": None, "cost_per_volume": 0.0, "name": None}, "t": [{"id": 0}, {"id": 1}]}
    write_json(value, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == dumps(value)
    for bad in (float("nan"), {"x": [math.inf]}, object(), {1: 0, "1": 0}):
        with pytest.raises(SetupError):
            dumps(bad)


def test_isotonic_in_ranges(spark):
    rng = np.random.default_rng(2)
    y, w = rng.normal(size=300) + np.linspace(0, 2, 300), rng.uniform(0.5, 2, 300)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, w, strict=True))], "x long, y double, w double")
    fitted = [r.fitted for r in stats.isotonic(points, "x", "y", "w", 7).orderBy("x").collect()]
    assert fitted == pytest.approx(stats.pava(y.tolist(), w.tolist()).tolist())
    assert stats.isotonic(points.limit(0), "x", "y", "w").collect() == []


@pytest.mark.parametrize("shape", ["rising", "falling", "bowl", "steps", "noise"])
def test_isotonic_asks_for_few_vertices(spark, monkeypatch, shape):
    """Chains longer than a round's vertices, in all relations to each other."""
    monkeypatch.setattr(stats, "VERTICES", 4)
    n, rng = 3000, np.random.default_rng(7)
    t = np.linspace(-1, 1, n)
    y = {"rising": t, "falling": -t, "bowl": -np.abs(t) + t**3, "steps": np.floor(t * 5) - 0.3 * t + 0.001 * np.sin(40 * t), "noise": t + 0.05 * rng.normal(size=n)}[shape]
    points = spark.createDataFrame([(i, float(v), 1.0 + i % 3) for i, v in enumerate(y)], "x long, y double, w double").withColumn("fitted_before", F.lit(1))
    fitted = [r.fitted for r in stats.isotonic(points, "x", "y", "w", 9).orderBy("x").collect()]
    assert fitted == pytest.approx(stats.pava(y.tolist(), [1.0 + i % 3 for i in range(n)]).tolist(), abs=1e-9)
    fit = stats.fit_link([1, 2, 3, 4, 5], [5, 20, 50, 80, 95], [100] * 5)
    assert stats.link_predict(fit, [1, 2, 3, 4, 5]) == pytest.approx(fit["fitted"]) and stats.link_predict(fit, [stats.link_threshold(fit, 0.7)]) == pytest.approx([0.7])


def test_conductivity(spark):
    chain = bodies(spark, [ball(i, x) for i, x in enumerate((-4, -2, 0, 2, 4))])
    assert T.conductivity(chain, Domain((10.0, 4.0, 6.0)), T.Law(2.0)).first().sigma == pytest.approx(2 / 6 * 10 / 24)
    s = T.directional(T.conductivity(chain, Domain(10.0, True), T.Law(1.0), ("x", "y", "z"))).first()
    assert (s.sigma_x, s.sigma_y, s.sigma_z) == pytest.approx((1 / 60, 0, 0))


def test_search_successes_are_the_recorded_ones(spark):
    model = W.Model(Domain(10.0, (False, True, True)), 0.2)
    assert W.nested_successes(spark, model, Population(1.0, 0), [], [40, 50, 60, 70, 80, 90, 100], 100, 314159) == [4, 14, 34, 62, 85, 91, 97]
    assert W.successes(spark, model, [Population(1.0, 70)], 160, 314159, (1, 0)) == 97
    assert volume_fraction([Population(1.0, 80)], model.domain) == pytest.approx(0.33510321638291124)


def test_mixture_decisions(spark):
    model = W.Model(Domain(10.0))
    sphere = [Population(1.0, 0, None, 1.0)]
    r = W.optimize_mixture(spark, model, sphere, [(0, 3)], 0.9, 250, 5000, evaluate=lambda c, n, _: n * (c[0] >= 1))
    assert (r["status"], r["counts"], r["comparisons"], r["per_comparison"]) == ("CERTIFIED_OPTIMAL", [1], 8, 0.99375)
    never = W.optimize_mixture(spark, model, sphere, [(0, 3)], evaluate=lambda c, n, _: 0)
    assert never["status"] == "NO_CERTIFIED_FEASIBLE" and never["counts"] is None
    with pytest.raises(DesignError):
        W.candidates(spark, sphere, [(0, 10**9)])


def test_blocks_of_a_mixture_search_decide_alike(spark):
    model, pops = W.Model(Domain(6.0), 0.2), [Population(1.0, 0, None, 1.0), Population(0.4, 0, 3.0, 2.0)]
    one, all_ = (W.optimize_mixture(spark, model, pops, [(8, 10), (0, 1)], 0.2, 10, 15, seed=7, block=b) for b in (1, 16))
    assert one == all_
    by_design = [W.successes(spark, model, [p.of(c) for p, c in zip(pops, r["counts"], strict=True)], 10, 7, (0, m)) for m, r in enumerate(one["screening"][:2])]
    assert by_design == [r["successes"] for r in one["screening"][:2]]


def test_evaluators_and_seeds(spark):
    """Outcomes by an aggregate of the particles: the recorded decisions; a seed sequence gives its own streams."""
    some = W.make_evaluator(Domain(10.0), F.count("*") >= 2)
    sphere = Population(1.0, 0)
    assert W.probability(spark, some, [sphere.of(2)], 20, 5)["probability"] == 1.0 and W.probability(spark, some, [sphere.of(1)], 20, 5)["probability"] == 0.0
    for strategy in ("pava", "logistic", "probit"):
        r = W.critical_loading(spark, some, sphere, [0, 1, 2, 3], target=0.9, search_trials=50, certification_trials=400, strategy=strategy, seed=1)
        assert (r["status"], r["critical_count"], r["per_comparison"]) == ("CERTIFIED", 2, 0.975)
    never = W.critical_loading(spark, W.make_evaluator(Domain(10.0), F.count("*") < 0), sphere, [0, 1, 2], search_trials=30, certification_trials=200, seed=1)
    assert never["status"] == "NO_CROSSING"
    model, key = W.Model(Domain(10.0, (False, True, True)), 0.2), np.random.SeedSequence(314159, spawn_key=(1,))
    assert W.probability(spark, model, [sphere.of(70)], 40, key.spawn(1)[0])["successes"] == W.successes(spark, model, [sphere.of(70)], 40, 314159, (1, 0))
    assert W.seed_label(W.seed_of(key)) == "314159/1" and W.seed_label(W.seed_of(3)) == "3"
    with pytest.raises(SetupError):
        W.seed_of(-1)


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8), (5, 5)], "a long, b long")
    assert sorted(map(tuple, connected_components(pairs).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)]


CONFIG = """
schema_version: 1
domain: {size: [10, 10, 10], periodic: [false, true, true]}
particles:
  - {name: s, shape: sphere, radius: 1.0, count: 70}
percolation: {threshold: 0.2, axis: x, mode: face_to_face}
simulation: {trials: 10, seed: 3}
"""


def test_config():
    c = loads_config(CONFIG)
    assert c.model.domain.periodic == (False, True, True) and c.populations[0].count == 70 and c.simulation["trials"] == 10
    for bad in (CONFIG.replace("version: 1", "version: true"), CONFIG + "extra: 1\n", CONFIG.replace("radius: 1.0", "radius: .nan"), CONFIG + "schema_version: 1\n", CONFIG.replace("radius", "radios")):
        with pytest.raises(SetupError):
            loads_config(bad)
    with pytest.raises(SetupError):
        load_config("/nowhere/x.yaml")
    assert loads_config(CONFIG.replace("seed: 3", "seed: {entropy: 3, spawn_key: [1]}")).simulation["seed"].spawn_key == (1,)
    for old, new in (("axis: x", "axis: w"), ("trials: 10", "trials: ten"), ("trials: 10", "trials: -1"), ("seed: 3", "seed: 1.5"), ("mode: face_to_face", "mode: 3"), ("threshold: 0.2", "threshold: true")):
        with pytest.raises(SetupError):
            loads_config(CONFIG.replace(old, new))
    with pytest.raises(SetupError):
        loads_config(CONFIG, "critical")


def test_wrong_types_are_errors_of_the_setup(tmp_path, capsys):
    from porespan import cli

    lines = CONFIG.splitlines()
    size = next(x for x in lines if "size:" in x)
    swap = lambda old, new: CONFIG.replace(old, new)
    wrong = [swap(size.strip(), f"size: {v}") for v in ("abc", "null", "true", "[1, 2]", "[1, 2, x]", "1e400")]
    for text in (*wrong, "schema_version: 1\ndomain: {size: 5}\nparticles: 5\n", "schema_version: 1\ndomain: {size: 5}\noptimization: {bounds: [1, 2]}\n", "schema_version: 1\ndomain: {size: 5}\nparticles: [{radius: 1.0, name: 3}]\n", "schema_version: 1\ndomain: 3\n", "schema_version: 1\ndomain: {size: 5}\ncritical: []\n"):
        with pytest.raises(SetupError):
            loads_config(text)
        path = tmp_path / "c.yaml"
        path.write_text(text)
        assert cli.main(["simulate", str(path)]) == 2 and capsys.readouterr().err.startswith("error: ")
    for bad in ({"radius": math.nan}, {"radius": True}, {"count": True}, {"count": 1.5}, {"count": -1}, {"length": math.inf}, {"cost_per_volume": -1.0}, {"radius": "1"}):
        with pytest.raises(SetupError):
            Population(**({"radius": 1.0, "count": 1} | bad))


def test_seeds_populations_and_microstructures(spark):
    assert W.seed_of([1, 2]) == ((1, 2), ()) and W.seed_of(np.random.SeedSequence([4, 5], spawn_key=(6,))) == ((4, 5), (6,))
    assert W.seed_label(((1, 2), (3,))) == "1,2/3"
    for bad in ([], [1, -1], [1, True], "7", 1.0):
        with pytest.raises(SetupError):
            W.seed_of(bad)
    pops = populations_of([Population(0.5, 0), Population(0.1, 9, 2.0)], [3, 2])
    assert [p.count for p in pops] == [3, 2] and populations_of(Population(0.5, 0), 4)[0].count == 4
    with pytest.raises(SetupError):
        populations_of([], [])
    domain = Domain(5.0)
    columns = ("cx", "cy", "cz", "ux", "uy", "uz", "length", "radius")
    held = lambda df: [[r[c] for c in columns] for r in df.orderBy("idx").collect()]
    by_seed = held(microstructure(spark, domain, pops, seed=[7, 8]))
    assert by_seed == held(microstructure(spark, domain, pops, rng=np.random.default_rng([7, 8]))) and len(by_seed) == 5
    with pytest.raises(SetupError):
        microstructure(spark, domain, pops, 1, np.random.default_rng(1))


def test_entry_without_the_pipeline():
    import __spark_entry__ as e

    assert "spanning_components" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_windings_of_prefixes_in_one_pass(spark):
    class Slow:
        """The same model, asked count by count."""

        def __init__(self, model):
            self.model, self.domain = model, model.domain

        def outcomes(self, particles):
            return self.model.outcomes(particles)

    model = W.Model(Domain(6.0, True), 0.1, 2, "periodic_wrap")
    for fixed in ([], [Population(0.6, 12)]):
        counts = [W.nested_successes(spark, m, Population(0.8, 0), fixed, [4, 9, 14, 20, 30], 200, 5) for m in (model, Slow(model))]
        assert counts[0] == counts[1] and counts[0][0] < counts[0][-1]


def test_exact_sums(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=3000) * np.exp2(rng.integers(-1000, 900, 3000).astype(float)), [1e308, -1e308, 5e-324, -5e-324, 0.0, -0.0, 2.0**60, 2.0**-60], rng.choice([0.1, 0.7, -0.3], 1000)])
    rows = [(int(i % 3), float(v)) for i, v in enumerate(x)] + [(7, None), (8, 1.0), (8, math.inf), (9, math.nan), (None, 0.1), (None, 0.2)]
    table = spark.createDataFrame(rows, "k int, x double")
    want = {k: math.fsum(v for g, v in rows if g == k) for k in range(3)} | {8: math.inf, None: math.fsum([0.1, 0.2])}
    for parts in (1, 5, 40):
        found = {r.k: r.total for r in sums.exact_sums(table.repartition(parts), ["k"], {"total": F.col("x")}).collect()}
        assert {k: found[k] for k in want} == want and found[7] is None and math.isnan(found[9])
    whole = sums.exact_sums(table.where("k < 3"), [], {"a": F.col("x"), "b": -F.col("x")}).first()
    assert (whole.a, whole.b) == (math.fsum(x.tolist()), -math.fsum(x.tolist()))
    assert tuple(sums.exact_sums(table.limit(0), [], {"a": F.col("x")}).first()) == (None,)
    assert spark.range(1).select(G.safe_product(F.lit(1e300), F.lit(1e-300), F.lit(1e200))).first()[0] == pytest.approx(1e200)
    for bad in ((1e300, 1e300), (1e-300, 1e-300)):
        with pytest.raises(Exception, match="beyond the range"):
            spark.range(1).select(G.safe_product(*(F.lit(v) * (F.col("id") + 1) for v in bad))).collect()


def test_link_fits_of_many_keys(spark):
    rng, rows = np.random.default_rng(3), []
    for key in range(4):
        for x in range(8):
            rows.append((key, float(x), int(rng.binomial(50, 1 / (1 + np.exp(2.0 - (0.4 + 0.2 * key) * x)))), 50))
    rows += [(9, float(x), 50 * (x > 3), 50) for x in range(8)]  # separable
    table = spark.createDataFrame(rows, "k int, x double, hits int, n int").repartition(3)
    for link in ("logistic", "probit"):
        found = {r.k: r for r in stats.fit_links(table, ["k"], "x", "hits", "n", link, rounds=25).collect()}
        for key in range(4):
            own = [r for r in rows if r[0] == key]
            one = stats.fit_link([r[1] for r in own], [r[2] for r in own], [r[3] for r in own], link)
            r = found[key]
            assert r.converged and (r.intercept, r.slope, r.log_likelihood) == pytest.approx((one["intercept"], one["slope"], one["log_likelihood"]), abs=1e-7)
        assert not found[9].converged


def test_functions_for_sql(spark):
    assert "lattice_images" in register(spark)
    got = spark.sql("select * from lattice_images(3.5D, 1D, -4D, 8D, 0D, 1D, -4D, cast(null as double), 0D, 1D, -4D, 8D, 0D)").collect()
    assert sorted(map(tuple, got)) == [(-1, 0, 0), (0, 0, 0)]
    assert spark.sql("select wrapped(5D, -4D, 8D), lattice_step(5D, -4D, 8D), minimum_image(5D, 8D), sphere_gap(0D, 0D, 0D, 1D, 3D, 4D, 0D, 1D)").first() == (-3.0, -1, -3.0, 3.0)


def test_one_search_for_all_axes(spark, monkeypatch):
    p = generate(trial_keys(spark, 3), Domain(6.0, True), [Population(0.7, 40), Population(0.2, 10, 2.0)], 5).persist()
    law, calls, find = T.Law(1.0, 0.3, 0.2), [], C.find_contacts
    apart = {(r.realization_id, r.axis): r.conductance for k in range(3) for r in T.solve(T.resistors(p, Domain(6.0, True), law, k)).collect()}
    monkeypatch.setattr(C, "find_contacts", lambda *a, **k: calls.append(1) or find(*a, **k))
    found = {(r.realization_id, r.axis): r.conductance for r in T.conductivity(p, Domain(6.0, True), law, ("x", "y", "z")).collect()}
    assert found == apart and len(calls) == 1 and any(found.values())
    large = T.solve_any(T.resistors(p.where("realization_id = 0"), Domain(6.0, True), law, 0), 1.0, 5).first()
    assert large.conductance == pytest.approx(apart[0, "x"], rel=1e-8)
    p.unpersist()


def test_exact_segments(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, rng.uniform(-2, 2, 12))) for _ in range(300)]
    rows += [tuple(map(float, rng.integers(-2, 3, 12))) for _ in range(200)]  # touching, parallel and degenerate ones
    rows += [
        (0.0, 0.0, 0.0, 1e9, 0.0, 0.0, 0.0, 1.0, 0.0, 1e9, 1.0 + 1e-7, 0.0),  # nearly parallel
        (0.0, 0.0, 0.0, 1e9, 0.0, 0.0, 5e8, -1e-8, 0.0, 5e8, 1e-8, 0.0),  # crossing
        (1e300, 0.0, 0.0, 1e300, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ]
    names = [f"{p}{a}" for p in "abcd" for a in "xyz"]
    at = lambda p: tuple(F.col(f"{p}{a}") for a in "xyz")
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names))
    held = {r.i: r for r in segments.segment_gaps(table, at("a"), at("b"), at("c"), at("d")).collect()}
    for i, r in enumerate(rows[:-1]):
        assert held[i].gap == pytest.approx(segments.rational_distance(*r), rel=1e-9, abs=1e-12)
    assert held[500].gap == 1.0 and held[501].gap == 0.0 and held[502].gap == pytest.approx(1e300)
    assert sum(held[i].exact for i in range(300)) <= 6 and all(held[i].exact for i in (500, 501))
    hits = {r.i: r.meets for r in segments.segment_box_hits(table.where("i < 500"), at("a"), at("b"), at("c"), tuple(F.abs(x) for x in at("d"))).collect()}
    for i, r in enumerate(rows[:500]):
        assert hits[i] is segments.rational_hit(*r[:9], *map(abs, r[9:]))
    empty = segments.segment_gaps(table.where("i = 0").withColumn("ax", F.lit(None).cast("double")), at("a"), at("b"), at("c"), at("d")).first()
    assert empty.gap is None
