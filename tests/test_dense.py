"""Many overlapping spheres: found in blocks, the same as by the join and by all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from porespan.operators import contacts as C
from porespan.operators import dense as D
from porespan.operators import large as L
from porespan.operators import percolation as P
from porespan.policy import Domain
from porespan.session import materialize
from porespan.sources.particles import SCHEMA, checked


def spheres(spark, n, seed, parents=0, width=9.0):
    rng = random.Random(seed)
    rows = [(0, i, *(rng.uniform(-width, width) for _ in range(3)), rng.choice((0.3, 0.5, 0.8)), str(rng.randrange(parents)) if parents and rng.random() < 0.5 else None) for i in range(n)]
    return checked(spark.createDataFrame(rows, "realization_id long, idx int, cx double, cy double, cz double, radius double, parent_id string"))


def keys(contacts):
    return sorted((r.i, r.j, r.sx, r.sy, r.sz) for r in contacts.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(C, "MANY", 1)
    monkeypatch.setattr(D, "LEAST", 60)
    monkeypatch.setattr(D, "SIDE", 70)


@pytest.mark.parametrize("flags", [(False, False, False), (True, False, True), (True, True, True)])
def test_f2_all_pairs_in_blocks(spark, small, monkeypatch, flags):
    """Both searches in blocks find what they found by joins; a contact that one misses or repeats is counted."""
    p, d = spheres(spark, 250, 5, 30, 9.0 if any(flags) else 4.0), Domain(8.0, flags)
    a, b = C.cell_contacts(p, d, 0.1), C.theta_contacts(p, d, 0.1)
    monkeypatch.setattr(C, "MANY", 1 << 40)
    want = keys(C.cell_contacts(p, d, 0.1))
    assert keys(a) == keys(b) == want and len(want) > 200
    assert C.different_contacts(a, b) == 0
    less, more = a.where("i <> 7 or j > 100"), a.unionByName(a.where("i = 9"))
    assert C.different_contacts(less, b) == C.different_contacts(b, less) == sum(i == 7 and j <= 100 for i, j, *_ in want)
    assert C.different_contacts(more, a) == sum(i == 9 for i, *_ in want) > 0


def test_f3_f10_paths_without_lists_of_contacts(spark, small, monkeypatch):
    asked = []
    monkeypatch.setattr(D, "contacts", lambda *a: asked.append(a))
    monkeypatch.setattr(C, "_contacts", lambda *a: asked.append(a))
    p, d = spheres(spark, 500, 6, width=4.0), Domain(8.0)
    many = L.face_percolations(p, d, 0.1, (0, 1, 2))
    depth = P.spanning_depth(p, d, 0.1)
    assert not asked
    monkeypatch.undo()
    for k, found in enumerate(many):
        one, two = P.analyze_percolation(p, d, 0.1, k).first(), found.first()
        assert (one.percolates, one.n_nodes, one.n_components, len(one.path)) == (two.percolates, two.n_nodes, two.n_components, len(two.path))
        touch = {r[:2] for r in keys(C.cell_contacts(p, d, 0.1))}
        assert all((min(x, y), max(x, y)) in touch for x, y in zip(two.path, two.path[1:], strict=False))
        if k == 0:
            assert depth == len(one.path) > 2


def test_f4_windings_from_stars(spark, small, monkeypatch):
    asked = []
    monkeypatch.setattr(D, "contacts", lambda *a: asked.append(a))
    monkeypatch.setattr(C, "_contacts", lambda *a: asked.append(a))
    d, seen, tables = Domain(8.0, True), set(), [spheres(spark, n, n, 20) for n in (30, 90, 250)]
    all_found = [[x.first() for x in L.winding_percolations(p, d, 0.1, (0, 1, 2))] for p in tables]
    assert not asked
    monkeypatch.undo()
    for p, found in zip(tables, all_found, strict=True):
        for k in range(3):
            one = P.analyze_percolation(p, d, 0.1, k, "periodic_wrap").first()
            assert (one.percolates, one.n_components) == (found[k].percolates, found[k].n_components)
            assert not one.percolates or found[k].winding[k] > 0
            seen.add(one.percolates)
    assert seen == {True, False}


@pytest.mark.parametrize("size", [8.0, 2.5])
def test_f7_nearest_of_touching_images(spark, size):
    """As the search over all images finds it; in the narrow box several images of a pair touch."""
    p, d = spheres(spark, 40, 7), Domain(size, True)
    found = {(r.i, r.j): (round(r.gap, 9), r.sx, r.sy, r.sz, r.images) for r in C.nearest_contacts(p, d, 0.1).collect()}
    pairs = C.cell_contacts(p, d, 0.1).groupBy("realization_id", "i", "j").agg(F.count("*").alias("images"))
    near = C.nearest_images(pairs, p, d).join(pairs, ["realization_id", "i", "j"])
    assert found == {(r.i, r.j): (round(r.gap, 9), r.sx, r.sy, r.sz, r.images) for r in near.collect()} and found
    assert (max(v[4] for v in found.values()) > 1) is (size < 3)


def test_f8_degrees_by_cells(spark, small):
    p, d = spheres(spark, 250, 8, 30), Domain(8.0, True)
    ends = C.cell_contacts(p, d, 0.1).select(F.explode(F.array("i", "j")).alias("idx"), "gap").groupBy("idx")
    want = ends.agg(F.count("*").alias("degree"), F.count_if(F.col("gap") == 0).alias("overlaps"), F.max("gap").alias("widest")).collect()
    found = D.degrees(p, d, 0.1).drop("realization_id").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(want) > 200


def test_cylinders_keep_the_join(spark, small):
    row = lambda i, x, shape: (0, i, shape, x, 0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 0.5, None, None, None, None)
    p = checked(spark.createDataFrame([row(0, 0.0, "sphere"), row(1, 1.0, "cylinder"), row(2, 5.0, "sphere")], SCHEMA))
    assert keys(C.cell_contacts(p, Domain(20.0), 0.1)) == keys(C.theta_contacts(p, Domain(20.0), 0.1)) == [(0, 1, 0, 0, 0)]
    assert [tuple(r)[1:4] for r in D.degrees(p, Domain(20.0), 0.1).orderBy("idx").collect()] == [(0, 1, 1), (1, 1, 1)]


def test_f5_joins_of_many_bodies_are_no_broadcasts(spark, monkeypatch):
    """Their files are small where lines repeat, so sizes of files would have them broadcast."""
    p = spark.range(3000).selectExpr("id div 3 as realization_id", "cast(id % 3 as int) as idx", "double(id % 3) as cx", "0D as cy", "0D as cz", "1D as radius")
    p = materialize(checked(p), "trials")
    links = lambda: P.face_links(p, Domain(10.0), 0.5, 0, False, "cell_list", C.POLICY)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = links()
    monkeypatch.setattr(C, "BROADCAST_BODIES", 1000)
    many = links()
    assert "BroadcastHashJoin" in plan(few) and "BroadcastHashJoin" not in plan(many) and "SortMergeJoin" in plan(many)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
