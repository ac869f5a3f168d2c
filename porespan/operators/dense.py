"""Contacts of many spheres that overlap: pairs outnumber bodies by far, so they are found in blocks of numbers, and are rows only if they are asked for.

Bodies are dealt into the cells of ``contacts`` as there, but into larger ones; a cell's bodies are one group. A block of them is compared with all bodies of the cell within
reach by one matrix product, which rules out what lies clearly apart; all other pairs are decided by the formulas of ``contacts``. Cylinders stay there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespan.functions import geometry as G
from porespan.operators import contacts as C
from porespan.policy import Domain, Policy, TrialError
from porespan.session import discard, materialize

#: Bodies of a cell: a sixteenth of a realization, within these bounds; those of a block; numbers of a product.
LEAST, MOST, SHARE, BLOCK, NUMBERS = 4096, 32768, 16, 64, 1 << 19
#: Bodies of a block of the comparison of all pairs; tasks at most, and those of a round of a search.
SIDE, TASKS, ROUND_TASKS = 8192, 512, 64
#: Rows of a batch of pairs.
ROWS = 1 << 16
KEYS = ("realization_id", "cell")
COLUMNS = ("idx", "radius", "parent_id", *(f"{x}{a}" for x in ("c", "b", "turn", "low", "high", "from", "to") for a in G.AXES))
CONTACT = "realization_id long, i int, j int, sx long, sy long, sz long, gap double"


def dealt(particles: DataFrame, domain: Domain, threshold: float, policy: Policy, summary: tuple | None = None) -> DataFrame | None:
    """``(realization_id, cell, COLUMNS)``: spheres by the cells that their padded boxes reach; none if there are cylinders."""
    reach, total, largest, cylinders = summary or C._summary(particles)
    if cylinders:
        return None
    pad = (threshold + policy.tolerance(max(reach, threshold))) / 2
    cells = C._fitted(particles, domain, pad, total, largest, min(max(LEAST, largest // SHARE), MOST))
    rows = C._dealt(particles, "i", domain, pad, cells).select(*KEYS, *[F.col(f"i_{c}").alias(c) for c in COLUMNS])
    # a cell is much work on few bytes: as many partitions as cells, whatever their size
    return rows.repartition(max(1, min(TASKS, int((cells.axis < 0).sum()))), *KEYS)


class Bodies:
    """Rows of spheres as numbers, in order of space."""

    def __init__(self, table: pa.Table, domain: Domain, threshold: float, policy: Policy, extra: tuple[str, ...] = ()):
        take = lambda c: table[c].to_numpy()
        self.domain, self.threshold, self.policy = domain, threshold, policy
        size = np.array(domain.size)[:, None]
        center, turn = np.stack([take(f"c{a}") for a in G.AXES]), np.stack([take(f"turn{a}") for a in G.AXES])
        at = center - turn * size
        order = self._order(at)
        self.at, self.center, self.turn = at[:, order], center[:, order], turn[:, order]
        self.idx, self.radius, self.base = take("idx")[order], take("radius")[order], np.stack([take(f"b{a}") for a in G.AXES])[:, order]
        parent = table["parent_id"].combine_chunks()
        self.parent = None if parent.null_count == len(parent) else parent.dictionary_encode().indices.fill_null(-1).to_numpy()[order]
        if "lowx" in table.column_names:
            self.low = np.stack([take(f"low{a}") for a in G.AXES])[:, order]
            self.start, self.stop = ([take(f"{x}{a}")[0] for a in G.AXES] if len(order) else [0.0] * 3 for x in ("from", "to"))
        self.extra = {c: take(c)[order] for c in extra}
        # |a - b|^2 - (r + s)^2 as one product of six numbers each, about the middle of all
        middle = at.mean(axis=1, keepdims=True) if len(order) else np.zeros((3, 1))
        x, top = self.at - middle, float(self.radius.max(initial=0.0))
        wide = 2 * top + threshold
        self.more = threshold + 2 * (policy.absolute + policy.relative * (4 * wide + 4))
        r = self.radius + self.more
        with np.errstate(over="ignore", invalid="ignore"):
            square = (x**2).sum(axis=0)
            self.left = np.stack([*x, r, square - r**2, np.ones(len(r))], axis=1)
            self.right = np.stack([*(-2 * x), -2 * self.radius, np.ones(len(r)), square - self.radius**2], axis=1)
            scale = np.abs(at).max(initial=0.0) + wide
            self.slack = 2.0**-44 * scale**2
        self.reach = top + self.more + 2.0**-44 * scale

    @staticmethod
    def _order(at: np.ndarray) -> np.ndarray:
        n = at.shape[1]
        if n < 2:
            return np.arange(n)
        low, high = at.min(axis=1, keepdims=True), at.max(axis=1, keepdims=True)
        parts = max(1, round((n / BLOCK) ** (1 / 3)))
        with np.errstate(invalid="ignore", divide="ignore"):
            place = np.nan_to_num(np.floor((at - low) / (high - low) * parts))
        return np.lexsort((place[2], place[1], place[0]))

    def near(self, rows: np.ndarray | None = None, others: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that aren't clearly apart, in portions: of ``rows`` with ``others``, or each pair of all once."""
        once = rows is None
        rows = np.arange(len(self.idx)) if once else rows
        for lo in range(0, len(rows), BLOCK):
            own = rows[lo : lo + BLOCK]
            some = rows[lo:] if once else others
            far = self.radius[own].max() + self.reach
            for k in range(3):
                x = self.at[k, own]
                some = some[(self.at[k, some] >= x.min() - far) & (self.at[k, some] <= x.max() + far)]
            step = NUMBERS // BLOCK
            for first in range(0, len(some), step):
                part = some[first : first + step]
                with np.errstate(over="ignore", invalid="ignore"):
                    a, b = np.nonzero(~(self.left[own] @ self.right[part].T > self.slack))
                a, b = own[a], part[b]
                yield (a[a < b], b[a < b]) if once else (a, b)

    def touching(self, a: np.ndarray, b: np.ndarray, here: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, gap) of the given pairs that touch, the lesser idx first; ``here``: only in the cell that holds the low corner of what both boxes share."""
        if here:
            for k in range(3):
                corner = np.maximum(self.low[k, a], self.low[k, b])
                keep = (corner >= self.start[k]) & (corner < self.stop[k])
                a, b = a[keep], b[keep]
        order = self.idx[a] < self.idx[b]
        a, b = np.where(order, a, b), np.where(order, b, a)
        keep = self.idx[a] != self.idx[b]
        if self.parent is not None:
            keep &= (self.parent[a] < 0) | (self.parent[a] != self.parent[b])
        if not keep.all():
            a, b = a[keep], b[keep]
        apart = 0.0
        for k in range(3):
            there = self.center[k, b]
            if self.domain.periodic[k]:
                there = there + (self.turn[k, a] - self.turn[k, b]) * self.domain.size[k]
            apart = np.hypot(apart, self.center[k, a] - there)
        gap = np.maximum(apart - self.radius[a] - self.radius[b], 0.0)
        scale = np.maximum(np.maximum(apart, max(self.threshold, 1.0)), np.maximum(self.radius[a], self.radius[b]))
        keep = gap <= self.threshold + np.maximum(self.policy.absolute, self.policy.relative * scale)
        return a[keep], b[keep], gap[keep]

    def steps(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Lattice steps from a to b."""
        return [self.turn[k, a] - self.turn[k, b] + self.base[k, b] - self.base[k, a] for k in range(3)]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All contacts that belong to this cell."""
        for a, b in self.near():
            found = self.touching(a, b, here=True)
            if len(found[0]):
                yield found


def _by_cell(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``work`` on the rows of each cell, whose results go out in portions."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        for columns in work(table):
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else pa.array(np.full(len(columns[-1]), c)) for c in columns], [x.split()[0] for x in schema.split(", ")])

    return rows.groupBy(*keys).applyInArrow(run, schema)


def contacts(rows: DataFrame, domain: Domain, threshold: float, policy: Policy) -> DataFrame:
    """The contacts of ``dealt`` rows, as ``contacts.cell_contacts`` returns them."""

    def work(table: pa.Table) -> Iterator[list]:
        bodies, rid = Bodies(table, domain, threshold, policy), table["realization_id"][0].as_py()
        for a, b, gap in bodies.pairs():
            for lo in range(0, len(a), ROWS):
                i, j = a[lo : lo + ROWS], b[lo : lo + ROWS]
                yield [rid, bodies.idx[i], bodies.idx[j], *bodies.steps(i, j), gap[lo : lo + ROWS]]

    return _by_cell(rows, work, CONTACT)


def degrees(particles: DataFrame, domain: Domain, threshold: float, policy: Policy = C.POLICY) -> DataFrame:
    """``(realization_id, idx, degree, overlaps, widest)`` of bodies with contacts: their number, those without a gap, the greatest gap."""
    total = [F.sum("degree").alias("degree"), F.sum("overlaps").alias("overlaps"), F.max("widest").alias("widest")]
    if (rows := dealt(particles, domain, threshold, policy)) is None:
        ends = C.cell_contacts(particles, domain, threshold, policy).select("realization_id", F.explode(F.array("i", "j")).alias("idx"), "gap")
        return ends.groupBy("realization_id", "idx").agg(F.count("*").alias("degree"), F.count_if(F.col("gap") == 0).alias("overlaps"), F.max("gap").alias("widest"))

    def work(table: pa.Table) -> Iterator[list]:
        bodies, n = Bodies(table, domain, threshold, policy), len(table)
        degree, overlaps, widest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        for a, b, gap in bodies.pairs():
            apart = gap > 0
            for end in (a, b):
                degree += np.bincount(end, minlength=n)
                overlaps += np.bincount(end[~apart], minlength=n)
                np.maximum.at(widest, end[apart], gap[apart])
        used = degree > 0
        yield [table["realization_id"][0].as_py(), bodies.idx[used], degree[used], overlaps[used], widest[used]]

    return _by_cell(rows, work, "realization_id long, idx int, degree long, overlaps long, widest double").groupBy("realization_id", "idx").agg(*total)


def spanning_links(particles: DataFrame, domain: Domain, threshold: float, policy: Policy = C.POLICY) -> DataFrame:
    """``(realization_id, i, j, sx, sy, sz)``: links with the components and windings of all contacts, a star for each connected part of a cell; j lies at i plus the steps.

    Within a cell every body has its place, so all ways between two of its images there have the same steps.
    """
    if (rows := dealt(particles, domain, threshold, policy)) is None:
        return C.cell_contacts(particles, domain, threshold, policy).drop("gap")

    def work(table: pa.Table) -> Iterator[list]:
        bodies, root = Bodies(table, domain, threshold, policy), np.arange(len(table))
        for a, b in bodies.near():
            new = root[a] != root[b]
            a, b, _ = bodies.touching(a[new], b[new])
            while len(a):
                low = np.minimum(root[a], root[b])
                np.minimum.at(root, root[a], low)
                np.minimum.at(root, root[b], low)
                while not np.array_equal(root, root[root]):
                    root = root[root]
                new = root[a] != root[b]
                a, b = a[new], b[new]
        b = np.flatnonzero(root != np.arange(len(root)))
        a = root[b]
        yield [table["realization_id"][0].as_py(), bodies.idx[a], bodies.idx[b], *bodies.steps(a, b)]

    return _by_cell(rows, work, CONTACT.removesuffix(", gap double")).distinct()


def breadth_first(held: DataFrame, domain: Domain, threshold: float, policy: Policy, start: DataFrame, goal: DataFrame, max_depth: int = 10_000) -> list[int] | None:
    """As ``large.breadth_first`` over the contacts of written ``dealt`` rows of one realization with their ``node``, which needn't be listed: each round looks for open bodies that touch the last level's."""
    levels = [materialize(start.select("node", F.lit(None).cast("long").alias("parent")).distinct(), "level")]

    def work(table: pa.Table) -> Iterator[list]:
        bodies = Bodies(table, domain, threshold, policy, ("node", "last"))
        node, last = bodies.extra["node"], bodies.extra["last"].astype(bool)
        best = np.full(len(node), np.iinfo(np.int64).max)
        for a, b in bodies.near(np.flatnonzero(~last), np.flatnonzero(last)):
            i, j, _ = bodies.touching(a, b)
            open_, met = np.where(last[i], j, i), np.where(last[i], i, j)
            np.minimum.at(best, open_, node[met])
        used = best < np.iinfo(np.int64).max
        yield [node[used], best[used]]

    try:
        for _ in range(max_depth):
            met = levels[-1].join(goal, "node", "left_semi").agg(F.min("node")).first()[0]
            if met is not None:
                path = [met]
                for level in reversed(levels[1:]):
                    path.append(level.where(F.col("node") == path[-1]).first()["parent"])
                return path[::-1]
            seen = None
            for k, level in enumerate(levels):
                part = level.select("node", F.lit(k == len(levels) - 1).alias("last"))
                seen = part if seen is None else seen.unionByName(part)
            open_ = held.join(seen, "node", "left").where("last is null or last").withColumn("last", F.coalesce("last", F.lit(False)).cast("int"))
            found = _by_cell(open_.repartition(ROUND_TASKS, *KEYS), work, "node long, parent long")
            levels.append(materialize(found.groupBy("node").agg(F.min("parent").alias("parent")), "level"))
            if not levels[-1].limit(1).count():
                return None
    finally:
        discard(*levels)
    raise TrialError("path longer than max_depth")


def all_contacts(base: DataFrame, images: DataFrame, domain: Domain, threshold: float, policy: Policy, total: int) -> DataFrame:
    """The contacts of all pairs of ``base`` and ``images`` (placed spheres of ``contacts``; with the images' steps ``k*`` and the centres ``own*`` of their bodies): both in blocks, each pair of blocks a group."""
    n = -(-total // SIDE)
    keys = ("realization_id", "p", "q")
    zero = [F.lit(0).cast("long").alias(f"turn{a}") for a in G.AXES]
    body = ["idx", "radius", "parent_id", *(f"{x}{a}" for x in "cb" for a in G.AXES)]
    block, every = F.pmod(F.xxhash64("idx"), F.lit(n)), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select("realization_id", block.cast("int").alias("p"), every.alias("q"), *body, *zero, F.lit(1).alias("left"))
    # their bodies' own centres, and a turn of minus the step, put images where they are
    own = [F.col(c) for c in body[:3]] + [F.col(f"own{a}").alias(f"c{a}") for a in G.AXES] + [F.col(f"b{a}") for a in G.AXES]
    right = images.select("realization_id", every.alias("p"), block.cast("int").alias("q"), *own, *[(-F.col(f"k{a}")).alias(f"turn{a}") for a in G.AXES], F.lit(0).alias("left"))

    def work(table: pa.Table) -> Iterator[list]:
        bodies, rid = Bodies(table, domain, threshold, policy, ("left",)), table["realization_id"][0].as_py()
        own, others = np.flatnonzero(bodies.extra["left"] == 1), np.flatnonzero(bodies.extra["left"] == 0)
        if not len(own) or not len(others):
            return
        for a, b in bodies.near(own, others):
            keep = bodies.idx[a] < bodies.idx[b]
            i, j, gap = bodies.touching(a[keep], b[keep])
            for lo in range(0, len(i), ROWS):
                x, y = i[lo : lo + ROWS], j[lo : lo + ROWS]
                yield [rid, bodies.idx[x], bodies.idx[y], *bodies.steps(x, y), gap[lo : lo + ROWS]]

    return _by_cell(left.unionByName(right).repartition(min(TASKS, n * n), *keys), work, CONTACT, keys)
