"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

*Cells.* Centers are fitted by spherical k-means on a bounded sample; every vector's home is the cell of its nearest
center. Vectors are compared within ``(label, length, cell)`` only. So that no link across a border is lost, a
vector also visits those lower-numbered cells that can hold a partner: if its cosine with its own center
exceeds that with the other by more than the tangent bound of the angle lets a partner make good, or its angle to the other center is beyond
the cell's radius and the angle together, no partner lives there. Visitors are compared with the cell's residents, not with each
other, so each pair meets once. With ``slack=1`` the bounds are certain and all links are found; a smaller
``slack`` shortens them, for fewer visits at some loss of links.

*Blocks.* A cell's vectors are dealt into blocks by hash, and each pair of blocks is a task's key; small cells share keys.
Pairs never become rows: a pair of blocks gives each vector's number of links and a forest that spans the links.

*Hot groups.* Equal vectors of a label are one node before anything is compared, their rows are weights.

Cases: a vector that is null, empty, all zeros or holds null, NaN or infinite components, or whose label is null, links with nothing;
vectors of different lengths link with nothing; rows with equal ids are rows of their own; null ids take part and
are never the least id; a group without any id has a null ``component_id``, and then all its rows are kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from porespan.llm.memory import frugal
from porespan.operators.graph import connected_components
from porespan.session import discard, materialize

#: Vectors of the largest label that a cell holds on average, and the most cells (their centers are broadcast).
CELL_ROWS, MAX_CELLS = 2048, 1024
#: Vectors that centers are fitted on, at most, and rounds of k-means.
FIT_ROWS, FIT_ROUNDS = 20_000, 8
#: Vectors of a block, and of a product within it.
BLOCK, TILE = 4096, 1024
#: Broadcast no more than this many rows of a few numbers, or components of vectors.
BROADCAST_ROWS, BROADCAST_COMPONENTS = 250_000, 4_000_000
EPS = 1e-9


def is_comparable(vector: Column) -> Column:
    """Whether a vector has a direction: components, none null or not finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centers(vectors: DataFrame, k: int, fit_rows: int = FIT_ROWS, seed: int = 42) -> np.ndarray:
    """``k`` unit centers (or fewer) from the ``fit_rows`` vectors of least hash; ``vectors`` has ``node, vector``, all of one length."""
    some = vectors.orderBy(F.xxhash64("node"), "node").limit(fit_rows)
    greatest = F.array_max(F.transform("vector", F.abs)).cast("double")
    some = some.select(array_to_vector(F.transform("vector", lambda x: x.cast("double") / greatest)).alias("features"))
    kmeans = KMeans(k=k, maxIter=FIT_ROUNDS, seed=seed, distanceMeasure="cosine", initMode="random")
    centers = np.array(kmeans.fit(some).clusterCenters())
    norm = np.linalg.norm(centers, axis=1)
    return centers[norm > 0] / norm[norm > 0, None]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def visits(cosines: np.ndarray, home: np.ndarray, centers: np.ndarray, radius: np.ndarray, angle: float, slack: float = 1.0) -> np.ndarray:
    """(rows, cells) marks of the lower-numbered cells in which a partner within ``angle`` of a row can live.

    ``cosines`` are those of rows and centers, ``radius`` the greatest angle of a resident to its center, negative where there is none.
    """
    apart = np.sqrt(np.maximum(0, 2 - 2 * centers @ centers.T))
    lead = cosines[np.arange(len(home)), home][:, None] - cosines
    near = lead <= slack * np.sin(angle) * apart[home] + EPS
    within = np.arccos(np.clip(cosines, -1, 1)) <= radius + slack * angle + EPS
    return near & within & (radius >= 0) & (np.arange(len(centers)) < home[:, None])


def block_links(x: np.ndarray, part: np.ndarray, resident: np.ndarray, rows: np.ndarray, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked, root): weight of partners of each row, and the least row of its links' component, by pairs of blocks i and j.

    Two visitors aren't compared.
    """
    norm, linked, root = _norms(x), np.zeros(len(x), np.int64), np.arange(len(x))
    first, second = np.flatnonzero(part == i), np.flatnonzero(part == j)
    left, right = [], []
    for lo in range(0, len(first), TILE):
        a = first[lo : lo + TILE]
        for at in range(lo if i == j else 0, len(second), TILE):
            b = second[at : at + TILE]
            cosine = (x[a] @ x[b].T) / np.outer(norm[a], norm[b])
            hit = cosine >= threshold
            # products of blocks round differently from block to block: pairs at the threshold are decided one by one
            r, c = np.nonzero(np.abs(cosine - threshold) < 1e-12)
            for u, v in zip(r.tolist(), c.tolist(), strict=True):
                hit[u, v] = float(np.sum(x[a[u]] * x[b[v]]) / (norm[a[u]] * norm[b[v]])) >= threshold
            if i == j and at == lo:
                hit &= a[:, None] < b
            hit &= resident[a][:, None] | resident[b]
            if not hit.any():
                continue
            linked[a] += hit @ rows[b]
            linked[b] += rows[a] @ hit
            r, c = np.nonzero(hit)
            r, c = a[r], b[c]
            keep = _forest(r, c, len(x))
            left.append(r[keep])
            right.append(c[keep])
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for end in (a, b):
                np.minimum.at(new, end, low)
                np.minimum.at(new, root[end], low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
    return linked, root


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of links that connect what all links connect."""
    root, kept = np.arange(n), []
    index = np.arange(len(a))
    while len(index):
        low, high = np.minimum(root[a[index]], root[b[index]]), np.maximum(root[a[index]], root[b[index]])
        index, low, high = index[low < high], low[low < high], high[low < high]
        tops, first = np.unique(high, return_index=True)
        kept.append(index[first])
        root[tops] = low[first]
        while not np.array_equal(root, root[root]):
            root = root[root]
    return np.concatenate(kept) if kept else index


def _placed(nodes: DataFrame, centers: np.ndarray, angle: float, slack: float) -> DataFrame:
    """Written ``(label, length, cell, resident, node, rows, vector)``: each node in its home cell, and where it visits."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(centers)
    length = centers.shape[1]
    kinds = [nodes.schema[c] for c in ("label", "length", "node", "rows", "vector")]

    def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return (batch.slice(lo, TILE) for lo in range(0, len(batch), TILE))

    def cosines(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _scaled(_matrix(batch.column(4)))
        all_ = (x / _norms(x)[:, None]) @ shared.value.T
        return all_, all_.argmax(axis=1)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(shared.value), np.inf)
        for batch in batches:
            for part in portions(batch):
                found, home = cosines(part)
                np.minimum.at(least, home, found[np.arange(len(home)), home])
        held = np.flatnonzero(least < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(least[held])], ["cell", "least"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                found, home = cosines(part)
                row, cell = np.nonzero(visits(found, home, shared.value, radius, angle, slack))
                at = pa.array(np.r_[np.arange(len(home)), row])
                live = np.r_[np.ones(len(home), bool), np.zeros(len(row), bool)]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns), pa.array(np.r_[home, cell]), pa.array(live)], [*(f.name for f in kinds), "cell", "resident"])

    columns = [f.name for f in kinds]
    own = nodes.where(F.col("length") == length).select(columns)
    radius = np.full(len(centers), -1.0)
    for r in own.mapInArrow(homes, "cell long, least double").groupBy("cell").agg(F.min("least").alias("least")).collect():  # a row a center
        radius[r.cell] = acos(max(-1.0, min(1.0, r.least)))
    schema = T.StructType([*kinds, T.StructField("cell", T.LongType()), T.StructField("resident", T.BooleanType())])
    other = nodes.where(F.col("length") != length).select(*columns, F.lit(0).cast("long").alias("cell"), F.lit(True).alias("resident"))
    return materialize(own.mapInArrow(frugal(place), schema).unionByName(other), "placed")


def _links(placed: DataFrame, threshold: float, block: int) -> DataFrame:
    """Written ``(node, root, linked)`` by pair of blocks."""
    cell = ["label", "length", "cell"]
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("n"), F.count(F.when(F.col("resident"), 1)).alias("live")).where("n > 1 and live > 0")
    sizes = materialize(sizes.select(*[F.col(c).alias(f"of_{c}") for c in cell], "n", F.ceil(F.col("n") / block).alias("blocks")), "sizes")
    groups = (sizes.where("blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // block + 1
    same = [F.col(c) == F.col(f"of_{c}") for c in cell]
    small = sizes.count() <= BROADCAST_ROWS
    held = placed.join(F.broadcast(sizes) if small else sizes, same)
    large = F.col("blocks") > 1
    key = F.xxhash64(*cell)
    held = held.withColumns({"large": large, "block": F.pmod(F.xxhash64("node"), "blocks"), "bucket": F.when(large, key).otherwise(F.pmod(key, F.lit(groups)))})
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = held.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "bucket", "large", *cell, "block", "resident", "node", "rows", "vector")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        of = np.zeros(len(table), np.int64)
        for c in cell:
            codes = table[c].combine_chunks().dictionary_encode().indices.to_numpy()
            of = np.unique(of * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        order = np.lexsort((table["node"].to_numpy(), of))
        table, of = table.take(pa.array(order)), of[order]
        node = table["node"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = table.slice(lo, hi - lo)
            x = _scaled(_matrix(part["vector"]))
            linked, root = block_links(x, part["block"].to_numpy(), part["resident"].to_numpy(zero_copy_only=False), part["rows"].to_numpy(), i, j, threshold)
            used = np.flatnonzero(linked > 0)
            out.append(pa.table({"node": node[lo:hi][used], "root": node[lo:hi][root[used]], "linked": linked[used]}))
        return pa.concat_tables(out)

    found = materialize(held.groupBy("bucket", "large", "i", "j").applyInArrow(run, "node long, root long, linked long"), "linked")
    discard(sizes)
    return found


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, slack: float = 1.0,
    cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, fit_rows: int = FIT_ROWS, block: int = BLOCK,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` of every row: rows of its label within ``threshold``, the least id they reach, and whether it stays.

    ``threshold`` is a cosine above 0. Links are decided in double precision.
    """
    if not 0 < threshold <= 1 or not 0 <= slack <= 1:
        raise ValueError("threshold must be in (0, 1], slack in [0, 1]")
    angle = min(acos(threshold), pi / 2)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    able = F.col("label").isNotNull() & is_comparable(F.col("vector"))
    nodes = rows.where(able).groupBy("label", "vector").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vector").alias("length"), "rows", "first", "vector"), "nodes")
    by_length = nodes.groupBy("label", "length").agg(F.count("*").alias("n"))
    usual = by_length.groupBy("length").agg(F.sum("n").alias("all"), F.max("n").alias("most")).orderBy(F.desc("all"), "length").first()
    if usual is None:
        cells, length = 1, 1
    else:
        cells, length = min(max_cells, -(-usual["most"] // cell_rows)), usual["length"]
    if cells > 1:
        centers = fit_centers(nodes.where(F.col("length") == length).select("node", "vector"), cells, fit_rows)
    else:
        centers = np.full((1, length), 1 / np.sqrt(length))
    placed = _placed(nodes, centers, angle, slack)
    linked = _links(placed, threshold, block)
    discard(placed)
    component = connected_components(linked, "node", "root")
    known = nodes.drop("vector").join(linked.groupBy("node").agg(F.sum("linked").alias("linked")), "node", "left").join(component, "node", "left")
    known = known.where("rows > 1 or component is not null").select("node", "rows", "first", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "node").alias("component"))
    known = materialize(known, "known")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    told = known.join(least, "component").select("node", (F.col("linked") + F.col("rows") - 1).alias("n_links"), "component_id")
    told = nodes.join(told, "node").select(F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), "n_links", "component_id", F.lit(True).alias("found"))
    told = materialize(told, "told")
    discard(nodes, linked, known)
    few = told.agg(F.coalesce(F.sum(F.size("of_vector") + 8), F.lit(0))).first()[0] <= BROADCAST_COMPONENTS
    out = rows.join(F.broadcast(told) if few else told, able & (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector")), "left")
    group = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), group.alias("component_id"), F.col("id").eqNullSafe(group).alias("kept"))


def keep_representatives(vectors: DataFrame, id_col: str = "vec_id", **options: object) -> DataFrame:
    """``vectors`` without the rows whose group holds a smaller id; all columns stay, rows that share the least id all stay."""
    found = near_vectors(vectors, id_col, **options)
    gone = found.where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    kept = found.where("kept").select(F.col(id_col).alias("__gone")).distinct()
    return vectors.join(gone.join(kept, "__gone", "left_anti"), F.col(id_col) == F.col("__gone"), "left_anti")
