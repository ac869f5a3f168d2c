"""Best-fit packing of tokenised documents by minimum bin slack.

*Pieces.* A document's ids and an end id make one piece; only those longer than a sequence are cut.

*Bins.* Minimum bin slack fills one bin after the other: the longest length that is left, and with it the
combination of lengths that fills the bin most, found by a subset-sum dynamic programme over a bitset of
reachable sums; what it takes is removed. A bin depends only on how many pieces of each length are left. So the
programme runs over the counts of at most ``capacity`` lengths, whatever the size of the corpus, and a
combination is repeated while its pieces last (the programme would find it again). There are at most
``capacity`` combinations until a length is exhausted each time.

*Placement.* Pieces of a length are numbered across the corpus (counts by length and hash bucket give the first
number of each bucket), and a table of combinations, small by the above, maps numbers to bins.

Cases: null and empty texts are a piece of the end id alone; repeated rows are packed each; equal lengths are
numbered by id, piece and checksum; null ids work like others; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from porespan.llm.encode import encoder
from porespan.llm.memory import frugal
from porespan.session import materialize

CAPACITY, END_ID = 2048, 0
#: Pieces of one length that a task numbers, about.
BUCKET_ROWS = 50_000
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for lo, hi, ids, ends in own.batches(batch.column(1)):
                starts = ends[:-1] + np.arange(hi - lo)
                stream = np.full(len(ids) + hi - lo, end_id, "<u4")
                keep = np.ones(len(stream), bool)
                keep[ends[1:] + np.arange(hi - lo)] = False
                stream[keep] = ids
                size = np.diff(ends) + 1
                n = -(-size // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                raw, at = memoryview(stream).cast("B"), starts[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(frugal(run), PIECES.format(id=docs.schema[id_col].dataType.simpleString()))


# ---------------------------------------------------------------- combinations


def fullest(left: dict[int, int], capacity: int, seed: int) -> dict[int, int]:
    """The combination of lengths with ``seed`` that fills a bin most; ``left`` counts the pieces of each length."""
    room, mask = capacity - seed, (1 << (capacity - seed + 1)) - 1
    sums, steps, done = 1, [], False
    for length in sorted((x for x in left if x <= room), reverse=True):
        n, k = min(left[length] - (length == seed), room // length), 1
        while n > 0 and not done:
            take = min(k, n)
            before, sums = sums, (sums | sums << (take * length)) & mask
            steps.append((before, length, take))
            n, k, done = n - take, 2 * k, bool(sums >> room & 1)
        if done:
            break
    at, used = sums.bit_length() - 1, {seed: 1}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= take * length
            used[length] = used.get(length, 0) + take
    return used


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """(pieces of each length in a bin, how many such bins), until all pieces are packed."""
    left = {k: n for k, n in counts.items() if n > 0}
    while left:
        used = fullest(left, capacity, max(left))
        times = min(left[k] // n for k, n in used.items())
        yield used, times
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]


def placements(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length rows (first number, bins' first id, offset in the bin, pieces of this length in a bin)."""
    given, out, bins = dict.fromkeys(counts, 0), {k: [] for k in counts}, 0
    for used, times in combinations(counts, capacity):
        offset = 0
        for length, n in used.items():
            out[length].append((given[length], bins, offset, n))
            given[length] += n * times
            offset += n * length
        bins += times
    return {k: np.array(v, np.int64) for k, v in out.items() if v}


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have at least ``doc_id, piece, length, ids_crc32``."""
    pieces = materialize(pieces, "pieces")
    buckets = max(1, -(-pieces.count() // bucket_rows))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    by_bucket = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = materialize(by_bucket.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "buckets")
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = pieces.sparkSession.sparkContext.broadcast(placements(counts, capacity))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("number", F.row_number().over(order) - 1).join(by_bucket.select("length", "bucket", "first"), ["length", "bucket"])
    numbered = numbered.select(*[c for c in pieces.columns if c != "bucket"], (F.col("first") + F.col("number")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                own = np.flatnonzero(length == k)
                rows = table.value[k]
                r = rows[np.searchsorted(rows[:, 0], number[own], "right") - 1]
                i = number[own] - r[:, 0]
                bins[own], offset[own] = r[:, 1] + i // r[:, 3], r[:, 2] + i % r[:, 3] * k
            names = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(bins), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = numbered.drop("number").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return numbered.mapInArrow(frugal(run), schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(token_pieces(docs, id_col, text_col, vocabulary, capacity, end_id), capacity)
