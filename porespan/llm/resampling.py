"""Importance resampling towards a target distribution, over hashed n-gram features.

Identical texts are collapsed by grouping on the full text (its SHA-256 beside it keeps the keys of later joins short). The features of each distinct text
are computed once, as counts of buckets; its multiplicity multiplies them in the corpus's counts. A bucket's gain is the logarithm of
its smoothed share in the target over that in the corpus, in thousandths; a text's weight is the floored mean gain of its features. Weights are
joined back to the documents by digest, and noise of each document's own (a Gumbel variate from a hash of its id) makes
the greatest scores a sample without replacement in proportion to the weights' exponentials.

*Scale.* Texts are shuffled once, by digest, after copies within a task have been combined. Gains are one number a bucket, so they are
bounded by ``buckets`` and travel with the tasks. Scores are whole numbers whose range logarithms of counts bound, so their histogram has at most
some hundred thousand rows whatever the input: it gives the cut and the ranks' starts, and the ties of each score are ranked as groups of their own.

Cases: a null text has no features (weight 0), like a text without words; a null id is the word ``null`` in the noise and comes last among ties; equal ids
draw the same noise, their ties go by the text's digest, and rows that repeat both have ranks in any order; extra columns are ignored; without
documents the result is empty; an empty target counts zero everywhere. Features are case-blind for ASCII letters only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porespan.llm.memory import frugal
from porespan.llm.words import ALNUM, LOWER, chunks, spans, text_buffers
from porespan.session import discard, materialize

BUCKETS = 10_000
#: Words and n-grams of more bytes than this are hashed one by one.
LONG_WORD = 48
UNSIGNED = 2.0**32

_byte = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _byte = np.where(_byte & 1, (_byte >> 1) ^ np.uint32(0xEDB88320), _byte >> 1)  # the reflected polynomial of CRC-32
CRC_TABLE = _byte


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of spans, a byte of all of them at a time; long spans by zlib."""
    state, length = state.copy(), ends - starts
    long = np.flatnonzero(length > LONG_WORD)
    for i in long.tolist():
        state[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    live = np.flatnonzero((length > 0) & (length <= LONG_WORD))
    at = 0
    while len(live):
        state[live] = CRC_TABLE[(state[live] ^ data[starts[live] + at]) & 0xFF] ^ (state[live] >> 8)
        at += 1
        live = live[length[live] > at]
    return state


def feature_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(unsigned CRC-32, text index) of all runs of ``least`` to ``most`` words of a text, joined by one space."""
    n = len(starts)
    state, found, of = np.full(n, 0xFFFFFFFF, np.uint32), [], []
    for k in range(1, most + 1):
        m = max(0, n - k + 1)
        state = state[:m]
        if k > 1:
            state = CRC_TABLE[(state ^ 32) & 0xFF] ^ (state >> 8)
        state = _crc_on(state, data, starts[k - 1 :][:m], ends[k - 1 :][:m])
        if k >= least:
            whole = text[:m] == text[k - 1 :][:m]
            found.append(~state[whole])
            of.append(text[:m][whole])
    return np.concatenate(found), np.concatenate(of)


def batch_features(column: pa.Array, buckets: int, least: int = 1, most: int = 1) -> Iterator[tuple[int, int, np.ndarray, pa.ListArray, pa.ListArray]]:
    """(first text, last text, words, buckets, counts) for portions of an Arrow column of texts; buckets of a text ascend."""
    data, offsets = text_buffers(column)
    for first, last in chunks(offsets):
        base, n = offsets[first], last - first
        part = LOWER[data[base : offsets[last]]]
        starts, ends, text = spans(part, offsets[first : last + 1] - base, ALNUM)
        words = np.bincount(text, minlength=n)
        crc, of = feature_hashes(part, starts, ends, text, least, most)
        code, count = np.unique(of * buckets + (crc % np.uint32(buckets)).astype(np.int64), return_counts=True)
        cuts = pa.array(np.searchsorted(code, np.arange(n + 1) * buckets), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((code % buckets).astype(np.int32), count.astype(np.int64))]
        yield first, last, words, *lists


def distinct_features(texts: DataFrame, text_col: str, buckets: int, least: int, most: int) -> DataFrame:
    """``(digest, rows, words, buckets, counts)`` of each distinct text that isn't null."""
    held = texts.where(F.col(text_col).isNotNull()).select(digest_of(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    held = held.groupBy("digest", "text").agg(F.count("*").alias("rows")).select("digest", "rows", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, bucket, count in batch_features(batch.column(2), buckets, least, most):
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(words, pa.int64()), bucket, count], ["digest", "rows", "words", "buckets", "counts"])

    return held.mapInArrow(frugal(run), "digest string, rows long, words long, buckets array<int>, counts array<long>")


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def bucket_counts(features: DataFrame) -> DataFrame:
    """``(bucket, n)``: features of all rows, copies counted, in each bucket that has any."""
    each = features.select("rows", F.inline(F.arrays_zip("buckets", "counts")))
    return each.groupBy(F.col("buckets").alias("bucket")).agg(F.sum(F.col("rows") * F.col("counts")).alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket in thousandths, from two tables ``(bucket, n)``; both have at most ``buckets`` rows."""
    total = lambda t: int(t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    s, t = total(corpus), total(target)
    both = corpus.join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    share = ((F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(float(s + buckets))) / ((F.col("n") + 1).cast("double") * F.lit(float(t + buckets)))
    gains = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain")).collect():
        gains[r.bucket] = r.gain
    return gains


def text_weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """``(digest, words, n_features, weight)``: the floored mean gain of a text's features."""
    shared = features.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, count = batch.column(2), batch.column(3)
            length = bucket.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(length)), length)
            k = count.flatten().to_numpy()
            n, total = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            np.add.at(n, of, k)
            np.add.at(total, of, k * shared.value[bucket.flatten().to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], ["digest", "words", "n_features", "weight"])

    return features.select("digest", "words", "buckets", "counts").mapInArrow(run, "digest string, words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths from a hash of the seed and an id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(UNSIGNED))))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... of the ``percent`` of eligible rows of greatest ``score``, ties to the lesser ``doc_id``; else null.

    ``scored`` is read three times, so it should be a written table.
    """
    levels = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()  # whole thousandths of logarithms: a bounded range
    levels = sorted((-r.score, r.n) for r in levels)
    draw, before, starts = percent * sum(n for _, n in levels) // 100, 0, []
    for score, n in levels:
        if before >= draw:
            break
        starts.append((-score, before))
        before += n
    spark = scored.sparkSession
    drawn = scored.where(eligible).join(F.broadcast(spark.createDataFrame(starts, "score long, before long")), "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    drawn = drawn.withColumn("rank", F.col("before") + F.row_number().over(order)).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).drop("before")
    cut = starts[-1][0] if starts else None
    rest = ~eligible | (F.col("score") < cut) if cut is not None else F.lit(True)
    return drawn.unionByName(scored.where(rest).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, ngrams: tuple[int, int] = (1, 1),
    least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """``(id_col, n_features, weight, score, rank)`` of every row of ``docs``; ``rank`` is null for rows that aren't drawn.

    Rows of at least ``least_words`` words take part in the draw of ``percent`` of their number.
    """
    features = materialize(distinct_features(docs, text_col, buckets, *ngrams), "features")
    wanted = materialize(bucket_counts(distinct_features(target, target_col, buckets, *ngrams)), "target")
    counts = materialize(bucket_counts(features), "counts")
    weights = text_weights(features, bucket_gains(counts, wanted, buckets))
    rows = docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))
    zero = F.lit(0).cast("long")
    rows = rows.join(weights, "digest", "left").select("doc_id", "digest", *[F.coalesce(c, zero).alias(c) for c in ("words", "n_features", "weight")])
    scored = materialize(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    discard(features, wanted, counts)
    out = ranked(scored, F.col("words") >= least_words, percent)
    return out.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")


def resampled_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns (rows that share an id that is drawn all stay)."""
    drawn = importance_resample(docs, target, id_col, **options).where("rank is not null").select(F.col(id_col).alias("__drawn")).distinct()
    return docs.join(drawn, F.col(id_col).eqNullSafe(F.col("__drawn")), "left_semi")
