"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k least distinct 64-bit hashes of a text's word shingles (shorter if
there are fewer). The sketch of a union is the k least of both sketches' hashes, so sketches of parts
merge. From the k least hashes of a union, the share that both have estimates the resemblance; the k-th
least hash estimates how many distinct shingles there are, and both give the containment.

Cases: null text is empty; a text without words has an empty sketch (two empty ones resemble each other
fully, an empty and another one not at all); fewer than ``n`` words make one shingle; null ids come last in
the order of documents, equal ids are ordered by a hash of their text, and rows that repeat both id and text
count once as a neighbour and get equal results; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porespan.session import materialize

K, WORDS = 128, 5
SPACES = r"[ \t-\r]+"
TWO64 = float(2**64)


# ---------------------------------------------------------------- sketches


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text."""
    return F.transform(F.filter(F.split(F.lower(text), SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, n: int = WORDS) -> Column:
    """Hashes of all runs of n word hashes; of all words where there are fewer, none without words."""
    # the runs start at 0 .. size - n; past the end get() gives null, which xxhash64 leaves out
    last = F.greatest(F.size(hashes) - n, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))
    return F.when(F.size(hashes) > 0, runs).otherwise(F.array().cast("array<bigint>"))


def sketch(shingles: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Exact below k hashes; else k - 1 over the share of the hash range below the k-th."""
    share = (F.element_at(s, k).cast("double") + F.lit(TWO64 / 2)) / F.lit(TWO64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / F.greatest(share, F.lit(1 / TWO64)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two texts' shingle sets."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has as well."""
    union, own = distinct_count(merged(a, b, k), k), distinct_count(a, k)
    return F.when(own == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / F.greatest(own, F.lit(1.0))))


def as_text(s: Column) -> Column:
    """16 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merge_parts(parts: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K, fan: int = 64) -> DataFrame:
    """The sketch of all parts of a key. A hot key's parts are first merged in salted groups, so no task holds them all."""
    merge = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(sketch_col)))), 1, k).alias(sketch_col)
    now = parts.select(*keys, sketch_col).where(F.col(sketch_col).isNotNull())
    most = now.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while most > fan:
        salt = -(-most // fan)
        now = now.withColumn("salt", F.pmod(F.xxhash64(sketch_col, F.monotonically_increasing_id()), F.lit(salt))).groupBy(*keys, "salt").agg(merge).drop("salt")
        now = materialize(now, "parts")
        most = now.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return now.groupBy(*keys).agg(merge)


# ---------------------------------------------------------------- documents and their neighbours


def _neighbours(rows: DataFrame) -> DataFrame:
    """``(key, h, n, next_key, next_h)``: the following document of each distinct (id, text), the first after the last.

    Ids are dealt into ranges; rows of a range see their successor in a window over it, the last one of a
    range takes the first of the next range, of which there is one row a range.
    """
    spark = rows.sparkSession
    ids = rows.groupBy("id", "key", "h").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ids = materialize(ids.repartitionByRange(parts, F.col("id").asc_nulls_last(), F.col("h")).withColumn("part", F.spark_partition_id()), "ids")
    order = (F.col("id").asc_nulls_last(), F.col("h"))
    after = F.lead(F.struct("key", "h")).over(Window.partitionBy("part").orderBy(*order))
    first = ids.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("a"), "id", "h", "key")).alias("f"))
    first = first.select("part", F.struct("f.key", "f.h").alias("f"))
    every = Window.orderBy("part")
    turn = first.select("part", F.coalesce(F.lead("f").over(every), F.first("f").over(every)).alias("turn"))
    linked = ids.withColumn("after", after).join(F.broadcast(turn), "part")  # as many rows as shuffle partitions
    linked = linked.withColumn("after", F.coalesce("after", "turn"))
    return linked.select("key", "h", "n", "copies", F.col("after.key").alias("next_key"), F.col("after.h").alias("next_h"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, n: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses.

    Edited: the last floor(n_chars / 2) characters are replaced by the first as many of the next document.
    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    key = F.coalesce(F.concat(F.lit("v"), F.col("id").cast("string")), F.lit("null"))
    rows = rows.select("id", "text", key.alias("key"), F.xxhash64("text").alias("h"), F.char_length("text").alias("n"))
    links = materialize(_neighbours(rows.drop("text")), "links")
    # both joins read the same three columns, so that one exchange of the texts serves both; sketches are cheaper to make again
    base = rows.select("key", "h", "text").repartition("key", "h")
    asked = links.select(F.col("next_key").alias("key"), F.col("next_h").alias("h"), F.col("key").alias("for_key"), F.col("h").alias("for_h"), F.expr("n div 2").cast("int").alias("half"))
    heads = base.join(asked, ["key", "h"]).select("for_key", "for_h", "half", "text", word_hashes(F.col("text")).alias("words"))
    heads = heads.select(F.col("for_key").alias("key"), F.col("for_h").alias("h"), F.col("text").substr(F.lit(1), F.col("half")).alias("head"), sketch(shingle_hashes(F.col("words"), n), k).alias("next_sketch"))
    if links.where("copies > 1").limit(1).count():
        heads = heads.groupBy("key", "h").agg(F.first("head").alias("head"), F.first("next_sketch").alias("next_sketch"))
    both = base.join(heads, ["key", "h"]).withColumn("n", F.char_length("text"))
    both = both.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.expr("n - n div 2").cast("int")), F.col("head")))
    doc_id = F.when(F.col("key") != "null", F.substring("key", 2, 1 << 30)).cast(docs.schema[id_col].dataType)
    both = both.select(doc_id.alias("id"), "n", F.sha2("edited", 256).alias("edited_sha256"), "next_sketch", word_hashes(F.col("text")).alias("own"), word_hashes(F.col("edited")).alias("words"))
    both = both.withColumn("sketch", sketch(shingle_hashes(F.col("own"), n), k))
    both = both.withColumn("edited_sketch", sketch(shingle_hashes(F.col("words"), n), k))
    return both.select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
