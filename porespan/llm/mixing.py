"""Mixing sources to target weights, in DataFrame functions only.

*Targets.* Sources share ``share`` times all words by weight. A source stops at ``most`` times its own size; the
excess goes to the others by weight until none is above its stop. That level is found in closed form: with
sources ordered by stop over weight, the first ones stop and the others get weight times the level.

*Selection.* A source's target is some complete epochs, in which every document is taken once, and a
fraction. The fraction takes documents in the order of Efraimidis and Spirakis: ascending ``-ln(u) / weight``
with ``u`` from a hash of id and seed, so a heavier document comes early more often and reruns agree. A prefix
sum of sizes up to the budget decides; the document at the budget is taken if that brings the sum nearer.
The interval of keys that holds the budget is narrowed by quantiles of the rows in it, each time to about one part in
``SPLIT``, until it has at most ``bucket_rows`` rows; rows before it are taken, and only its own are sorted. So a source of
any size and any weights needs no sorted pass in one task.

Cases: null text has size 0; a null source is a source, ordered last; a source without words has the target 0;
null or non-positive quality weights count as 1; equal keys are ordered by text hash; documents with null ids get their
key from their text; repeated rows are rows of their own; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porespan.session import discard, materialize

WORD = r"[^ \t-\r]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Rows of a source that are sorted at most (but for quantiles' error), parts of an interval, and the quantiles' accuracy.
BUCKET_ROWS, SPLIT, ACCURACY = 20_000, 64, 10_000
#: Rows of a table that is broadcast at most; beyond, tables are joined by shuffles.
BROADCAST_ROWS = 1_000_000
#: What rows of a source are ordered by; the last one parts rows that are equal in all.
ORDER = ("rank_key", "text_hash", "tie")


def uniform(id_col: Column, text_col: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5, the same in every engine; from the text where the id is null."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("null/"), F.md5(F.coalesce(text_col, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def rank_key(id_col: Column, text_col: Column, weight: Column, seed: int) -> Column:
    return -F.ln(uniform(id_col, text_col, seed)) / F.when(weight > 0, weight).otherwise(F.lit(1.0))


def _group(source: Column) -> Column:
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("none"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``. The last steps run over one row a source.

    ``weights`` repeat over the sources in code point order, null last.
    """
    if share > most:
        raise ValueError("sources can't hold that share within their stops")
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    own = own.withColumn("level", (total - before) / onward)
    # the first source that keeps below its stop sets the level for itself and all after it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct(F.col("stop") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(Window.partitionBy())
    own = own.withColumn("at", level.getField("level"))
    target = F.least(F.col("stop"), F.coalesce(F.col("at") * F.col("weight"), F.col("stop")))
    return own.select("source", "source_size", target.alias("target"))


def _placed(order: tuple[str, ...] = ORDER, prefix: str = "") -> tuple[Column, Column]:
    """Whether a row comes before the interval of its source, and whether it lies in it (null bounds don't bind)."""
    before, inside = F.lit(False), F.lit(True)
    for c in reversed(order):
        below = F.coalesce(F.col(f"{prefix}{c}") <= F.col(f"{prefix}low_{c}"), F.lit(False))
        within = ~below & F.coalesce(F.col(f"{prefix}{c}") <= F.col(f"{prefix}high_{c}"), F.lit(True))
        before, inside = below | (within & before), within & inside
    return before, inside


def _narrowed(rows: DataFrame, cuts: DataFrame, level: str) -> DataFrame:
    """The part of each interval that holds the budget, by quantiles of ``level`` over its rows."""
    own = rows.join(cuts, "group").where(_placed()[1])
    marks = own.groupBy("group").agg(F.percentile_approx(level, F.array(*[F.lit(i / SPLIT) for i in range(1, SPLIT)]), F.lit(ACCURACY)).alias("marks"))
    part = F.size(F.filter("marks", lambda m: m < F.col(level)))
    sums = own.join(marks, "group").groupBy("group", part.alias("part")).agg(F.sum("size").alias("s"), F.count("*").alias("own_n"), F.min(level).alias("least"), F.max(level).alias("greatest"))
    order = Window.partitionBy("group").orderBy("part")
    sums = sums.withColumns({"upto": F.sum("s").over(order), "floor": F.lag("greatest").over(order)})
    found = cuts.join(sums, "group").where("before + upto - s < rest and before + upto >= rest")
    keep = {f"{e}_{c}": F.col(f"{e}_{c}") for c in ORDER for e in ("low", "high")}
    keep |= {f"low_{level}": F.coalesce("floor", f"low_{level}"), f"high_{level}": F.col("greatest")}
    return found.select("group", "rest", (F.col("before") + F.col("upto") - F.col("s")).alias("before"), F.col("own_n").alias("n"), (F.col("least") == F.col("greatest")).alias("one"), *[v.alias(k) for k, v in keep.items()])


def _cuts(rows: DataFrame, plan: DataFrame, bucket_rows: int) -> DataFrame:
    """Written, a row for each source with a budget: the interval of ``ORDER`` at whose rows the budget ends."""
    kinds = dict(rows.dtypes)
    bounds = [F.lit(None).cast(kinds[c]).alias(f"{e}_{c}") for c in ORDER for e in ("low", "high")]
    cuts = plan.where("rest > 0").select("group", "rest", F.lit(0).cast("long").alias("before"), "n", F.lit(False).alias("one"), *bounds)
    cuts = materialize(cuts, "cuts")
    for level in ORDER:
        cuts = cuts.withColumn("one", F.lit(False))
        while (wide := cuts.where((F.col("n") > bucket_rows) & ~F.col("one"))).limit(1).count():
            cuts = materialize(cuts.where((F.col("n") <= bucket_rows) | F.col("one")).unionByName(_narrowed(rows, wide, level)), "cuts")
    return cuts


def _mixed(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: DataFrame | None, weights: tuple[float, ...], share: float, most: float, seed: int, bucket_rows: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, plan of the sources, cuts, weights by id); rows are written."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    text = F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(source_col).alias("source"), size.alias("size"), text.alias("digest"))
    rows = materialize(rows, "sizes")
    if quality is None:
        quality = docs.sparkSession.createDataFrame([], docs.select(F.col(id_col).alias("q_id"), F.lit(1.0).alias("q")).schema)
    quality = materialize(quality.toDF("q_id", "q").where("q_id is not null").groupBy("q_id").agg(F.max("q").cast("double").alias("q")), "quality")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null/"), F.col("digest")))
    keyed = rows.join(quality, F.col("doc_id") == F.col("q_id"), "left")
    keyed = keyed.withColumns({"rank_key": rank_key(name, F.lit(""), F.col("q"), seed), "tie": F.monotonically_increasing_id(), "group": _group(F.col("source"))})
    keyed = materialize(keyed.drop("q_id", "q", "digest"), "keys")
    discard(rows)
    targets = source_targets(keyed, weights, share, most)
    counts = keyed.groupBy("group").agg(F.count("*").alias("n"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumns({"group": _group(F.col("source")), "epochs": whole.cast("long")}).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan.join(counts, "group").select("group", "source_size", "target", "epochs", "rest", "n"), "plan")
    return keyed, plan, _cuts(keyed, plan, bucket_rows), quality


def _chosen(rows: DataFrame, plan: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with ``source_size, target, copies``, and whether key and hash alone don't decide (``at_cut``)."""
    columns = ["doc_id", "text_hash", "source", "size", "group", "at_cut"]
    before, inside = _placed()
    known = rows.join(cuts.select("group", "rest", F.col("before").alias("cut_at"), *[f"{e}_{c}" for c in ORDER for e in ("low", "high")]), "group", "left")
    open_ = F.col("rest").isNotNull()
    known = known.withColumn("at_cut", open_ & _placed(ORDER[:2])[1])
    off = known.where(~(open_ & inside)).select(*columns, (open_ & before).cast("long").alias("extra"))
    order = Window.partitionBy("group").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    edge = known.where(open_ & inside).withColumn("upto", F.col("cut_at") + F.sum("size").over(order))
    edge = edge.select(*columns, (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long").alias("extra"))
    out = off.unionByName(edge).join(plan.select("group", "source_size", "target", "epochs"), "group")
    copies = F.col("epochs") + F.when(F.col("size") > 0, F.col("extra")).otherwise(F.lit(0))
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"), "at_cut")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``(doc_id, text_hash, size, source, source_size, target, copies, taken)`` for every row of ``docs``.

    ``quality (id, weight)`` scales the keys; ids without one have weight 1. ``copies`` is how often the mix holds
    the document, ``taken = copies * size``.
    """
    rows, plan, cuts, _ = _mixed(docs, id_col, text_col, source_col, quality, weights, share, most, seed, bucket_rows)
    return _chosen(rows, plan, cuts).drop("at_cut").withColumn("taken", F.col("copies") * F.col("size"))


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as often as ``mixed`` holds it, by a join on id and text hash; rows that repeat both share the greatest number."""
    times = mixed.groupBy("doc_id", "text_hash").agg(F.max("copies").alias("__copies")).where("__copies > 0")
    times = times.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    found = docs.join(times, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__hash")))
    return _repeated(found, F.col("__copies")).drop("__id", "__hash", "__copies")


def _repeated(docs: DataFrame, copies: Column) -> DataFrame:
    many = docs.withColumn("__again", F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>")))
    return many.withColumn("__again", F.explode("__again")).drop("__again")


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
    seed: int = 42, bucket_rows: int = BUCKET_ROWS, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every row of ``docs`` as often as the mix holds it; the columns of ``docs`` stay.

    How often follows from a row's own id and source, its weight, the cut of its source and, for the few rows at the cut, their
    places there. Where weights and those rows are within ``broadcast_rows`` they are broadcast, and no text is shuffled; beyond,
    texts are joined by a shuffle (``repeat_documents``). Rows that repeat id and text share the greatest number.
    """
    rows, plan, cuts, weight_of = _mixed(docs, id_col, text_col, source_col, quality, weights, share, most, seed, bucket_rows)
    chosen = _chosen(rows, plan, cuts)
    edge = chosen.where("at_cut").groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies"))
    edge = materialize(edge.toDF("__id", "__hash", "__copies"), "edge")
    if weight_of.count() + edge.count() + plan.count() > broadcast_rows:
        return repeat_documents(docs, chosen, id_col, text_col)
    discard(rows)
    bounds = [f"{e}_{c}" for c in ORDER[:2] for e in ("low", "high")]
    cuts = plan.select("group", "epochs").join(cuts.select("group", F.lit(True).alias("open"), *bounds), "group", "left")
    cuts = materialize(cuts.toDF(*[f"__{c}" for c in cuts.columns]), "cuts")
    id_, text = F.col(id_col), F.col(text_col)
    found = docs.join(F.broadcast(weight_of.toDF("__q_id", "__q")), id_ == F.col("__q_id"), "left")
    found = found.withColumn("__group", _group(F.col(source_col))).join(F.broadcast(cuts), "__group", "left")
    found = found.withColumns({"__rank_key": rank_key(id_, text, F.col("__q"), seed), "__text_hash": F.xxhash64(text)})
    before, inside = _placed(ORDER[:2], "__")
    found = found.withColumns({"__before": F.col("__open").isNotNull() & before, "__inside": F.col("__open").isNotNull() & inside})
    found = found.join(F.broadcast(edge), id_.eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")) & F.col("__inside"), "left")
    worded = F.coalesce(text.rlike(WORD), F.lit(False))
    copies = F.when(F.col("__inside"), F.coalesce("__copies", F.lit(0))).otherwise(F.col("__epochs") + F.when(F.col("__before") & worded, F.lit(1)).otherwise(F.lit(0)))
    return _repeated(found, copies).select(*[F.col(c) for c in docs.columns])
