"""The operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porespan.llm import embedding_dedup, fim, fingerprints, media, mixing, ngram_join, packing, resampling, secrets, token_counts, toxicity, url_filter, warc
from porespan.session import limit_batches, materialize, scratch_path

RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
TOXIC_FROM = 0.3
#: Weights of documents that the quality labels call good and bad; others have 1.
QUALITY = {1: 2.0, 0: 0.5}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are the query's own, so a gap in them, or a revisit without its response, is an error."""
    manifest = warc.write_warc(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    found = warc.resolve_revisits(materialize(warc.read_warc(manifest, with_payload=False), "records"))
    why = F.concat(F.lit("an archive doesn't read back: "), F.col("path"), F.lit(" at "), F.col("start").cast("string"), F.lit(", "), F.coalesce("reason", F.lit("no response")))
    sound = F.when(F.col("resolved"), F.lit(True)).otherwise(F.raise_error(why).cast("boolean"))
    return found.where(sound).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=4, threshold=(85, 100))
    return members.select("doc_id", "n_shingles", "component_id", "n_links")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Trained on labelled rows that are not held out."""
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.train_on(docs, labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "spans")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def standing_edits(text) -> F.Column:
    """Three edits of a text: 40 characters in the middle go, words come in after a third, and its start is replaced by its end."""
    n = F.char_length(F.coalesce(text, F.lit(""))).cast("long")
    half, third = F.floor(n / 2), F.floor(n / 3)
    edit = lambda seq, start, stop, new: F.struct(F.lit(seq).cast("long").alias("seq"), start.alias("start"), stop.alias("stop"), new.alias("new"))
    tail = F.coalesce(F.right(text, F.lit(25)), F.lit(""))
    return F.array(
        edit(1, half, half + 40, F.lit("")), edit(2, third, third, F.lit("an added remark, ")), edit(3, F.lit(0).cast("long"), F.least(F.lit(12).cast("long"), n), tail)
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.apply_edits(docs.select("doc_id", "text", standing_edits(F.col("text")).alias("edits")))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are the query's own, so a member that doesn't read back is an error."""
    return media.media_features(_table(spark, sf_dir, "documents"), strict=True)


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, weight)`` from the quality labels."""
    weight = F.when(F.col("quality") == 1, F.lit(QUALITY[1])).when(F.col("quality") == 0, F.lit(QUALITY[0]))
    return _table(spark, sf_dir, "labels").select("doc_id", weight.alias("weight")).where("doc_id is not null and weight is not null")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), quality=quality_weights(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train_forest(secrets.labelled_findings())
    return secrets.find_secrets(_table(spark, sf_dir, "documents"), forest)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return held.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha(F.col("fim.output")).alias("output_sha256"), sha(fim.restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256")
    )


# ---------------------------------------------------------------- stages of the pipeline
# Stages return plans that run later, one after the other in the same workers: they limit the session's batches to Python.


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxic score stay."""
    limit_batches(spark)
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf_dir), keep=docs.columns)
    return scored.where(F.col("__score") < TOXIC_FROM).drop("__score", "__spans")


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    limit_batches(spark)
    return ngram_join.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    limit_batches(spark)
    return secrets.redact_secrets(docs, secrets.train_forest(secrets.labelled_findings()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix holds it."""
    return mixing.mix_documents(docs, quality=quality_weights(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in the sequences."""
    limit_batches(spark)
    return packing.pack_documents(docs)


# ---------------------------------------------------------------- SQL

OP1_SQL = """
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
rules(verdict, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
urls as (select distinct host, path from b),
fits as (select host, path, h || p as rule, verdict, row_number() over (partition by host, path order by length(h) desc, length(p) desc) as k
         from urls join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, b.host, b.path, rule, coalesce(verdict, 'allow') as verdict
from b left join (select * from fits where k = 1) f on b.host = f.host and b.path = f.path
"""

OP2_SQL = """
with a as (select page_id, encode(coalesce(html, '')) as body from pages),
b as (select page_id, octet_length(body) as n, sha1(body) as h, min(page_id) over (partition by sha1(body)) as first, count(*) over (partition by sha1(body)) as k from a)
select page_id, n::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') as payload_digest,
       case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from b
"""

OP9_SQL = """
with q as (select doc_id, max(case quality when 1 then 2.0 when 0 then 0.5 end) as q from labels where doc_id is not null group by 1),
a as (select d.doc_id, d.source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint as size,
             -ln((('0x' || substr(md5('42/' || coalesce(d.doc_id::varchar, 'null/' || md5(coalesce(text, '')))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / coalesce(q.q, 1.0) as k
      from documents d left join q on d.doc_id = q.doc_id),
s as (select source, sum(size)::double as n, ([3.0, 1.0, 2.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from a group by source),
c as (select *, 2.0 * n as stop,
             (1.5 * sum(n) over () - coalesce(sum(2.0 * n) over (order by 2.0 * n / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
               / sum(w) over (order by 2.0 * n / w, source nulls last rows between current row and unbounded following) as level from s),
l as (select level from c where level * w <= stop order by stop / w, source nulls last limit 1),
t as (select source, n, least(stop, coalesce((select level from l) * w, stop)) as target from c),
e as (select *, case when n > 0 then floor(target / n) else 0 end as epochs from t),
r as (select a.*, e.n, e.target, e.epochs, e.target - e.epochs * e.n as rest, sum(size) over (partition by a.source order by k, doc_id rows unbounded preceding) as upto
      from a join e on a.source is not distinct from e.source)
select doc_id, size, n::bigint as source_size, target,
       ((epochs + case when size > 0 and rest > 0 and upto - size / 2 <= rest then 1 else 0 end) * size)::bigint as taken
from r
"""


OP11_SQL = """
with v as (select vec_id, label, embedding::double[] as e from embeddings
           where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
          where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach as (with recursive r(a, b) as (select a, b from links union select r.a, l.b from r join links l on r.b = l.a) select a, min(b) as least from r group by a),
degree as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(least, vec_id)) as component_id, vec_id = least(vec_id, coalesce(least, vec_id)) as kept
from embeddings e left join degree d on e.vec_id = d.a left join reach r on e.vec_id = r.a
"""

#: CRC-32 by its definition: a byte at a time, a bit at a time.
OP12_SQL = """
with bits as (select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
texts as (select 0 as side, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
words as (select side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from texts),
counted as (select side, id, w, count(*) as k from words group by all),
known as (select distinct w, hex(encode(w)) as x from counted),
buckets as (select w, xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint)),
                   lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket from known, bits),
placed as (select side, id, bucket, sum(k)::bigint as k from counted join buckets using (w) group by all),
totals as (select coalesce(sum(k) filter (side = 0), 0)::double as s, coalesce(sum(k) filter (side = 1), 0)::double as t from placed),
gains as (select bucket, floor(1000.0 * ln(((tk + 1)::double * (s + 10000)) / ((sk + 1)::double * (t + 10000))))::bigint as gain
          from (select bucket, coalesce(sum(k) filter (side = 0), 0) as sk, coalesce(sum(k) filter (side = 1), 0) as tk from placed group by bucket), totals),
weights as (select id, sum(k)::bigint as n, sum(k * gain)::bigint as total from placed join gains using (bucket) where side = 0 group by id),
scored as (select doc_id, coalesce(n, 0)::bigint as n_features, case when n > 0 then (total - ((total % n) + n) % n) // n else 0 end::bigint as weight,
                  floor(-1000.0 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint::double + 0.5) / 4294967296.0)))::bigint as noise
           from documents left join weights on doc_id = id),
held as (select doc_id, n_features, weight, weight + noise as score from scored),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from held where n_features >= 20)
select h.doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end::bigint as rank from held h left join drawn d on h.doc_id = d.doc_id
"""

OP13_SQL = """
with a as (select doc_id, coalesce(text, '') as x, length(coalesce(text, ''))::bigint as n, sha256('1:' || doc_id) as d from documents),
b as (select *, ('0x' || substr(d, 1, 8))::bigint % (n + 1) as p, ('0x' || substr(d, 9, 8))::bigint % (n + 1) as q, ('0x' || substr(d, 17, 8))::bigint as h3, ('0x' || substr(d, 25, 8))::bigint as h4 from a),
c as (select *, least(p, q) as lo, greatest(p, q) as hi,
             case when n = 0 or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from b),
e as (select *, substr(x, 1, lo) as pre, substr(x, lo + 1, hi - lo) as mid, substr(x, hi + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars, case when form <> 'plain' then hi - lo end as middle_chars,
       sha256(case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(x) as restored_sha256
from e
"""


def queries() -> dict:
    found = (
        op1_url_filters, op2_warc, op3_ngram_join, op4_fingerprints, op5_toxicity, op6_packing, op7_token_counts, op8_media_columns, op9_mixing, op10_secret_scans,
        op11_embedding_dedup, op12_resampling, op13_fim,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op2_warc": OP2_SQL, "op9_mixing": OP9_SQL, "op11_embedding_dedup": OP11_SQL, "op12_resampling": OP12_SQL, "op13_fim": OP13_SQL}
