"""Stages of the pipeline on tables with nulls, ties, repeated rows and other columns, and trees of edited documents that stay cheap."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from porespan.llm import encode, queries, token_counts

SF = "/root/testdata/sf0.001"
STAGES = [queries.toxicity_stage, queries.ngram_stage, queries.secrets_stage, queries.mixing_stage]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.mark.parametrize("stage", STAGES)
def test_stages_on_odd_rows(spark, stage):
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(5).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 0.5) for r in some]
    rows += [(None, "a text without an id", None, None, None, None), (None, "a text without an id", None, None, None, None), (900, None, "en", "web", 0, 1.0), (901, "", "en", "web", 0, 1.0)]
    rows += [(902, "plain words " * 3, "en", "web", 36, 1.0)] * 3 + [(903, "word " * 30_000, "en", None, 150_000, 2.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = stage(spark, docs, SF)
    assert found.columns == docs.columns
    held = found.collect()
    assert {r.doc_id for r in held} <= {r[0] for r in rows}
    if stage is queries.ngram_stage:
        assert sum(r.doc_id == 902 for r in held) == 1 and {900, 901, 903} <= {r.doc_id for r in held}
    if stage in (queries.toxicity_stage, queries.secrets_stage):
        assert sum(r.doc_id == 902 for r in held) == 3 and any(r.doc_id is None for r in held)
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_packing_of_odd_rows(spark):
    rows = [(None, None), (None, ""), (1, "a b"), (1, "a b"), (2, "word " * 5000)]
    held = queries.packing_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("sequence_id", F.lit("clash")), SF).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in held)
    at = {}
    for seq, offset, length in places:
        assert offset == at.get(seq, 0)
        at[seq] = offset + length
    assert max(at.values()) <= 2048 and len([r for r in held if r.doc_id == 1]) == 2
    assert queries.packing_stage(spark, spark.createDataFrame([], "doc_id long, text string"), SF).collect() == []


def test_insertions_move_few_leaves():
    own, rng = encode.encoder(), random.Random(2)
    text = " ".join("word%d" % (i % 997) for i in range(200_000))
    doc = token_counts.EditedDocument(text, np.full(200_000, 3), own)
    new = " one two three four five "
    for _ in range(1000):
        at = rng.randrange(doc.n_chars)
        doc.edit(at, at, new)
        text = text[:at] + new + text[at:]
    assert doc.moved < 10**6 and doc.encoded < 10**5 and doc.text == text
