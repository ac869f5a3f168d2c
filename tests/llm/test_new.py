"""Vectors by cells, resampling and fill-in-the-middle against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from porespan.llm import embedding_dedup, fim, resampling

# ---------------------------------------------------------------- near vectors


def comparable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_vectors(rows, threshold):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    unit = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and comparable(v):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            unit[i] = x / np.linalg.norm(x)
    for i in unit:
        for j in unit:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), links[i], str(least.get(find(i))), r[0] == least.get(find(i))) for i, r in enumerate(rows))


def vector_rows():
    rng, rows = np.random.default_rng(1), []
    for _ in range(25):
        base = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), [float(x) for x in (base + rng.normal(size=8) * 0.3) * rng.choice([1, 7])], int(rng.integers(0, 2))))
    n = len(rows)
    odd = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [math.nan] * 8, [math.inf] * 8, []]
    rows += [(n, rows[0][1], rows[0][2]), (n, rows[0][1], rows[0][2]), (None, rows[3][1], rows[3][2]), (n + 1, rows[3][1], None), (5, [1e300, 2e300], 1), (None, [9.0, -2.0], 0), (None, [9.0, -2.0], 0)]
    return rows + [(n + 2 + i, v, 1) for i, v in enumerate(odd)]


@pytest.mark.parametrize(("options", "threshold"), [({}, 0.93), ({"cell_rows": 10, "block": 8}, 0.93), ({"cell_rows": 3, "block": 3}, 0.6)])
def test_vectors_by_brute_force(spark, options, threshold):
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash")).repartition(5)
    found = embedding_dedup.near_vectors(table, threshold=threshold, **options)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in found.collect()) == brute_vectors(rows, threshold)


def test_shorter_slack_keeps_most_links(spark):
    """Fewer visits at some loss: measured against all links."""
    rng, rows = np.random.default_rng(3), []
    for _ in range(150):
        base = rng.normal(size=32)
        rows += [(len(rows) + k, [float(x) for x in base + rng.normal(size=32) * 0.2], 0) for k in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    total = lambda slack: embedding_dedup.near_vectors(table, cell_rows=40, slack=slack).agg(F.sum("n_links")).first()[0]
    every = sum(r[1] for r in brute_vectors(rows, 0.93))
    assert total(1.0) == every and total(0.4) >= 0.9 * every


def test_empty_vectors_and_representatives(spark):
    schema = "vec_id long, embedding array<float>, label int, other string"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], 1, "a"), (2, [1.0, 0.01], 1, "b"), (3, [0.0, 1.0], 1, "c"), (4, None, 1, "d")]
    assert sorted(r.other for r in embedding_dedup.keep_representatives(spark.createDataFrame(rows, schema)).collect()) == ["a", "c", "d"]


# ---------------------------------------------------------------- resampling

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_features(text, least, most):
    words = WORD.findall(lowered(text))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in range(least, most + 1) for i in range(len(words) - k + 1))


def brute_resample(docs, target, least, most, percent, least_words):
    count = lambda texts: sum((brute_features(t, least, most)[1] for t in texts), Counter())
    s, t = count([x for _, x in docs]), count(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in s}
    rows = []
    for i, text in docs:
        n_words, f = brute_features(text, least, most)
        n = sum(f.values())
        weight = sum(gain[b] * k for b, k in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words])
    able = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((str(r[0]), *r[1:4], rank.get(id(r))) for r in rows)


@pytest.mark.parametrize(("ngrams", "percent"), [((1, 1), 10), ((1, 2), 100), ((2, 3), 33)])
def test_resampling_by_brute_force(spark, ngrams, percent):
    rng = random.Random(2)
    vocabulary = ["Word%d" % i for i in range(300)] + ["Ünïcode", "日本語", "x" * 70, "y" * 5000]
    text = lambda: rng.choice([" ", ", ", "\x00-"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
    docs = [(i, text()) for i in range(200)]
    docs += [(1000 + i, docs[7][1]) for i in range(100)] + [(2000, None), (2001, ""), (2002, "...!"), (None, docs[3][1])]
    target = [text() for _ in range(9)] + [None, ""]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(6)
    found = resampling.importance_resample(table, spark.createDataFrame([(t,) for t in target], "text string"), ngrams=ngrams, percent=percent)
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()) == brute_resample(docs, target, *ngrams, percent, 20)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (1, "a " * 30)], "doc_id long, text string")
    assert resampling.importance_resample(none, some).collect() == []
    found = resampling.importance_resample(some, none, percent=100).collect()
    assert sorted(r["rank"] for r in found) == [1, 2] and {r.n_features for r in found} == {30}
    assert resampling.resampled_documents(some.withColumn("rank", F.lit(0)), none, percent=50).count() == 2  # both rows have the id that is drawn


# ---------------------------------------------------------------- fill in the middle


def brute_fim(doc_id, text, rate=90, spm=20, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    pre, mid, suf = text[:lo], text[lo:hi], text[hi:]
    if h[3] % 100 < spm:
        return n, "spm", lo, hi - lo, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", lo, hi - lo, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("chunk", [1, 7, 300, 1 << 16])
def test_fim_by_brute_force(spark, chunk):
    rng = random.Random(6)
    alphabet = ["a", "b", " ", "\n", "<", ">", "P", "S", "é", "日", "😀", "é"]
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    docs = [(i, text(rng.choice([0, 1, 2, 30, 255, 256, 257, 700]))) for i in range(60 if chunk < 10 else 150)]
    docs += [(900, None), (901, ""), (902, "x" * 299 + "<P>"), (903, "y" * 298 + "<M>" + "z" * 9), (904, "<<S" * 90), (None, text(400)), (905, "é<" * 200)]
    docs += [(906, docs[3][1])] * 3
    table = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, body string").withColumn("n", F.lit(1)).repartition(3)
    found = fim.fill_in_middle(table, rate=95, spm=50, chunk=chunk, portion=2000).withColumn("again", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    got = sorted((str(r.doc_id), *r.fim, r.again) for r in found)
    assert got == sorted((str(i), *brute_fim(i, t, 95, 50), t or "") for i, t in docs)
    assert found[0].body == "q" and found[0].n == 1


def test_composition_is_associative():
    dfa = fim.code_points()
    data = np.frombuffer("a<P<é<S>日<M".encode() * 3, np.uint8)
    cuts = [0, 4, 5, 11, len(data)]
    parts = [fim.scan_chunks(data, np.array([a]), np.array([b]), dfa) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = fim.scan_chunks(data, np.array([0]), np.array([len(data)]), dfa)
    left = fim.compose(fim.compose(fim.compose(parts[0], parts[1]), parts[2]), parts[3])
    right = fim.compose(parts[0], fim.compose(parts[1], fim.compose(parts[2], parts[3])))
    for x, y, z in zip(whole, left, right, strict=True):
        assert (x == y).all() and (y == z).all()


def test_fim_sentinels(spark):
    for bad in (("", "b", "c"), ("aba", "x", "y"), ("ab", "xaby", "q"), ("a", "a", "b")):
        with pytest.raises(ValueError, match="sentinel"):
            fim.check_sentinels(bad)
    docs = spark.createDataFrame([(i, "text %d with [pre] none" % i) for i in range(40)], "doc_id long, text string")
    found = fim.fill_in_middle(docs, rate=100, sentinels=("[a]", "[b]", "[c]"))
    again = fim.restored(F.col("fim.output"), F.col("fim.form"), ("[a]", "[b]", "[c]"))
    assert found.where(~again.eqNullSafe(F.col("text"))).count() == 0 and found.where(F.col("fim.form") != "plain").count() == 40
    assert fim.fill_in_middle(docs.limit(0)).collect() == []
