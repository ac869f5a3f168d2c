"""The ten operators against brute force, exact round trips and held-out labels, and on odd rows."""

import base64
import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from porespan.llm import encode, fingerprints, media, mixing, ngram_join, packing, queries, secrets, token_counts, toxicity, url_filter, warc
from porespan.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, length string"
SPACE = " \t\n\v\f\r"


def words(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [now] if now else []
            now = ""
        else:
            now += c.lower() if c.isascii() else c
    return out


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(["th", "an", "é", "ing", "os", "Re"], k=rng.randint(1, 4)))
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(5, 120))]
        out.append(" ".join(base))
        for edits in (0, 1, 3, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            out.append("  ".join(copy) if edits == 1 else "\n".join(copy))
    return [*out, None, "", " \t ", "one", "one", "one two three", "x" * 5000, "long " * 9000, "naïve ☃ <|endoftext|> İstanbul"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, "clash", 1.0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (3, texts[3], "en", "s0", None, None, None, None), (None, texts[0], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


URLS = ["http://Ex.COM/en/1", "https://example.com/en/742?x#y", "http://a.example.com/en/8", "ftp://example.net/de/81", "http://net/de/", "http://b.net/de", None, "nothing", "http://x.org/es/a/b", "http://notexample.com:80/en/", "http://.com./en/", "http://", "http://x.com/" + "en/" * 4000]


def judged(pages, rules, **options):
    rows = url_filter.filter_urls(pages, rules, **options).collect()
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows), key=lambda t: tuple((v is not None, v) for v in t))


def test_url_rules(spark):
    pages = spark.createDataFrame([*((i, u, "clash") for i, u in enumerate(URLS)), (0, URLS[0], None), (None, URLS[1], None)], "page_id long, url string, host string")
    table = spark.createDataFrame([(r.verdict, r.host.upper() + ".", r.path, "x") for r in queries.RULES] + [("block", None, "/", "x"), ("allow", "", None, "x"), ("block", "com", "en/", "x")], "verdict string, host string, path string, url string")
    lists = judged(pages, queries.RULES)
    assert lists == judged(pages, queries.RULES, broadcast_bytes=0) == judged(pages, table) == judged(pages, table, broadcast_bytes=0)
    by_id = {t[0]: t[1:] for t in lists}
    assert by_id[0] == ("ex.com", "/en/1", "com/en/", "block") and by_id[1] == by_id[None] == ("example.com", "/en/742", "example.com/en/7", "allow")
    assert by_id[2][2:] == ("com/en/", "block") and by_id[3][3] == "allow" and by_id[4][3] == "block" and by_id[5][2] is None and by_id[6] == ("", "", None, "allow")
    assert judged(pages.limit(0), table) == judged(pages.limit(0), table, broadcast_bytes=0) == []
    none = judged(pages, table.limit(0))
    assert none == judged(pages, table.limit(0), broadcast_bytes=0) and {t[3] for t in none} == {None}
    with pytest.raises(Exception, match="verdict must be"):
        judged(pages, spark.createDataFrame([("maybe", "com", "/")], "verdict string, host string, path string"))


def test_url_rules_against_brute_force(spark):
    """Random rules with ties of allow and block, both as a list and as a table, by the trie and by the join."""
    rng = random.Random(4)
    host = lambda: ".".join(rng.choices(["a", "b", "com", "net"], k=rng.randint(1, 4)))
    path = lambda: "".join(rng.choices(["/", "x", "y", "/xy"], k=rng.randint(0, 6)))
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(10_000)]
    urls = [(i, f"http://{host()}/{path()}?q") for i in range(300)]
    norm = [(v, h, p if not p or p[0] == "/" else "/" + p) for v, h, p in rules]
    want = []
    for i, u in urls:
        h, _, p = u[7:-2].partition("/")
        fits = [(len(rh), len(rp), v, rh + rp) for v, rh, rp in norm if (h == rh or h.endswith("." + rh)) and ("/" + p).startswith(rp)]
        want.append((i, h, "/" + p, max(fits)[3] if fits else None, max(fits)[2] if fits else "allow"))
    pages, table = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "verdict string, host string, path string")
    listed = [url_filter.Rule(*r) for r in rules]
    for given in (listed, table):
        for most in (10**9, 0):
            assert judged(pages, given, broadcast_bytes=most) == want


def test_warc_round_trip_and_salvage(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "<p>WARC/1.1\r\n\r\n</p>" * (i % 5) if i % 5 else None) for i in range(60)] + [(3, "http://x/3", "<p>WARC/1.1\r\n\r\n</p>" * 3), (None, None, "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages, str(tmp_path / "w"))
    found = warc.read_warc(manifest, range_bytes=700).collect()
    assert len(found) == len(rows) and all(r.kind == "record" for r in found)
    for r in found:
        if r.page_id is None:
            continue
        body = (dict((a, c) for a, _, c in rows)[r.page_id] or "").encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.payload_bytes == len(body)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id < 5 else ("revisit", r.page_id % 5))
    path = manifest.first().path
    data = bytearray(open(path, "rb").read())
    good = sorted((r.start, r.stop) for r in found)
    a, b = good[10], good[30]
    data[a[0] + 15 : a[0] + 40] = b"\0" * 25
    data[b[0] : b[0]] = b"junk between members"
    bad = tmp_path / "bad.warc.gz"
    bad.write_bytes(bytes(data[:-7]))
    for step in (300, 10**6):
        read = warc.read_warc(warc.list_archives(spark, str(bad)), range_bytes=step).collect()
        gaps = sorted((r.start, r.stop) for r in read if r.kind == "gap")
        assert len(gaps) == 3 and gaps[0] == a and gaps[1] == (b[0], b[0] + 20) and sum(r.kind == "record" for r in read) == len(rows) - 2
    plain = tmp_path / "plain.warc"
    record = lambda i, body: warc.record_bytes(i, "http://x", body, base64.b32encode(hashlib.sha1(body).digest()).decode(), None)
    plain.write_bytes(record(1, b"WARC/1.1\r\n") + b"noise" + record(2, b"b") + record(3, b"c")[:-9])
    read = sorted(warc.read_warc(warc.list_archives(spark, str(plain))).collect(), key=lambda r: r.start)
    assert [(r.kind, r.page_id) for r in read] == [("record", 1), ("gap", None), ("record", 2), ("gap", None)]
    assert warc.read_warc(warc.write_warc(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_warc_long_records_and_headers(spark, tmp_path):
    """Headers and payloads beyond any window, ranges that start inside them, and plain files cut into ranges."""
    body = bytes(random.Random(1).randbytes(3 << 20)) + b"WARC/1.1\r\ncontent-length: 3\r\n\r\n"
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    one = warc.record_bytes(1, "http://x/" + "y" * (2 << 20), body, digest, None)
    small = lambda i: warc.record_bytes(i, "http://x", b"b%d" % i, base64.b32encode(hashlib.sha1(b"b%d" % i).digest()).decode(), None)
    (tmp_path / "l.warc").write_bytes(one + b"".join(map(small, range(2, 9))))
    (tmp_path / "l.warc.gz").write_bytes(warc._gzip(one) + b"".join(warc._gzip(small(i)) for i in range(2, 9)))
    for step in (500, 1 << 20, 1 << 30):
        for name in ("l.warc", "l.warc.gz"):
            files = warc.list_archives(spark, str(tmp_path / name))
            found = sorted(warc.read_warc(files, range_bytes=step, tasks=3).collect(), key=lambda r: r.start)
            assert [(r.kind, r.page_id) for r in found] == [("record", i) for i in range(1, 9)], (step, name)
            assert found[0].payload_digest == digest and found[0].payload == body and found[0].uri.endswith("yy")


def test_warc_revisits_need_their_response(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, "same") for i in range(4)] + [(9, None, "other")], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages, str(tmp_path / "w"))
    path = manifest.first().path
    whole = warc.resolve_revisits(warc.read_warc(manifest, with_payload=False)).collect()
    assert all(r.resolved for r in whole) and {r.payload_bytes for r in whole} == {4, 5}
    at = next(r for r in whole if r.page_id == 0)
    data = bytearray(open(path, "rb").read())
    data[at.start + 20 : at.start + 30] = b"\0" * 10
    open(path, "wb").write(bytes(data))
    hurt = {r.page_id: r for r in warc.resolve_revisits(warc.read_warc(manifest, with_payload=False)).collect()}
    assert hurt[None].kind == "gap" and hurt[9].resolved and not any(hurt[i].resolved for i in (1, 2, 3))


def brute_links(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    return sets, [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]


def brute_components(rows, n, num, den):
    """(id, set size, component id, number of links) of each row."""
    sets, links = brute_links(rows, n, num, den)
    root, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        root[find(i)] = find(j)
        degree[i] += 1
        degree[j] += 1
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)].append(k)
    return [(k, len(sets[i]), min(least[find(i)], default=None), degree[i]) for i, (k, _) in enumerate(rows)]


def by_value(t):
    return tuple(-1 if v is None else v for v in t)


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_ngram_join(docs, empty, n, num):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    members, _ = ngram_join.ngram_jaccard_join(docs, n=n, threshold=(num, 100))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in members.collect()), key=by_value)
    assert got == sorted(brute_components(rows, n, num, 100), key=by_value)
    kept = ngram_join.keep_one(docs, n=n, threshold=(num, 100)).collect()
    assert len({r.doc_id for r in kept if r.doc_id is not None and words(r.text)}) == len({c for k, s, c, _ in got if s and c is not None}) and kept[0].asDict().keys() == docs.first().asDict().keys()
    assert ngram_join.ngram_jaccard_join(empty)[0].count() == 0


def test_ngram_join_of_large_groups(spark, monkeypatch):
    """Near copies beyond a block, in a chain, and short sets that share an n-gram without linking."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(60)] = f"x{i}"
        texts.append(" ".join(copy))
    chain = [f"c{i}" for i in range(160)]
    texts += [" ".join(chain[4 * i : 4 * i + 100]) for i in range(15)]
    texts += [f"the same four words {i} and {i}" for i in range(50)] + ["the same four words 1 and 1"] * 5
    long = [f"l{i}" for i in range(1500)]
    for k in range(24):  # on both sides of the threshold, and halves that are shared
        copy = list(long)
        for at in rng.sample(range(1500), 10 + k):
            copy[at] = f"y{k}-{at}"
        texts += [" ".join(copy), " ".join([*long[:750], *(f"z{k}-{i}" for i in range(750))])]
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    members, links = ngram_join.ngram_jaccard_join(d, n=4, threshold=(85, 100))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in members.collect())
    assert got == sorted(brute_components(rows, 4, 85, 100))
    node = {r.doc_id: r.node for r in members.collect()}
    want = {frozenset((node[i], node[j])) for i, j in brute_links(rows, 4, 85, 100)[1] if node[i] != node[j]}
    pairs = [frozenset((r.a, r.b)) for r in links.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert sorted(r.doc_id for r in ngram_join.keep_one(d, n=4, threshold=(85, 100)).collect()) == sorted({c for _, _, c, _ in got})


def test_sets_of_equal_hash_are_parted():
    h = np.array([1, 2, 3, 4], np.uint64)
    of = np.array([0, 0, 1, 1])
    node, check, _ = ngram_join._set_hash(h, of, 2, np.zeros(0, np.int64))
    apart, _, _ = ngram_join._set_hash(h, of, 2, node[:1])
    assert node[0] != node[1] and check[0] != check[1] and apart[0] != node[0] and apart[1] == node[1]


def brute_sketch(text, k):
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t-\r]+", text.lower()) if w]

    def chained(run):
        seed = 42
        for h in run:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return signed(seed)

    runs = {chained(hashes[i : i + 5]) for i in range(max(1, len(hashes) - 4))} if hashes else set()
    return sorted(runs)[:k]


def brute_likeness(a, b, k):
    union = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*union}) / len(union) if union else 1.0


def test_fingerprints(spark, docs, texts, empty):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = {r.doc_id: r for r in fingerprints.fingerprint_edits(rows).collect()}
    for i, t in enumerate(texts):
        text, after = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        r = found[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text, 5), shingles(edited, 5)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
        sketch_of = lambda t: brute_sketch(t, 128)
        own, changed, nxt = sketch_of(text), sketch_of(edited), sketch_of(after)
        hexed = lambda s: "".join(f"{h % 2**64:016X}" for h in s)
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(own), hexed(changed))
        assert r.near_edited == pytest.approx(brute_likeness(own, changed, 128)) and r.near_next == pytest.approx(brute_likeness(own, nxt, 128))
    assert found[texts.index("one")].fingerprint == found[texts.index("one") + 1].fingerprint
    assert fingerprints.fingerprint_edits(docs).count() == docs.count() and fingerprints.fingerprint_edits(empty).count() == 0
    # sketches of parts merge to the sketch of the whole, and estimate counts and containment
    h = spark.range(5000).selectExpr("id % 2 as k", "xxhash64(id % 4000) as h")
    sketched = lambda df, *keys: df.groupBy(*keys).agg(fingerprints.sketch(fingerprints.F.collect_list("h")).alias("sketch"))
    parts = sketched(h.withColumn("p", fingerprints.F.pmod("h", fingerprints.F.lit(9))), "k", "p")
    whole, merged = sketched(h, "k").orderBy("k").collect(), fingerprints.merge_parts(parts, ["k"], fan=3).orderBy("k").collect()
    assert [tuple(r.sketch) for r in whole] == [tuple(r.sketch) for r in merged]
    s = spark.createDataFrame(whole).select(fingerprints.distinct_count(fingerprints.F.col("sketch")).alias("n"), fingerprints.containment(fingerprints.F.col("sketch"), fingerprints.F.col("sketch")).alias("c")).first()
    assert abs(s.n - 2000) < 600 and s.c == 1.0


def test_toxicity(spark, docs, empty):
    p = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{p}/documents.parquet"), spark.read.parquet(f"{p}/labels.parquet")
    model = toxicity.train_on(d, labels.where(~toxicity.held_out()))
    scored = toxicity.score_toxicity(d, model).join(labels, "doc_id").where(toxicity.held_out()).select("score", "toxic").toPandas()
    hit = scored["score"] >= 0.3
    assert (hit & (scored["toxic"] == 1)).sum() >= 0.75 * (scored["toxic"] == 1).sum() and (hit & (scored["toxic"] == 0)).sum() <= 0.03 * len(scored)
    odd = toxicity.score_toxicity(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    score, spans = toxicity.score_batch(pa.array(["é such an IDIOT, worthless trash", None, ""]), model)
    assert score[0] > score[1] == score[2] and [("é such an IDIOT, worthless trash"[s["start"] : s["stop"]]) for s in spans[0]][0].startswith("IDIOT")
    assert toxicity.score_toxicity(empty, model).count() == 0 and toxicity.train_on(d, labels.limit(0)).score is None


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    s, first = rng.normal(size=40), np.zeros(40, bool)
    first[[0, 1, 9, 30]] = True
    a, start = rng.normal(size=(2, 2)), 0.4
    got = toxicity.marginals(s, first, a, start)
    cuts = [*np.flatnonzero(first), 40]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n = min(hi - lo, 10)
        if hi - lo > 12:
            continue
        total, on = 0.0, np.zeros(hi - lo)
        for y in np.ndindex(*(2,) * (hi - lo)):
            w = np.exp(start * y[0] + sum(s[lo + i] * y[i] for i in range(hi - lo)) + sum(a[y[i - 1], y[i]] for i in range(1, hi - lo)))
            total, on = total + w, on + w * np.array(y)
        assert np.allclose(got[lo:hi], on / total) and n


def test_encoder_equals_the_library(spark):
    own = encode.encoder()
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(400).toPandas()["text"].tolist()
    d += ["naïve ☃ <|endoftext|>x İstanbul ΑΣ don't I'LL á  b", "", " ", None, "it's 'tis 12.50€ ½ ª", "A" * 3000]
    for lo, hi, ids, ends in own.batches(pa.array(d)):
        for i in range(lo, hi):
            assert ids[ends[i - lo] : ends[i - lo + 1]].tolist() == own.tokenizer.encode(d[i] or "", add_special_tokens=False).ids


def test_packing(docs, empty):
    own = encode.encoder()
    found = packing.pack_documents(docs, capacity=64).toPandas()
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append([*own.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])
    for key, rows in found[found["doc_id"].notna()].groupby("doc_id"):
        want = ids[key][0]
        for r in rows.itertuples():
            assert zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.start == 64 * r.piece
        assert rows["length"].sum() == sum(map(len, ids[key]))
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() <= 64
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // 64) + 2 and packing.pack_documents(empty).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(40):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(6)}
        used = packing.fullest(counts, 40, max(counts))
        sums = {max(counts)}
        for k, n in counts.items():
            for _ in range(n - (k == max(counts))):
                sums |= {s + k for s in sums if s + k <= 40}
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def edited_by(text, edits):
    for _, start, stop, new in sorted(edits):
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        text = text[:start] + new + text[stop:]
    return text


def n_ids(own, text):
    return len(own.tokenizer.encode(text, add_special_tokens=False).ids)


def test_edited_documents():
    own, rng = encode.encoder(), random.Random(9)
    for text in ["", " a  b ", "one two\nthree don't stop", "long word " * 50]:
        doc = token_counts.EditedDocument(text, np.array([len(own.encode(c)) for c in token_counts._CHUNK.findall(text)], np.int64), own)
        for _ in range(80):
            a, new = rng.randint(0, doc.n_chars + 3), rng.choice(["", " ", "x", "y z  w", "  it's", "\n", "some more words come in here "])
            b = a + rng.randint(0, 9)
            want = edited_by(doc.text, [(0, a, b, new)])
            doc.edit(a, b, new)
            assert doc.text == want and doc.n_tokens == n_ids(own, want) and doc.n_chars == len(want)
            chars, tokens = doc.tree_leaves()
            again = token_counts.EditedDocument(want, tokens, own, chars)
            assert again.n_tokens == doc.n_tokens and again.text == want


def test_edits_stay_local():
    """After a large insertion small edits are as cheap as before, and so are insertions in one place."""
    own = encode.encoder()
    doc = token_counts.EditedDocument("start of a text", np.array([1, 1, 1, 1]), own)
    doc.edit(6, 6, "many words " * 20_000)
    large = doc.encoded
    assert large < 11 * 20_000 + 20
    for k in range(5):
        doc.edit(50_000 * k + 8, 50_000 * k + 10, "xy")
    assert doc.encoded - large < 200
    for _ in range(300):
        doc.edit(1000, 1000, "one more ")
    assert doc.encoded - large < 300 * 60 and doc.n_tokens == n_ids(own, doc.text)


def test_token_counts(spark, docs, empty):
    own = encode.encoder()
    edits = [(3, 2, 0, 5, None), (3, 1, 4, 4, " new "), (None, 1, 0, 1, "x"), (5, 1, -4, 10**9, "all new"), *((6, k, 2 * k, 2 * k + 1, f" w{k}") for k in range(25))]
    table = spark.createDataFrame(edits, "doc_id long, seq int, start long, stop long, new string")
    by_doc = defaultdict(list)
    for i, seq, a, b, new in edits:
        by_doc[i].append((seq, a, b, new or ""))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = sorted(((i, n_ids(own, t), n_ids(own, u), len(u)) for i, t in rows for u in [edited_by(t, by_doc[i] if i is not None else [])]), key=by_value)
    trees = token_counts.token_trees(docs)
    for given, most in ((docs, 10**5), (trees, 10**5), (docs, 7)):
        found = token_counts.count_with_edits(given, table, at_once=most).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_chars_edited) for r in found), key=by_value) == want
    # a second batch on the trees that the first one left
    second = spark.createDataFrame([(6, 1, 3, 8, "again"), (7, 1, 0, 0, "first ")], "doc_id long, seq int, start long, stop long, new string")
    kept = token_counts.count_with_edits(trees, table, with_trees=True).drop("n_segments", "n_tokens", "n_tokens_edited", "n_encoded", "n_chars_edited")
    again = {r.doc_id: r for r in token_counts.count_with_edits(kept, second).where("doc_id in (6, 7)").collect()}
    six, seven = edited_by(edited_by(dict(rows)[6], by_doc[6]), [(1, 3, 8, "again")]), "first " + dict(rows)[7]
    assert (again[6].n_tokens_edited, again[7].n_tokens_edited) == (n_ids(own, six), n_ids(own, seven)) and again[7].n_encoded < 60
    assert token_counts.count_with_edits(empty, table).count() == 0 and token_counts.token_trees(empty).count() == 0


def test_token_count_query(spark):
    """Every row of the query against the library's own encoding of the edited text."""
    sf, own = "/root/testdata/sf0.001", encode.encoder()
    found = {r.doc_id: r for r in queries.op7_token_counts(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        t, n = r.text or "", len(r.text or "")
        steps = [(1, n // 2, n // 2 + 40, ""), (2, n // 3, n // 3, "an added remark, "), (3, 0, min(12, n), t[-25:] if n else "")]
        u, got = edited_by(t, steps), found[r.doc_id]
        assert (got.n_segments, got.n_tokens, got.n_tokens_edited, got.n_chars_edited) == (max(1, len(words(t))) if t else 0, n_ids(own, t), n_ids(own, u), len(u)) or not t


def test_media(spark, docs, empty):
    found = media.media_features(docs, strict=True)
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == docs.count()
    for r in docs.where("doc_id is not null").collect():
        data = (r.text or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        x = rows[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) and x.error is None
        stored = media.wav(payload, len(data))
        with wave.open(io.BytesIO(stored)) as w:  # any reader of the format finds the payload as its samples
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert (x.media_bytes, x.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        middle = [b - 128 for b in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(middle, middle[1:], strict=False))
        ranges = [sum(b // 32 == k for b in payload) for k in range(8)]
        assert x.feature == f"sum={sum(middle)};energy={sum(v * v for v in middle)};crossings={crossings};ranges={','.join(map(str, ranges))}"
    assert media.media_features(empty).count() == 0
    names = spark.createDataFrame([("null", "a"), (None, "b"), ("~null", "c"), ("id=x", "d"), ("", "e")], "doc_id string, text string")
    assert {r.doc_id: r.n_bytes for r in media.media_features(names).collect()} == {"null": 1, None: 1, "~null": 1, "id=x": 1, "": 1}
    manifest = media.write_media(docs.coalesce(1), scratch_path(spark, "media"))
    path = spark.read.parquet(manifest).first().path
    for partitions in (1, 3, 1000):
        assert media.read_media(spark, manifest, range_bytes=2000, partitions=partitions).select("offset").distinct().count() == docs.count()
    members = media.read_media(spark, manifest, range_bytes=2000, batch_bytes=5000)
    one = sorted(members.collect(), key=lambda r: r.offset)[10]
    data = bytearray(open(path, "rb").read())
    data[one.offset + 45 : one.offset + 60] = b"\xff" * 15
    open(path, "wb").write(bytes(data))
    read = media.member_features(media.read_media(spark, manifest, retries=2, pause=0)).collect()
    assert len(read) == docs.count() and [r.member for r in read if r.error] == [one.member]


def brute_copies(rows, seed=42):
    """How often the mix holds each (id, text, source, weight), by the definition; rows that are equal in all share a list."""
    size = [len(words(t)) for _, t, _, _ in rows]
    sources = sorted({s for _, _, s, _ in rows}, key=lambda s: (s is None, s))
    weight, total = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sources)}, sum(size)
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    target, left, open_ = dict.fromkeys(sources, 0.0), 1.5 * total, set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2.0 * own[s]}
        for s in full or open_:
            target[s] = 2.0 * own[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    copies = defaultdict(list)
    for s in sources:
        epochs = target[s] // own[s] if own[s] else 0
        rest, upto = target[s] - epochs * own[s], 0
        keyed = []
        for (i, t, x, q), n in zip(rows, size, strict=True):
            if x == s:
                name = str(i) if i is not None else "null/" + hashlib.md5((t or "").encode()).hexdigest()
                u = (int(hashlib.md5(f"{seed}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                keyed.append((-math.log(u) / (q if q and q > 0 else 1.0), i, t, n))
        for _, i, t, n in sorted(keyed, key=lambda r: r[0]):
            upto += n
            copies[i, t].append(int(epochs + (n > 0 and rest > 0 and upto - n / 2 <= rest)))
    return copies


def test_mixing(spark, docs, empty):
    found = mixing.mix_sources(docs, bucket_rows=10).toPandas()
    again = mixing.mix_sources(docs.repartition(3), bucket_rows=10).toPandas()
    key = ["doc_id", "text_hash", "source", "size", "taken"]
    assert found[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    own = found.assign(source=found["source"].fillna("~")).groupby("source").agg(size=("size", "sum"), n=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), top=("size", "max"))
    assert (own["size"] == own["n"]).all() and ((own["taken"] - own["target"]).abs() <= own["top"]).all() and (own["target"] <= 2 * own["n"]).all()
    assert own["target"].sum() == pytest.approx(1.5 * found["size"].sum()) and (found["taken"] <= 2 * found["size"]).all()
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixing_by_definition(spark):
    """Weights of six orders, null ids, odd weights; a narrow bucket; documents by broadcasts and by a shuffle."""
    rng = random.Random(8)
    rows = [(i if i % 9 else None, f"text {i} " * rng.randint(0, 6), rng.choice(["a", "a", "b", None]), rng.choice([0.001, 0.5, 1.0, 1000.0, None, -1.0])) for i in range(400)]
    d = spark.createDataFrame([(i, t, s, "clash") for i, t, s, _ in rows], "doc_id long, text string, source string, rank_key string").repartition(3)
    q = spark.createDataFrame([(i, w) for i, _, _, w in rows], "id long, w double")
    want = brute_copies([(i, t, s, w if i is not None else None) for i, t, s, w in rows])
    for bucket_rows in (5, 20_000):
        got = defaultdict(list)
        for r in mixing.mix_sources(d, quality=q, bucket_rows=bucket_rows).join(d.selectExpr("doc_id as d", "text", "xxhash64(text) as h"), mixing.F.expr("doc_id <=> d and text_hash = h")).collect():
            got[r.doc_id, r.text].append(r.copies)
        assert {k: sorted(set(v)) for k, v in got.items()} == {k: sorted(set(v)) for k, v in want.items()}
    once = {k: max(v) for k, v in want.items() if max(v)}
    for most in (10**6, 0):
        out = mixing.mix_documents(d, quality=q, bucket_rows=5, broadcast_rows=most)
        assert out.columns == d.columns
        assert {(r.doc_id, r.text): r["count"] for r in out.groupBy("doc_id", "text").count().collect()} == once


def test_mixing_of_equal_keys(spark):
    """Rows that repeat an id, or are equal in all: intervals narrow by text hash and then by row."""
    rows = [(7, f"a b {i}", "s") for i in range(60)] + [(8, "same text here", "s")] * 60
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed, plan, cuts, _ = mixing._mixed(d, "doc_id", "text", "source", None, mixing.WEIGHTS, 1.5, 2.0, 42, 5)
    assert cuts.first().n <= 5
    found = mixing._chosen(keyed, plan, cuts).toPandas()
    assert abs((found["copies"] * found["size"]).sum() - found["target"][0]) <= 3


def test_secrets(spark, docs, empty):
    rows = secrets.labelled_findings()
    forest = secrets.train_forest(rows)
    other = secrets.labelled_findings(600, seed=99)
    p = forest.probability(np.array([secrets.features(*r[:4]) for r in other])) >= 0.5
    assert np.mean(p == np.array([r[4] == 1 for r in other])) > 0.95
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = f'é text token = "{key}" then commit {key[::-1]} and 2669109448945250, {"word" * 9}.'
    d = spark.createDataFrame([(1, text, "s"), (2, None, None), (3, "", "s"), (1, text, "s")], "doc_id long, text string, source string")
    found = secrets.find_secrets(d, forest).collect()
    assert [(r.doc_id, text[r.start : r.stop]) for r in found] == [(1, key)] * 2
    redacted = secrets.redact_secrets(d, forest).collect()
    assert redacted[0].text == text.replace(key, secrets.MARK) and redacted[1].text is None and len(redacted) == 4
    assert secrets.find_secrets(empty, forest).count() == 0 and secrets.redact_secrets(docs, forest).count() == docs.count()


def test_secrets_of_unseen_shapes():
    """Forests that never saw a shape still judge it, but for bare hexadecimal keys, which look like checksums."""
    for shape, secret in (("base64", True), ("forge", True), ("chat", True), ("password", True), ("md5", False), ("uuid", False), ("snake", False), ("mail", False)):
        forest = secrets.train_forest(secrets.labelled_findings(2000, without=(shape,)), trees=20)
        rows = secrets.labelled_findings(300, seed=5, only=(shape,))
        assert np.mean((forest.probability(np.array([secrets.features(*r[:4]) for r in rows])) >= 0.5) == secret) > 0.9, shape


def brute_findings(text, path, forest):
    """Candidates by regular expressions over the bytes of one text, judged one by one."""
    raw = (text or "").encode()
    t, mixed = raw.decode("latin-1"), lambda x: bool(re.search("[0-9]", x)) or (len(re.findall("[A-Z]", x)) >= 2 and bool(re.search("[a-z]", x)))
    names = "|".join(re.escape(x) for x in sorted(secrets.CREDENTIALS, key=len, reverse=True))
    named = lambda at: re.search(rf"(?:{names})[\"']?\s{{0,3}}$", t[max(0, at - 48) : at], re.IGNORECASE | re.ASCII)
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/=_.-]{16,}", t):
        if not mixed(m[0]):
            continue
        cuts = [m.start() + k for k, c in enumerate(m[0]) if c == "=" and named(m.start() + k)]
        for a, b in zip([m.start(), *(c + 1 for c in cuts)], [*cuts, m.end()], strict=True):
            b = a + len(t[a:b].rstrip(".-=/"))
            a = b - len(t[a:b].lstrip(".-=/+"))
            if b - a >= 16 and (not cuts or mixed(t[a:b])):
                found.append((a, -b, "run"))
    for m in re.finditer("[=:]", t):
        v = re.compile(r"\s{0,3}([\"']?)((?:(?!&[\w.-]+=)[^\s\"'<>]){8,})", re.ASCII).match(t, m.end())
        if v and named(m.start()):
            found.append((v.start(2), -v.end(2), "assigned"))
    best = []
    for a, b, kind in sorted(found, key=lambda x: x[:2]):
        if best and a < best[-1][1]:
            if -b - a > best[-1][1] - best[-1][0]:
                best[-1] = (a, -b, kind)
        else:
            best.append((a, -b, kind))
    out = []
    for a, b, kind in best:
        text_of = lambda x, y: raw[x:y].decode("utf-8", "ignore")
        x = secrets.features(text_of(max(0, a - 48), a), text_of(a, b), text_of(b, b + 48), path)
        trees = [0.0]
        for feature, threshold, left, right, value in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if x[feature[at]] <= threshold[at] else right[at]
            trees.append(value[at])
        q = sum(trees) / len(forest.trees)
        if q >= 0.5:
            out.append((len(raw[:a].decode()), len(raw[:b].decode()), kind, round(q, 9), hashlib.sha256(raw[a:b]).hexdigest()))
    return out


def test_secret_query(spark):
    """Every row of the query against candidates and trees taken one by one; a long text with many findings is quick."""
    sf, forest = "/root/testdata/sf0.001", secrets.train_forest(secrets.labelled_findings())
    want = [(r.doc_id, *f) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for f in brute_findings(r.text, r.source, forest)]
    got = [(r.doc_id, r.start, r.stop, r.kind, round(r.probability, 9), r.secret_sha256) for r in queries.op10_secret_scans(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    many = "é token = '04dbebab91ab85687d33eeaaf9ac699e1188f962' and https://x/?access_token=ghp_abcdefghijklmnopqrstuvwxyz0123456789&b=1 " * 300
    found = secrets.scan_batch(pa.array([many]), [None], forest)[0]
    assert [(f["start"], f["stop"], f["kind"]) for f in found] == [x[:3] for x in brute_findings(many, None, forest)] and len(found) == 600


def test_toxicity_scores(spark):
    """Scores against forward and backward sums, features and a logistic curve written out for one text after the other."""
    p = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{p}/documents.parquet"), spark.read.parquet(f"{p}/labels.parquet")
    model = toxicity.train_on(d, labels.where(~toxicity.held_out()), train_docs=60, train_total=200_000, train_tokens=50_000)
    texts = [r.text for r in d.join(labels.where("toxic = 1"), "doc_id").orderBy("doc_id").limit(15).collect()] + ["", None, "one", "one two"]
    scores, _ = toxicity.score_batch(pa.array(texts), model)
    a = np.exp(model.transitions)
    for text, score in zip(texts, scores, strict=True):
        data, offsets = toxicity.text_buffers(pa.array([text]))
        around = toxicity.tokens(data[: offsets[-1]], offsets)[-1]
        e = [math.exp(min(20, max(-20, sum(float(model.weights[k]) for k in row) + model.bias))) for row in toxicity.slots(around).T]
        forward, backward = [], [(1.0, 1.0)]
        for t, x in enumerate(e):
            f = (1.0, math.exp(model.start) * x) if t == 0 else (forward[-1][0] * a[0, 0] + forward[-1][1] * a[1, 0], (forward[-1][0] * a[0, 1] + forward[-1][1] * a[1, 1]) * x)
            forward.append((f[0] / sum(f), f[1] / sum(f)))
        for x in reversed(e[1:]):
            b = (a[0, 0] * backward[0][0] + a[0, 1] * x * backward[0][1], a[1, 0] * backward[0][0] + a[1, 1] * x * backward[0][1])
            backward.insert(0, (b[0] / sum(b), b[1] / sum(b)))
        m = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=False)]
        strong = sum(x for x in m if x > 0.5)
        z = float(np.dot([1.0, max(m, default=0.0), math.log1p(strong), strong / max(1, len(m))], model.score))
        assert score == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, z)))), abs=1e-6)


def test_training_is_bounded(spark):
    """One row a repeated id, no more documents and characters than the bounds say; the same model whatever the order."""
    rows = [(i % 40, f"good words {i % 40} " * 5) for i in range(200)] + [(i, f"vile slur {i} " * 5) for i in range(40, 80)] + [(None, "x"), (99, None), (98, "y" * 300_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(100)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    one, two = (toxicity.train_on(x, labels, train_docs=30, train_total=2000, train_tokens=100) for x in (d, d.repartition(5)))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.score, two.score)
    assert toxicity.train_on(d.limit(0), labels).score is None


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == before.columns
        if name == "ngram_join":
            own = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(k for k, n, c, _ in own if k == c or not n)
        if name in ("toxicity", "secret_scans"):
            assert docs.count() > 0.8 * before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == docs.count()
