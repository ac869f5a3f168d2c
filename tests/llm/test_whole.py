"""Tests that operators do the whole job: all links, all groups, all forms of a secret."""

import random

import numpy as np
import pyarrow as pa
import pytest

from porespan.llm import ngram_join, queries, secrets


def shingles(text, n):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_words_of_url_rules(spark, tmp_path):
    """Each rule's word is the contract's: net/ is allowed, example.net/de/8 within it blocked."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://b.example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://b.example.net/de/81": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block"), "http://a.net/en/": (None, "allow"),
    }
    spark.createDataFrame([(i, u, None) for i, u in enumerate(want)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op1_url_filters(spark, str(tmp_path)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in found} == dict(enumerate(want.values()))


@pytest.mark.parametrize("block", [3, 256])
def test_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(5000)
    rows = []
    for size in (1, 2, 12, 30):  # groups of texts that are alike but different, around one passage
        base = [word() for _ in range(90)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(90)] = word()
            rows.append(" ".join(copy))
    rows += [rows[0], rows[0], rows[3], rows[20], None, "", "one two"]
    docs = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(rows)], "doc_id long, text string")
    sets = [shingles(t, 4) for t in rows]
    alike = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 85 * len(x | y)
    want = sorted((i if i != 5 else -1, sum(alike(sets[i], sets[j]) for j in range(len(rows)) if j != i)) for i in range(len(rows)))
    members, links = ngram_join.ngram_jaccard_join(docs, n=4, threshold=(85, 100))
    held = members.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_links) for r in held) == want
    node = {r.doc_id: r.node for r in held}
    of = {s: node[i if i != 5 else None] for i, s in enumerate(sets) if s}
    expected = {tuple(sorted((of[x], of[y]))) for x in of for y in of if x != y and alike(x, y)}
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_links_under_any_partitioning(spark):
    rng = random.Random(11)
    word = lambda: "w%d" % rng.randrange(5000)
    rows = []
    for size in (1, 3, 40, 90):
        base = [word() for _ in range(80)]
        for _ in range(size):
            copy = list(base)
            copy[rng.randrange(80)] = word()
            rows += [" ".join(copy)] * rng.randint(1, 6)
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    seen = []
    for parts in (1, 2, 8, 64):
        members, links = ngram_join.ngram_jaccard_join(docs.repartition(parts), n=4, threshold=(85, 100))
        found = [(r.a, r.b) for r in links.collect()]
        assert len(set(found)) == len(found) and all(a != b for a, b in found)
        seen.append((sorted((r.doc_id, r.component_id, r.n_links) for r in members.collect()), sorted(map(sorted, found))))
    assert all(s == seen[0] for s in seen)


@pytest.mark.parametrize("block", [4, 256])
def test_pairs_of_many_shared_signatures_are_asked_for_once(spark, monkeypatch, block):
    """Near copies share many buckets, which lie in many groups; a node has one row in a cell, and a pair is in one list."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 20)
    rng, kept, asked = random.Random(6), ngram_join.materialize, []

    def watched(df, name="t"):
        out = kept(df, name)
        if name == "dealt":
            asked.extend(out.collect())
        return out

    monkeypatch.setattr(ngram_join, "materialize", watched)
    rows = []
    for size in (2, 12, 12):
        base = ["w%d" % rng.randrange(5000) for _ in range(150)]
        for _ in range(size):
            copy = list(base)
            for _ in range(2):
                copy[rng.randrange(150)] = "x%d" % rng.randrange(5000)
            rows.append(" ".join(copy))
    sets = [shingles(t, 5) for t in rows]
    alike = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    members, _ = ngram_join.ngram_jaccard_join(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    links = {i: sum(alike(x, y) for y in sets) - 1 for i, x in enumerate(sets)}
    assert {r.doc_id: r.n_links for r in members.collect()} == links
    places = [(*(r[c] for c in ngram_join.CELL), r.node) for r in asked]
    pairs = [frozenset((r.node, o)) for r in asked for o in r.others]
    assert len(places) == len(set(places)) and len(pairs) == len(set(pairs)) >= sum(links.values()) // 2 > 20


def test_signatures_of_doubled_rows_stay_apart(spark):
    """A set that two tasks emit, once salted and once not, is one member of its signature."""
    a, b, c, d = 11, 22, 33, 44
    rows = [(1, 0, a), (1, 0, d), (1, 0, b), (1, 3, b), (2, 0, a), (2, 0, d), (2, 0, c), (2, 5, c), (3, 0, a), (3, 1, a), (4, 0, a)]
    shared = ngram_join._shared(spark.createDataFrame(rows, "sig long, salt byte, node long"))
    assert sorted(map(tuple, shared.where("sig < 3").collect())) == [(1, a), (1, b), (1, d), (2, a), (2, c), (2, d)]
    facts = [(n, 10, *[0] * len(ngram_join.PARITIES)) for n in (a, b, c, d)]
    sets = spark.createDataFrame(facts, "node long, n_shingles long, " + ", ".join(f"{p} long" for p in ngram_join.PARITIES))
    lists = ngram_join._candidates(shared, sets, 85, 100).collect()
    pairs = {(r.node, o) for r in lists for o in r.others}
    assert pairs == {(a, b), (a, d), (b, d), (a, c), (c, d)}


def test_kept_by_component(spark):
    rng = random.Random(4)
    text = lambda: " ".join("w%d" % rng.randrange(5000) for _ in range(60))
    apart, near = [text() for _ in range(4)], text()
    rows = [(7, t) for t in apart] + [(7, apart[0]), (None, near), (None, near + " more"), (None, near + " words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.keep_one(docs).collect()
    assert sorted(r.text for r in kept if r.doc_id == 7) == sorted(apart)
    assert len([r for r in kept if r.doc_id is None]) == 1


def test_unquoted_and_bare_secrets():
    rng = random.Random(8)
    some = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))
    forest = secrets.train_forest(secrets.labelled_findings())
    forms = ["run API_KEY={} now", "set token={} and go", "see https://a.example.com/x?access_token={}&page=2 there", "the key {} was left here"]
    texts, keys = [], []
    for form in forms:
        for _ in range(25):
            keys.append("ghp_" + some(36))
            texts.append(form.format(keys[-1]))
    plain = ["set token=" + "example_token_12345678" + " first", "at commit " + "04dbebab91ab85687d33eeaaf9ac699e1188f962", "https://www.site.example.com/path/page=12 is open"]
    found = secrets.scan_batch(pa.array(texts + plain), [None] * (len(texts) + len(plain)), forest)
    for k in range(len(forms)):
        right = sum([f["candidate"] for f in found[i]] == [keys[i]] for i in range(25 * k, 25 * k + 25))
        assert right >= 24, (forms[k], right)
    assert not any(found[len(texts) :])


def test_signatures_travel_packed(spark):
    """Signatures go through the shuffle by ranges, 12 bytes each, once for each set whatever tasks its copies lie in; what is shared is the same."""
    rng = random.Random(11)
    texts = [" ".join("w%d" % rng.randrange(4000) for _ in range(300)) for _ in range(40)]
    texts += [t + " more" for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts * 6)), "doc_id long, text string").repartition(6)
    none = np.zeros(0, np.int64)
    sets, _ = ngram_join._parted(docs, "doc_id", "text", 5)
    rows = ngram_join._once(docs, sets, "doc_id")
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == list(range(50))
    packed = ngram_join.signature_table(rows, "text", 5, 80, 100, none, 4).collect()
    count, size = sum(len(r.nodes) // 8 for r in packed), sum(len(r.steps) + len(r.nodes) for r in packed)
    assert {r.part for r in packed} >= {0, 1, 2, 3} and size <= 16 * count
    by_sig = {}
    for r in packed:
        sig, node = ngram_join._unpacked(pa.Table.from_pylist([r.asDict()]))
        assert (np.diff(sig) >= 0).all()
        for s, n in zip(sig.tolist(), node.tolist(), strict=True):
            by_sig.setdefault(s, set()).add(n)
    want = {(s, n) for s, nodes in by_sig.items() if len(nodes) > 1 for n in nodes}
    for parts in (1, 4):
        found = ngram_join._shared(ngram_join.signature_table(docs, "text", 5, 80, 100, none, parts), parts).collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want and len(want) > 100
    steep = np.array([3, 1 << 47, 5], np.uint64)
    batch = list(ngram_join._packed([(steep, np.zeros(3, np.int8), np.array([7, 8, 9]))], 1))
    assert [x.tolist() for x in ngram_join._unpacked(pa.Table.from_batches(batch))] == [[3, 5, 1 << 47], [7, 9, 8]]
