"""Secret scans: candidates by form, and a random forest that removes false positives.

*Candidates.* Runs of at least ``MIN_RUN`` letters, digits and ``+/=_.-`` that hold a digit or mix cases, and values
of at least ``MIN_VALUE`` characters that are assigned (``=`` or ``:``) to a name such as password or token. A run is
cut at an ``=`` that follows such a name, and a value ends at the next parameter of a query (``&name=``).

*Forest.* Trees on length, character transitions and entropy, shares of character classes, dictionary
coverage, known prefixes, placeholders, how the value is assigned and quoted, words before it and the path.
It is trained from labelled findings, a table ``(before, candidate, after, path, secret)``. Where no such table
is at hand, ``labelled_findings`` makes one from the published shapes of keys and of look-alikes
(commits, checksums, UUIDs, card numbers, addresses, names, placeholders); its secrets are cut as candidates are, and
some keys with a known prefix stand without a name.

Cases: null and empty texts have no candidates; a long candidate is one; overlapping candidates count as the
longer one; repeated rows are scanned each; null paths say nothing; extra columns are dropped by
``find_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porespan.llm.memory import frugal
from porespan.llm.words import chunks, text_buffers

MIN_RUN, MIN_VALUE, NEAR = 16, 8, 48
#: Labelled findings on which a forest is trained at most; trees, their depth, and the least probability of a finding.
TRAIN_ROWS, TREES, DEPTH, THRESHOLD = 6000, 40, 10, 0.5
MARK = "[SECRET]"

# Names of credentials, words beside look-alikes, public key prefixes, and common words.
CREDENTIALS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "auth", "credential", "bearer", "key")
LOOKALIKES = ("commit", "sha1", "sha256", "sha", "md5", "hash", "checksum", "digest", "etag", "uuid", "guid", "isbn", "card", "order", "version", "revision", "build", "image", "http", "www")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "npm_", "SG.")
PLACEHOLDERS = ("xxxx", "your", "example", "dummy", "changeme", "placeholder", "sample", "12345678", "0000", "abcdef", "test", "insert")
WORDS = (
    "the and for that with this from have not you are was but all can has will one about which when make like time just know take into year good some could them see other than then now look only come over think also back after use two how our work first well way even new want because any these give day most access account action address admin application array async author backup base basic block body branch build button cache call change channel check class client close cloud code color column command comment common config connect content context control copy count create current custom data database date debug default delete demo deploy description design develop device dialog directory display document domain download driver edit element email enable encode engine entity entry error event example exception execute export feature field file filter find folder format frame function generate global group handler hash header height help history home host html http image import index info input insert install instance integer interface internal issue item java json key label language large last layout level library license limit line link list load local lock log login main manager map master match member memory menu message method model module name network next node number object open option order output package page parameter parent password path pattern plugin point policy port position post print private process product profile program project property provider public query queue read record reference region release remote remove render report request reset resource response result return role root route rule run sample save schema scope screen script search section secret security select send server service session setting shape show simple single size sort source split stack start state status step stop storage store stream string style submit success support switch system table target task template test text thread title token tool total trace track transaction transfer tree type update upload user util value variable vector version video view web widget width window worker write"
).split()

_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_.-"]] = True
_NAMED = re.compile(rb"(?:" + b"|".join(re.escape(x.encode()) for x in sorted(CREDENTIALS, key=len, reverse=True)) + rb")[\"']?\s{0,3}$", re.IGNORECASE)
_VALUE = re.compile(rb"\s{0,3}([\"']?)((?:(?!&[\w.-]+=)[^\s\"'<>]){8,})")
_DICTIONARY = re.compile("|".join(sorted({w for w in WORDS if len(w) > 2}, key=len, reverse=True)))


# ---------------------------------------------------------------- features


def features(before: str, candidate: str, after: str, path: str | None) -> list[float]:
    n = max(1, len(candidate))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in candidate]
    share = [kinds.count(k) / n for k in "dulo"]
    counts = {c: candidate.count(c) for c in set(candidate)}
    lower, near = candidate.lower(), before.lower()
    letters = sum(k in "ul" for k in kinds)
    tail = near.rstrip().rstrip("\"'").rstrip()
    name = re.search(r"([a-z0-9_-]+)\W*$", near)
    name = name[1] if name else ""
    run = best = 1
    for a, b in zip(candidate, candidate[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return [
        math.log(n),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        *share,
        float(all(c in "0123456789abcdef" for c in lower)),
        sum(len(x) for x in _DICTIONARY.findall(lower)) / max(1, letters),
        float(candidate.startswith(PREFIXES)),
        float(any(x in lower for x in PLACEHOLDERS)),
        best / n,
        float(tail.endswith(("=", ":"))),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(any(x in name for x in CREDENTIALS)),
        float(any(x in near[-32:] for x in CREDENTIALS)),
        float(any(x in near[-32:] for x in LOOKALIKES)),
        float(bool(re.search(r"test|example|fixture|sample|doc|vendor|lock|mock", (path or "").lower()))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", lower))),
        float(candidate.count(".") + candidate.count("/")) / n,
        sum(c in "aeiou" for c in lower) / max(1, letters),
    ]


# ---------------------------------------------------------------- forest


@dataclass
class Forest:
    """Trees as arrays (feature, threshold, left, right, value); a leaf has feature -1."""

    trees: list[tuple[np.ndarray, ...]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                go = x[i, feature[at[i]]] <= threshold[at[i]]
                at[i] = np.where(go, left[at[i]], right[at[i]])
            total += value[at]
        return total / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, left_depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
        if left_depth == 0 or len(rows) < 4 or nodes[me][4] in (0.0, 1.0):
            return me
        best = None
        for f in rng.choice(x.shape[1], max(2, int(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, s = x[rows, f][order], np.cumsum(y[rows][order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n, k = cut + 1.0, s[cut]
            m, j = len(rows) - n, s[-1] - k
            gini = k * (1 - k / n) + j * (1 - j / m)
            i = int(gini.argmin())
            if best is None or gini[i] < best[0]:
                best = (gini[i], f, (v[cut[i]] + v[cut[i] + 1]) / 2)
        if best is None:
            return me
        _, f, t = best
        go = x[rows, f] <= t
        left, right = split(rows[go], left_depth - 1), split(rows[~go], left_depth - 1)
        nodes[me][:4] = [int(f), t, left, right]
        return me

    split(rng.integers(0, len(y), len(y)), depth)
    a = np.array(nodes)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


def train_forest(findings: list[tuple[str, str, str, str | None, int]], trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
    """A forest from labelled findings ``(before, candidate, after, path, secret)``; without any, none is a secret."""
    if not findings:
        return Forest([(np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.zeros(1))])
    x, y = np.array([features(*f[:4]) for f in findings]), np.array([float(f[4]) for f in findings])
    rng = np.random.default_rng(seed)
    return Forest([_grow(x, y, rng, depth) for _ in range(trees)])


def forest_from_table(findings: DataFrame, train_rows: int = TRAIN_ROWS, **options) -> Forest:
    """Trains on at most ``train_rows`` rows of a labelled table, those of least hash."""
    rows = findings.where("candidate is not null and secret is not null")
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("before", "candidate", "after")], "path", F.col("secret").cast("int").alias("secret"))
    rows = rows.orderBy(F.xxhash64("before", "candidate", "after")).limit(train_rows)
    return train_forest([tuple(r) for r in rows.collect()], **options)


def _as_found(before: str, body: str, after: str) -> tuple[str, str, str]:
    """The longest candidate that meets ``body``, and what stands around it; ``body`` itself if there is none."""
    raw = (before + body + after).encode()
    lo = len(before.encode())
    hi = lo + len(body.encode())
    met = [(b - a, a, b) for _, a, b, _ in candidates(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) if a < hi and b > lo]
    if not met:
        return before, body, after
    _, a, b = max(met)
    return raw[:a].decode("utf-8", "ignore"), raw[a:b].decode("utf-8", "ignore"), raw[b:].decode("utf-8", "ignore")


def labelled_findings(n: int = 4000, seed: int = 11, without: tuple[str, ...] = (), only: tuple[str, ...] = ()) -> list[tuple[str, str, str, str | None, int]]:
    """Half secrets, half look-alikes, made from published shapes; the same rows for the same arguments.

    ``without`` leaves shapes of secrets or look-alikes out, ``only`` takes no others, so that a forest can be tested on shapes it hasn't seen.
    """
    rng = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(rng.choices(chars, k=k))
    syllables = [a + b for a in ("th", "an", "er", "qu", "la", "de", "st", "ch", "pr", "on", "") for b in ("ion", "ent", "a", "ing", "os", "eau", "ung", "re", "er")]
    prose = lambda k: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(k))
    folder = lambda: rng.choice([None, "src", "src/app.py", "config/settings.yml", "tests/test_login.py", "docs/example.md", "vendor/x.lock", "web"])
    keys = {
        "hex": lambda: some(hexa, rng.choice([32, 40, 40, 48, 64])), "letters": lambda: some(alnum, rng.randint(20, 48)), "base64": lambda: some(alnum + "+/", 40), "cloud": lambda: "AKIA" + some(alnum[:26] + "234567", 16),
        "forge": lambda: "ghp_" + some(alnum, 36), "payment": lambda: "sk_live_" + some(alnum, 24), "web_token": lambda: "eyJ" + some(alnum + "_-", 40) + "." + some(alnum + "_-", 43),
        "chat": lambda: "xoxb-" + some("0123456789", 12) + "-" + some(alnum, 24), "password": lambda: some(alnum + "!#$%*", rng.randint(10, 16)),
    }
    lookalikes = {
        "commit": lambda: ("commit ", some(hexa, 40)), "md5": lambda: ("md5: ", some(hexa, 32)), "sha256": lambda: ("sha256:", some(hexa, 64)), "checksum": lambda: ("checksum = ", some(hexa, 40)), "digits": lambda: ("", some("0123456789", 16)),
        "card": lambda: ("card ", some("0123456789", 16)), "uuid": lambda: ("uuid = ", "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))), "placeholder": lambda: ("token = ", rng.choice(["YOUR_TOKEN_HERE_1", "xxxxxxxxxxxxxxxxxxxxxx", "example_token_12345678", "0000000000000000000000"])),
        "address": lambda: ("https://", f"www.{prose(1)}.example.com/{prose(1)}/{rng.randint(1, 999)}"), "mail": lambda: ("", f"{prose(1)}{rng.randint(1, 99)}@{prose(1)}.example.org".replace("@", ".")), "camel": lambda: ("", "".join(x.title() for x in rng.choices(WORDS, k=4))),
        "snake": lambda: ("key: ", "_".join(rng.choices(WORDS, k=4)) + str(rng.randint(1, 9))), "long_word": lambda: ("", "".join(rng.choices(syllables, k=9)).title() + prose(1).upper()), "phone": lambda: ("", "+49-" + some("0123456789", 3) + "-" + some("0123456789", 8)),
        "spoken": lambda: ("password: ", "".join(rng.choices(syllables, k=5))), "version": lambda: ("version ", ".".join(some("123456789", 4) for _ in range(4))), "image": lambda: ("image:", "/".join(rng.choices(WORDS, k=4)) + "-v2.png"), "call": lambda: ("auth = ", ".".join(rng.choices(WORDS, k=3)) + "()"),
    }
    keys, lookalikes = ([f for k, f in x.items() if k not in without and (not only or k in only)] for x in (keys, lookalikes))
    rows = []
    for i in range(n):
        if not (keys if i % 2 else lookalikes):
            continue
        if i % 2:
            body = rng.choice(keys)()
            name = rng.choice([*CREDENTIALS, "token", "token", "access_token", "client_secret", "API_KEY", "db_password"])
            between, quote = rng.choice([" = ", "=", ": ", " : ", " "]), rng.choice(['"', "'", '"', ""])
            if between == " " and not quote and not body.startswith(PREFIXES):
                between = "="
            before, after = f"{prose(4)} {name}{between}{quote}", f"{quote} {prose(3)}"
            if body.startswith(PREFIXES) and rng.random() < 0.4:
                before = f"{prose(4)} {quote}"
            if rng.random() < 0.15:
                before, body, after = before.upper(), body.upper() if all(c in hexa for c in body) else body, after.upper()
        else:
            word, body = rng.choice(lookalikes)()
            quote = rng.choice(["", "", '"'])
            before, after = f"{prose(4)} {word}{quote}", f"{quote} {prose(3)}"
        if i % 2:
            before, body, after = _as_found(before, body, after)
        rows.append((before[-NEAR:], body, after[:NEAR], folder(), i % 2))
    return rows


# ---------------------------------------------------------------- scanning


def candidates(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(text index, first byte, end, kind) of the candidates in texts that ``offsets`` cut ``data`` into."""
    n = len(data)
    if not n:
        return []
    token = _TOKEN[data]
    inside = np.ones(n, bool)
    inside[offsets[:-1][offsets[:-1] < n]] = False
    begin, end = token.copy(), token.copy()
    begin[1:] &= ~(token[:-1] & inside[1:])
    end[:-1] &= ~(token[1:] & inside[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = ends - starts >= MIN_RUN
    starts, ends = starts[long], ends[long]
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    digit, upper, lower = sums((data >= 48) & (data <= 57)), sums((data >= 65) & (data <= 90)), sums((data >= 97) & (data <= 122))
    has = lambda c, k: c[ends] - c[starts] >= k
    mixed = has(digit, 1) | (has(upper, 2) & has(lower, 1))
    raw, found = data.tobytes(), []
    text_of = lambda at: int(np.searchsorted(offsets, at, "right")) - 1
    for first, last in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        t = text_of(first)
        named = [at for at in range(first, last) if raw[at] == 61 and _NAMED.search(raw[max(int(offsets[t]), at - NEAR) : at])]
        for a, b in zip([first, *(at + 1 for at in named)], [*named, last], strict=True):
            while a < b and raw[b - 1] in b".-=/":
                b -= 1
            while a < b and raw[a] in b".-=/+":
                a += 1
            if b - a >= MIN_RUN and (not named or digit[b] - digit[a] or (upper[b] - upper[a] >= 2 and lower[b] - lower[a])):
                found.append((t, a, b, "run"))
    for at in np.flatnonzero((data == 61) | (data == 58)).tolist():
        t = text_of(at)
        if _NAMED.search(raw[max(int(offsets[t]), at - NEAR) : at]) and (m := _VALUE.match(raw, at + 1, int(offsets[t + 1]))):
            found.append((t, m.start(2), m.end(2), "assigned"))
    found.sort(key=lambda x: (x[1], -x[2]))
    out: list[tuple[int, int, int, str]] = []
    for c in found:
        if out and c[1] < out[-1][2]:
            if c[2] - c[1] > out[-1][2] - out[-1][1]:
                out[-1] = c
        else:
            out.append(c)
    return out


def scan_batch(texts: pa.Array, paths: list[str | None], forest: Forest, threshold: float = THRESHOLD) -> list[list[dict]]:
    """The findings of each text: start and stop in characters, kind, candidate, probability."""
    data, offsets = text_buffers(texts)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for lo, hi in chunks(offsets):
        base = offsets[lo]
        part, cut = data[base : offsets[hi]], offsets[lo : hi + 1] - base
        found = candidates(part, cut)
        if not found:
            continue
        raw, rows, kept = part.tobytes(), [], []
        chars = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
        for t, a, b, kind in found:
            text = lambda i, j: raw[i:j].decode("utf-8", "ignore")
            body = text(a, b)
            rows.append(features(text(max(int(cut[t]), a - NEAR), a), body, text(b, min(int(cut[t + 1]), b + NEAR)), paths[lo + t]))
            kept.append((t, a, b, kind, body))
        p = forest.probability(np.array(rows))
        for (t, a, b, kind, body), q in zip(kept, p.tolist(), strict=True):
            if q >= threshold:
                start, stop = int(chars[a] - chars[cut[t]]), int(chars[b] - chars[cut[t]])
                out[lo + t].append({"start": start, "stop": stop, "kind": kind, "candidate": body, "probability": q})
    return out


def find_secrets(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, start, stop, kind, probability, secret_sha256)`` of every finding that the forest keeps."""
    held = docs.sparkSession.sparkContext.broadcast(forest)  # TREES trees of bounded depth
    kind = docs.schema[id_col].dataType
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan_batch(batch["text"], batch["path"].to_pylist(), held.value, threshold)
            at = [i for i, x in enumerate(found) for _ in x]
            flat = [f for x in found for f in x]
            names = ["start", "stop", "kind", "candidate", "probability"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            columns = [pa.array([f[n] for f in flat], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), *columns], ["doc_id", *names])

    found = rows.mapInArrow(frugal(run), f"doc_id {kind.simpleString()}, start long, stop long, kind string, candidate string, probability double")
    return found.select("doc_id", "start", "stop", "kind", "probability", F.sha2("candidate", 256).alias("secret_sha256"))


def redacted(text: str, found: list[dict], mark: str = MARK) -> str:
    out, at = [], 0
    for f in found:
        out += [text[at : f["start"]], mark]
        at = f["stop"]
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = "source", mark: str = MARK, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every kept finding replaced by ``mark``; all rows and columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[text_col]
            paths = batch[path_col].cast(pa.string()).to_pylist() if path_col else [None] * len(texts)
            found = scan_batch(texts, paths, held.value, threshold)
            if any(found):
                new = [redacted(texts[i].as_py(), f, mark) for i, f in enumerate(found) if f]
                texts = pc.replace_with_mask(texts, pa.array([bool(f) for f in found]), pa.array(new, texts.type))
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i), texts)

    return docs.mapInArrow(frugal(run), docs.schema)
