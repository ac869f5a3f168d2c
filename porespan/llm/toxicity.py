"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

*Labelled tokens.* Where only documents are labelled, ``label_tokens`` marks a word toxic if the contexts
(neighbouring words) in which it occurs lie in toxic documents far more often than chance explains (a
likelihood-ratio test); the first bytes of words are tested like words. Contexts are counted once, so copies of a document add nothing.

*Model.* Two tags. A token's potential sums hashed weights of its word, of its first bytes (so that other forms
of a word count as well) and of its neighbours; transitions and
the start have weights of their own. Training maximises the regularised likelihood of the tags by Adam on
exact forward-backward marginals. The ratio of the forward (and of the backward) values of both tags
follows Moebius maps, whose composition is a product of 2 x 2 matrices, so numpy runs the recursions
for a whole batch of texts in blocks, with a reset at the start of each text.

*Scores.* A logistic model over the greatest marginal and the expected number and share of toxic tokens,
fitted to the labels of the training documents. Tokens with a marginal over one half are offending
spans, given as character offsets. Only the text enters a score.

Cases: null, empty and wordless texts get the score of a document without toxic tokens; without any
training labels every score is 0; null ids are never trained on; labels repeated for an id count as their
maximum; extra columns are dropped; a long text is one chain, never cut.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from porespan.llm.memory import frugal
from porespan.llm.words import ALNUM, chunks, mix, span_hashes, spans, text_buffers

#: Bounds of the training sample: documents of each label, characters of one of them, characters of each label's
#: documents together, and tokens on which the field's weights are fitted. All are parameters of ``train_on``.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_TOTAL, TRAIN_TOKENS = 1000, 200_000, 4_000_000, 400_000
BITS, STEPS = 18, 60
#: Likelihood ratio and share of toxic contexts from which on a word is marked in toxic documents.
MIN_RATIO, MIN_SHARE = 25.0, 0.85
#: Lengths in bytes of the beginnings of words.
STEMS = (4, 6)


@dataclass
class ToxicityModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -5.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    score: np.ndarray | None = None

    def potentials(self, at: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[at].sum(axis=0) + self.bias, -20, 20).astype(np.float64)


# ---------------------------------------------------------------- tokens


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index, is first of its text, hashes of word, stems and neighbours) of all words."""
    starts, ends, text = spans(data, offsets, ALNUM)
    h = span_hashes(data, starts, ends)
    first = np.ones(len(h), bool)
    first[1:] = text[1:] != text[:-1]
    before, after = np.zeros_like(h), np.zeros_like(h)
    if len(h):
        before[1:] = h[:-1]
        before[first] = 1
        after[:-1] = h[1:]
        after[np.r_[first[1:], True]] = 2
    stems = [span_hashes(data, starts, np.minimum(ends, starts + k)) for k in STEMS]
    return starts, ends, text, first, np.stack([h, *stems, before, after])


def slots(around: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Rows of the weight table for word, stems, previous word and next word."""
    shift = np.uint64(64 - bits)
    return np.stack([(mix(x + np.uint64(i)) >> shift).astype(np.int32) for i, x in enumerate(around)])


# ---------------------------------------------------------------- exact recursions


def _scan(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """x[t] = (p[t] x[t-1] + q[t]) / (r[t] x[t-1] + s[t]), x[-1] = 1, in blocks."""
    n = len(p)
    steps = max(1, int(np.sqrt(n)))
    blocks = -(-n // steps)
    pad = steps * blocks - n
    p, q, r, s = (np.concatenate([x, np.full(pad, v)]).reshape(blocks, steps).T.copy() for x, v in ((p, 1.0), (q, 0.0), (r, 0.0), (s, 1.0)))
    a, b, c, d = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(steps):
        a, b, c, d = p[t] * a + q[t] * c, p[t] * b + q[t] * d, r[t] * a + s[t] * c, r[t] * b + s[t] * d
        scale = 1 / np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    x, begin = 1.0, np.empty(blocks)
    for i, (e, f, g, h) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        begin[i] = x
        x = (e * x + f) / max(g * x + h, 1e-300)
    out, x = np.empty((steps, blocks)), begin
    for t in range(steps):
        x = (p[t] * x + q[t]) / (r[t] * x + s[t])
        out[t] = x
    return out.T.reshape(-1)[:n]


def forward_backward(s: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Ratios (toxic over clean) of the forward and the backward values at every token."""
    if not len(s):
        return s, s
    a, e = np.exp(transitions), np.exp(s)
    p, q = np.where(first, 0.0, e * a[1, 1]), np.where(first, e * np.exp(start), e * a[0, 1])
    r, d = np.where(first, 0.0, a[1, 0]), np.where(first, 1.0, a[0, 0])
    forward = _scan(p, q, r, d)
    last, e_next = np.r_[first[1:], True][::-1], np.r_[e[1:], 1.0][::-1]
    p, q = np.where(last, 0.0, a[1, 1] * e_next), np.where(last, 1.0, a[1, 0])
    r, d = np.where(last, 0.0, a[0, 1] * e_next), np.where(last, 1.0, a[0, 0])
    return forward, _scan(p, q, r, d)[::-1]


def marginals(s: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: float) -> np.ndarray:
    forward, backward = forward_backward(s, first, transitions, start)
    odds = forward * backward
    return odds / (1 + odds)


# ---------------------------------------------------------------- training


def label_tokens(around: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tags of tokens from labels of texts: true for the words that mark toxic texts, in toxic texts."""
    if not len(text):
        return np.zeros(0, bool)
    bad = toxic[text].astype(bool)
    context = mix(around[0] + mix(around[-2] + np.uint64(7) * mix(around[-1])))
    key = mix(context * np.uint64(2) + bad.astype(np.uint64))
    once = np.unique(key, return_index=True)[1]
    base = min(max(bad[once].mean(), 1e-6), 1 - 1e-6)
    log = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / y), 0.0)
    tags = np.zeros(len(text), bool)
    for row in around[: 1 + len(STEMS)]:
        keys, of = np.unique(row[once], return_inverse=True)
        n = np.bincount(of).astype(float)
        share = np.bincount(of, weights=bad[once]) / n
        ratio = 2 * n * (log(share, base) + log(1 - share, 1 - base))
        tags |= np.isin(row, keys[(share >= MIN_SHARE) & (ratio >= MIN_RATIO) & (share > base)])
    return bad & tags


def fit_crf(at: np.ndarray, first: np.ndarray, tags: np.ndarray, steps: int = STEPS, rate: float = 0.3, ridge: float = 1e-6) -> ToxicityModel:
    """Weights of greatest regularised likelihood; ``at`` are the tokens' slots."""
    model, y = ToxicityModel(), tags.astype(float)
    n, size = max(1, len(y)), 1 << BITS
    params = np.zeros(size + 6)  # weights, bias, start, transitions
    params[size] = model.bias
    m, v = np.zeros_like(params), np.zeros_like(params)
    inner = ~first
    seen = [((~tags[:-1] if i == 0 else tags[:-1]) & (~tags[1:] if j == 0 else tags[1:]) & inner[1:]).sum() for i in (0, 1) for j in (0, 1)]
    for step in range(1, steps + 1):
        model.weights, model.bias, model.start, model.transitions = params[:size], params[size], params[size + 1], params[size + 2 :].reshape(2, 2)
        s = model.potentials(at)
        forward, backward = forward_backward(s, first, model.transitions, model.start)
        odds = forward * backward
        gap = y - odds / (1 + odds)
        a, e = np.exp(model.transitions), np.exp(s)
        f, b = forward[:-1], backward[1:] * e[1:]
        pair = [a[0, 0] * np.ones_like(f), a[0, 1] * b, a[1, 0] * f, a[1, 1] * f * b]
        total = sum(pair)
        grad = np.zeros_like(params)
        for row in at:
            grad[:size] += np.bincount(row, weights=gap, minlength=size)
        grad[size], grad[size + 1] = gap.sum(), gap[first].sum()
        grad[size + 2 :] = [c - (x / total)[inner[1:]].sum() for c, x in zip(seen, pair, strict=True)]
        grad = grad / n - ridge * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights = params[:size].astype(np.float32)
    model.bias, model.start, model.transitions = float(params[size]), float(params[size + 1]), params[size + 2 :].reshape(2, 2).copy()
    return model


def document_features(marginal: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(1, greatest marginal, log of the expected toxic tokens, their share) for each of n texts."""
    top = np.zeros(n)
    np.maximum.at(top, text, marginal)
    strong = np.where(marginal > 0.5, marginal, 0.0)
    expected, count = np.bincount(text, strong, n), np.bincount(text, minlength=n)
    return np.stack([np.ones(n), top, np.log1p(expected), expected / np.maximum(count, 1)], axis=1)


def fit_scores(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(texts: pa.Array, toxic: np.ndarray, clean_weight: float = 1.0, train_tokens: int = TRAIN_TOKENS) -> ToxicityModel:
    """A model from texts and their 0/1 labels. ``clean_weight``: how many clean texts one of the sample stands for.

    The field is fitted to at most ``train_tokens`` tokens, half of them from texts that hold marked words.
    """
    data, offsets = text_buffers(texts)
    n, parts = len(toxic), []
    for lo, hi in chunks(offsets):
        _, _, text, first, around = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        parts.append((text + lo, first, around))
    text, first = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    around = np.concatenate([p[2] for p in parts], axis=1)
    tags, at = label_tokens(around, text, toxic), slots(around)
    # texts with tags come first, then others, up to the bound on tokens
    held = np.bincount(text, tags, n) > 0
    order = np.lexsort((np.arange(n) * 2654435761 % 1000003, ~held))
    count = np.bincount(text, minlength=n)
    half = np.cumsum(np.where(held[order], count[order], 0)) <= train_tokens // 2
    rest = np.cumsum(np.where(held[order], 0, count[order])) <= train_tokens // 2
    used = np.zeros(n, bool)
    used[order] = np.where(held[order], half, rest)
    pick = used[text] if len(text) else np.zeros(0, bool)
    model = fit_crf(at[:, pick], first[pick], tags[pick]) if pick.any() else ToxicityModel()
    x = document_features(marginals(model.potentials(at), first, model.transitions, model.start), text, n)
    w = fit_scores(x, toxic.astype(float))
    w[0] -= np.log(clean_weight)
    model.score = w
    return model


def train_on(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS,
    train_total: int = TRAIN_TOTAL, train_tokens: int = TRAIN_TOKENS,
) -> ToxicityModel:
    """Trains on a bounded sample of labelled documents, which a single task gathers; only the model reaches the driver.

    Of each label at most ``train_docs`` ids, those of least hash, one row each; of these the texts of at most
    ``train_chars`` characters, and of those the first by hash that have ``train_total`` characters together.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.where("y in (0, 1)")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not total:
        return ToxicityModel()
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(train_docs) for y in (0, 1)]
    sample = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * train_docs ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.char_length("text") <= train_chars).join(sample, "id")
    rows = rows.groupBy("y", "id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("y", "id", "x.text")  # a repeated id counts once
    upto = F.sum(F.char_length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= train_total).select("y", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        # rows arrive in any order; sort, so that training is repeatable
        found = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("text", "ascending")])
        y = found["y"].to_numpy().astype(int)
        scale = lambda v: total.get(v, 0) / max(1, int((y == v).sum()))
        texts = found["text"].combine_chunks()
        model = train(texts, y, scale(0) / scale(1) if scale(1) else 1.0, train_tokens)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    made = rows.repartition(1).mapInArrow(frugal(run), "model binary").first()
    return pickle.loads(made["model"]) if made else ToxicityModel()


# ---------------------------------------------------------------- scoring

SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def score_batch(texts: pa.Array, model: ToxicityModel) -> tuple[np.ndarray, list[list[dict]]]:
    """(score, offending spans in characters) of each text."""
    data, offsets = text_buffers(texts)
    score, found = np.zeros(len(texts)), [[] for _ in range(len(texts))]
    if model.score is None:
        return score, found
    for lo, hi in chunks(offsets):
        base = offsets[lo]
        part, cut = data[base : offsets[hi]], offsets[lo : hi + 1] - base
        starts, ends, text, first, around = tokens(part, cut)
        p = marginals(model.potentials(slots(around)), first, model.transitions, model.start)
        x = document_features(p, text, hi - lo) @ model.score
        score[lo:hi] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        bad = np.flatnonzero(p > 0.5)
        if len(bad):
            chars = np.zeros(len(part) + 1, np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
            joined = np.zeros(len(bad), bool)
            joined[1:] = (bad[1:] == bad[:-1] + 1) & (text[bad[1:]] == text[bad[:-1]])
            for i, j in enumerate(bad.tolist()):
                k = int(text[j])
                at, to = int(chars[starts[j]] - chars[cut[k]]), int(chars[ends[j]] - chars[cut[k]])
                if joined[i]:
                    found[lo + k][-1]["stop"] = to
                else:
                    found[lo + k].append({"start": at, "stop": to})
    return score, found


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, score, spans)`` for every row, with the columns ``keep`` of ``docs`` before them if they are named."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights
    fields = [F.col(id_col).alias("doc_id")] if keep is None else [F.col(c) for c in keep]
    rows = docs.select(*fields, F.col(text_col).alias("__text"))
    schema = rows.drop("__text").withColumns({"__score": F.lit(0.0), "__spans": F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, found = score_batch(batch.column(batch.num_columns - 1), held.value)
            columns = [*batch.columns[:-1], pa.array(score), pa.array(found, pa.list_(SPAN))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "__score", "__spans"])

    out = rows.mapInArrow(frugal(run), schema)
    return out.withColumnsRenamed({"__score": "score", "__spans": "spans"} if keep is None else {})
