"""Fill-in-the-middle transformation by a parallel automaton scan.

A text's UTF-8 bytes run through an automaton that counts units (code points here) and finds sentinels. Bytes are cut into
chunks, wherever that falls: within a character or a sentinel. Each chunk is scanned from every state at once and emits its
transition function (the state it ends in, for each it may be entered in), the units and the sentinels that it holds for each entry state. Functions compose
associatively, which resolves the states in which chunks are really entered and the number of units before each. A cut after k units
then lies in one known chunk, and only that chunk is scanned again to select its byte.

*Scale.* Texts of one chunk are scanned where they lie, thousands of pieces side by side. Longer texts are cut into chunk rows that are dealt over
all tasks, whatever text they come from; their functions, some dozens of numbers a chunk, are composed per text. No text is shuffled or sent to Python whole, and
texts are taken apart and put together by the engine's own byte functions.

Cases: a null or empty text is plain with an empty output; a text that holds a sentinel is plain; a null id is the word ``null`` in the hashes; rows
that repeat an id get equal cuts where their texts have equal lengths; equal ids, repeated rows, extra columns and columns of
any name are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from porespan.session import materialize

#: Bytes of a chunk row, and of the pieces that one task scans side by side.
CHUNK, PIECE = 1 << 16, 256
#: Chunk functions (or their sums) up to which longer texts are joined with them by a broadcast.
BROADCAST_CHUNKS = 200_000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Automaton:
    """A byte automaton: ``step[state, byte]`` is the next state, ``units`` and ``hits`` count what a step begins and completes. It starts in state 0."""

    step: np.ndarray
    units: np.ndarray
    hits: np.ndarray
    states: int = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "states", len(self.step))


def code_points(sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> Automaton:
    """Units are code points, hits are ends of sentinels (the states are their proper prefixes)."""
    words = [s.encode() for s in sentinels]
    if not all(words):
        raise ValueError("a sentinel must not be empty")
    prefixes = sorted({w[:i] for w in words for i in range(len(w))} | {b""}, key=lambda p: (len(p), p))
    index = {p: i for i, p in enumerate(prefixes)}
    step, hits = np.zeros((len(prefixes), 256), np.uint8 if len(prefixes) < 256 else np.int32), np.zeros((len(prefixes), 256), np.int64)
    for p, i in index.items():
        for b in range(256):
            seen = p + bytes([b])
            hits[i, b] = any(seen.endswith(w) for w in words)
            step[i, b] = next(index[seen[k:]] for k in range(len(seen) + 1) if seen[k:] in index)
    begins = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int64)  # every byte of UTF-8 but a continuation begins a code point
    return Automaton(step, np.broadcast_to(begins, hits.shape).copy(), hits)


# ---------------------------------------------------------------- chunk functions


def scan_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, dfa: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end state, units, hits) of each chunk for each entry state: arrays of chunks by states."""
    n, s = len(starts), dfa.states
    state = np.broadcast_to(np.arange(s), (n, s)).copy()
    units, hits = np.zeros((n, s), np.int64), np.zeros((n, s), np.int64)
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still running are a prefix
    length, at = (ends - starts)[order], starts[order]
    step, unit, hit = dfa.step.ravel().astype(np.int64), dfa.units.ravel(), dfa.hits.ravel()
    for k in range(int(length[0]) if n else 0):
        m = int(np.searchsorted(-length, -k, "left"))
        code = state[:m] * 256 + data[at[:m] + k][:, None]
        units[:m] += unit[code]
        hits[:m] += hit[code]
        state[:m] = step[code]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return state[back], units[back], hits[back]


def compose(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The functions of chunk pairs, ``first`` before ``then``; the operation is associative."""
    end, units, hits = first
    return tuple(np.take_along_axis(x, end, -1) + (0 if i == 0 else (units, hits)[i - 1]) for i, x in enumerate(then))


def reduced(functions: tuple[np.ndarray, ...], of: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The functions of n texts from those of their chunks, in order (``of`` ascends), by composing neighbours in rounds; a text without chunks has the identity."""
    end, units, hits = functions
    s = end.shape[1]
    while True:
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        rank = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
        if not (rank > 0).any():
            break
        right = np.flatnonzero(rank % 2 == 1)
        joined = compose(tuple(x[right - 1] for x in (end, units, hits)), tuple(x[right] for x in (end, units, hits)))
        for x, y in zip((end, units, hits), joined, strict=True):
            x[right - 1] = y
        keep = rank % 2 == 0
        end, units, hits, of = end[keep], units[keep], hits[keep], of[keep]
    out = np.broadcast_to(np.arange(s), (n, s)).copy(), np.zeros((n, s), np.int64), np.zeros((n, s), np.int64)
    for x, y in zip(out, (end, units, hits), strict=True):
        x[of] = y
    return out


def _pieces(offsets: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of the pieces of at most ``size`` bytes of texts."""
    length = np.diff(offsets)
    count = -(-length // size)
    of = np.repeat(np.arange(len(length)), count)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[of] + rank * size
    return starts, np.minimum(starts + size, offsets[of + 1]), of


def select_units(data: np.ndarray, offsets: np.ndarray, entry: np.ndarray, wanted: np.ndarray, dfa: Automaton) -> np.ndarray:
    """For each text (entered in state ``entry``) and each of its row of ``wanted``: the byte from its start before which so many units begin; its end if no more do."""
    starts, ends, of = _pieces(offsets)
    end, units, _ = scan_chunks(data, starts, ends, dfa)
    n, count = len(entry), np.diff(np.searchsorted(of, np.arange(len(entry) + 1)))
    first = np.cumsum(count) - count
    state, before = entry.astype(np.int64).copy(), np.zeros(n, np.int64)
    # states and units at the starts of all pieces, text by text
    states, befores = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    for k in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > k)
        at = first[live] + k
        states[at], befores[at] = state[live], before[live]
        before[live] += units[at, state[live]]
        state[live] = end[at, state[live]]
    out = np.repeat(np.diff(offsets)[:, None], wanted.shape[1], axis=1)
    for q in range(wanted.shape[1]):
        ask = np.flatnonzero(before > wanted[:, q])
        # the last piece before which at most the wanted units begin: befores ascend within a text
        code = np.searchsorted(of * (1 << 32) + befores, ask * (1 << 32) + wanted[ask, q], "right") - 1
        s, seen, at = states[code], befores[code], starts[code].copy()
        while len(ask):
            b = data[at]
            seen = seen + dfa.units[s, b]
            done = seen > wanted[ask, q]
            out[ask[done], q] = at[done] - offsets[ask[done]]
            ask, s, b, seen, at = (x[~done] for x in (ask, s, b, seen, at))
            s, at = dfa.step[s, b].astype(np.int64), at + 1
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _portions(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1))
        yield first, last
        first = last


# ---------------------------------------------------------------- columns


def _scan_udf(dfa: Automaton, portion: int):
    """Struct of arrays ``(ends, units, hits)`` by entry state of the binary argument."""
    kind = pa.struct([("ends", pa.list_(pa.int64())), ("units", pa.list_(pa.int64())), ("hits", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<ends: array<long>, units: array<long>, hits: array<long>>")
    def scan(body: pa.Array) -> pa.Array:
        data, offsets = _bytes(body)
        parts = [[], [], []]
        for first, last in _portions(offsets, portion):
            own = offsets[first : last + 1]
            starts, ends, of = _pieces(own)
            for held, x in zip(parts, reduced(scan_chunks(data, starts, ends, dfa), of, last - first), strict=True):
                held.append(x.reshape(-1))
        cuts = pa.array(np.arange(len(body) + 1) * dfa.states, pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(p) if p else np.zeros(0, np.int64))) for p in parts]
        return pa.StructArray.from_arrays(lists, fields=list(kind))

    return scan


def _select_udf(dfa: Automaton, portion: int):
    """``select_units`` of a binary chunk, the state it is entered in and an array of wanted numbers of units."""

    @F.arrow_udf("array<long>")
    def select(body: pa.Array, entry: pa.Array, wanted: pa.Array) -> pa.Array:
        data, offsets = _bytes(body)
        entry = entry.to_numpy(zero_copy_only=False).astype(np.int64)
        asked = wanted.flatten().to_numpy(zero_copy_only=False).reshape(len(body), -1)
        found = [select_units(data, offsets[a : b + 1], entry[a:b], asked[a:b], dfa) for a, b in _portions(offsets, portion)]
        flat = np.concatenate(found).reshape(-1) if found else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(body) + 1) * asked.shape[1] if len(body) else [0], pa.int32()), pa.array(flat))

    return select


def _draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers from a hash of the seed and an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _composed(pieces: DataFrame, states: int) -> DataFrame:
    """``(digest, n, found, entries, befores)`` of each text from its chunks' functions: states in which chunks are entered, units before them."""
    chunk = F.struct("chunk", "f.ends", "f.units", "f.hits")
    once = pieces.groupBy("digest", "chunk").agg(F.first("f").alias("f"))
    held = once.groupBy("digest").agg(F.sort_array(F.collect_list(chunk)).alias("c"))  # a string holds at most 2 ** 31 bytes, so 2 ** 15 chunks
    empty = F.array().cast("array<long>")
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("h"), empty.alias("entries"), empty.alias("befores"))

    def step(a: Column, c: Column) -> Column:
        at = lambda name: F.get(c[name], a["s"].cast("int"))
        return F.struct(
            at("ends").alias("s"), (a["n"] + at("units")).alias("n"), (a["h"] + at("hits")).alias("h"),
            F.concat(a["entries"], F.array(a["s"])).alias("entries"), F.concat(a["befores"], F.array(a["n"])).alias("befores"),
        )

    return held.select("digest", F.aggregate("c", start, step).alias("a")).select("digest", "a.n", F.col("a.h").alias("found"), "a.entries", "a.befores")


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Texts can be restored if no sentinel lies in another one and none begins as it ends."""
    for i, a in enumerate(sentinels):
        if not a or any(a.startswith(a[k:]) for k in range(1, len(a))) or any(a in b for j, b in enumerate(sentinels) if i != j):
            raise ValueError(f"not a usable sentinel among the three: {a!r}")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim", seed: int = 1, rate: int = 90, spm: int = 20,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), chunk: int = CHUNK, portion: int = 1 << 20,
) -> DataFrame:
    """``docs`` with a struct ``(n, form, prefix_chars, middle_chars, output)`` as ``out_col`` (which replaces a column of that name).

    ``rate`` of a hundred texts are transformed, ``spm`` of a hundred of those with the suffix first; numbers are of code points and null for plain texts.
    """
    check_sentinels(sentinels)
    dfa = code_points(sentinels)
    scan, select = _scan_udf(dfa, portion), _select_udf(dfa, portion)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out_col]
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.struct(*kept).alias("row"), body.alias("body"), _draws(F.col(id_col), seed).alias("h"))
    zero = F.array(F.lit(0).cast("long"))
    short = base.where(F.octet_length("body") <= chunk).withColumn("f", scan("body"))
    short = short.select("row", "body", "h", F.get("f.units", F.lit(0)).alias("n"), F.get("f.hits", F.lit(0)).alias("found"), zero.alias("entries"), zero.alias("befores"))
    short = _with_cuts(short).withColumn("at", select("body", F.lit(0).cast("long"), F.array("low", "high")))
    short = short.withColumns({"from": F.get("at", F.lit(0)), "to": F.get("at", F.lit(1))}).drop("at")

    long = base.where(F.octet_length("body") > chunk)
    each = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("body") - 1) / chunk).cast("int")), lambda i: F.struct(i.alias("chunk"), F.substring("body", i * chunk + 1, F.lit(chunk)).alias("piece")))
    pieces = long.select(F.sha2("body", 256).alias("digest"), F.inline(each)).repartition("digest", "chunk")
    total = materialize(_composed(pieces.select("digest", "chunk", scan("piece").alias("f")), dfa.states), "chunks")
    few = total.agg(F.coalesce(F.sum(F.size("entries")), F.lit(0))).first()[0] <= BROADCAST_CHUNKS
    long = long.withColumn("digest", F.sha2("body", 256)).join(F.broadcast(total) if few else total, "digest").drop("digest")
    long = _with_cuts(long)
    for name, end in (("low", "from"), ("high", "to")):
        long = long.withColumn("k", _chunk_of(F.col(name)))
        piece = F.substring("body", F.col("k") * chunk + 1, F.lit(chunk))
        found = select(piece, F.get("entries", "k"), F.array(F.col(name) - F.get("befores", "k")))
        long = long.withColumn(end, F.get(found, F.lit(0)) + F.col("k").cast("long") * chunk).drop("k")

    both = short.unionByName(long)
    cut = lambda a, b: F.substring("body", a.cast("int") + 1, (b - a).cast("int"))
    size = F.octet_length("body")
    parts = cut(F.lit(0), F.col("from")), cut(F.col("from"), F.col("to")), cut(F.col("to"), size)
    p, s, m = (F.lit(x.encode()) for x in sentinels)
    h = lambda i: F.get("h", F.lit(i))
    plain = (F.col("n") == 0) | (F.col("found") > 0) | (h(2) % 100 >= rate)
    form = F.when(plain, F.lit("plain")).when(h(3) % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    output = F.when(plain, F.col("body")).when(h(3) % 100 < spm, F.concat(s, parts[2], p, parts[0], m, parts[1])).otherwise(F.concat(p, parts[0], s, parts[2], m, parts[1]))
    fim = F.struct("n", form.alias("form"), F.when(~plain, F.col("low")).alias("prefix_chars"), F.when(~plain, F.col("high") - F.col("low")).alias("middle_chars"), output.cast("string").alias("output"))
    return both.select("row.*", fim.alias(out_col))


def _chunk_of(unit: Column) -> Column:
    """The last chunk before which at most so many units begin."""
    return F.size(F.filter("befores", lambda x: x <= unit)) - 1


def _with_cuts(rows: DataFrame) -> DataFrame:
    """Adds the lesser and the greater of a row's two cuts, in units."""
    a, b = (F.get("h", F.lit(i)) % (F.col("n") + 1) for i in (0, 1))
    return rows.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)})


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output and its form were made from."""
    p, s, m = sentinels

    def split(text: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(text, mark, 1)
        return head, F.substr(text, F.char_length(head) + len(mark) + 1)

    def parted(lead: str, second: str) -> tuple[Column, Column, Column]:
        first, rest = split(F.substr(output, F.lit(len(lead) + 1)), second)
        return first, *split(rest, m)

    prefix, suffix, middle = parted(p, s)
    last, first, between = parted(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, between, last)).otherwise(output)
