"""N-gram Jaccard join by vertical partitioning.

The n-grams of all texts have one global order, that of their 64-bit hashes. The order is cut into
fragments, and every document's set into one segment per fragment.

*Candidates.* Two sets of a size class differ in at most ``d`` n-grams if they link, so of ``d + 1 + e``
fragments at least ``1 + e`` hold equal segments. For large sets fewer and longer segments do: hashes scatter the differing n-grams over the
fragments, and so many are cut that the chance that fewer than ``1 + e`` stay free of them is below e ** -SURE, or 5e-18, for any texts
(the number that stay free counted as Poisson). A document with at most ``e`` empty segments therefore
shares an equal, non-empty segment with each of its partners, and segment hashes find the pair. Where
both documents have more empty segments than that, both also offer the prefix of their sets (the
classical prefix filter), which must have an n-gram in common. But for that chance no candidate of a link is missed, nothing
is capped, and a passage that many documents share gives no long lists, since a segment also holds what
surrounds it.

*Bitmaps.* Each set keeps the parities of its n-grams in ``BITS`` buckets. Two sets differ in at least as many n-grams
as their parities do, which bounds their overlap and rules pairs out.

*Hot groups.* Nodes are distinct sets, so exact copies collapse before any pair exists and count as weights. Signatures
that several sets of a task share are salted before their rows meet. Signatures travel packed by ranges, each range small against a task. Signatures
with the same members are one bucket; members of a large bucket are dealt into blocks, and each pair of blocks is a
task's key of its own. Sets in many large buckets meet at the least signature that they share.

*Overlaps.* Pairs are never rows: a row holds a node and the list of its partners in a cell. Clusters of candidates are
cut into blocks likewise, a cell is a pair of blocks, and ``FRAGMENTS`` fragments of the global order count the partial overlaps of a
cell's pairs separately, from their own part of the sets; a second pass sums them per pair. It gives each node's
number of links, its partners, and a forest that spans the cell's links, from which components are made.

Cases: null or blank texts have an empty set and link with nothing; fewer than n words make one n-gram;
repeated rows are copies; null ids take the component of their text; extra columns are ignored; an empty
table gives an empty result. Different sets whose 64-bit hashes agree are found by a second hash and parted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from porespan.llm.memory import frugal
from porespan.llm.words import batch_shingle_sets, mix
from porespan.operators.graph import connected_components
from porespan.session import discard, drop_shuffles, materialize

#: Broadcast no more than this many ids (8 bytes each); beyond, tables are joined by shuffles.
BROADCAST_IDS = 1_000_000
#: Sets in a block of a large bucket or cluster, n-grams in a block of a cluster, and rows of small buckets in a group.
BLOCK, BLOCK_GRAMS, GROUP_ROWS = 256, 1 << 20, 4_000
#: Bits of a signature that are kept, signatures of a task that are packed at once, and n-grams of all sets to a part.
SIG_BITS, PORTION, PART_GRAMS = 48, 1 << 20, 1 << 21
PACKED = "part int, base long, steps binary, nodes binary"
#: Fewer than d + 1 + e fragments miss a link with a chance below e ** -SURE.
SURE = 40
#: Parts of the global order whose overlaps are counted apart.
FRAGMENTS = 4
#: Signatures of large buckets that a set carries in order to meet a partner once.
CARRIED = 32
#: Distinct sets that one task remembers in order to emit each of them once.
REMEMBERED = 500_000
#: Sets of a portion of texts (about a megabyte) that share a signature from which on it is salted, and salts.
OFTEN, SALTS = 4, 64
MAX_SIZE = 1 << 31
#: Parity bits of a set, kept in longs.
BITS = 512
PARITIES = [f"p{i}" for i in range(BITS // 64)]
#: Pairs that a task compares at once.
PAIRS = 1 << 18
CELL = ["group", "large", "i", "j"]


@dataclass(frozen=True)
class SizeClasses:
    """Size classes for the threshold num / den: class i has sizes low[i] to low[i + 1] - 1."""

    num: int
    den: int

    @staticmethod
    def _expected(e: int) -> int:
        """The least mean of a Poisson count that is at most ``e`` with a chance below e ** -SURE."""
        mean = SURE + e
        while sum(exp(i * log(mean) - mean - lgamma(i + 1)) for i in range(e + 1)) >= exp(-SURE):
            mean += 1
        return mean

    def _enough(self, d: int, e: int) -> int:
        """The least number of fragments of which enough are expected to be free of ``d`` n-grams that hashes scatter, so that ``1 + e`` are."""
        mean = self._expected(e)
        lo, hi = 1, 2 * d + 2 * mean
        while lo < hi:
            k = (lo + hi) // 2
            lo, hi = (lo, k) if k * exp(-d / k) >= mean else (k + 1, hi)
        return lo

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(low, joins, fragments, spare): sizes from ``joins[i]`` on can have partners in class i."""
        num, den = self.num, self.den
        gap = lambda top: 2 * top * (den - num) // (den + num)  # noqa: E731  most differing n-grams
        low = [1]
        while gap(low[-1]) == 0:
            low[-1] += 1
        while low[-1] < MAX_SIZE:
            low.append(-(-low[-1] * den * den // (num * num)))
        joins, fragments, spare = [], [], []
        for i in range(len(low) - 1):
            least = -(-num * low[i] // den)
            d, e = gap(low[i + 1] - 1), 1
            for _ in range(3):
                k = min(d + 1 + e, self._enough(d, e))
                empty = k * exp(-least / k)
                e = max(1, min(ceil(empty + 2 * sqrt(empty)), d + 2))
            joins.append(least)
            fragments.append(min(d + 1 + e, self._enough(d, e)))
            spare.append(e)
        return tuple(np.array(x, np.int64) for x in (low, joins, fragments, spare))


# ---------------------------------------------------------------- sets


def _sums(h: np.ndarray, of: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    total = np.zeros(n, np.uint64)
    if len(h):
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        total[of[starts]] = mix(np.add.reduceat(mix(h), starts) + size[of[starts]].astype(np.uint64))
    return total


def _set_hash(h: np.ndarray, of: np.ndarray, n: int, clash: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, check, size) of each of n sets: a 64-bit hash, an independent one, and the number of n-grams; the empty set has 0.

    ``clash`` are the hashes that different sets share (their checks differ): there both hashes make the node.
    """
    size = np.bincount(of, minlength=n) if len(of) else np.zeros(n, np.int64)
    node, check = _sums(h, of, n, size), _sums(~h, of, n, size)
    if len(clash):
        shared = np.isin(node.view(np.int64), clash)
        node[shared] = mix(node[shared] ^ mix(check[shared]))
    return node.view(np.int64), check.view(np.int64), size


def _parities(h: np.ndarray, of: np.ndarray, n: int) -> list[np.ndarray]:
    """The parity bits of n sets, in longs."""
    odd = np.bincount(of * BITS + (h & np.uint64(BITS - 1)).astype(np.int64), minlength=n * BITS).reshape(n, BITS) & 1
    return list(np.packbits(odd.astype(np.uint8), axis=1).view(np.int64).T.copy())


def set_table(docs: DataFrame, id_col: str, text_col: str, n: int, clash: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, node, check, parities)``: node stands for the document's whole n-gram set, null if empty."""
    clash = np.zeros(0, np.int64) if clash is None else clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, h, of in batch_shingle_sets(batch.column(1), n):
                node, check, size = _set_hash(h, of, last - first, clash)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(first, last - first) for i in (0, 2)), pa.array(size, pa.int64()), pa.array(node, mask=size == 0), pa.array(check),
                        *map(pa.array, _parities(h, of, last - first)),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "node", "check", *PARITIES],
                )

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("text_hash", "n_shingles", "node", "check", *PARITIES))])
    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(text_col))).mapInArrow(frugal(run), schema)


def _parted(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """The written table of sets, and the hashes that different sets share: some N ** 2 / 2 ** 65 of N sets, so hardly ever one."""
    sets = materialize(set_table(docs, id_col, text_col, n), "sets")
    mixed = sets.where("node is not null").groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y")
    clash = np.array([r[0] for r in mixed.select("node").collect()], np.int64)
    if len(clash):
        discard(sets)
        sets = materialize(set_table(docs, id_col, text_col, n, clash), "sets")
    return sets, clash


def _new_nodes(seen: set[int], node: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Marks sets that this task has not emitted yet."""
    fresh = np.zeros(len(node), bool)
    for i in np.flatnonzero(size > 0):
        key = int(node[i])
        if key not in seen:
            fresh[i] = True
            seen.add(key)
    if len(seen) > REMEMBERED:
        seen.clear()
    return fresh


def _sets_of(docs: DataFrame, text_col: str, n: int, clash: np.ndarray) -> DataFrame:
    """``(node, g0, g1, ...)``: the distinct sets of the given documents by fragment of the order, once per task."""
    names = [f"g{f}" for f in range(FRAGMENTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, last, h, of in batch_shingle_sets(batch.column(0), n):
                node, _, size = _set_hash(h, of, last - first, clash)
                fresh = _new_nodes(seen, node, size)
                keep = fresh[of]
                h, of = h[keep], of[keep]
                if not len(h):
                    continue
                row = np.cumsum(fresh) - 1
                part = fragment_of(h)
                lists = []
                for f in range(FRAGMENTS):
                    own = part == f
                    count = np.bincount(row[of[own]], minlength=int(fresh.sum()))
                    lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(h[own].view(np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array(node[fresh]), *lists], ["node", *names])

    return docs.select(text_col).mapInArrow(frugal(run), "node long, " + ", ".join(f"{g} array<long>" for g in names))


def fragment_of(h: np.ndarray) -> np.ndarray:
    """The fragment of the global order that an n-gram lies in."""
    return (((h >> np.uint64(32)) * np.uint64(FRAGMENTS)) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------- signatures


def segment_signatures(h: np.ndarray, of: np.ndarray, size: np.ndarray, classes: tuple, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set index) under which sets meet all their possible partners."""
    low, joins, fragments, spare = classes
    own = np.searchsorted(low, size, "right") - 1
    found = []
    for up in (0, 1):
        index = own + up
        use = (index >= 0) & (index < len(fragments)) & (size > 0)
        use[use] &= size[use] >= joins[index[use]]
        at = use[of]
        if not at.any():
            continue
        x, doc = h[at], of[at]
        k = fragments[np.clip(index, 0, len(fragments) - 1)]
        part = ((x >> np.uint64(32)) * k[doc].astype(np.uint64)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])
        of_segment = doc[starts]
        tag = (index[of_segment].astype(np.uint64) << np.uint64(40)) + part[starts]
        found.append((mix(np.add.reduceat(mix(x), starts) + mix(tag)), of_segment))
        full = np.bincount(of_segment, minlength=len(size))
        weak = use & (k - full > spare[np.clip(index, 0, len(spare) - 1)])
        if weak.any():
            begins = np.searchsorted(doc, np.arange(len(size)))
            prefix = size + (-num * size) // den + 1
            near = weak[doc] & (np.arange(len(doc)) - begins[doc] < prefix[doc])
            tag = (index[doc[near]].astype(np.uint64) << np.uint64(40)) + np.uint64(1 << 39)
            found.append((mix(x[near] + mix(tag)), doc[near]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in found]), np.concatenate([d for _, d in found])


def _salts(sig: np.ndarray, node: np.ndarray, told: set[int]) -> np.ndarray:
    """0, or 1 to ``SALTS`` where ``OFTEN`` sets or more of a portion share a signature.

    Salted rows count as shared without being compared. The first two of a task stay unsalted, so that rows of
    other tasks meet them.
    """
    salt = np.zeros(len(sig), np.int8)
    order = np.argsort(sig, kind="stable")
    start = np.flatnonzero(np.r_[True, sig[order][1:] != sig[order][:-1]]) if len(sig) else np.zeros(0, np.int64)
    length = np.diff(np.r_[start, len(sig)])
    for at, n in zip(start[length >= OFTEN].tolist(), length[length >= OFTEN].tolist(), strict=True):
        rows = order[at : at + n]
        key = int(sig[rows[0]])
        rows = rows if key in told else rows[2:]
        told.add(key)
        salt[rows] = 1 + np.mod(node[rows], SALTS)
    if len(told) > REMEMBERED:
        told.clear()
    return salt


def _packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """``(part, base, steps, nodes)`` of signatures of ``SIG_BITS``, salts and nodes: by range of the signatures, in ascending order, as steps from one to the next.

    Salted rows go to parts of their own, from ``parts`` on, by salt.
    """
    sig, salt, node = (np.concatenate(x) for x in zip(*held, strict=True))
    part = (((sig >> np.uint64(SIG_BITS - 32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    part = np.where(salt > 0, parts + ((mix(sig) >> np.uint64(33)).astype(np.int64) + salt) % parts, part)
    order = np.lexsort((sig, part))
    sig, part, node = sig[order], part[order], node[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    rows = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        steps = np.diff(sig[lo:hi], prepend=sig[lo])
        steps = steps.astype(np.uint32) if steps.max() < 1 << 32 else steps
        rows.append((int(part[lo]), int(sig[lo]), steps.tobytes(), node[lo:hi].tobytes()))
    for lo in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + 64], strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "base", "steps", "nodes"])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, nodes) of rows of ``_packed``."""
    sig, node = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for base, steps, nodes in zip(*(table[c].to_pylist() for c in ("base", "steps", "nodes")), strict=True):
        node.append(np.frombuffer(nodes, np.int64))
        wide = np.uint64 if len(steps) == len(nodes) else np.uint32
        sig.append(np.uint64(base) + np.cumsum(np.frombuffer(steps, wide), dtype=np.uint64))
    return np.concatenate(sig).view(np.int64), np.concatenate(node)


def signature_table(docs: DataFrame, text_col: str, n: int, num: int, den: int, clash: np.ndarray, parts: int) -> DataFrame:
    """``(part, base, steps, nodes)``: the signatures of every distinct set, once per task, packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen, told, held, rows = SizeClasses(num, den).tables(), set(), set(), [], 0
        for batch in batches:
            for first, last, h, of in batch_shingle_sets(batch.column(0), n):
                node, _, size = _set_hash(h, of, last - first, clash)
                fresh = _new_nodes(seen, node, size)
                keep = fresh[of]
                sig, doc = segment_signatures(h[keep], of[keep], np.where(fresh, size, 0), classes, num, den)
                sig = sig >> np.uint64(64 - SIG_BITS)
                held.append((sig, _salts(sig.view(np.int64), node[doc], told), node[doc]))
                rows += len(sig)
                if rows >= PORTION:
                    yield from _packed(held, parts)
                    held, rows = [], 0
        if rows:
            yield from _packed(held, parts)

    return docs.select(text_col).mapInArrow(frugal(run), PACKED)


def _shared(signatures: DataFrame, parts: int = 1) -> DataFrame:
    """Distinct ``(sig, node)`` of the signatures that more than one node has (or salted ones), from packed ones or from rows ``(sig, salt, node)``.

    A set that several tasks emit can be salted in one and not in another, so duplicates go at the end.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _packed([(batch["sig"].to_numpy().view(np.uint64), batch["salt"].to_numpy(), batch["node"].to_numpy())], parts)

    if "part" not in signatures.columns:
        signatures = signatures.select("sig", "salt", "node").mapInArrow(pack, PACKED)

    def run(table: pa.Table) -> pa.Table:
        sig, node = _unpacked(table)
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        if len(sig) and table["part"][0].as_py() < parts:
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            more = np.minimum.reduceat(node, start) != np.maximum.reduceat(node, start)
            keep = np.repeat(more, np.diff(np.r_[start, len(sig)]))
            sig, node = sig[keep], node[keep]
        return pa.table({"sig": sig, "node": node})

    # as many partitions as parts, whatever the session's number: a task sorts and holds one or a few
    return signatures.repartition(2 * parts, "part").groupBy("part").applyInArrow(run, "sig long, node long").distinct()


def _once(docs: DataFrame, sets: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without rows whose set a row of lesser id has, if the ids that go or those that stay are few enough for a broadcast."""
    held = sets.where("node is not null")
    stay = materialize(held.groupBy("node").agg(F.min("doc_id").alias(id_col)).select(id_col).where(F.col(id_col).isNotNull()).distinct(), "stay")
    go = materialize(held.select(F.col("doc_id").alias(id_col)).where(F.col(id_col).isNotNull()).distinct().join(stay, id_col, "left_anti"), "go")
    n, gone = stay.count(), go.count()
    if gone <= min(n, BROADCAST_IDS):
        return docs.join(F.broadcast(go), id_col, "left_anti") if gone else docs
    return docs.join(F.broadcast(stay), id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull())) if n <= BROADCAST_IDS else docs


# ---------------------------------------------------------------- pairs within a task


def _joined(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For n things with links ``left, right``: the least thing that each reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _grouped(key: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    """Lists of the values of keys 0 to n - 1; keys ascend."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(key, minlength=n))], pa.int32()), pa.array(value))


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    lists = table[column].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _within(start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows r < s of each run, in bounded portions."""
    ends = np.cumsum(length)
    at = np.repeat(start - (ends - length), length) + np.arange(length.sum())
    more = np.repeat(start + length, length) - at - 1
    done, lo = np.cumsum(more), 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
        k = more[lo:hi]
        left = np.repeat(at[lo:hi], k)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        lo = hi


def _across(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of a and one of b, in bounded portions."""
    step = max(1, PAIRS // max(1, len(b)))
    for lo in range(0, len(a), step):
        part = a[lo : lo + step]
        yield np.repeat(part, len(b)), np.tile(b, len(part))


def _meets_here(carried: np.ndarray, rows: np.ndarray, sig: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether ``sig`` is the least signature that the rows' lists share; ``carried`` and ``rows`` are its values and their rows."""
    values, column = np.unique(carried, return_inverse=True)
    n = int(max(left.max(initial=0), right.max(initial=0), rows.max(initial=0))) + 1
    has = np.zeros((n, len(values) + 1), bool)
    has[rows, column] = True
    out, step = np.ones(len(left), bool), max(1, (1 << 22) // (len(values) + 1))
    for lo in range(0, len(left), step):
        both = has[left[lo : lo + step]] & has[right[lo : lo + step]]
        first = both.argmax(axis=1)
        any_ = both[np.arange(len(both)), first]
        out[lo : lo + step] = ~any_ | (values[np.minimum(first, len(values) - 1)] >= sig) if len(values) else True
    return out


def candidate_lists(cell: pa.Table, num: int, den: int) -> pa.Table:
    """``(node, root, others)`` of the pairs of a cell that sizes and parities allow to link: each pair in the list of its lesser node.

    A cell holds whole small buckets, or one block of a large bucket, or two (then only pairs across count).
    """
    cell = cell.take(pc.sort_indices(cell, [("sig", "ascending"), ("node", "ascending")]))
    sig, node, size, block = (cell[c].to_numpy() for c in ("sig", "node", "n", "block"))
    bits = np.stack([cell[c].to_numpy() for c in PARITIES], axis=1).view(np.uint64)
    large = bool(cell["large"][0].as_py())
    i, j = cell["i"][0].as_py(), cell["j"][0].as_py()
    if i != j:
        pairs = _across(np.flatnonzero(block == i), np.flatnonzero(block != i))
    else:
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        length = np.diff(np.r_[start, len(sig)])
        pairs = _within(start[length > 1], length[length > 1])
    nodes, own = np.unique(node, return_inverse=True)
    carried, lengths = _flat(cell, "carried") if large else (np.zeros(0, np.int64), None)
    found = [np.zeros(0, np.int64)]
    for left, right in pairs:
        total = size[left] + size[right]
        lesser = np.minimum(size[left], size[right])
        near = lesser * (num + den) >= total * num
        left, right, total, lesser = left[near], right[near], total[near], lesser[near]
        differ = np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1).astype(np.int64)
        near = np.minimum(lesser, (total - differ) // 2) * (num + den) >= total * num
        left, right = left[near], right[near]
        if large and len(left):
            here = _meets_here(carried, np.repeat(np.arange(len(sig)), lengths), int(sig[0]), left, right)
            left, right = left[here], right[here]
        a, b = own[left], own[right]
        found.append(np.unique((np.minimum(a, b) * len(nodes) + np.maximum(a, b))[a != b]))
    code = np.unique(np.concatenate(found))
    a, b = code // max(1, len(nodes)), code % max(1, len(nodes))
    root = _joined(a, b, len(nodes))
    used = np.zeros(len(nodes), bool)
    used[a] = used[b] = True
    row = np.cumsum(used) - 1
    return pa.table({"node": nodes[used], "root": nodes[root[used]], "others": _grouped(row[a], nodes[b], int(used.sum()))})


def _pairs(two: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, a, b): the distinct pairs of lists ``(node, others)``, as indices of ``nodes``, a < b, ascending."""
    b, lengths = _flat(two, "others")
    a = np.repeat(two["node"].to_numpy(), lengths)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    code = np.unique(np.minimum(x, y) * len(nodes) + np.maximum(x, y))
    return nodes, code // max(1, len(nodes)), code % max(1, len(nodes))


def partial_overlaps(two: pa.Table, some: pa.Table) -> pa.Table:
    """``(node, others, common)``: n-grams of one fragment that each pair of ``two`` shares, by the sets in ``some``."""
    nodes, a, b = _pairs(two)
    if not len(a):
        return pa.table({"node": nodes[:0], "others": _grouped(a, nodes[b], 0), "common": _grouped(a, b, 0)})
    grams, lengths = _flat(some, "grams")
    values, dense = np.unique(grams, return_inverse=True)
    at = np.searchsorted(nodes, some["node"].to_numpy())
    here = (at < len(nodes)) & (nodes[np.minimum(at, len(nodes) - 1)] == some["node"].to_numpy())
    size, offset = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    size[at[here]], offset[at[here]] = lengths[here], (np.cumsum(lengths) - lengths)[here]
    held, common = np.zeros(len(values), bool), np.zeros(len(a), np.int64)
    cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own, other = dense[offset[a[lo]] : offset[a[lo]] + size[a[lo]]], b[lo:hi]
        held[own] = True
        k = size[other]
        ends = np.cumsum(k)
        hit = np.zeros(int(ends[-1]) + 1, np.int64)
        np.cumsum(held[dense[np.arange(ends[-1]) + np.repeat(offset[other] - (ends - k), k)]], out=hit[1:])
        common[lo:hi] = hit[ends] - hit[ends - k]
        held[own] = False
    left = nodes[a[cuts[:-1]]]
    row = np.repeat(np.arange(len(left)), np.diff(cuts))
    return pa.table({"node": left, "others": _grouped(row, nodes[b], len(left)), "common": _grouped(row, common, len(left))})


def summed_links(parts: pa.Table, facts: pa.Table, num: int, den: int) -> pa.Table:
    """``(node, root, linked, others)`` from the partial overlaps of a cell and its nodes' ``(n, rows)``.

    ``linked`` counts the rows that a node's links in the cell reach; ``others`` are those of greater hash.
    """
    b, lengths = _flat(parts, "others")
    common, _ = _flat(parts, "common")
    a = np.repeat(parts["node"].to_numpy(), lengths)
    nodes, at = np.unique(facts["node"].to_numpy(), return_index=True)
    size, rows = facts["n"].to_numpy()[at], facts["rows"].to_numpy()[at]
    code, of = np.unique(np.searchsorted(nodes, a) * len(nodes) + np.searchsorted(nodes, b), return_inverse=True)
    overlap = np.bincount(of, common, len(code)).astype(np.int64)
    a, b = code // len(nodes), code % len(nodes)
    link = overlap * (num + den) >= (size[a] + size[b]) * num
    a, b = a[link], b[link]
    linked = np.bincount(a, rows[b], len(nodes)) + np.bincount(b, rows[a], len(nodes))
    used = linked > 0
    row = np.cumsum(used) - 1
    return pa.table({"node": nodes[used], "root": nodes[_joined(a, b, len(nodes))[used]], "linked": linked[used].astype(np.int64), "others": _grouped(row[a], nodes[b], int(used.sum()))})


# ---------------------------------------------------------------- the join


def _candidates(shared: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Written ``(node, root, others)``: all pairs that share a signature and may link.

    Signatures are one bucket if the number and two sums of their members' hashes agree; sums, unlike parities, also tell rows that come twice.
    """
    total = lambda h: F.sum(F.shiftrightunsigned(h, 24).cast("decimal(18,0)"))
    buckets = shared.groupBy("sig").agg(F.count("*").alias("m"), total(F.xxhash64("node")).alias("x"), total(F.xxhash64("node", F.lit(1))).alias("y"))
    buckets = buckets.where("m > 1").groupBy("m", "x", "y").agg(F.min("sig").alias("sig"))
    held = materialize(shared.join(buckets.select("sig", F.ceil(F.col("m") / BLOCK).alias("blocks")), "sig"), "held")
    facts = sets.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in PARITIES])
    carried = F.slice(F.sort_array(F.collect_list("sig")), 1, CARRIED)
    facts = facts.join(held.where("blocks > 1").groupBy("node").agg(carried.alias("carried")), "node", "left")
    groups = held.where("blocks = 1").count() // GROUP_ROWS + 1
    dealt = held.join(facts, "node").withColumns({"large": F.col("blocks") > 1, "block": F.pmod("node", "blocks")})
    dealt = dealt.withColumn("group", F.when(F.col("large"), F.col("sig")).otherwise(F.pmod(F.xxhash64("sig"), F.lit(groups))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "group", "large", "sig", "node", "n", "block", "carried", *PARITIES)

    def run(cell: pa.Table) -> pa.Table:
        return candidate_lists(cell, num, den)

    found = materialize(dealt.groupBy(*CELL).applyInArrow(run, "node long, root long, others array<long>"), "lists")
    discard(held)
    return found


def _linked(lists: DataFrame, sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, clash: np.ndarray) -> DataFrame:
    """Written ``(node, root, linked, others)`` of the pairs that link, by cell. Sets are rebuilt for one document of each node."""
    cluster = materialize(connected_components(lists, "node", "root"), "cluster")
    owner = sets.where("node is not null").join(cluster, "node").groupBy("node", "component").agg(F.min(F.struct("doc_id", "n_shingles")).alias("x"), F.count("*").alias("rows"))
    owner = materialize(owner.select("node", "component", "x.doc_id", F.col("x.n_shingles").alias("n"), "rows"), "owner")
    count, grams_in_all = owner.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ids = owner.select(F.col("doc_id").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    ids = F.broadcast(ids) if count <= BROADCAST_IDS else ids
    held = docs.join(ids, id_col, "left_semi")
    if sets.where("doc_id is null").limit(1).count():
        held = held.unionByName(docs.where(F.col(id_col).isNull()))
    grams = _sets_of(held, text_col, n, clash).dropDuplicates(["node"])
    # clusters of one block share groups; larger ones are cut into blocks, and each pair of blocks is a cell
    groups = max(count // BLOCK, grams_in_all // BLOCK_GRAMS) + 1
    blocks = owner.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).alias("blocks"))
    place = owner.join(blocks, "component").select(
        "node", "n", "rows", "blocks",
        F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(groups))).alias("group"),
        (F.col("blocks") > 1).alias("large"), F.pmod("node", "blocks").alias("block"),
    )
    place = materialize(place, "place")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            other, lengths = _flat(table, "others")
            row = np.repeat(np.arange(len(lengths)), lengths)
            mine, theirs = table["block"].to_numpy()[row], np.mod(other, table["blocks"].to_numpy()[row])
            order = np.lexsort((theirs, row))
            row, mine, theirs, other = row[order], mine[order], theirs[order], other[order]
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (theirs[1:] != theirs[:-1])]) if len(row) else np.zeros(0, np.int64)
            at = pa.array(row[start])
            columns = [batch[c].take(at) for c in ("group", "large")] + [pa.array(np.minimum(mine, theirs)[start]), pa.array(np.maximum(mine, theirs)[start]), batch["node"].take(at)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)], pa.int32()), pa.array(other))], [*CELL, "node", "others"])

    dealt = lists.where(F.size("others") > 0).join(place, "node").select("group", "large", "block", "blocks", "node", "others")
    dealt = dealt.mapInArrow(frugal(deal), "group long, large boolean, i long, j long, node long, others array<long>")
    # a pair comes once from each group of buckets that it shares; a cell asks for it once
    dealt = materialize(dealt.groupBy(*CELL, "node").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others")), "dealt")
    cells = dealt.select(*CELL).distinct()
    cells = cells.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    facts = materialize(cells.join(place.select("group", "large", "block", "node", "n", "rows"), ["group", "large", "block"]).select(*CELL, "node", "n", "rows"), "facts")
    parts = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"g{f}").alias("grams")) for f in range(FRAGMENTS)])
    own = [F.col(c).alias(f"of_{c}") for c in CELL]
    needs = facts.join(grams, "node").select("node", *own, F.explode(parts).alias("p")).select("node", *[f"of_{c}" for c in CELL], F.col("p.f").alias("of_f"), "p.grams")
    asked = dealt.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))

    def overlaps(key: tuple, two: pa.Table, some: pa.Table) -> pa.Table:
        out = partial_overlaps(two, some)
        for k, c in reversed(list(enumerate(CELL))):
            out = out.add_column(0, c, pa.array([key[k].as_py()] * len(out), two.schema.field(c).type))
        return out

    schema = "group long, large boolean, i long, j long, node long, others array<long>, common array<long>"
    partial = asked.groupBy(*CELL, "f").cogroup(needs.groupBy(*[f"of_{c}" for c in CELL], "of_f")).applyInArrow(overlaps, schema)

    def total(parts: pa.Table, some: pa.Table) -> pa.Table:
        return summed_links(parts, some, num, den)

    sizes = facts.select("node", "n", "rows", *own)
    found = partial.groupBy(*CELL).cogroup(sizes.groupBy(*[f"of_{c}" for c in CELL])).applyInArrow(total, "node long, root long, linked long, others array<long>")
    found = materialize(found, "linked")
    discard(cluster, owner, place, dealt, facts)
    return found


def _join(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """(members, links by cell, written tables that both read)."""
    sets, clash = _parted(docs, id_col, text_col, n)
    parts = int(sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]) // PART_GRAMS + 1
    packed = signature_table(_once(docs, sets, id_col), text_col, n, num, den, clash, parts)
    shared = materialize(_shared(packed, parts), "shared")
    drop_shuffles(docs.sparkSession)
    lists = _candidates(shared, sets, num, den)
    discard(shared)
    drop_shuffles(docs.sparkSession)
    linked = _linked(lists, sets, docs, id_col, text_col, n, num, den, clash)
    discard(lists)
    drop_shuffles(docs.sparkSession)
    label = materialize(connected_components(linked, "node", "root"), "label")
    nodes = (
        sets.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
        .join(label, "node", "left")
        .where("rows > 1 or component is not null")
        .select("node", "first", "rows", F.coalesce("component", "node").alias("component"))
    )
    nodes = materialize(nodes, "nodes")
    degree = linked.groupBy("node").agg(F.sum("linked").alias("linked"))
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    known = nodes.join(least, "component").join(degree, "node", "left").select("node", "component", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    known = materialize(known, "known")
    discard(label, nodes)
    tables = (sets, known, linked)
    if known.count() <= BROADCAST_IDS // 4:
        known = F.broadcast(known)
    members = sets.join(known, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", "node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return members, linked, tables


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (80, 100)
) -> tuple[DataFrame, DataFrame]:
    """Documents whose n-gram sets have a Jaccard similarity of at least ``threshold[0] / threshold[1]``.

    Returns ``members`` with a row for each row of ``docs`` (``doc_id, text_hash, n_shingles, node,
    component, component_id, n_links``) and ``links`` (``a, b``), all links between nodes, i.e. distinct sets. ``component`` is
    the least node of the document's component (rows with an equal id can be in several); ``component_id`` is
    the least id that links reach; ``n_links`` counts the other rows that the row links with, copies among them.
    """
    members, linked, _ = _join(docs, id_col, text_col, n, *threshold)
    return members, linked.select(F.col("node").alias("a"), F.explode("others").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one row of each group of linked documents, that of least id (and text hash); all columns stay.

    Rows with an empty set stay, one of each that repeats both id and text. The ids that go are fewer than those that
    stay: they are broadcast if they are within ``BROADCAST_IDS``, and texts aren't shuffled then.
    """
    members, _, tables = _join(docs, id_col, text_col, n, *threshold)
    group = F.when(F.col("node").isNotNull(), F.concat(F.lit("n"), F.col("component").cast("string"))).otherwise(F.concat_ws("/", F.lit("e"), "doc_id", "text_hash"))
    rows = members.select(group.alias("g"), F.isnull("doc_id").alias("none"), "doc_id", "text_hash")
    least = rows.groupBy("g").agg(F.min(F.struct("none", "doc_id", "text_hash")).alias("r"), F.count("*").alias("rows")).where("rows > 1")
    least = materialize(least.select("g", F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__hash")), "least")
    some = F.broadcast(least) if least.count() <= BROADCAST_IDS // 4 else least
    gone = rows.join(some, "g").where("not (doc_id <=> __id and text_hash <=> __hash)").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    gone = materialize(gone.distinct(), "gone")
    again = rows.groupBy("doc_id", "text_hash").count().where("count > 1").join(least, F.expr("doc_id <=> __id and text_hash <=> __hash"), "left_semi")
    again = materialize(again.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "again")
    discard(*tables, least)
    few = lambda t: F.broadcast(t) if t.count() <= BROADCAST_IDS else t
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col("__hash"))
    found = docs.join(few(gone), same, "left_anti")
    if again.limit(1).count():  # rows that repeat id and text
        twice = few(again)
        once = found.join(twice, same, "left_semi").withColumn("__hash", F.xxhash64(F.col(text_col))).dropDuplicates([id_col, "__hash"]).drop("__hash")
        found = found.join(twice, same, "left_anti").unionByName(once)
    return found
