"""Token counts that follow edits without encoding a document again.

A document keeps a segment tree. Its leaves are pre-token segments, the chunks with the white space before
them; each node holds the characters and tokens below it. An edit replaces a range of characters. The tree is
descended by characters to the segments that the range touches; they and their neighbours up to the next white
space are the boundary context that is encoded again (white space parts pre-tokens of these vocabularies, so
nothing beyond it can change). The new region is cut into segments again, which take the touched leaves' place in their block of leaves, and the
sums on the path above are updated. Blocks take leaves in and split when they grow, so an edit costs its own region and a block, however large the text and
earlier edits were; no text is copied as a whole.

*Kept trees.* ``token_trees`` gives documents with the characters and tokens of their leaves as columns. Calls that get these
columns encode nothing but what edits touch, and can return them for the next call.

Cases: null text is empty and has an empty tree of one leaf; edits out of range are clipped to the text; edits
of a null or unknown document are dropped; a null replacement is empty; edits of a document apply in ascending
``seq``, each to the text that the one before left (equal ``seq``: by start, stop and replacement); documents without edits
keep their counts; repeated rows are documents of their own that get the same edits; a chunk without white space is one segment,
however long; a large insertion is encoded once, as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from porespan.llm.encode import ChunkEncoder, encoder, parts
from porespan.llm.memory import frugal
from porespan.session import discard, materialize

_CHUNK = re.compile(r"[^ \t\n\v\f\r]+")
RESULT = "n_segments long, n_tokens long, n_tokens_edited long, n_encoded long, n_chars_edited long"
TREE = "text string, leaf_chars array<int>, leaf_tokens array<int>"
#: Edits of a document that are gathered at once; further ones follow in rounds. Leaves of a block in a new layout.
EDITS_AT_ONCE, BLOCK = 100_000, 64


class SegmentTree:
    """Sums of characters and tokens over leaves; ``2 * size`` nodes in two arrays, node 1 is the root."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = max(1, len(chars))
        self.size = 1 << (self.leaves - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        for tree, leaves in ((self.chars, chars), (self.tokens, tokens)):
            tree[self.size : self.size + len(leaves)] = leaves
            level = self.size
            while level > 1:
                tree[level // 2 : level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
                level //= 2

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``at``; the last one at the end."""
        node, base, chars = 1, 0, self.chars
        at = min(at, int(chars[1]) - 1)
        if at < 0:
            return 0, 0
        while node < self.size:
            node *= 2
            if at - base >= chars[node]:
                base += int(chars[node])
                node += 1
        return node - self.size, base

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2


def segments(text: str) -> list[int]:
    """Ends of a text's segments: a chunk with the white space before it, the last one with what follows."""
    ends = [m.end() for m in _CHUNK.finditer(text)]
    return ends[:-1] + [len(text)]


def count_tokens(text: str, own: ChunkEncoder) -> int:
    return sum(len(own.encode(x)) for x in _CHUNK.findall(text))


class Block:
    """Some leaves in a row: as long as no edit touched them a range of the first layout, then lists of their texts and tokens."""

    __slots__ = ("first", "last", "pieces", "tokens")

    def __init__(self, first: int = 0, last: int = 0, pieces: list[str] | None = None, tokens: list[int] | None = None):
        self.first, self.last, self.pieces, self.tokens = first, last, pieces, tokens


class EditedDocument:
    """A text with its tree. ``encoded`` counts the characters that edits had encoded again, ``moved`` the leaves that edits wrote.

    Leaves are held in blocks, and the tree has a leaf of its own for each block: an edit opens the blocks that it touches, exchanges leaves in them and
    updates the sums above. A block that grows beyond ``2 * BLOCK`` leaves is split; only then the sums over blocks are laid out anew. ``chars`` are the lengths of the
    leaves; without them the text is cut into segments.
    """

    def __init__(self, text: str, tokens: np.ndarray, own: ChunkEncoder, chars: np.ndarray | None = None):
        self.own, self.encoded, self.moved, self.base = own, 0, 0, text
        if chars is None and len(tokens):
            chars = np.diff(np.array(segments(text), np.int64), prepend=0)
        if not len(tokens):
            chars, tokens = np.array([len(text)], np.int64), np.zeros(1, np.int64)
        self.at, self.upto = np.concatenate([[0], np.cumsum(chars)]), np.concatenate([[0], np.cumsum(tokens)])
        cuts = [*range(0, len(chars), BLOCK), len(chars)]
        self.blocks = [Block(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self._sum_up()

    def _sum_up(self) -> None:
        sums = [self._sums(b) for b in self.blocks]
        self.tree = SegmentTree(*(np.array(x, np.int64) for x in zip(*sums, strict=True)))

    def _sums(self, block: Block) -> tuple[int, int]:
        if block.pieces is None:
            return int(self.at[block.last] - self.at[block.first]), int(self.upto[block.last] - self.upto[block.first])
        return sum(map(len, block.pieces)), sum(block.tokens)

    def _open(self, block: Block) -> Block:
        """The same block with lists of its leaves."""
        if block.pieces is None:
            at, upto = (x[block.first : block.last + 1].tolist() for x in (self.at, self.upto))
            block.pieces = [self.base[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            block.tokens = [b - a for a, b in zip(upto[:-1], upto[1:], strict=True)]
            self.moved += len(block.pieces)
        return block

    @property
    def n_tokens(self) -> int:
        return int(self.tree.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.tree.chars[1])

    @property
    def text(self) -> str:
        return "".join(self.base[self.at[b.first] : self.at[b.last]] if b.pieces is None else "".join(b.pieces) for b in self.blocks)

    def tree_leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of the leaves that hold text."""
        parts = [(np.diff(self.at[b.first : b.last + 1]), np.diff(self.upto[b.first : b.last + 1])) if b.pieces is None else (np.array([len(p) for p in b.pieces], np.int64), np.array(b.tokens, np.int64)) for b in self.blocks]
        chars, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
        return chars[chars > 0], tokens[chars > 0]

    def _leaf(self, at: int) -> tuple[int, int, int]:
        """(block, leaf of it, the leaf's first character) that hold character ``at``; the last leaf at the end. The block is opened."""
        k, base = self.tree.find(at)
        pieces = self._open(self.blocks[k]).pieces
        at = min(at, self.n_chars - 1)
        for leaf, piece in enumerate(pieces):
            if at < base + len(piece) or leaf == len(pieces) - 1:
                return k, leaf, base
            base += len(piece)
        raise AssertionError("a block has a leaf")

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces the characters from ``start`` up to ``stop`` by ``new``."""
        n = self.n_chars
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        # the segments of the characters beside the range: an edit can join or part the chunks it touches
        k, i, begin = self._leaf(max(0, start - 1))
        m, j, last_begin = self._leaf(stop)
        first, last = self.blocks[k], self.blocks[m]
        region = first.pieces[i][: start - begin] + new + last.pieces[j][stop - last_begin :]
        # what follows the region starts with white space, as every segment but a text's first one does
        ends = segments(region)
        pieces = [region[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        counts = [count_tokens(x, self.own) for x in pieces]
        self.encoded += len(region)
        pieces, counts = [*first.pieces[:i], *pieces, *last.pieces[j + 1 :]], [*first.tokens[:i], *counts, *last.tokens[j + 1 :]]
        kept = [x for x, p in enumerate(pieces) if p]  # leaves that the edit emptied go
        if len(kept) < len(pieces):
            pieces, counts = ([v[x] for x in kept] for v in (pieces, counts))
        self.moved += len(pieces)
        if k == m and 0 < len(pieces) <= 2 * BLOCK:
            first.pieces, first.tokens = pieces, counts
            self.tree.put(k, *self._sums(first))
            return
        step = range(0, max(1, len(pieces)), BLOCK)
        fresh = [Block(pieces=pieces[x : x + BLOCK], tokens=counts[x : x + BLOCK]) for x in step if pieces]
        self.blocks[k : m + 1] = fresh
        if not self.blocks:
            self.blocks = [Block(pieces=[""], tokens=[0])]
        self._sum_up()


def _counts(texts: pa.Array, own: ChunkEncoder) -> Iterator[np.ndarray]:
    """Tokens of the chunks of each text."""
    size = np.array([len(x) if x is not None else 0 for x in texts.to_pylist()], np.int64)
    for lo, hi in parts(size):
        slot, count, offsets = own.chunk_counts(texts.slice(lo, hi - lo))
        real = slot != own.slot.get("", -1)  # white space at the ends of a text leaves empty chunks
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield count[a:b][real[a:b]]


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text, leaf_chars, leaf_tokens)``: every document with its tree's leaves, to be kept beside it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("array<struct<seq:bigint>>").alias("edits"))
    return apply_edits(rows, vocabulary, with_trees=True).select("doc_id", *[x.split()[0] for x in TREE.split(", ")])


def count_with_edits(
    docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_trees: bool = False, at_once: int = EDITS_AT_ONCE
) -> DataFrame:
    """Counts before and after ``edits (doc_id, seq, start, stop, new)`` for every row of ``docs``.

    ``docs`` may be a table of ``token_trees``: then untouched segments aren't encoded. ``with_trees`` adds the edited documents'
    text and leaves. At most ``at_once`` edits of a document are gathered; more of them follow in further rounds on kept trees.
    """
    edit = F.struct(F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.coalesce("new", F.lit("")).alias("new"))
    listed = edits.where("doc_id is not null").select(F.col("doc_id").alias("__id"), edit.alias("edit"))
    most = listed.groupBy("__id").count().agg(F.max("count")).first()[0] or 0
    kept = [c for c in ("leaf_chars", "leaf_tokens") if c in docs.columns]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
    if most <= at_once:
        return apply_edits(_with_edits(rows, listed), vocabulary, with_trees)
    names = [x.split()[0] for x in RESULT.split(", ")]
    place = F.row_number().over(Window.partitionBy("__id").orderBy("edit")) - 1
    listed = materialize(listed.withColumn("round", F.floor(place / at_once)), "edits")
    now = None
    for k in range(-(-most // at_once)):
        part = listed.where(F.col("round") == k).drop("round")
        if now is None:
            done = apply_edits(_with_edits(rows, part), vocabulary, True)
        else:
            before = now.select("doc_id", "text", "leaf_chars", "leaf_tokens", *[F.col(c).alias(f"__{c}") for c in names])
            done = apply_edits(_with_edits(before, part), vocabulary, True, [f"__{c}" for c in names])
            done = done.withColumns({"n_segments": F.col("__n_segments"), "n_tokens": F.col("__n_tokens"), "n_encoded": F.col("n_encoded") + F.col("__n_encoded")})
            done = done.drop(*[f"__{c}" for c in names])
        before_, now = now, materialize(done, "trees")
        if before_ is not None:
            discard(before_)
    return now if with_trees else now.select("doc_id", *names)


def _with_edits(rows: DataFrame, listed: DataFrame) -> DataFrame:
    by_doc = listed.groupBy("__id").agg(F.sort_array(F.collect_list("edit")).alias("edits"))
    return rows.join(by_doc, F.col("doc_id") == F.col("__id"), "left").drop("__id")


def apply_edits(rows: DataFrame, vocabulary: str | None = None, with_trees: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, n_segments, n_tokens, n_tokens_edited, n_encoded, n_chars_edited)`` of rows ``(doc_id, text, edits)``.

    Rows may have the columns of ``token_trees``; a null in them has the text encoded. ``with_trees`` adds these columns as they are after the
    edits; ``keep`` names columns that pass through.
    """
    keep = keep or []
    trees = "leaf_chars" in rows.columns and "leaf_tokens" in rows.columns
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            known = batch["leaf_tokens"].to_pylist() if trees else [None] * len(batch)
            lengths = batch["leaf_chars"].to_pylist() if trees else known
            asked = pa.array([t if k is None else "" for t, k in zip(batch["text"].to_pylist(), known, strict=True)], pa.string()) if trees else batch["text"]
            out, leaves = [], []
            for text, tokens, edits, kept, chars in zip(batch["text"].to_pylist(), _counts(asked, own), batch["edits"].to_pylist(), known, lengths, strict=True):
                if kept is not None:
                    tokens = np.array(kept, np.int64)
                doc = EditedDocument(text or "", tokens, own, None if kept is None else np.array(chars, np.int64))
                before, n = doc.n_tokens, len(tokens)
                for e in edits or []:
                    doc.edit(e["start"], e["stop"], e["new"])
                out.append((n, before, doc.n_tokens, doc.encoded, doc.n_chars))
                if with_trees:
                    leaves.append((doc.text, *(x.tolist() for x in doc.tree_leaves())))
            columns = [batch["doc_id"], *(pa.array(c) for c in np.array(out, np.int64).reshape(-1, 5).T)]
            if with_trees:
                columns += [pa.array([x[k] for x in leaves], kind) for k, kind in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*columns, *(batch[c] for c in keep)], ["doc_id", *names, *([x.split()[0] for x in TREE.split(", ")] if with_trees else []), *keep])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {RESULT}" + (f", {TREE}" if with_trees else "") + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("doc_id", "text", "edits", *(["leaf_chars", "leaf_tokens"] if trees else []), *keep).mapInArrow(frugal(run), schema)
