"""Token ids of whole texts for a word-level BPE vocabulary that drops white space.

Such a tokenizer never joins what white space parts, so the ids of a text are those of its chunks between
ASCII white space, one after the other. Arrow splits a batch into chunks and finds the distinct ones; only
chunks that a task has not seen are encoded.

A chunk of ASCII and Latin-1 letters, digits and marks is cut into pre-tokens by the vocabulary's pattern,
and their merges run in tiktoken's byte-pair core, which follows the same merge ranks (an extra byte, which
UTF-8 never uses, marks a word's end). All others go to the ``tokenizers`` library as they are. Tests hold both
ways against each other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks that a task remembers, and texts' bytes that are encoded together.
REMEMBERED, BATCH_BYTES = 300_000, 2 << 20
END = b"\xff"
_SIMPLE = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The published printable stand-ins of byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkEncoder:
    """Ids of chunks, and of batches of texts by their chunks."""

    def __init__(self, vocabulary: str | None = None, remembered: int = REMEMBERED):
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary or default_vocabulary()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, suffix = _byte_letters(), model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + (END if end else b"")

        ranks = {bytes([b]) + END: b for b in range(255)}
        for i, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(raw(a) + raw(b), 256 + i)
        ranks |= {bytes([b]): 1_000_000 + b for b in range(256)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        self.ids = {rank: ids[token] for token, rank in ranks.items() if token in ids}
        self.core = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.remembered = remembered
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.count, self.start, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0
        self.flat = np.zeros(1 << 18, np.uint32)

    def encode(self, chunk: str) -> list[int]:
        if not _SIMPLE.fullmatch(chunk) or "<|" in chunk:
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        out: list[int] = []
        for piece in _PIECES.findall(chunk.lower()):
            got = self.pieces.get(piece)
            if got is None:
                if len(self.pieces) > self.remembered // 2:
                    self.pieces.clear()
                got = self.pieces[piece] = [self.ids[r] for r in self.core.encode_single_piece(piece.encode() + END)]
            out += got
        return out

    def _slots(self, distinct: list[str]) -> np.ndarray:
        """Where the ids of these chunks are in ``flat``; new ones are encoded."""
        if len(self.slot) + len(distinct) > self.remembered:
            self._clear()
        known, out, ids, new = self.slot, np.empty(len(distinct), np.int64), [], []
        for i, chunk in enumerate(distinct):
            at = known.get(chunk)
            if at is None:
                at = known[chunk] = len(known)
                got = self.encode(chunk)
                ids += got
                new.append(len(got))
            out[i] = at
        if new:
            n, k = len(known), len(known) - len(new)
            while len(self.count) < n:
                self.count, self.start = np.concatenate([self.count, np.zeros_like(self.count)]), np.concatenate([self.start, np.zeros_like(self.start)])
            while len(self.flat) < self.used + len(ids):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.count[k:n] = new
            self.start[k:n] = self.used + np.cumsum(new) - new
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        return out

    def chunk_counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot of each chunk, token count of each chunk, first chunk of each text and the end)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = flat.dictionary_encode()
        slot = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        count = self.count[slot].astype(np.int64)
        return slot, count, offsets

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, last text, ids, first id of each text and the end) for parts of a column."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in parts(size):
            slot, count, offsets = self.chunk_counts(texts.slice(lo, hi - lo))
            # ascii_split_whitespace gives empty chunks at the ends of texts; they hold no ids
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            at = np.repeat(self.start[slot] - (ends - count), count) + np.arange(total)
            yield lo, hi, self.flat[at], np.concatenate([[0], ends])[offsets]


def parts(size: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes together; a longer one alone."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield lo, hi
        lo = hi


_own: dict[str | None, ChunkEncoder] = {}


def encoder(vocabulary: str | None = None) -> ChunkEncoder:
    """One encoder a process and vocabulary, so that tasks share what it remembers."""
    if vocabulary not in _own:
        _own[vocabulary] = ChunkEncoder(vocabulary)
    return _own[vocabulary]
