"""Words of Arrow string columns as 64-bit hashes, computed with numpy for whole batches of texts.

A word is a maximal run of bytes that ``is_word`` marks. Its hash is a polynomial over random byte
values modulo 2**64, finished by a mixer, so equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUE_LOWER = BYTE_VALUE[LOWER]
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
#: The words of the contracts: everything but the space and the bytes 9 to 13.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Letters, digits and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
CHUNK_BYTES = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, a longer text alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of all words of the texts that ``offsets`` cut ``data`` into."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    word = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = VALUE_LOWER) -> np.ndarray:
    """A hash for each span of ``data``; ``value`` maps bytes to numbers (the default ignores ASCII case)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * power[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of all k-word shingles; a text of fewer words (but some) has all of them as its one."""
    count = np.bincount(text, minlength=n_texts) if len(text) else np.zeros(n_texts, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    step = np.uint64(0xA24BAED4963EE407)
    m = len(hashes) - k + 1
    if m > 0:
        h = hashes[:m].copy()
        for i in range(1, k):
            h = h * step + hashes[i : m + i]
        whole = text[:m] == text[k - 1 :]
        h, of = mix(h[whole]), text[:m][whole]
    else:
        h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        more = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = count[short] > i
            more[has] = more[has] * step + hashes[first[short][has] + i]
        more = mix(mix(more) + count[short].astype(np.uint64))
        h, of = np.concatenate([h, more]), np.concatenate([of, short])
    return h, of


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order: (hashes, text index), sorted by text."""
    starts, ends, text = spans(data, offsets)
    h, of = shingles(span_hashes(data, starts, ends), text, len(offsets) - 1, k)
    order = np.argsort(h)
    order = order[np.argsort(of[order], kind="stable")]
    h, of = h[order], of[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[keep], of[keep]


def batch_shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, hashes, text index from first) for chunks of an Arrow column."""
    data, offsets = text_buffers(column)
    for first, last in chunks(offsets):
        base = offsets[first]
        yield first, last, *shingle_sets(data[base : offsets[last]], offsets[first : last + 1] - base, k)
