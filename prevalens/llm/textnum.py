"""Texts of an Arrow batch as flat numpy arrays: code points, words, word and shingle hashes.

All functions work on slices of a batch that hold a bounded number of bytes (or
one single text), so memory does not follow the batch size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 500_000
#: Bytes up to which the tables of powers are kept; a longer text makes its own and drops them.
_KEPT_POWERS = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Consecutive row ranges whose texts hold at most ``limit`` bytes, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0),
                       dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text.  Text i is bytes[o[i]:o[i+1]]."""
    a = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) with one space after every text."""
    joined = " ".join(texts) + " "
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return (np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32),
            np.concatenate([[0], np.cumsum(n)]))


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first ``n`` powers; a worker keeps one table, whose size is fixed."""
    return _kept_powers() if n <= _KEPT_POWERS else _made_powers(n)


@lru_cache(1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(_KEPT_POWERS)


def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return (np.cumprod(np.full(n, _ODD, dtype=np.uint64)),
            np.cumprod(np.full(n, inverse, dtype=np.uint64)))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words; words of text i are first[i]:first[i+1].

    A word never crosses a text's end: every text start is a word border too.
    """
    inner = ~_SPACE[raw]
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    cut = offsets[:-1][(offsets[:-1] < len(raw))]
    begins[cut] = inner[cut]
    starts = np.flatnonzero(begins)
    stops = inner.copy()
    stops[:-1] &= ~inner[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = inner[last]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word from prefix sums of a polynomial over its bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(raw))
    values = _byte_values()[_LOWER[raw] if lower else raw] * up[:len(raw)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    h = (total[ends] - total[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * _ODD)


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): hashes of the n-word sequences text by text, and their number per text.

    A text with fewer than n words has one sequence, the whole; with none, no sequence.
    """
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    if not made.sum():
        return np.zeros(0, np.uint64), made
    owner = np.repeat(np.arange(len(count)), made)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(made) - made, made) + first[:-1][owner]
    stop = first[1:][owner]
    h = np.zeros(len(owner), dtype=np.uint64)
    for j in range(n):
        w = np.where(at + j < stop, words[np.minimum(at + j, len(words) - 1)], np.uint64(0))
        h = mixed(h + w + np.uint64((j + 1) * int(_ODD) % (1 << 64))) if j in (0, n - 1) else (h * _ODD) ^ w
    return h, made


def sum_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of consecutive runs of ``values`` (rows of a matrix or numbers), run lengths ``counts``."""
    out = np.zeros((len(counts),) + values.shape[1:], dtype=np.float64)
    full = counts > 0
    if full.any():
        begin = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, begin, axis=0, dtype=np.float64)
    return out
