"""Vectorised word and shingle hashing over Arrow text batches.

A word is a maximal run of bytes other than the ASCII white space 0x20 and 0x09-0x0D, with A-Z
lower-cased.  Hashing works on the UTF-8 bytes of a whole Arrow batch at once; nothing is done per
word in Python.  Null texts count as empty.  Word hashes are 64 bit; a shingle is the hash of
``width`` words in a row, and a text with fewer words has its whole word sequence as one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators where punctuation counts as white space: all ASCII but letters and digits.
PUNCTUATED = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1

_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_STEP = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, _CHUNK + 4096)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 row offsets of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n+1 offsets of each row's words."""
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separators[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    start[edges] |= inside[edges]
    end[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, case folded for A-Z."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _CHUNK, side="right")))
        base, stop = int(starts[a]), int(ends[b - 1])
        up, down = _tables_for(stop - base + 1)
        sums = np.empty(stop - base + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_LOWER[raw[base:stop]] * up[: stop - base], out=sums[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        out[a:b] = (sums[e] - sums[s]) * down[s]
        a = b
    return mix(out + (ends - starts).astype(np.uint64) * _MIX_2)


def shingle_hashes(words: np.ndarray, word_offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows in text order, and n+1 offsets of each row's shingles."""
    n_words = np.diff(word_offsets)
    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    offsets = np.concatenate([[0], np.cumsum(n_shingles)])
    if len(words) == 0:
        return np.zeros(0, np.uint64), offsets
    rolled = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        rolled *= np.uint64(_STEP)
        rolled += words[k : k + len(rolled)]
    out = np.empty(offsets[-1], dtype=np.uint64)
    long_rows = np.flatnonzero(n_words >= width)
    if len(long_rows):
        counts = n_shingles[long_rows]
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        out[np.repeat(offsets[long_rows], counts) + place] = rolled[np.repeat(word_offsets[long_rows], counts) + place]
    for row in np.flatnonzero((n_words > 0) & (n_words < width)):
        acc = 0
        for w in words[word_offsets[row] : word_offsets[row + 1]]:
            acc = (acc * _STEP + int(w)) % (1 << 64)
        out[offsets[row]] = (acc + int(n_words[row]) * 0x2545F4914F6CDD1D) % (1 << 64)
    return mix(out), offsets


def batches_of_text(column: pa.Array, limit: int = 1 << 20):
    """Row ranges (a, b) of a string column, each of about ``limit`` bytes or one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield a, b
        a = b
