"""Vectorised text kernels over Arrow buffers, shared by the operators here.

All kernels see whole UTF-8 texts as one byte array with offsets, so nothing is
decoded and no Python object is made per word. Batches are cut into pieces of a
few MB (never within a text) so that the working memory of a task doesn't follow
the number of rows in an Arrow batch. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

PIECE_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.default_rng(20240229)
#: random value for each byte, and an odd base with its inverse modulo 2**64
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: bytes that are not [^\x20\x09-\x0D]
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
#: lead bytes, one for each code point
IS_LEAD = (np.arange(256) & 0xC0) != 0x80

_powers: dict[int, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    size = 1 << max(16, int(n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[size] = np.stack(out)
    return _powers[size][0], _powers[size][1]


def trim() -> None:
    """Gives memory that a worker has freed back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: str, target: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece has about `target` bytes of text, and a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + target, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and its n + 1 offsets into them; a null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes within texts: starts, ends, and the n + 1 run numbers where each text begins."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Hasher:
    """Hashes of any spans of a byte array, from one pass of prefix sums."""

    def __init__(self, raw: np.ndarray, values: np.ndarray = BYTE_VALUE):
        power, self.inverse = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, U64)
        np.cumsum(values[raw] * power[: len(raw)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U64))


#: sums of powers modulo 2**64 tell spans of up to so many bytes apart; longer ones, for which they have regular collisions, get another hash
LONG = 48


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of spans of any length, with A-Z as a-z if asked."""
    out = Hasher(raw, LOWER_VALUE if lower else BYTE_VALUE)(starts, ends)
    long_ = np.flatnonzero(ends - starts > LONG)
    if len(long_):
        data = raw.tobytes()
        data = data.lower() if lower else data
        digest = xxhash.xxh3_64_intdigest
        found = [digest(data[a:b]) for a, b in zip(starts[long_].tolist(), ends[long_].tolist())]
        out[long_] = mix(np.array(found, U64))
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a row of word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for i in range(k):
        total = total * U64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(total)


def row_of(firsts: np.ndarray, total: int) -> np.ndarray:
    """For each of `total` items the row that it belongs to; firsts: n + 1 item numbers."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)) if total else np.zeros(0, np.int64)


def sums_by_row(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of each row's items; firsts: n + 1 item numbers."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]
