"""Vectorised words, lines and hashes of Arrow text columns.

Everything works on UTF-8 bytes. All separators used by the operators are ASCII,
so cutting bytes at them never splits a code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def _table(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


#: ``[\x20\x09-\x0D]``
BLANK = _table([0x20, *range(0x09, 0x0E)])
#: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``
NON_WORD = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
NEWLINE = _table([0x0A])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(batches, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def encoded(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and len+1 offsets; nulls are empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (len+1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1] | edge[1:-1]
    closes[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * _CHUNK)
        _powers[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, b, U64)]), dtype=U64) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, mixed with its length. Spans ascend."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(starts, base + _CHUNK)))
        last = int(ends[at:stop].max())
        power, inverse = _power_tables(last - base + 1)
        sums = np.zeros(last - base + 1, U64)
        np.cumsum(data[base:last].astype(U64) * power[: last - base], dtype=U64, out=sums[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        at = stop
    return out


def word_hashes(column, separators: np.ndarray = BLANK, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and each text's first index (len+1)."""
    data, offsets = encoded(column)
    if lower:
        data = lowered(data)
    starts, ends, first = spans(data, offsets, separators)
    return hash_spans(data, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text, windows never crossing texts.

    A text of 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    factors = mix(np.arange(1, k + 1, dtype=U64) * U64(_BASE)) | U64(1)
    padded = np.concatenate([words, np.zeros(k, U64)])
    index = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n)
    room = np.repeat(counts, n)
    total = np.zeros(at[-1], U64)
    for j in range(k):
        total += np.where(j < room, padded[index + j] * factors[j], U64(0x2545F4914F6CDD1D * (j + 1) & (2**64 - 1)))
    return mix(total), at


def owners(first: np.ndarray) -> np.ndarray:
    """For each element the index of the text that holds it."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:], dtype=total.dtype)
    return total[bounds[1:]] - total[bounds[:-1]]


def lists(values: np.ndarray, first: np.ndarray) -> pa.LargeListArray:
    """An Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))
