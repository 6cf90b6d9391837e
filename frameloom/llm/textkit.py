"""Vectorised text kernels shared by the training-data operators.

Everything here works on Arrow string arrays through numpy and touches no Spark
state, so the functions run unchanged inside ``mapInArrow`` workers.  A batch is cut
into chunks of about ``CHUNK_BYTES`` (a longer document is a chunk of its own),
which bounds a worker's memory by the largest document rather than by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWBYTE = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _pow(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if size <= 2 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on a uint64 array (returns a new array)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, off = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64)[off : off + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(buf: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) pieces of about `size` bytes, whole documents each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and words per document.

    A word is a maximal run of bytes that are not ASCII white space, or that `inside` holds true for.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[buf] if inside is None else inside[buf]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = word[first]
    last = first[1:] - 1
    end[last] = word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = True, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word (A-Z lower-cased if asked), its start and end, and words per document."""
    starts, ends, counts = word_bounds(buf, offsets, inside)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, counts
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWBYTE if lower else _BYTE)[buf] * _pow("p", _P, len(buf)), out=total[1:])
    return mix((total[ends] - total[starts]) * _pow("q", _PINV, len(buf))[starts]), starts, ends, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and how many each document has.

    A document of fewer than k words, but at least one, has its whole sequence as its only shingle.
    """
    n = len(words)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ends = np.cumsum(counts)
    begins = ends - counts
    acc = np.zeros(n, np.uint64)
    a = _U(0xD6E8FEB86659FD93)
    if n:
        for j in range(k):
            acc *= a
            acc[: n - j if j < n else 0] += words[j:]
    at = np.repeat(begins, per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    out = acc[at] if len(at) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h = 0x51ED270B ^ int(counts[i])
        for w in words[begins[i] : ends[i]]:
            h = (h * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF
        out[int(per[:i].sum())] = h
    return mix(out), per


def distinct_sets(hashes: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, one after another, and how many each has."""
    ends = np.cumsum(per)
    parts = [np.unique(hashes[e - c : e]) for e, c in zip(ends, per)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


def sum_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum (mod 2^64) of each consecutive group of the given sizes."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `size` bytes (or of one longer row), without a copy.

    Spark bounds a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch) or ends it with one longer
    text; slices bound what Python makes of it, so no setting of the caller's session is touched.
    """
    for batch in batches:
        at = 0
        while at < max(1, batch.num_rows):
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = batch.slice(at, part.num_rows // 2)
            yield part
            at += max(1, part.num_rows)
