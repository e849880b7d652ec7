"""Vectorised tokenising and hashing over Arrow string buffers.

All helpers work on whole texts: a batch is cut only *between* documents, so that
the working arrays stay small whatever the batch size.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

# letters, digits and every non-ASCII byte belong to words; the rest separates
WORD_BYTE = np.zeros(256, dtype=bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    WORD_BYTE[list(_r)] = True
# everything but ASCII white space
VISIBLE_BYTE = np.ones(256, dtype=bool)
VISIBLE_BYTE[[9, 10, 11, 12, 13, 32]] = False


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or _powers["p"].size < n:
        size = max(n, CHUNK_BYTES)
        for key, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: 64 well-mixed bits for each input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of documents of about CHUNK_BYTES."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def spans(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of a kind, and each document's first run (n + 1 values)."""
    if not buf.size:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(offs.size, np.int64)
    inside = kind[buf]
    cut = np.zeros(buf.size + 1, dtype=bool)
    cut[offs] = True
    before = np.empty(buf.size, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(buf.size, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one prefix sum over the buffer."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    p, inv = _power(buf.size)
    c = np.empty(buf.size + 1, dtype=np.uint64)
    c[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: buf.size], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; empty segments give 0."""
    c = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0, dtype=values.dtype)])
    return c[first[1:]] - c[first[:-1]]
