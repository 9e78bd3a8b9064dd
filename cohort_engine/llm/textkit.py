"""Vectorised word and shingle hashing over Arrow string columns.

Used inside ``mapInArrow`` tasks: one pass of numpy over a batch's UTF-8
buffer gives a 64-bit hash per word, without a Python object per word.  A word
is a run of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (bytes of other
letters are left alone), which is a byte-level rule, so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 21           # bytes hashed at a time, cut between words
SLICE_BYTES = 4 << 20           # text bytes handled at a time, cut between rows

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PUNCTUATION = np.zeros(256, bool)   # every ASCII byte but letters and digits
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]    # A-Z hash as a-z
_STEP = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), base, U64)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps, dtype=U64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``limit`` text bytes each (one row at least), so
    memory follows the slice and not the batch."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, base + limit, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row pointer) of the words: the words
    of row r are entries ptr[r]:ptr[r + 1].  ``gap`` marks the bytes between
    words."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    space = gap[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each byte span (spans in order, not overlapping);
    ``fold`` hashes A-Z as a-z."""
    values = _FOLD if fold else _BYTE
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(int(np.searchsorted(ends, lo + CHUNK_BYTES, "right")), at + 1)
        hi = int(ends[to - 1])
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(values[raw[lo:hi]] * _power(_STEP, hi - lo), out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix64((sums[e] - sums[s]) * _power(_BACK, hi - lo + 1)[s])
        at = to
    return out


def words(texts: pa.Array, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, row pointer) of a string column."""
    raw, off = text_bytes(texts)
    starts, ends, ptr = word_spans(raw, off, gap)
    return hash_spans(raw, starts, ends), ptr


_GRAM = mix64(np.arange(1, 65, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position (the last n - 1 have none)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = h[:m] * _GRAM[0]
    for i in range(1, n):
        out += h[i:i + m] * _GRAM[i]
    return mix64(out)


def shingles(h: np.ndarray, ptr: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in text order, row pointer).  A row of 1 to n - 1 words
    has its whole sequence as its one shingle; a row without words has none."""
    lens = np.diff(ptr)
    count = np.where(lens >= n, lens - n + 1, (lens > 0).astype(np.int64))
    out_ptr = np.zeros(len(ptr), np.int64)
    np.cumsum(count, out=out_ptr[1:])
    out = np.empty(int(out_ptr[-1]), U64)
    roll = rolling(h, n)
    long_rows = lens >= n
    if len(roll):
        row_first = np.repeat(ptr[:-1][long_rows] - out_ptr[:-1][long_rows], count[long_rows])
        at = np.repeat(long_rows, count)
        pos = np.flatnonzero(at)
        out[pos] = roll[pos + row_first]
    for k in range(1, n):
        rows = np.flatnonzero(lens == k)
        if len(rows):
            first = ptr[rows]
            acc = np.full(len(rows), k, U64) * U64(0xA0761D6478BD642F)
            for i in range(k):
                acc += h[first + i] * _GRAM[i]
            out[out_ptr[rows]] = mix64(acc)
    return out, out_ptr


def row_sets(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values of each row, row pointer)."""
    values = values.copy()
    for s, e in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        values[s:e].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    firsts = ptr[:-1]
    keep[firsts[firsts < len(values)]] = True
    out_ptr = np.concatenate([[0], np.cumsum(keep)])[ptr]
    return values[keep], out_ptr


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed integer (Spark's long)."""
    return x.view(np.int64)


# -- bytes between tasks -----------------------------------------------------------

def planes(x: np.ndarray) -> bytes:
    """Unsigned integers as bytes: their number, then all first bytes, all
    second bytes and so on, compressed."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def from_planes(blob: bytes, kind) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, int.from_bytes(blob[:4], "little")
    flat = pa.decompress(blob[4:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, n).T).view(kind).ravel()


def packed(x: np.ndarray) -> bytes:
    """64-bit integers in ascending order, by their steps."""
    return planes(np.diff(x, prepend=U64(0)))


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(from_planes(blob, U64), dtype=U64)
