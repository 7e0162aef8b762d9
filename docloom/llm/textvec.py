"""Vectorised text primitives over Arrow string columns.

Every function works on the raw UTF-8 buffer of a whole batch of texts, so the cost per
document is a handful of numpy passes and no Python loop touches a word or a character.
Hashes are polynomial sums over random byte values followed by a 64-bit finaliser; they
depend on nothing but the bytes, so executors and reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_POW_N = 1 << 16
_POW = np.ones(_POW_N, np.uint64)
np.multiply.accumulate(np.full(_POW_N - 1, 0x9E3779B97F4A7C15 | 1, np.uint64), out=_POW[1:])
_BYTE_2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_POW_2 = np.ones(_POW_N, np.uint64)
np.multiply.accumulate(np.full(_POW_N - 1, 0xD6E8FEB86659FD93, np.uint64), out=_POW_2[1:])
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)

#: Bytes that belong to a word: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, np.bool_)
WORD_BYTES[128:] = True
for _r in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    WORD_BYTES[list(_r)] = True
_WORD_VALUE = np.where(WORD_BYTES, _BYTE, U64(0))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h *= _MIX1
    h ^= h >> U64(33)
    h *= _MIX2
    h ^= h >> U64(33)
    return h


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, i + 60_000)
        yield i, j
        i = j


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `limit` bytes of text at most; a longer text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        for i, j in pieces(spans(sizes), limit):
            yield batch.slice(i, j - i)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, byte position, index of the text) of each word, in order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = WORD_BYTES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1]
    edge = edge[(edge < n) & (offsets[1:] > edge)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts, starts
    where = np.arange(n, dtype=np.int64)
    where -= np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [n]))))
    value = _WORD_VALUE[data]
    value *= _POW[where & (_POW_N - 1)]
    h = mix(np.add.reduceat(value, starts))
    return h, starts, np.searchsorted(offsets, starts, "right") - 1


def beginnings(data: np.ndarray, starts: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first bytes of each word that has more than so many, for each length, and the words they begin."""
    found, owner = [], []
    live = np.arange(len(starts))
    total = np.zeros(len(starts), np.uint64)
    for k in range(max(lengths, default=0) + 1):
        at = starts[live] + k
        live, at = live[at < len(data)], at[at < len(data)]
        value = _WORD_VALUE[data[at]]
        inside = (value != 0) & ((k == 0) | (at != np.append(starts, -1)[live + 1]))
        live = live[inside]
        if k in lengths:
            found.append(mix(total[live] + U64(k)))
            owner.append(live)
        total[live] += value[inside] * _POW[k]
    return np.concatenate(found) if found else total[:0], np.concatenate(owner) if owner else live[:0]


def text_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's bytes; 0-length texts share one value. A byte's weight depends on its place, however long the text."""
    return text_hashes(data, offsets, 1)[0]


def text_hashes(data: np.ndarray, offsets: np.ndarray, number: int = 2) -> list[np.ndarray]:
    """One or two independent hashes of each text."""
    length = np.diff(offsets)
    full = np.flatnonzero(length)
    out = [np.zeros(len(length), np.uint64) for _ in range(number)]
    if len(full):
        starts = offsets[:-1][full]
        where = np.arange(len(data), dtype=np.int64)
        where -= np.repeat(starts, length[full])
        low = where & (_POW_N - 1) if length.max() > _POW_N else where
        for h, byte, power in zip(out, (_BYTE, _BYTE_2), (_POW, _POW_2), strict=False):
            value = byte[data]
            value *= power[low]
            if low is not where:
                value *= mix((where >> 16).astype(np.uint64)) | U64(1)
            h[full] = np.add.reduceat(value, starts)
    return [mix(h + length.astype(np.uint64) * _MIX2) for h in out]


def grams(data: np.ndarray, n: int = 8) -> np.ndarray:
    """A hash of the `n` bytes (a power of two) from each position on; the last n-1 positions are cut."""
    h = _BYTE[data]
    width, factor = 1, 0x9E3779B97F4A7C15
    while width < n:
        h = h[:-width] * U64(factor) + h[width:] if len(h) > width else h[:0]
        width, factor = width * 2, factor * factor % 2**64
    return mix(h)


def spans(counts: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive groups of these sizes."""
    return np.concatenate(([0], np.cumsum(counts)))


def per_text(index: np.ndarray, n: int) -> np.ndarray:
    """n+1 offsets of the sorted text indexes."""
    return np.searchsorted(index, np.arange(n + 1))
