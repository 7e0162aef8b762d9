"""Near-duplicate documents by SimHash, with every pair within MAX_BITS.

The fingerprint has 240 bits over the distinct words of a document; words under LEAST_BYTES bytes, which most
texts of a language share, count only where there are few others, so that unrelated texts differ in nearly
half of the bits. It is cut into 4 words of 60 bits and these into 12 segments of 20.

By the pigeonhole principle two fingerprints within MAX_BITS have a word that differs by WORD_LIMITS bits at
most, and in it a segment that differs by LIMITS bits at most, so that one of the segment's parts, of which
there is one more than its limit, is equal. Rows meet by that part (a block), 41 times each. Within a block the
rows that may be near differ in the rest of the segment by one of a few masks: values of the segment are looked
up under each of them, or, where there are few rows, all of them are compared.
Found pairs are verified on the whole fingerprint, and copies are grouped transitively.

Defined results: a null or wordless text has no fingerprint and is in no group. Rows of one doc_id and one
fingerprint are one document; rows of one doc_id with other fingerprints are documents of their own. Rows
without a doc_id that is a whole number are in no group. The document of the least doc_id of a group is the
one that stays, of several with that id the one of the least fingerprint.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textvec as tv
from docloom.llm.components import components
from docloom.llm.shared import cut, forest, free_name, ids_and_texts, maybe_broadcast, scratch, small_batches, sorted_runs, whole_id

WORDS, PER_WORD, SEGMENT_BITS = 4, 3, 20
SEGMENTS = WORDS * PER_WORD
BITS = SEGMENTS * SEGMENT_BITS
#: Pairs within these share a variant, a segment with one bit left out: with more, all segments could differ by two bits.
SURE_BITS = 2 * SEGMENTS - 1
#: Verified distance. Unrelated texts differ in about 115 bits.
MAX_BITS = 40
#: Bits by which a segment and its word may differ: with more in all of them, the whole would differ by more than MAX_BITS.
LIMITS = (2, 2, 3, 2, 2, 3, 2, 2, 3, 2, 3, 3)
WORD_LIMITS = (9, 9, 9, 10)
LEAST_BYTES, LEAST_WORDS = 4, 8
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_USED = np.uint64((1 << PER_WORD * SEGMENT_BITS) - 1)
#: A segment's bits in three parts: variants with a wildcard in one of them agree in the two others.
_PARTS = ((0, 7), (7, 14), (14, 20))
#: (segment, first bit, end) of each block's part: two rows meet in it if they agree there.
BLOCKS = tuple((s, lo, hi) for s, most in enumerate(LIMITS) for lo, hi in (_PARTS if most == 2 else ((0, 5), (5, 10), (10, 15), (15, 20))))
#: Pairs whose words are compared at a time, so that they stay in a core's cache; of those left, pairs after which joined rows are looked for; of two values of a segment, pairs of rows from which on joined rows are passed over.
PAIRS, FEW, HEAVY = 1 << 16, 1 << 12, 1 << 12
_COLS = tuple(f"f{k}" for k in range(WORDS))
_F = ", ".join(f"{c} long" for c in _COLS)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x WORDS words of the fingerprints, whether there is one)."""
    data, offsets = tv.flat(pc.utf8_lower(texts))
    out, known = np.zeros((len(offsets) - 1, WORDS), np.uint64), np.zeros(len(offsets) - 1, bool)
    for i, j in tv.pieces(offsets):
        part, own = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        h, at, doc = tv.words(own, part)
        if not len(h):
            continue
        large = np.add.reduceat(tv.WORD_BYTES[own].view(np.int8), at, dtype=np.int64) >= LEAST_BYTES
        use = large | (np.bincount(doc[large], minlength=j - i) < LEAST_WORDS)[doc]
        h, doc = h[use], doc[use]
        key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        doc = (key >> np.uint64(48)).astype(np.int64)
        h = key & np.uint64((1 << 48) - 1)
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        ends = np.concatenate((starts[1:], [len(doc)]))
        cells = np.stack([tv.mix(h * s) for s in _SALT], 1)
        ones = np.empty((len(starts), 64 * WORDS), np.int64)
        for a in range(0, len(starts), 64):  # bounded unpacked bits
            b = min(a + 64, len(starts))
            lo, hi = starts[a], ends[b - 1]
            if hi - lo <= 1 << 17:
                ones[a:b] = np.add.reduceat(np.unpackbits(cells[lo:hi].view(np.uint8), axis=1), starts[a:b] - lo, axis=0, dtype=np.int32)
            else:
                for k in range(a, b):
                    ones[k] = sum(np.unpackbits(cells[x : min(x + 65536, ends[k])].view(np.uint8), axis=1).sum(0, dtype=np.int64) for x in range(starts[k], ends[k], 65536))
        bits = np.packbits(2 * ones > (ends - starts)[:, None], axis=1)
        at = doc[starts] + i
        out[at] = np.ascontiguousarray(bits).view(np.uint64) & _USED
        known[at] = True
    return out, known


def _segments(f: np.ndarray) -> np.ndarray:
    shifts = np.arange(PER_WORD, dtype=np.uint64) * np.uint64(SEGMENT_BITS)
    return ((f[:, :, None] >> shifts) & np.uint64((1 << SEGMENT_BITS) - 1)).reshape(len(f), SEGMENTS).astype(np.uint32)


def places(f: np.ndarray) -> np.ndarray:
    """n x 36 places: segment, part of it, and the bits outside that part.

    All variants with a wildcard in the part agree in those bits, so they can be made where the row arrives:
    a seventh of the variants' rows is moved.
    """
    seg = _segments(f)
    out = np.stack([((seg >> np.uint32(hi)) << np.uint32(lo)) | (seg & np.uint32((1 << lo) - 1)) for lo, hi in _PARTS], 2)
    out |= np.arange(3, dtype=np.uint32) << np.uint32(16)
    out |= np.arange(SEGMENTS, dtype=np.uint32)[:, None] << np.uint32(18)
    return out.reshape(len(f), -1).astype(np.int32)


def variants(place: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): for each wildcard position in the place's part, segment, position, and the segment with that bit cleared."""
    p = place.astype(np.uint32)
    s, part = p >> np.uint32(18), (p >> np.uint32(16)) & np.uint32(3)
    seg = _segments(f)[np.arange(len(f)), s][:, None]
    lo, hi = (np.array(x, np.uint32)[part][:, None] for x in zip(*_PARTS, strict=True))
    wild = lo + np.arange(7, dtype=np.uint32)
    keys = (seg & ~(np.uint32(1) << wild)) | (wild << np.uint32(20)) | (s[:, None] << np.uint32(25))
    row, _ = np.nonzero(wild < hi)
    return row, keys[wild < hi].view(np.int32)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first variant that each pair shares: (segment << 5 | wildcard); a pair counts only there."""
    seg = _segments(a ^ b).astype(np.int64)
    ok = (seg & (seg - 1)) == 0
    s = ok.argmax(1)
    v = seg[np.arange(len(seg)), s]
    return (s << 5) | np.where(v > 0, np.log2(np.maximum(v, 1)).astype(np.int64), 0)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tv.parts(batches):
        f, known = fingerprints(batch.column("text"))
        v = f.view(np.int64)
        table = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), *(pa.array(v[:, k]) for k in range(WORDS))], ["doc_id", "copy", *_COLS])
        yield table.filter(pa.array(known))


def blocks(f: np.ndarray) -> np.ndarray:
    """n x 41 places: block and the bits of its part."""
    seg = _segments(f)
    return np.stack([((seg[:, s] >> np.uint32(lo)) & np.uint32((1 << (hi - lo)) - 1)) | np.uint32(k << 7) for k, (s, lo, hi) in enumerate(BLOCKS)], 1).astype(np.int32)


def _before(block: int) -> list[tuple[int, int, int]]:
    return [b for b in BLOCKS[:block] if b[0] == BLOCKS[block][0]]


@functools.cache
def masks(block: int) -> np.ndarray:
    """The differences of a segment without the block's part: as many bits as its limit at most, some in each earlier part, so that of a segment's blocks one finds a pair."""
    s, lo, hi = BLOCKS[block]
    earlier = [(1 << y) - (1 << x) for _, x, y in _before(block)]
    bits = [1 << i for i in range(SEGMENT_BITS - (hi - lo))]
    found = (sum(c) for n in range(LIMITS[s] + 1) for c in combinations(bits, n))
    return np.array([m for m in found if all(m & e for e in earlier)], np.int32)


def first_segment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first segment in which each pair within MAX_BITS meets."""
    x = a ^ b
    word = np.bitwise_count(x) <= np.array(WORD_LIMITS)
    return ((np.bitwise_count(_segments(x)) <= np.array(LIMITS)) & np.repeat(word, PER_WORD, 1)).argmax(1)


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            f = np.stack([part.column(c).to_numpy() for c in _COLS], 1)
            keys = blocks(f.view(np.uint64))
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(part.column("id").to_numpy(), n)), *(pa.array(np.repeat(f[:, k], n)) for k in range(WORDS))],
                ["place", "id", *_COLS],
            )


def _joined(label: np.ndarray, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the labels with those of each pair made one, which pairs it takes for that)."""
    tree, live = [np.zeros(0, np.int64)], np.arange(len(p))
    while True:
        a, b = label[p[live]], label[c[live]]
        apart = a != b
        live, high, low = live[apart], np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        if not len(live):
            return label, np.concatenate(tree)
        order = np.lexsort((low, high))
        own = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
        tree.append(live[own])
        to = np.arange(len(label))
        to[high[own]] = low[own]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _all_pairs(word: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n, i = len(word), 0
    while i < n - 1:
        j = min(n - 1, i + max(1, PAIRS // (n - i)))
        p, c = np.nonzero(np.bitwise_count(word[i:j, None] ^ word[None, i + 1 :]) <= most)
        yield p[c >= p] + i, c[c >= p] + i + 1
        i = j


def _masked_pairs(size: np.ndarray, at: np.ndarray, value: np.ndarray, bits: int, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of rows, which are sorted by value, whose values differ by one of the masks; or, with True, pairs of values that too many rows have."""
    slot = np.full(1 << bits, -1, np.int32)
    slot[value] = np.arange(len(value), dtype=np.int32)
    step = max(1, PAIRS // len(own))
    for i in range(0, len(value), step):
        to = slot[value[i : i + step, None] ^ own]
        hit = np.flatnonzero(to >= np.arange(i, min(i + step, len(value)), dtype=np.int32)[:, None])
        x, y = hit // len(own) + i, to.ravel()[hit]
        number = size[x] * size[y]
        heavy = number > HEAVY
        if heavy.any():
            yield x[heavy], y[heavy], True
            x, y, number = x[~heavy], y[~heavy], number[~heavy]
        for k, m in tv.pieces(tv.spans(number), PAIRS):
            u, v = x[k:m], y[k:m]
            p = np.repeat(at[u], size[u]) + _counted(size[u])
            wide = np.repeat(size[v], size[u])
            c = np.repeat(np.repeat(at[v], size[u]), wide) + _counted(wide)
            p = np.repeat(p, wide)
            if (u == v).any():
                p, c = p[p < c], c[p < c]
            yield p, c, False


def _counted(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of these sizes."""
    at = tv.spans(size)
    return np.arange(at[-1]) - np.repeat(at[:-1], size)


def block_edges(block: int, ids: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows of one place that meet in no earlier block; with those of earlier blocks they join all that are within MAX_BITS of each other here.

    Rows that are joined already are not compared again.
    """
    s, lo, hi = BLOCKS[block]
    seg = (f[:, s // PER_WORD] >> np.uint64(s % PER_WORD * SEGMENT_BITS)) & np.uint64((1 << SEGMENT_BITS) - 1)
    rest = (((seg >> np.uint64(hi)) << np.uint64(lo)) | (seg & np.uint64((1 << lo) - 1))).astype(np.int32)
    order = np.argsort(rest, kind="stable")
    ids, f, seg, rest = ids[order], f[order], seg[order], rest[order]
    word, most = np.ascontiguousarray(f[:, s // PER_WORD]), WORD_LIMITS[s // PER_WORD]
    label = np.arange(len(f))
    earlier = np.array([(1 << y) - (1 << x) for _, x, y in _before(block)], np.uint64)
    out = [np.zeros((2, 0), np.int64)]

    def near(p: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(seg[p] ^ seg[c]) <= LIMITS[s]) & (np.bitwise_count(word[p] ^ word[c]) <= most) & (distance(f[p], f[c]) <= MAX_BITS)

    def found(p: np.ndarray, c: np.ndarray) -> None:
        nonlocal label
        if len(p):
            label, tree = _joined(label, p, c)
            p, c = p[tree], c[tree]
            own = (first_segment(f[p], f[c]) == s) & ((seg[p] ^ seg[c])[:, None] & earlier).all(1)
            out.append(ids[np.stack((p[own], c[own]))])

    def judge(p: np.ndarray, c: np.ndarray) -> None:
        ok = np.flatnonzero(np.bitwise_count(word[p] ^ word[c]) <= most)
        for i in range(0, len(ok), FEW):
            x, y = p[ok[i : i + FEW]], c[ok[i : i + FEW]]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            hit = near(x, y)
            found(x[hit], y[hit])

    own = masks(block)
    if len(f) < 4 * len(own):
        for p, c in _all_pairs(word, most):
            judge(p, c)
    else:
        at = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1])))
        size = np.diff(np.append(at, len(rest)))
        for p, c, heavy in _masked_pairs(size, at, rest[at], SEGMENT_BITS - (hi - lo), own):
            if not heavy:
                judge(p, c)
                continue
            for x, y in zip(p.tolist(), c.tolist(), strict=True):
                rows = np.concatenate([np.arange(at[v], at[v] + size[v]) for v in {x, y}])
                if (label[rows] != label[rows[0]]).any():
                    tree = forest(len(rows), lambda some, others, rows=rows: near(rows[some][:, None], rows[others][None]))
                    found(*rows[np.array(tree, np.int64).reshape(-1, 2)].T)
    return tuple(np.concatenate(out, 1))


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges among rows sorted by place."""
    for table, starts in sorted_runs(batches, "place"):
        f, ids = np.stack([table.column(c).to_numpy() for c in _COLS], 1).view(np.uint64), table.column("id").to_numpy()
        block = table.column("place").to_numpy()[starts[:-1]] >> 7
        for k in np.flatnonzero(np.diff(starts) > 1):
            a, b = block_edges(int(block[k]), ids[starts[k] : starts[k + 1]], f[starts[k] : starts[k + 1]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _spare(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, duplicate_of) for each document that a group can spare; copy is a hash of the text.

    One narrow pass fingerprints the texts; everything after it handles fingerprints and ids only. Equal
    fingerprints are collapsed first, so thousands of exact copies cost one indexed row.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        rows = ids_and_texts(docs).where("doc_id is not null and text is not null").withColumn("copy", F.xxhash64("text"))
        prints, _ = cut(rows.mapInArrow(_fingerprint_rows, f"doc_id long, copy long, {_F}"), "prints")
        # read again from where they are written, so the numbers are the same each time
        reps, _ = cut(prints.groupBy(*_COLS).agg(F.min("doc_id").alias("rep")).withColumn("id", F.monotonically_increasing_id()), "reps")
        placed = reps.select("id", *_COLS).mapInArrow(_place_rows, f"place int, id long, {_F}").repartition("place")
        edges = placed.sortWithinPartitions("place", "id").mapInArrow(_edge_rows, "a long, b long")
        roots, n = components(edges)
        groups = reps.join(maybe_broadcast(roots, n), F.col("id") == F.col("node"), "left").select(*_COLS, "rep", F.coalesce("root", "id").alias("root"))
        place = F.struct("rep", *_COLS)
        kept = groups.groupBy("root").agg(F.min(place).alias("kept"))
        judged = groups.join(kept, "root").select(*_COLS, F.col("kept.rep").alias("duplicate_of"), (place == F.col("kept")).alias("stays"))
        found = prints.join(judged, list(_COLS)).where(~F.col("stays") | (F.col("doc_id") != F.col("duplicate_of")))
        return cut(found.select("doc_id", "copy", "duplicate_of").distinct(), "duplicates", keep=True)[0]


def duplicates(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, duplicate_of) for each document that a group can spare, and their number."""
    out = _spare(docs).select("doc_id", "duplicate_of").distinct()
    return out, out.count()


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of copies, all columns as they were."""
    key, copy = free_name(docs, "__gone"), free_name(docs, "__copy")
    gone = _spare(docs).select(F.col("doc_id").alias(key), F.col("copy").alias(copy))
    return docs.join(maybe_broadcast(gone, gone.count()), (whole_id(docs, "doc_id") == gone[key]) & (F.xxhash64(docs["text"].cast("string")) == gone[copy]), "left_anti")
