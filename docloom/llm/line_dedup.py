"""Fuzzy line deduplication by MinHash.

A line is compared by its lower-cased text with white space trimmed at both ends. Lines of equal text are
collapsed by a hash of 128 bits. Each other line gets a MinHash signature over its byte shingles; bands of it
that are equal make two lines candidates; candidates are verified by the exact Jaccard similarity of their
shingle sets; verified pairs are joined by distributed union-find, and the first line of a component (by
doc_id, then line number) stays.

Shingles have 4 bytes where one of the two lines is short (under LONG bytes) and the other not much longer
(under NEAR bytes, past which lengths alone rule MIN_JACCARD out for lines that don't repeat themselves), and
8 bytes where both are LONG or more. Long unrelated lines of a language have many runs of 4 bytes in common,
so that with them every line would meet a share of all others; few changed words replace few runs of 8.

A band with more than HOT lines is split by hash of the line, and every two parts of it are compared in a
task of their own. Within a part, pairs that cannot be similar enough are ruled out by an upper bound from
bit sets of their shingles, and lines that are joined already aren't compared with each other again.

Defined results: lines of white space are no text and stay as they are. A line too short for a shingle is
compared by its whole text only. A null text has no lines. Rows of one doc_id and one text are one document
and lose the same lines; rows of one doc_id with other texts are documents of their own. Rows without a
doc_id that is a whole number are left alone. A document whose every line with text goes is dropped by
`dedup_lines`, one that was empty before is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textvec as tv
from docloom.llm.components import components
from docloom.llm.shared import cut, filter_of, forest, free_name, ids_and_texts, in_filter, maybe_broadcast, scratch, small_batches, sorted_runs, whole_id

GRAM, LONG_GRAM = 4, 8
LONG, NEAR = 96, 138
#: At MIN_JACCARD two lines share a band with probability 0.96.
BANDS, BAND_ROWS = 18, 5
#: Two lines are one from this share of common shingles on.
MIN_JACCARD = 0.7
#: Lines of a band from which on it is split.
HOT = 20_000
#: Lines that a band may have to be told by its lines.
WHOLE = 4096
#: Parts of the bands' keys, by their first 12 bits, that are sorted one at a time; members of bands that a task sends, and that it holds of a part, at once.
PARTS, SENT, HELD = 1 << 12, 1 << 21, 1 << 22
#: Lines that a task remembers, so as not to band them again.
MEMO = 1 << 20
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 2**32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
_ID = np.uint64((1 << 44) - 1)


def lines_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, line number, normalised text) of the lines that are judged."""
    parts = pc.split_pattern(pc.fill_null(batch.column("text"), ""), "\n")
    row = pc.list_parent_indices(parts).to_numpy()
    number = np.arange(len(row)) - np.searchsorted(row, np.arange(batch.num_rows))[row]
    text = pc.list_flatten(parts)
    text = pc.utf8_trim_whitespace(pc.utf8_lower(text))
    some = pc.greater(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    return row[some], number[some], text.filter(pa.array(some))


def shingles(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles, offsets by line); lines have `gram` bytes at least."""
    h = tv.grams(data, gram)
    count = np.diff(offsets) - (gram - 1)
    at = tv.spans(count)
    inside = np.arange(at[-1]) + np.repeat(np.arange(len(count)) * (gram - 1), count)
    return h[inside], at


def bands(data: np.ndarray, offsets: np.ndarray, gram: int) -> np.ndarray:
    """lines x BANDS hashes of the bands of the MinHash signatures."""
    out = np.empty((len(offsets) - 1, BANDS), np.uint64)
    for i, j in tv.pieces(offsets, 1 << 15):  # small enough to stay in a core's cache
        h, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gram)
        h = (h >> np.uint64(32)).astype(np.uint32)
        starts, v = at[:-1], np.empty_like(h)
        for b in range(BANDS):
            key = np.full(j - i, (b + 1) * 16 + gram, np.uint64)
            for r in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
                np.multiply(h, _MUL[r], out=v)
                key = key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, starts)
            out[i:j, b] = tv.mix(key)
    # the last bit tells the kind of the shingles
    return (out & ~np.uint64(1)) | np.uint64(gram == LONG_GRAM)


def families(length: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bytes of a shingle, whether a line of this length is banded by such shingles)."""
    return [(GRAM, (length >= GRAM) & (length < NEAR)), (LONG_GRAM, length >= LONG)]


def _hashes(text: pa.Array, number: int = 1) -> list[np.ndarray]:
    data, offsets = tv.flat(text)
    out = [np.empty(len(offsets) - 1, np.uint64) for _ in range(number)]
    for i, j in tv.pieces(offsets, 1 << 16):
        for h, x in zip(out, tv.text_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], number), strict=True):
            h[i:j] = x
    return [h.view(np.int64) for h in out]


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tv.parts(batches):
        row, number, text = lines_of(batch)
        if len(row):
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("doc_id", "copy")), pa.array(number.astype(np.int32)), *map(pa.array, _hashes(text, 2))], ["doc_id", "copy", "line_no", "h1", "h2"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bands of the lines that this task hasn't met before: (key, line) pairs, packed by part of the keys."""
    met: set[int] = set()
    held: list[np.ndarray] = []
    for batch in tv.parts(batches):
        _, _, text = lines_of(batch)
        h, first = np.unique(_hashes(text)[0], return_index=True)
        new = np.fromiter((x not in met for x in h.tolist()), bool, len(h))
        h, text = h[new], text.take(pa.array(first[new]))
        if len(met) > MEMO:
            met.clear()
        met.update(h.tolist())
        length = pc.binary_length(text).to_numpy()
        for gram, own in families(length):
            if own.any():
                keys = bands(*tv.flat(text.filter(pa.array(own))), gram)
                held.append(np.stack((keys.view(np.int64).ravel(), np.repeat(h[own], BANDS)), 1))
        if sum(map(len, held)) > SENT:
            yield from _packed(held)
            held = []
    yield from _packed(held)


def _packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if held:
        pairs = np.concatenate(held)
        part = (pairs[:, 0].view(np.uint64) >> np.uint64(52)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        at = np.searchsorted(part[order], np.arange(PARTS + 1))
        some = np.flatnonzero(np.diff(at))
        offsets = np.append(at[some], at[-1]).astype(np.int32) * np.int32(16)
        packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(pairs[order])])
        batch = pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packed], ["part", "pairs"])
        for i in range(0, len(some), 256):
            yield batch.slice(i, 256)


def _sorted_pairs(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, line), sorted and once each, of the pairs whose key another line has, too."""
    pairs = np.concatenate(held)
    key = np.ascontiguousarray(pairs[:, 0])
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    shared = np.append(same, False) | np.append(False, same)
    key, line = key[shared], pairs[order[shared], 1]
    order = np.lexsort((line, key))
    key, line = key[order], line[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])))[: len(key)]
    return key[fresh], line[fresh]


def _crowded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of bands that hold more than one line, from rows sorted by part, under a key of their own.

    Bands of the same lines get the same key, from the sum of the lines' hashes, so that lines with many bands
    in common are compared once. A band of more than WHOLE lines is passed on under its band's key, in a part of
    more than HELD pairs as it comes.
    """
    now, held, passing = -1, [], np.zeros(0, np.int64)
    n, most = 0, HELD

    def out(k: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(k)], ["line", "key"])

    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("pairs"), strict=True):
            if part != now:
                if held:
                    yield from _named(*_sorted_pairs(held), out)
                now, held, passing = part, [], passing[:0]
                n, most = 0, HELD
            pairs = np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, 2)
            if len(passing):
                goes = np.isin(pairs[:, 0], passing)
                yield out(pairs[goes, 0], pairs[goes, 1])
                pairs = pairs[~goes]
            held.append(pairs)
            n += len(pairs)
            if n > most:
                whole = np.concatenate(held)
                key, line = _sorted_pairs([whole])
                names, size = np.unique(key, return_counts=True)
                large = names[size > WHOLE]
                passing = np.concatenate((passing, large))
                goes = np.isin(key, large)
                yield out(key[goes], line[goes])
                held = [whole[~np.isin(whole[:, 0], large)]]
                n = len(held[0])
                most = max(HELD, 2 * n)
    if held:
        yield from _named(*_sorted_pairs(held), out)


def _named(key: np.ndarray, line: np.ndarray, out) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    size = np.diff(np.concatenate((starts, [len(key)])))
    sums = np.add.reduceat(tv.mix(line.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), starts)
    name = np.where(size > WHOLE, key[starts], ((tv.mix(sums) & ~np.uint64(1)).view(np.int64) | (key[starts] & 1)))
    keep = np.repeat(size > 1, size)
    if keep.any():
        yield out(np.repeat(name, size)[keep], line[keep])


def _text_rows(bits: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.parts(batches):
            _, _, text = lines_of(batch)
            h = _hashes(text)[0]
            hit = np.flatnonzero(in_filter(bits, h))
            if len(hit):
                h, first = np.unique(h[hit], return_index=True)
                text = text.take(pa.array(hit[first]))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(_hashes(text, 2)[1]), text.cast(pa.string())], ["h1", "h2", "body"])

    return rows


class Sets:
    """The shingle sets of lines, sorted, as numbers of 44 bits under the number of the line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gram: int) -> None:
        h, at = shingles(data, offsets, gram)
        n = len(offsets) - 1
        keys = np.sort((np.repeat(np.arange(n, dtype=np.uint64), np.diff(at)) << np.uint64(44)) | (h >> np.uint64(20)))
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        row = (keys >> np.uint64(44)).astype(np.int64)
        self.values, self.at = keys & _ID, np.searchsorted(row, np.arange(n + 1))
        self.size = np.diff(self.at)

    def similar(self, p: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether the Jaccard similarity of each pair is high enough."""
        out = np.zeros(len(p), bool)
        # sizes alone rule out some
        may = np.flatnonzero(np.minimum(self.size[p], self.size[c]) >= MIN_JACCARD * np.maximum(self.size[p], self.size[c]))
        p, c = p[may], c[may]
        both = self.size[p] + self.size[c]
        for i, j in tv.pieces(tv.spans(both), 1 << 20):
            pair = np.repeat(np.arange(j - i, dtype=np.uint64), both[i:j])
            ends = np.stack((p[i:j], c[i:j]), 1).ravel()
            size = self.size[ends]
            where = np.arange(size.sum()) + np.repeat(self.at[:-1][ends] - tv.spans(size)[:-1], size)
            keys = np.sort((pair << np.uint64(44)) | self.values[where])
            same = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(44)
            shared = np.bincount(same.astype(np.int64), minlength=j - i)
            out[may[i:j]] = shared >= MIN_JACCARD * (both[i:j] - shared)
        return out

    def bits(self, rows: np.ndarray, words: int = 32) -> np.ndarray:
        """The sets of these lines as sets of 64 * words bits."""
        slot = (self.values % np.uint64(64 * words)).astype(np.int64)
        out = np.empty((len(rows), words), np.uint64)
        for i in range(0, len(rows), 4096):  # bounded unpacked bits
            size = self.size[rows[i : i + 4096]]
            where = np.arange(size.sum()) + np.repeat(self.at[rows[i : i + 4096]] - tv.spans(size)[:-1], size)
            flags = np.zeros((len(size), 64 * words), bool)
            flags[np.repeat(np.arange(len(size)), size), slot[where]] = True
            out[i : i + 4096] = np.packbits(flags, axis=1).view(np.uint64)
        return out


def _judged(length: np.ndarray, gram: int, p: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (length[p] < LONG) | (length[c] < LONG) if gram == GRAM else np.ones(len(p), bool)


def bucket_edges(text: pa.Array, key: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as numbers of the lines, between lines of one bucket whose exact Jaccard similarity is high enough."""
    out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    data, offsets = tv.flat(text)
    size = np.diff(starts)
    for g in (GRAM, LONG_GRAM):
        own = ((key[starts[:-1]] & 1) == (g == LONG_GRAM)) & (size > 1)
        rows = np.flatnonzero(np.repeat(own, size))
        if not len(rows):
            continue
        length = np.diff(offsets)[rows]
        ends = np.repeat(tv.spans(size[own])[1:], size[own])
        begin = tv.spans(size[own])
        inside = np.arange(length.sum()) + np.repeat(offsets[rows] - tv.spans(length)[:-1], length)
        sets = Sets(data[inside], tv.spans(length), g)
        few = np.flatnonzero(np.repeat(size[own] <= 8, size[own]))
        part = np.arange(len(rows))  # lines that are joined have the same
        for step in range(1, 8):
            p = few[few + step < ends[few]]
            if not len(p):
                break
            c = p + step
            ok = (part[p] != part[c]) & _judged(length, g, p, c)
            p, c = p[ok], c[ok]
            hit = sets.similar(p, c)
            p, c = p[hit], c[hit]
            out.append(rows[np.stack((p, c), 1)])
            if step == 1:
                new = np.ones(len(rows), bool)
                new[c] = False
                part = np.cumsum(new)
            else:
                for x, y in zip(p.tolist(), c.tolist(), strict=True):
                    near = slice(max(0, x - 8), y + 8)
                    part[near][part[near] == part[y]] = part[x]
        many = np.flatnonzero(size[own] > 8)
        if not len(many):
            continue
        crowd = np.flatnonzero(np.repeat(size[own] > 8, size[own]))
        bits, lost = np.zeros((len(rows), 32), np.uint64), np.zeros(len(rows), np.int64)
        bits[crowd] = sets.bits(crowd)
        lost[crowd] = sets.size[crowd] - np.bitwise_count(bits[crowd]).sum(1, dtype=np.int64)
        for k in many:
            lo, hi = int(begin[k]), int(begin[k + 1])

            def near(some: np.ndarray, others: np.ndarray, lo=lo) -> np.ndarray:
                found = np.zeros((len(some), len(others)), bool)
                o = others + lo
                for r, s in enumerate(some + lo):
                    most = np.bitwise_count(bits[s] & bits[o]).sum(1, dtype=np.int64) + np.minimum(lost[s], lost[o])
                    may = np.flatnonzero((most >= MIN_JACCARD * (sets.size[s] + sets.size[o] - most)) & _judged(length, g, np.full(len(o), s), o))
                    found[r, may] = sets.similar(np.full(len(may), s), o[may])
                return found

            tree = np.array(forest(hi - lo, near), np.int64).reshape(-1, 2)
            out.append(rows[tree + lo])
    edges = np.concatenate(out)
    return edges[:, 0], edges[:, 1]


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in sorted_runs(batches):
        a, b = bucket_edges(table.column("body").combine_chunks(), table.column("key").to_numpy(), starts)
        if len(a):
            h1, h2 = table.column("h1").to_numpy(), table.column("h2").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[a], h2[a], h1[b], h2[b])], ["a1", "a2", "b1", "b2"])


def _met(crowded: DataFrame, bodies: DataFrame, hot: int) -> DataFrame:
    """(key, h1, h2, body) of the candidates, sorted by key; the keys of hot bands are split into those of two parts each."""
    large = crowded.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    large, _ = cut(large, "hot-bands")
    n = large.count()
    met = crowded.join(bodies, F.col("line") == F.col("h1")).select("key", "h1", "h2", "body")
    if n:
        part = F.pmod("h2", F.col("parts")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.xxhash64("key", F.least(t, part), F.greatest(t, part)))
        kind = F.col("key").bitwiseAND(F.lit(1))
        keys = F.when(F.col("parts").isNull(), F.array("key")).otherwise(F.transform(pair, lambda x: x.bitwiseAND(F.lit(-2)).bitwiseOR(kind)))
        met = met.join(maybe_broadcast(large, n), "key", "left").select(F.explode(keys).alias("key"), "h1", "h2", "body")
    return met.repartition("key").sortWithinPartitions("key", "h1", "h2")


def _groups(edges: DataFrame) -> tuple[DataFrame, int]:
    """(h1, h2, group) of each line with an edge, and their number."""
    ends = edges.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).unionByName(edges.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).distinct()
    # read again from where it is written, so the numbers are the same each time
    nodes, _ = cut(ends.withColumn("id", F.monotonically_increasing_id()), "line-nodes")
    n = nodes.count()
    of = lambda e, c: nodes.select(F.col("h1").alias(f"{e}1"), F.col("h2").alias(f"{e}2"), F.col("id").alias(c))
    links = edges.join(maybe_broadcast(of("a", "a"), n, 24), ["a1", "a2"]).join(maybe_broadcast(of("b", "b"), n, 24), ["b1", "b2"]).select("a", "b")
    roots, m = components(links)
    return nodes.join(maybe_broadcast(roots, m), F.col("id") == F.col("node"), "left").select("h1", "h2", F.coalesce("root", "id").alias("group")), n


def _duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, copy, line_no, kept_doc_id, kept_line_no) of each line that an earlier one replaces; copy is a hash of the document's text."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        rows = ids_and_texts(docs).where("doc_id is not null and text is not null").withColumn("copy", F.xxhash64("text"))
        lines, _ = cut(rows.mapInArrow(_line_rows, "doc_id long, copy long, line_no int, h1 long, h2 long"), "lines")
        banded = rows.select("text").mapInArrow(_band_rows, "part int, pairs binary")
        crowded, _ = cut(banded.repartition("part").sortWithinPartitions("part").mapInArrow(_crowded_rows, "line long, key long").distinct(), "crowded")
        ids = crowded.select("line").distinct()
        bodies = rows.select("text").mapInArrow(_text_rows(filter_of(ids, ids.count())), "h1 long, h2 long, body string").groupBy("h1", "h2").agg(F.first("body").alias("body"))
        edges, _ = cut(_met(crowded, bodies, hot).mapInArrow(_edge_rows, "a1 long, a2 long, b1 long, b2 long"), "line-edges")
        groups, n = _groups(edges)
        labelled = lines.join(maybe_broadcast(groups, n, 24), ["h1", "h2"], "left")
        own = F.col("group").isNull()
        labelled = labelled.select("doc_id", "copy", "line_no", own.alias("g0"), F.coalesce("group", "h1").alias("g1"), F.when(own, F.col("h2")).otherwise(0).alias("g2"))
        place = F.struct("doc_id", "line_no", "copy")
        first = labelled.groupBy("g0", "g1", "g2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        found = labelled.join(first, ["g0", "g1", "g2"]).where(place != F.col("first"))
        out, _ = cut(found.select("doc_id", "copy", "line_no", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.line_no").alias("kept_line_no")).distinct(), "line-duplicates", keep=True)
        return out


def duplicate_lines(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, int]:
    """(doc_id, line_no, kept_doc_id, kept_line_no) of each line that an earlier one replaces, and their number."""
    out = _duplicates(docs, hot).drop("copy")
    return out, out.count()


def _without(text: pa.Array, lines: pa.Array) -> pa.Array:
    """The texts without the lines of these numbers; null where there is no text."""

    def one(t: str | None, gone: list[int] | None) -> str | None:
        if t is None:
            return None
        drop = set(gone or ())
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)

    return pa.array([one(t, g) for t, g in zip(text.to_pylist(), lines.to_pylist(), strict=True)], pa.string())


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines, all columns kept and n_chars, if there, set anew.

    A document that has lost every line with text is dropped.
    """
    gone = _duplicates(docs)
    key, copy, lines, left = (free_name(docs, f"__{c}") for c in ("gone", "copy", "lines", "left"))
    by_doc, _ = cut(gone.groupBy(F.col("doc_id").alias(key), F.col("copy").alias(copy)).agg(F.collect_list("line_no").alias(lines)), "lines-by-document")
    n, of_lines = by_doc.agg(F.count("*"), F.sum(F.size(lines))).first()
    small = maybe_broadcast(by_doc, n, 32 + 4 * (of_lines or 0) // max(1, n))
    text = docs["text"].cast("string")
    joined = docs.join(small, (whole_id(docs, "doc_id") == small[key]) & (F.xxhash64(text) == small[copy]), "left")
    # only texts that lose lines go to Python, and once: without the mark the optimiser would repeat the call in the filter
    without = F.arrow_udf(_without, "string").asNondeterministic()
    met = joined.withColumn(left, without(F.when(F.col(lines).isNotNull(), text), F.col(lines)))
    kept = met.where(F.col(left).isNull() | (F.length(F.btrim(left, F.lit(" \t\r\n"))) > 0))
    new = {"text": F.coalesce(left, text).cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(left).isNull(), docs["n_chars"]).otherwise(F.length(left).cast(docs.schema["n_chars"].dataType))
    return kept.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))
