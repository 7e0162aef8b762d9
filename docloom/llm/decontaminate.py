"""Benchmark decontamination by spaced seeds.

Words are lower-cased runs of letters and digits. Each of a few fixed masks looks at five of up to nine
consecutive words and ignores the others, so a seed survives a substitution at an ignored place. Seeds of
the test items and of the training texts are joined by hash; around each hit the two texts are laid over
each other, and the overlap counts if some window of MIN_WORDS aligned words agrees in MIN_SHARE of them.

The seeds of the items are held in each task while there are at most BROADCAST_SEEDS of them. Beyond that a
Bloom filter of them is, and only the seeds of a document that pass it are moved, to an equality join with
those of the items; the texts of documents with hits are then fetched and verified. Both ways give the same rows.

Defined results: an item of fewer than LEAST words has no seed and matches nothing; one of fewer than SHORTEST
must be there whole, every word; one shorter than MIN_WORDS whole, up to the same share as others. Null and
empty texts match nothing, nor do rows without an id that is a whole number. Rows of one doc_id with other
texts are told apart when documents are dropped. Of several places of a doc_id where an item matches, the one
with most equal words is reported, then the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textvec as tv
from docloom.llm.shared import cut, filter_of, free_name, ids_and_texts, in_filter, maybe_broadcast, scratch, small_batches, whole_id

MASKS = ("11111", "110111", "1101011", "11001101", "101001101")
LEAST, SHORTEST, MIN_WORDS, MIN_SHARE = 5, 8, 12, 0.8
BROADCAST_SEEDS = 2_000_000
_FACTOR = np.random.default_rng(5).integers(1, 2**63, max(map(len, MASKS)), dtype=np.uint64) | np.uint64(1)
_FLAG_BITS = np.uint64(22)
OUT = "doc_id long, copy long, item_id long, doc_word int, item_word int, words int, matches int"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets by text)."""
    data, offsets = tv.flat(pc.utf8_lower(texts))
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, j in tv.pieces(offsets):
        h, _, doc = tv.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hashes.append(h)
        counts[i:j] = np.bincount(doc, minlength=j - i)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), tv.spans(counts)


def seeds(w: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask, (hash, position) of each window that lies in one text."""
    for k, mask in enumerate(MASKS):
        n = len(w) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, k + 1, np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                h += w[i : i + n] * _FACTOR[i]
        ok = np.ones(n, bool)
        for back in range(1, len(mask)):
            edge = at[1:-1] - back
            ok[edge[(edge >= 0) & (edge < n)]] = False
        pos = np.flatnonzero(ok)
        yield tv.mix(h[pos]), pos


def overlaps(doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each shift (place in doc of the item's first word): (passes, window start in the item, its length, equal words in it)."""
    m = len(item)
    width = min(m, MIN_WORDS)
    need = width if m < SHORTEST else int(np.ceil(MIN_SHARE * width - 1e-9))
    best, where = np.zeros(len(shift), np.int64), np.zeros(len(shift), np.int64)
    for a in range(0, len(shift), 2048):
        idx = shift[a : a + 2048, None] + np.arange(m)
        inside = (idx >= 0) & (idx < len(doc))
        eq = inside & (doc[np.clip(idx, 0, len(doc) - 1)] == item)
        run = np.concatenate((np.zeros((len(eq), 1), np.int64), eq.cumsum(1)), 1)
        win = run[:, width:] - run[:, :-width]
        full = np.concatenate((np.zeros((len(eq), 1), np.int64), inside.cumsum(1)), 1)
        win = np.where(full[:, width:] - full[:, :-width] == width, win, 0)
        best[a : a + 2048], where[a : a + 2048] = win.max(1), win.argmax(1)
    return best >= need, where, np.full(len(shift), width), best


class Items:
    """The test items with their seeds, sorted by hash."""

    def __init__(self, ids: np.ndarray, texts: pa.Array) -> None:
        w, at = words_of(texts)
        long = np.diff(at) >= LEAST
        self.ids, self.words = ids, [w[at[i] : at[i + 1]] if long[i] else w[:0] for i in range(len(ids))]
        size = np.array([len(x) for x in self.words])
        flat, at = np.concatenate([*self.words, np.zeros(0, np.uint64)]), tv.spans(size)
        h, pos = zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *seeds(flat, at), strict=True)
        h, pos = np.concatenate(h), np.concatenate(pos)
        order = np.argsort(h, kind="stable")
        self.hash, pos = h[order], pos[order]
        self.item = np.searchsorted(at, pos, "right") - 1
        self.pos = pos - at[self.item]
        self.flag = np.zeros(1 << int(_FLAG_BITS), bool)
        self.flag[self.hash >> (np.uint64(64) - _FLAG_BITS)] = True


def matches(doc: np.ndarray, words: list[np.ndarray], item: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(item index, word of the document, word of the item, window length, equal words) of each item that overlaps."""
    for i in np.unique(item):
        s = np.unique(shift[item == i])
        ok, where, width, best = overlaps(doc, words[i], s)
        if ok.any():
            k = int(np.where(ok, best, -1).argmax())
            yield int(i), int(s[k] + where[k]), int(where[k]), int(width[k]), int(best[k])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])


def _scan(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = shared.value
        for batch in tv.parts(batches):
            ids, copies = (batch.column(c).to_numpy() for c in ("doc_id", "copy"))
            data, offsets = tv.flat(pc.utf8_lower(batch.column("text")))
            out = []
            for i, j in tv.pieces(offsets):
                w, _, doc = tv.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = tv.per_text(doc, j - i)
                hit_doc, hit_item, hit_shift = [], [], []
                for h, pos in seeds(w, at):
                    some = np.flatnonzero(it.flag[h >> (np.uint64(64) - _FLAG_BITS)])
                    lo = np.searchsorted(it.hash, h[some])
                    n = np.searchsorted(it.hash, h[some], "right") - lo
                    if n.sum():
                        at_seed = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(tv.spans(n)[:-1], n)
                        p = np.repeat(pos[some], n)
                        hit_doc.append(doc[p])
                        hit_item.append(it.item[at_seed])
                        hit_shift.append(p - at[doc[p]] - it.pos[at_seed])
                if hit_doc:
                    hit_doc, hit_item, hit_shift = map(np.concatenate, (hit_doc, hit_item, hit_shift))
                    for d in np.unique(hit_doc):
                        own = hit_doc == d
                        out += [(int(ids[i + d]), int(copies[i + d]), int(it.ids[m[0]]), *m[1:]) for m in matches(w[at[d] : at[d + 1]], it.words, hit_item[own], hit_shift[own])]
            if out:
                yield _batch(out)

    return rows


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tv.parts(batches):
        w, at = words_of(batch.column("text"))
        enough = np.diff(at) >= LEAST
        for h, pos in seeds(w, at):
            row = np.searchsorted(at, pos, "right") - 1
            keep = enough[row]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row[keep])), pa.array(h[keep].view(np.int64)), pa.array((pos - at[row])[keep])], ["item_id", "hash", "item_at"])


def _possible_seeds(shared):
    """The seeds of documents that the filter lets pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.parts(batches):
            w, at = words_of(batch.column("text"))
            for h, pos in seeds(w, at):
                hit = in_filter(shared.value, h)
                h, pos = h[hit], pos[hit]
                if len(h):
                    row = np.searchsorted(at, pos, "right") - 1
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("doc_id", "copy")), pa.array(h.view(np.int64)), pa.array(pos - at[row])], ["doc_id", "copy", "hash", "doc_at"])

    return rows


def _with_hits(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(shared.value, batch.column("copy").to_numpy())))

    return rows


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, da = words_of(batch.column("text"))
        m, ma = words_of(batch.column("item_text"))
        out = []
        for r in range(batch.num_rows):
            shift = np.array(batch.column("shifts")[r].as_py(), np.int64)
            ids = [batch.column(c)[r].as_py() for c in ("doc_id", "copy", "item_id")]
            out += [(*ids, *x[1:]) for x in matches(d[da[r] : da[r + 1]], [m[ma[r] : ma[r + 1]]], np.zeros(len(shift), np.int64), shift)]
        if out:
            yield _batch(out)


def _overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int) -> DataFrame:
    """Verified overlaps (columns of OUT), of a document and an item perhaps several; copy is a hash of the document's text."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = ids_and_texts(docs).where("doc_id is not null and text is not null").withColumn("copy", F.xxhash64("text"))
    items = benchmark.select(whole_id(benchmark, "item_id").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    # a word takes two bytes at least with its separator, so this bounds the seeds without tokenising anything
    bound = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) * len(MASKS) / 2).first()[0]
    if bound <= broadcast_seeds:
        got = items.toArrow()
        shared = spark.sparkContext.broadcast(Items(got["item_id"].to_numpy(), got["text"].combine_chunks()))
        return rows.mapInArrow(_scan(shared), OUT)
    right, _ = cut(items.mapInArrow(_item_seeds, "item_id long, hash long, item_at long"), "item-seeds")
    bits = spark.sparkContext.broadcast(filter_of(right.select("hash"), right.count(), 32 << 20))
    left = rows.mapInArrow(_possible_seeds(bits), "doc_id long, copy long, hash long, doc_at long")
    shifts = left.join(right, "hash").groupBy("doc_id", "copy", "item_id").agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("shifts"))
    hits, _ = cut(shifts, "item-hits")
    some = spark.sparkContext.broadcast(filter_of(hits.select("copy").distinct(), hits.count()))
    texts = rows.mapInArrow(_with_hits(some), "doc_id long, text string, copy long").dropDuplicates(["doc_id", "copy"])
    full = hits.join(texts, ["doc_id", "copy"]).join(items.select("item_id", F.col("text").alias("item_text")), "item_id")
    return full.select("doc_id", "copy", "item_id", "text", "item_text", "shifts").mapInArrow(_verify, OUT)


def overlaps_with(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The verified overlaps, a row for each document and item: (doc_id, item_id, doc_word, item_word, words, matches)."""
    best = F.max_by(F.struct("doc_word", "item_word", "words", "matches"), F.struct("matches", -F.col("doc_word"), -F.col("item_word"))).alias("b")
    return _overlaps(docs, benchmark, broadcast_seeds).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """The documents that overlap no test item, all columns as they were."""
    key, copy = free_name(docs, "__gone"), free_name(docs, "__copy")
    with scratch(docs.sparkSession):
        gone, _ = cut(_overlaps(docs, benchmark, broadcast_seeds).select(F.col("doc_id").alias(key), F.col("copy").alias(copy)).distinct(), "contaminated", keep=True)
    return docs.join(maybe_broadcast(gone, gone.count()), (whole_id(docs, "doc_id") == gone[key]) & (F.xxhash64(docs["text"].cast("string")) == gone[copy]), "left_anti")
