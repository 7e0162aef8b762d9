"""A quality classifier by Bradley-Terry pairwise ranking.

Each document has a score w.x, and the probability that one is preferred to another is the logistic function
of the difference of their scores; w is fitted by logistic loss on the feature differences of pairs of a
preferred document (labelled good and not toxic) and one that isn't. Documents under a quantile of the
scores of preferred documents are rejected.

Half of the labelled documents (by hash of the id) are there to fit, of which at most FIT_DOCS are used, those with the
lowest hashes; all others set the threshold, each at its score. Features are counted over the
whole text: shares of the byte classes, repetition of words and of word triples, lengths, and the rates of
the words and word beginnings that the sample shows often enough.

Defined results: a null text scores null and is kept, as nothing speaks against it; an empty one has the
features of no text and is scored. A label with a null quality and no toxic mark is not used, and the worst
of several labels of one document counts. Without labelled documents of both kinds nothing is rejected and
scores are null. Of several texts of one doc_id the one of the least hash is there to fit, all set the
threshold. Ids that are no whole numbers have no label. A rejected doc_id is rejected in all rows whose text scores low; ties with the threshold stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textvec as tv
from docloom.llm.shared import cut, filter_of, free_name, ids_and_texts, in_filter, maybe_broadcast, scratch, small_batches, whole_id

FIT_DOCS = 6000
VOCABULARY = 16384
#: Lengths in bytes of the word beginnings that are terms besides the words.
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_DOCS = 8
#: Rates are taken of so many words at least.
LEAST_WORDS = 50
#: The quantile of preferred documents' scores that is the threshold.
QUANTILE = 0.01
#: Scores are counted on this grid, so that the quantile is exact and needs bounded memory.
GRID = 0.01
_BYTES = 129
_DENSE = _BYTES + 8


def dense_of(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """n x _DENSE features that need no vocabulary."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    hist = np.bincount(owner * _BYTES + np.minimum(data, 128), minlength=n * _BYTES).reshape(n, _BYTES)
    count = np.bincount(doc, minlength=n)
    some = np.maximum(count, 1)

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        key = np.sort((of.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20)))
        first = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=n)

    same = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    three = (h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[doc[2:] == doc[:-2]] if len(h) > 2 else h[:0]
    three_doc = doc[2:][doc[2:] == doc[:-2]] if len(h) > 2 else doc[:0]
    triples = np.maximum(np.bincount(three_doc, minlength=n), 1)
    words = distinct(h, doc)
    out = np.empty((n, _DENSE), np.float32)
    out[:, :_BYTES] = np.sqrt(hist / size[:, None])
    letters = np.maximum(hist[:, 65:91].sum(1) + hist[:, 97:123].sum(1) + hist[:, 128], 1)
    out[:, _BYTES:] = np.stack(
        [hist[:, 65:91].sum(1) / letters, hist[:, 33:48].sum(1) / size, np.log1p(count), np.log1p(size / some), np.log1p(words) / np.log1p(some), same / some, distinct(tv.mix(three), three_doc) / triples, count == 0], 1
    )
    return out


def terms_of(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words, their texts, hashes of the terms, the texts of these).

    Terms are words and their beginnings; a word that only repeats the one before it adds none.
    """
    h, at, doc = tv.words(low, offsets)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    begun, owner = tv.beginnings(low, at[new], BEGINNINGS)
    return h, doc, np.concatenate([h[new], begun]), np.concatenate([doc[new], doc[new][owner]])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    vocabulary: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.flag = np.zeros(1 << 20, bool)
        self.flag[self.vocabulary >> np.uint64(44)] = True

    def rates(self, h: np.ndarray, doc: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Sum over each document's terms of their weights, as a rate of its words."""
        some = np.flatnonzero(self.flag[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == h[some]
        total = np.bincount(doc[some[hit]], self.weights[_DENSE:][at[hit]], minlength=len(words))
        return total / np.maximum(words, LEAST_WORDS)

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, offsets = tv.flat(texts)
        out = np.empty(len(offsets) - 1)
        for i, j in tv.pieces(offsets):
            h, doc, terms, owner = terms_of(*tv.flat(pc.utf8_lower(texts.slice(i, j - i))))
            x = dense_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], h, doc)
            out[i:j] = ((x - self.mean) / self.scale) @ self.weights[:_DENSE]
            if len(self.vocabulary) and len(h):
                out[i:j] += self.rates(terms, owner, np.bincount(doc, minlength=j - i))
        return out


#: Added to the spread of a word's rate, so that a word seen in few documents can't weigh without bound.
_LEAST_SPREAD = 0.0005


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sampled document's dense features and word counts."""
    for batch in batches:
        texts = batch.column("text")
        data, offsets = tv.flat(texts)
        low, low_offsets = tv.flat(pc.utf8_lower(texts))
        for r in range(batch.num_rows):
            h, doc, terms, _ = terms_of(low[low_offsets[r] : low_offsets[r + 1]], np.array([0, low_offsets[r + 1] - low_offsets[r]]))
            x = dense_of(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]), h, doc)
            u, c = np.unique(terms, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(r, 1), batch.column("good").slice(r, 1), pa.array([x.tobytes()]), pa.array([u.tobytes()]), pa.array([c.astype(np.int32).tobytes()]), pa.array([len(h)])],
                ["doc_id", "good", "dense", "words", "counts", "n"],
            )


def fit(sample: pa.Table, rounds: int = 400, seed: int = 1) -> Model | None:
    """A model from rows (good, dense, words, counts, n); None if one kind is missing."""
    good = sample["good"].to_numpy()
    if good.all() or not good.any():
        return None
    dense = np.stack([np.frombuffer(d.as_buffer(), np.float32) for d in sample["dense"]])
    words = [np.frombuffer(w.as_buffer(), np.uint64) for w in sample["words"]]
    seen, docs = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_counts=True)
    often = docs >= LEAST_DOCS
    seen, docs = seen[often], docs[often]
    vocabulary = np.sort(seen[np.lexsort((seen, -docs))[:VOCABULARY]])
    mean, scale = dense.mean(0), dense.std(0) + 0.02
    x = (dense - mean) / scale
    row, col, rate = _rates(words, sample["counts"], sample["n"].to_numpy(), vocabulary)
    n, size = len(sample), len(vocabulary)
    # of a column's deviation, its zeros need not be there
    average = np.bincount(col, rate, size) / n
    spread = 1 / (np.sqrt(np.maximum(np.bincount(col, np.square(rate, dtype=np.float64), size) / n - average**2, 0)) + _LEAST_SPREAD)
    rate = rate * spread[col].astype(np.float32)
    rows, row_at = np.unique(row, return_index=True)
    order = np.argsort(col, kind="stable")
    cols, col_at = np.unique(col[order], return_index=True)
    row_by_col, rate_by_col = row[order], rate[order]
    del row, order
    s, g = np.zeros(n, np.float32), np.zeros(_DENSE + size, np.float32)
    rng = np.random.default_rng(seed)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    w, m, v = (np.zeros(_DENSE + size, np.float32) for _ in range(3))
    for step in range(1, rounds + 1):
        a, b = rng.choice(up, 4096), rng.choice(down, 4096)
        s[:] = x @ w[:_DENSE]
        if len(rows):
            s[rows] += np.add.reduceat(rate * w[_DENSE:][col], row_at)
        miss = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        pull = (np.bincount(a, miss, minlength=n) - np.bincount(b, miss, minlength=n)).astype(np.float32)
        g[:_DENSE] = x.T @ pull
        if len(cols):
            g[_DENSE + cols] = np.add.reduceat(rate_by_col * pull[row_by_col], col_at)
        g = 3e-4 * w - g / 4096
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - step / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w[_DENSE:] *= spread
    return Model(mean, scale, vocabulary, w)


def _rates(words: list[np.ndarray], counts: pa.ChunkedArray, n_words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rate) of the vocabulary's terms that each document has."""
    rows, cols, rates = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for r, (w, c, n) in enumerate(zip(words, counts, n_words, strict=True)):
        if len(vocabulary) and len(w):
            at = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
            hit = vocabulary[at] == w
            cols.append(at[hit].astype(np.int32))
            rates.append((np.frombuffer(c.as_buffer(), np.int32)[hit] / max(n, LEAST_WORDS)).astype(np.float32))
            rows.append(np.full(len(cols[-1]), r, np.int32))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(rates)


def preferences(labels: DataFrame) -> DataFrame:
    """(doc_id, good, h, part): each labelled document once; documents of part 0 may be used to fit."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) != 0
    marked = labels.select(whole_id(labels, "doc_id").alias("doc_id"), F.when(toxic, 0).otherwise(F.col("quality")).alias("q")).where("doc_id is not null and q is not null")
    return marked.groupBy("doc_id").agg((F.min("q") > 0).alias("good")).withColumn("h", F.xxhash64("doc_id", F.lit("fit"))).withColumn("part", F.col("h").bitwiseAND(F.lit(1)))


def to_fit(labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The labelled documents, `fit_docs` at most, that fit the model."""
    return preferences(labels).where("part = 0").orderBy("h", "doc_id").limit(fit_docs)


def fitted(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    small_batches(docs.sparkSession)
    texts = ids_and_texts(docs).where("doc_id is not null and text is not null")
    # repeated rows are merged before they leave their tasks
    sample = texts.join(F.broadcast(to_fit(labels, fit_docs).select("doc_id", "good")), "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = sample.select("doc_id", "good", "t.text").mapInArrow(_sample_rows, "doc_id long, good boolean, dense binary, words binary, counts binary, n long").toArrow()
    return fit(rows.sort_by("doc_id")) if rows.num_rows else None


def score_of(text: Column, model: Model, session: SparkSession) -> Column:
    shared = session.sparkContext.broadcast(model)

    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(text), mask=text.is_null().to_numpy(zero_copy_only=False))

    # marked so that the optimiser does not repeat the call in a filter
    call = F.arrow_udf(score, "double").asNondeterministic()
    return F.round(call(text.cast("string")) / GRID) * GRID


def _scored_rows(bits, shared):
    """(doc_id, score) of the rows whose ids the filter lets pass: only they are scored, and no text is moved."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(in_filter(bits.value, batch.column("h").to_numpy())))
            if some.num_rows:
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(shared.value.scores(some.column("text")))], ["doc_id", "score"])

    return rows


def threshold(docs: DataFrame, labels: DataFrame, model: Model, quantile: float = QUANTILE, fit_docs: int = FIT_DOCS) -> float | None:
    """The score under which a document is rejected: counted over every preferred document that didn't fit the model; only those are scored."""
    spark = docs.sparkSession
    with scratch(spark):
        good, _ = cut(preferences(labels).where("good").join(to_fit(labels, fit_docs).select("doc_id"), "doc_id", "left_anti").select("doc_id"), "preferred")
        n = good.count()
        bits = spark.sparkContext.broadcast(filter_of(good.select(F.xxhash64("doc_id").alias("h")), n))
        texts = ids_and_texts(docs).where("doc_id is not null and text is not null").withColumn("h", F.xxhash64("doc_id"))
        some = texts.mapInArrow(_scored_rows(bits, spark.sparkContext.broadcast(model)), "doc_id long, score double").join(maybe_broadcast(good, n), "doc_id", "left_semi")
        hist = some.groupBy((F.round(F.col("score") / GRID) * GRID).alias("score")).count().toArrow()
    if not hist.num_rows:
        return None
    s, n = hist["score"].to_numpy(), hist["count"].to_numpy()
    order = np.argsort(s)
    return float(s[order][np.searchsorted(n[order].cumsum(), quantile * n.sum(), "right")])


def kept(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[DataFrame, str, str]:
    """The documents that are not rejected with two more columns, and the names of these: the score and the threshold."""
    model = fitted(docs, labels, fit_docs)
    least = threshold(docs, labels, model, fit_docs=fit_docs) if model is not None else None
    score, limit = free_name(docs, "__score"), free_name(docs, "__threshold")
    if model is None:
        return docs.withColumns({score: F.lit(None).cast("double"), limit: F.lit(None).cast("double")}), score, limit
    found = docs.withColumn(score, score_of(docs["text"], model, docs.sparkSession))
    if least is not None:
        found = found.where(F.col(score).isNull() | F.isnan(score) | (F.col(score) >= F.lit(least - GRID / 2)))
    return found.withColumn(limit, F.lit(least).cast("double")), score, limit
