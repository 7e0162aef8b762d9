"""Language-model scoring with a log-bilinear neural model trained in numpy by noise-contrastive estimation.

A token is predicted from the CONTEXT tokens before it: their vectors, each scaled by the weights of its
place, add up to a predicted vector. Tokens lie in classes of MEMBERS each, in order of frequency; the
predicted vector's products with the classes' vectors score the classes, those with the vectors of a class's
tokens score these within it. Training tells the corpus's class from classes drawn from their unigram
distribution, and its token from others of the class drawn likewise, so it needs no sums. Scoring is normalised
over the whole vocabulary: products of matrices of contexts with the vectors of all classes, and with those of
the members of each token's class, give both sums, so a probability costs the square root of the vocabulary.

Tokens are the VOCABULARY - RARE most frequent words of the whole corpus, and RARE groups of all others by their
first bytes. A word of a group backs off to the group: it has the group's probability in its context times the
word's share of the group's occurrences in the corpus, so the probabilities of all words of the corpus add up to
1 in every context. The counts of all words are kept as a table: shares of up to `most` words (the most frequent
ones) are sent to the workers, those of the others are joined by word. Every round each task trains on all
tokens of its partition from the same start, and the mean of the tasks' parameters, weighted by tokens, is the
next start; what is exchanged grows with the corpus, what the driver holds is one model and `most` shares.

Defined results: a null text has null scores; a text without words has 0 tokens, log_prob 0 and a null mean.
Rows repeat as often as they come, with the same score each, and teach the model as often. An empty corpus
gives an empty result. Tokens before the beginning of a text are a token of their own. Ids that are no whole
numbers are null in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textvec as tv
from docloom.llm.shared import BROADCAST_ROWS, cut, delete, ids_and_texts, small_batches

VOCABULARY, RARE = 32768, 2048
MEMBERS = 128
CONTEXT = 2
WIDTH = 16
#: Noise classes of each batch, and noise tokens of each class in it.
NOISE, SIBLINGS = 16, 3
#: Tokens of a step; of the first START_TOKENS of a task, START_BATCH.
BATCH, START_BATCH, START_TOKENS = 4096, 512, 1 << 17
ROUNDS = 1
RATE = 0.15
#: Parameters in one row of what tasks exchange.
SEGMENT = 1 << 14
_NONE = np.float32(-1e4)
#: Bytes of a rare word that choose its group.
GROUP_BYTES = 3
#: Words' counts are merged in a task when so many have gathered.
MERGE = 1 << 20
OUT = "doc_id long, n_tokens long, log_prob double, mean_log_prob double"


@dataclass
class Model:
    """Parameters; `before` has one row more than there are tokens, for places before the beginning; `after` and `bias` are filled up to whole classes."""

    before: np.ndarray
    place: np.ndarray
    after: np.ndarray
    bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    counts: np.ndarray

    @staticmethod
    def start(counts: np.ndarray, seed: int = 3) -> Model:
        """Unigram probabilities, and vectors near zero; tokens that don't occur have no probability."""
        rng = np.random.default_rng(seed)
        v = len(counts)
        padded = np.zeros(-(-v // MEMBERS) * MEMBERS)
        padded[:v] = counts
        of_class = padded.reshape(-1, MEMBERS).sum(1)
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-9)), _NONE).astype(np.float32)
        draw = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
        share = padded / np.maximum(np.repeat(of_class, MEMBERS), 1)
        return Model(draw(v + 1, WIDTH), np.ones((CONTEXT, WIDTH), np.float32), draw(len(padded), WIDTH), log(share), draw(len(of_class), WIDTH), log(of_class / max(1, of_class.sum())), padded)

    @property
    def size(self) -> int:
        return len(self.before) - 1

    def parts(self) -> list[np.ndarray]:
        return [self.before, self.place, self.after, self.bias, self.classes, self.class_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float32)

    def with_flat(self, flat: np.ndarray) -> Model:
        at, out = 0, []
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(*out, self.counts)

    def predicted(self, context: np.ndarray) -> np.ndarray:
        """Predicted vectors of contexts (n x CONTEXT, the nearest first)."""
        return sum(self.before[context[:, k]] * self.place[k] for k in range(CONTEXT))

    def log_probs(self, context: np.ndarray, token: np.ndarray, block: int = 512) -> np.ndarray:
        """Log-probabilities, normalised over the vocabulary by products of matrices."""
        out = np.empty(len(token), np.float32)
        order = np.argsort(token // MEMBERS, kind="stable")
        for a in range(0, len(order), 1 << 18):
            rows = order[a : a + (1 << 18)]
            q, t = self.predicted(context[rows]), token[rows]
            c = t // MEMBERS
            p = np.empty(len(rows), np.float32)
            for i in range(0, len(rows), block):
                p[i : i + block] = _log_softmax(q[i : i + block], self.classes, self.class_bias, c[i : i + block])
            starts = np.concatenate((np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))), [len(c)]))
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = slice(int(c[lo]) * MEMBERS, (int(c[lo]) + 1) * MEMBERS)
                for i in range(lo, hi, block):
                    j = min(i + block, hi)
                    p[i:j] += _log_softmax(q[i:j], self.after[own], self.bias[own], t[i:j] - own.start)
            out[rows] = p
        return out


def _log_softmax(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of the scores of vectors for each row, the logarithm of the softmax at `of`."""
    s = np.concatenate((q, np.ones((len(q), 1), np.float32)), 1) @ np.concatenate((vectors, bias[:, None]), 1).T
    own = s[np.arange(len(s)), of]
    with np.errstate(over="ignore", divide="ignore"):
        total = np.log(np.exp(s) @ np.ones(s.shape[1], np.float32))
    far = np.flatnonzero(~np.isfinite(total))
    if len(far):
        total[far] = np.logaddexp.reduce(s[far].astype(np.float64), axis=1)
    return own - total


def contexts(tokens: np.ndarray, offsets: np.ndarray, v: int) -> np.ndarray:
    """n x CONTEXT tokens before each, the nearest first; v where the text has none."""
    out = np.full((len(tokens), CONTEXT), v, np.int64)
    place = np.arange(len(tokens)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(CONTEXT):
        some = np.flatnonzero(place > k)
        out[some, k] = tokens[some - k - 1]
    return out


def _rows_sum(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, sums of the gradient's rows by row number)."""
    order = np.argsort(rows.astype(np.uint16) if VOCABULARY < 1 << 16 else rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows[starts], np.add.reduceat(grad[order], starts, axis=0)


class Trainer:
    """Stochastic gradient steps of noise-contrastive estimation, with a rate for each parameter by its past gradients."""

    def __init__(self, model: Model, seed: int, rate: float = RATE) -> None:
        self.m = model.with_flat(model.flat())
        self.rng, self.rate, self.n = np.random.default_rng(seed), rate, 0
        self.past = [np.full(p.shape, 0.1, np.float32) for p in self.m.parts()]
        self.cdf = np.concatenate(([0.0], model.counts.cumsum()))
        of_class = model.counts.reshape(-1, MEMBERS).sum(1)
        self.class_cdf = of_class.cumsum()
        start = Model.start(model.counts[: model.size])
        self.log_noise, self.log_class_noise = start.bias + np.float32(np.log(SIBLINGS)), start.class_bias + np.float32(np.log(NOISE))

    def learn(self, context: np.ndarray, token: np.ndarray) -> None:
        """One step a batch; the first batches are small, so that small corpora make many steps too."""
        a = 0
        while a < len(token):
            b = min(len(token), a + (BATCH if self.n + a >= START_TOKENS else START_BATCH))
            self._step(context[a:b], token[a:b])
            a = b
        self.n += len(token)

    def _step(self, context: np.ndarray, token: np.ndarray) -> None:
        m, n = self.m, len(token)
        order = np.argsort((token // MEMBERS).astype(np.uint16), kind="stable")
        context, token = context[order], token[order]
        c = token // MEMBERS
        starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        vectors = [m.before[context[:, k]] for k in range(CONTEXT)]
        q = sum(x * m.place[k] for k, x in enumerate(vectors))
        # classes: the noise is the same for all tokens of the batch
        noise = np.minimum(np.searchsorted(self.class_cdf, self.rng.random(NOISE) * self.class_cdf[-1], "right"), len(m.classes) - 1)
        own, other = m.classes[c], m.classes[noise]
        up = 1 - _logistic(np.einsum("ij,ij->i", q, own) + (m.class_bias - self.log_class_noise)[c])
        down = -_logistic(q @ other.T + (m.class_bias - self.log_class_noise)[noise])
        dq = up[:, None] * own + down @ other
        g = np.zeros_like(m.classes)
        g[c[starts]] = np.add.reduceat(up[:, None] * q, starts, axis=0)
        np.add.at(g, noise, down.T @ q)
        class_bias = np.bincount(c, up, len(m.classes))
        np.add.at(class_bias, noise, down.sum(0))
        # tokens of the class: the noise is the same for all tokens of a class in the batch
        k = len(m.classes)
        lo = self.cdf[np.arange(k) * MEMBERS]
        drawn = np.searchsorted(self.cdf, lo + self.rng.random((SIBLINGS, k)) * (self.cdf[np.arange(1, k + 1) * MEMBERS] - lo), "right") - 1
        drawn = np.clip(drawn, np.arange(k) * MEMBERS, np.arange(k) * MEMBERS + MEMBERS - 1)
        rows, level = m.after[token], m.bias - self.log_noise
        pull = 1 - _logistic(np.einsum("ij,ij->i", q, rows) + level[token])
        dq += pull[:, None] * rows
        at, grads, pulls = [token], [pull[:, None] * q], [pull]
        for some in drawn:
            rows = m.after[some][c]
            pull = -_logistic(np.einsum("ij,ij->i", q, rows) + level[some][c])
            dq += pull[:, None] * rows
            at.append(some[c[starts]])
            grads.append(np.add.reduceat(pull[:, None] * q, starts, axis=0))
            pulls.append(np.add.reduceat(pull, starts))
        token_rows = _rows_sum(np.concatenate(at), np.concatenate((np.concatenate(grads), np.concatenate(pulls)[:, None]), 1))
        before_rows = _rows_sum(context.T.ravel(), np.concatenate([dq * m.place[k] for k in range(CONTEXT)]))
        places = np.stack([np.einsum("ij,ij->j", dq, x) for x in vectors])
        every = slice(None)
        for k, (at, x) in enumerate((before_rows, (every, places), (token_rows[0], token_rows[1][:, :-1]), (token_rows[0], token_rows[1][:, -1]), (every, g), (every, class_bias.astype(np.float32)))):
            p, past = m.parts()[k], self.past[k]
            x = x * np.float32(1 / np.sqrt(n))
            now = past[at] + x * x
            past[at] = now
            p[at] += np.float32(self.rate) * x / np.sqrt(now)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, last one, hashes of their words, groups by the words' first bytes, offsets by text)."""
    data, offsets = tv.flat(pc.utf8_lower(texts))
    for i, j in tv.pieces(offsets):
        own = data[offsets[i] : offsets[j]]
        h, at, doc = tv.words(own, offsets[i : j + 1] - offsets[i])
        group = np.zeros(len(h), np.uint64)
        if len(h):
            length = np.add.reduceat(tv.WORD_BYTES[own].view(np.int8), at, dtype=np.int64)
            for k in range(GROUP_BYTES):
                group = (group << np.uint64(8)) | np.where(length > k, own[np.minimum(at + k, len(own) - 1)], 0).astype(np.uint64)
        yield i, j, h, (tv.mix(group + np.uint64(1)) % np.uint64(RARE)).astype(np.int64), tv.per_text(doc, j - i)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, groups, counts, size = [], [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, g, n = map(np.concatenate, (hashes, groups, counts))
        order = np.argsort(h)
        h, g, n = h[order], g[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], g[first], np.add.reduceat(n, first)

    def out(h: np.ndarray, g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.astype(np.int32)), pa.array(n)], ["word", "group", "n"])

    for batch in tv.parts(batches):
        for _, _, h, g, _ in _hashes(batch.column("text")):
            if len(h):
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                hashes.append(u)
                groups.append(g[first])
                counts.append(n)
                size += len(u)
        if size > MERGE:
            one = merged()
            hashes, groups, counts = ([x] for x in one)
            size = len(one[0])
            if size > MERGE // 2:
                yield out(*one)
                hashes, groups, counts, size = [], [], [], 0
    if hashes:
        yield out(*merged())


@dataclass
class Words:
    """Frequent words by hash, sorted, and their tokens; others have the token of their group."""

    hashes: np.ndarray
    tokens: np.ndarray

    def encode(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        rare = group + len(self.hashes)
        if not len(self.hashes):
            return rare
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.tokens[at], rare)


def word_counts(texts: DataFrame) -> tuple[DataFrame, str]:
    """(word, group, n) for every word of the corpus by hash, and the folder of that table."""
    return cut(texts.mapInArrow(_count_rows, "word long, group int, n long").groupBy("word").agg(F.min("group").alias("group"), F.sum("n").alias("n")), "words")


def vocabulary(texts: DataFrame) -> tuple[Words, np.ndarray]:
    """The words that have tokens of their own, and every token's count; all words of the corpus are counted."""
    counted, path = word_counts(texts)
    out = _tokens_from(counted)
    delete(texts.sparkSession, path)
    return out


def _tokens_from(counted: DataFrame) -> tuple[Words, np.ndarray]:
    top = counted.orderBy(F.desc("n"), "word").limit(VOCABULARY - RARE).toArrow()
    word, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(word)
    words = Words(word[order], order)
    rest = np.zeros(RARE, np.int64)
    if len(word) == VOCABULARY - RARE:  # else there are no others
        last, at = int(n[-1]), int(top["word"].to_numpy()[-1])
        others = counted.where((F.col("n") < last) | ((F.col("n") == last) & (F.col("word") > at)))
        groups = others.groupBy("group").agg(F.sum("n").alias("n")).toArrow()
        rest[groups["group"].to_numpy()] = groups["n"].to_numpy()
    return words, np.concatenate([n, rest])


@dataclass
class Shares:
    """Logarithms of words' shares of their classes, by hash, sorted; words with a token of their own have 0."""

    hashes: np.ndarray
    logs: np.ndarray

    def split(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the logarithm of each word's share, 0 where it isn't here; whether it is here)."""
        if not len(self.hashes):
            return np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        there = self.hashes[at] == h
        return np.where(there, self.logs[at], 0.0), there


def frequent_shares(counted: DataFrame, words: Words, counts: np.ndarray, most: int = BROADCAST_ROWS) -> Shares:
    """The shares of the words of the highest counts, all words of a count or none, `most` of them at most; and of those with tokens."""
    sizes = counted.groupBy("n").agg(F.count("*").alias("words")).toArrow()
    n, size = sizes["n"].to_numpy(), sizes["words"].to_numpy()
    order = np.argsort(-n)
    fit = n[order][size[order].cumsum() <= most]
    word, n, group = words.hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(fit):
        some = counted.where(F.col("n") >= int(fit[-1])).toArrow()
        word, n = some["word"].to_numpy().view(np.uint64), some["n"].to_numpy()
        own = np.isin(word, words.hashes)
        group = some["group"].to_numpy().astype(np.int64)[~own]
        word, n = np.concatenate([words.hashes, word[~own]]), n[~own]
    head = len(words.hashes)
    logs = np.concatenate([np.zeros(head), np.log(n / counts[head + group])])
    order = np.argsort(word)
    return Shares(word[order], logs[order])


def _token_rows(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.parts(batches):
            texts = batch.column("text")
            values, ends = [], [np.zeros(1, np.int64)]
            size = 0
            for _, _, h, group, at in _hashes(texts):
                values.append(shared.value.encode(h, group).astype(np.int16))
                ends.append(at[1:] + size)
                size += len(h)
            flat, offsets = np.concatenate([*values, np.zeros(0, np.int16)]), np.concatenate(ends) * 2
            kinds = pa.array(offsets.astype(np.int64), pa.int64())
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, kinds.buffers()[1], pa.py_buffer(flat.tobytes())])
            packed = pc.if_else(pc.is_valid(texts), packed, pa.scalar(None, pa.large_binary())).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed], ["doc_id", "tokens"])

    return rows


def _tokens_of(column: pa.Array, limit: int = 400_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last one, tokens, offsets) of whole texts of about so many tokens."""
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    flat = np.frombuffer(data, np.int16) if data is not None and data.size else np.zeros(0, np.int16)
    for i, j in tv.pieces(offsets, limit):
        yield i, j, flat[offsets[i] : offsets[j]].astype(np.int64), offsets[i : j + 1] - offsets[i]


def _train_rows(shared, number: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        trainer = Trainer(shared.value, 1000 * number + part, RATE / number)
        for batch in batches:
            for _, _, tokens, offsets in _tokens_of(batch.column("tokens")):
                trainer.learn(contexts(tokens, offsets, shared.value.size), tokens)
        if trainer.n:
            flat = trainer.m.flat()
            for k in range(0, len(flat), SEGMENT):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k // SEGMENT], pa.int32()), pa.array([trainer.n]), pa.array([flat[k : k + SEGMENT].tobytes()])], ["part", "segment", "n", "flat"])

    return rows


def _mean_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by segment, the mean of each segment's parameters, weighted, and the weight."""
    total, weight, now = None, 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([now], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()])], ["part", "segment", "n", "flat"])

    for batch in batches:
        for k, n, flat in zip(batch.column("segment").to_pylist(), batch.column("n").to_pylist(), batch.column("flat"), strict=True):
            if total is not None and k != now:
                yield out()
                total, weight = None, 0
            x = np.frombuffer(flat.as_buffer(), np.float32) * np.float64(n)
            total, weight, now = x if total is None else total + x, weight + n, k
    if total is not None:
        yield out()


def train(tokens: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model from (tokens binary) rows: every round trains on all of them."""
    spark, model, kind = tokens.sparkSession, Model.start(counts), "part int, segment int, n long, flat binary"
    for number in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(model)
        done, path = cut(tokens.select("tokens").where("tokens is not null").mapInArrow(_train_rows(shared, number), kind), "trained")
        # summed in two steps, so no task reads more than a few hundredths of what the tasks wrote
        some = done.withColumn("part", F.col("part") % 16).repartition("segment", "part").sortWithinPartitions("part", "segment", "n").mapInArrow(_mean_rows, kind)
        whole = some.repartition("segment").sortWithinPartitions("segment", "n").mapInArrow(_mean_rows, kind).toArrow().sort_by("segment")
        delete(spark, path)
        if whole.num_rows:
            model = model.with_flat(np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in whole["flat"]]))
    return model


def _score_rows(shared, more: tuple[str, ...] = ()):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j, tokens, offsets in _tokens_of(batch.column("tokens")):
                p = model.log_probs(contexts(tokens, offsets, model.size), tokens)
                sums = np.concatenate(([0.0], p.cumsum(dtype=np.float64)))
                n[i:j], total[i:j] = np.diff(offsets), sums[offsets[1:]] - sums[offsets[:-1]]
            there = batch.column("tokens").is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, mask=~there), pa.array(total, mask=~there), pa.array(total / np.maximum(n, 1), mask=~there | (n == 0)), *map(batch.column, more)],
                [*(x.split()[0] for x in OUT.split(", ")), *more],
            )

    return rows


def encoded(docs: DataFrame, words: Words) -> DataFrame:
    """(doc_id, tokens): each text's tokens as 16-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    return ids_and_texts(docs).mapInArrow(_token_rows(shared), "doc_id long, tokens binary")


def scores(tokens: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of (doc_id, tokens) rows."""
    return tokens.mapInArrow(_score_rows(tokens.sparkSession.sparkContext.broadcast(model)), OUT)


def _shared_rows(shared, shares):
    """Token rows with the sum of the logarithms of the shares that are known here, and the words whose shares are not."""
    encode = _token_rows(shared)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.parts(batches):
            known, rest, ends, size = [], [], [np.zeros(1, np.int64)], 0
            for _, _, h, _, at in _hashes(batch.column("text")):
                log, there = shares.value.split(h)
                sums = np.concatenate(([0.0], log.cumsum()))
                known.append(sums[at[1:]] - sums[at[:-1]])
                rest.append(h[~there])
                ends.append(tv.spans(~there)[at[1:]] + size)
                size += len(rest[-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate([*rest, np.zeros(0, np.uint64)]).view(np.int64)))
            tokens = pa.Table.from_batches(list(encode(iter([batch])))).column("tokens").combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), tokens, pa.array(np.concatenate([*known, np.zeros(0)])), lists], ["row", "doc_id", "tokens", "known", "rest"])

    return rows


def train_and_score(docs: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A model of all the documents, and each one's log-probability under it."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = ids_and_texts(docs)
    counted, _ = word_counts(texts.select("text").where("text is not null"))
    words, counts = _tokens_from(counted)
    shared, shares = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(frequent_shares(counted, words, counts, most))
    # the id only has to tell the rows that are written apart
    rows = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_shared_rows(shared, shares), "row long, doc_id long, tokens binary, known double, rest array<long>")
    tokens, _ = cut(rows, "tokens")
    totals = spark.createDataFrame([(k, int(n)) for k, n in enumerate(counts[len(words.hashes) :]) if n], "group int, total long")
    share = counted.join(F.broadcast(totals), "group").select("word", F.log(F.col("n") / F.col("total")).alias("log"))
    looked_up = tokens.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    tail = looked_up.join(share, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("tail"))
    model = train(tokens, counts)
    by_class = tokens.select("row", "doc_id", "tokens", "known").mapInArrow(_score_rows(spark.sparkContext.broadcast(model), ("row", "known")), OUT + ", row long, known double")
    log_prob = F.col("log_prob") + F.col("known") + F.coalesce("tail", F.lit(0.0))
    return by_class.join(tail, "row", "left").select("doc_id", "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob"))
