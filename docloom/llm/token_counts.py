"""Token counts through a digest cache.

The cache is a Parquet table in a folder for each tokenizer version: (digest, n_tokens), where the digest is
the SHA-256 of the normalised content and the version that of the vocabulary file, the pattern that cuts
texts and the rules of normalisation. Counting joins the digests of the texts to the stored counts, encodes
each distinct text that has none once, and appends the new counts, so a later run pays for new texts only.

Texts stay where they are: only digests are exchanged, and a text moves only if the digests that must be
left out (stored, or repeated) are too many to broadcast. Normalised content has line feeds for all line
ends and no white space at its end.

Defined results: a null text has null counts, an empty one 0 tokens. Rows repeat as often as they come, and
equal texts share one cache row whatever their doc_id, null ids too. Ids that are no whole numbers are null. Names of special tokens are ordinary
text. Where two writers have stored one digest, the counts agree and one is read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import cut, ids_and_texts, maybe_broadcast, small_batches

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_RULES = "crlf-to-lf,no-trailing-space,1"
_CACHE = "digest binary, n_tokens int"
_known: dict[str, tiktoken.Encoding] = {}


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(hashlib.sha256(f.read()).digest() + PATTERN.encode() + _RULES.encode()).hexdigest()


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of this file, read once in each worker."""
    if path not in _known:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _known[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _known[path]


def normalised(text: Column) -> Column:
    one = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.rtrim(one, F.lit(" \t\n"))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _encode(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        seen: set[bytes] = set()  # equal texts of one task that ids can't tell apart
        for batch in batches:
            digests, counts = [], []
            for d, t in zip(batch.column("digest").to_pylist(), batch.column("body"), strict=True):
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    counts.append(len(enc.encode_ordinary(t.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int32())], ["digest", "n_tokens"])

    return rows


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of a tokenizer version, each digest once."""
    try:
        found = spark.read.schema(_CACHE).parquet(f"{cache}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CACHE)
    return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def counts(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """(doc_id, digest, n_bytes, n_tokens, was_stored) of every row; `cache` is a folder that all executors share."""
    small_batches(docs.sparkSession)
    spark, version = docs.sparkSession, version_of(path)
    rows = ids_and_texts(docs).select("doc_id", normalised(F.col("text")).alias("body"))
    keyed = rows.select("doc_id", digest_of(F.col("body")).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"))
    keys, _ = cut(keyed, "digests")
    some = keys.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    before, _ = cut(some.select("digest").join(stored(spark, cache, version), "digest").withColumn("was_stored", F.lit(True)), "stored")
    known, _ = cut(some.join(before.select("digest", "was_stored"), "digest", "left").where("n > 1 or was_stored").select("digest", "first", "was_stored"), "known-digests")
    texts = rows.where("body is not null").withColumn("digest", digest_of(F.col("body")))
    met = texts.join(maybe_broadcast(known, known.count(), 48), "digest", "left")
    # a digest of one row needs no representative; of a repeated one the rows of the least id encode it
    todo = met.where("was_stored is null and (first is null or doc_id <=> first)").select("digest", "body")
    new = todo.mapInArrow(_encode(path), _CACHE).dropDuplicates(["digest"])
    fresh, _ = cut(new, "new-counts")
    fresh.write.mode("append").parquet(f"{cache}/version={version}")
    all_counts = before.unionByName(fresh.withColumn("was_stored", F.lit(False)))
    return keys.join(all_counts, "digest", "left").select("doc_id", F.hex("digest").alias("digest"), "n_bytes", "n_tokens", "was_stored")
