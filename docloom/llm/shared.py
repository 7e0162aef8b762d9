"""Shared storage, checked broadcasts and sorted-run streaming for the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow side up to which a join may broadcast it, and bytes of its values in all.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20

#: Rows of a batch that goes to a Python worker: a batch of texts is held several times on both sides.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of this session, unless they are smaller yet."""
    if not 0 < int(spark.conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a temporary one.

    A cluster without that setting is an error, since no machine-local folder would survive there.
    """
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="docloom-"))
        atexit.register(lambda d=_own[0]: __import__("shutil").rmtree(d, ignore_errors=True))
    return f"file://{_own[0]}"


def path_in_shared(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_scopes: list[list[str]] = []


def cut(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """Write to the shared folder and read again: the lineage ends there, and a lost executor costs nothing.

    Within `scratch` the table goes at the end of the block, or with `keep` at the end of the block around it.
    """
    spark = df.sparkSession
    path = path_in_shared(spark, name)
    depth = len(_scopes) - 1 - keep
    if depth >= 0:
        _scopes[depth].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose tables are deleted when it ends; what it hands on must be written with `keep`."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def maybe_broadcast(df: DataFrame, rows: int, width: int = 16) -> DataFrame:
    """Broadcast a side of known rows, and of `width` bytes of values in the mean row, if it is small; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * width <= BROADCAST_BYTES else df


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): ids that are no whole numbers of 64 bits count as null."""
    return docs.select(whole_id(docs, "doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))


def whole_id(rows: DataFrame, name: str) -> Column:
    return rows[name].cast("string").try_cast("long") if rows.schema[name].dataType.typeName() == "string" else rows[name].cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to be none of the columns'."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _slots(n_bytes: int, h: np.ndarray) -> list[np.ndarray]:
    u, m = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(n_bytes * 8)
    u ^= u >> np.uint64(29)
    return [(u >> np.uint64(32)) % m, (u & np.uint64(0xFFFFFFFF)) * np.uint64(40503) % m, ((u >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) * np.uint64(60013) % m]


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be in a Bloom filter (its bytes)."""
    out = np.ones(len(h), np.uint8)
    for s in _slots(len(bits), h):
        out &= (bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
    return out.astype(bool)


def filter_of(ids: DataFrame, n: int, most: int = 16 << 20, bits: int = 16) -> np.ndarray:
    """A Bloom filter of about n values of the one column, `bits` for each, built by partial filters in the tasks.

    With more values than `most` bytes hold it keeps that size and lets more others pass: whatever it lets pass
    is joined exactly, so the rows are the same.
    """
    n_bytes, name = min(most, 1 << max(10, int(np.ceil(np.log2(max(1, n) * bits / 8))))), ids.columns[0]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(name).to_numpy() for b in batches]
        if parts and sum(map(len, parts)):
            bit = np.unique(np.concatenate([x for p in parts for x in _slots(n_bytes, p)]))
            at, starts = np.unique((bit >> np.uint64(6)).astype(np.int64), return_index=True)
            word = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), starts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word.view(np.int64))], ["at", "word"])

    got = ids.mapInArrow(partial, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(n_bytes // 8, np.int64)
    out[got["at"].to_numpy()] = got["word"].to_numpy()
    return out.view(np.uint8)


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold only whole runs of equal keys, with the runs' offsets, from a stream sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if keys[0] == keys[-1] and (last is None or keys[0] == last):
            held.append(batch)
            last = keys[-1]
            continue
        tail = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        held.append(batch.slice(0, tail))
        yield from _whole(held, key)
        held, last = [batch.slice(tail)], keys[-1]
    yield from _whole(held, key)


def _whole(held: list[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    held = [b for b in held if b.num_rows]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        yield table, np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def forest(size: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..size-1 whose edges `near` tells.

    near(some, others) -> bool matrix. Members already joined are never compared with each other, so a
    bucket of n copies costs about n comparisons, while members that match nothing are compared with all.
    """
    edges: list[tuple[int, int]] = []
    free = np.arange(size)
    while len(free) > 1:
        todo, free = free[:1], free[1:]
        while len(todo) and len(free):
            some, todo = todo[:block], todo[block:]
            hit = near(some, free)
            found = hit.any(0)
            if found.any():
                parents = some[hit[:, found].argmax(0)]
                edges += zip(parents.tolist(), free[found].tolist(), strict=True)
                todo = np.concatenate((todo, free[found]))
                free = free[~found]
    return edges
