"""Distributed union-find: connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import cut, delete


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) for each node with an edge that isn't the least of its component, and their number.

    `edges` has two long columns a, b. Nulls and loops are dropped. Each round is written to the shared
    folder, so the lineage stays short and a lost executor repeats one round at most. Rounds needed grow
    with the logarithm of the number of nodes.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur, path = cut(e, "edges")
    state = None
    while True:
        nxt, new = cut(_small(_large(cur)), "edges")
        delete(edges.sparkSession, path)
        cur, path = nxt, new
        row = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if tuple(row) == state or row[0] == 0:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")), row[0]
        state = tuple(row)
