"""Operators on document trees and on operation lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import schema as S


def node(node_type: str | Column, id_: Column, title: Column, description: Column | None = None, content: Column | None = None, metadata: Column | None = None) -> list[Column]:
    """The columns of a node with their defaults; doc_key and path are the caller's."""
    kind = node_type if isinstance(node_type, Column) else F.lit(node_type)
    return [
        kind.alias("type"), id_.alias("id"), title.alias("title"), (F.lit("") if description is None else F.coalesce(description, F.lit(""))).alias("description"),
        (F.array() if content is None else F.coalesce(content, F.array())).cast(S.NODE["content"].dataType).alias("content"),
        (F.create_map() if metadata is None else metadata).cast(S.TEXT_MAP).alias("metadata"),
    ]


def content_block(kind: str | Column, content: Column, language: Column | None = None, annotations: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), (none if language is None else language).cast("string").alias("language"),
        content.alias("content"), (none if annotations is None else annotations).cast(S.TEXT_MAP).alias("annotations"),
    )


def is_node(v: Column) -> Column:
    """Whether a variant has what makes a node: type, id, title, and a list of children."""
    has = lambda key: F.try_variant_get(v, f"$.{key}", "variant").isNotNull()
    return has("type") & has("id") & has("title") & F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.children", "variant")).startswith("ARRAY"), F.lit(False))


def is_example(v: Column) -> Column:
    return F.try_variant_get(v, "$.id", "variant").isNotNull() & F.try_variant_get(v, "$.name", "variant").isNotNull() & F.try_variant_get(v, "$.code", "variant").isNotNull()


def is_operation(v: Column) -> Column:
    return F.try_variant_get(v, "$.id", "variant").isNotNull() & F.try_variant_get(v, "$.title", "variant").isNotNull() & F.try_variant_get(v, "$.examples", "variant").isNotNull()


def in_order(nodes: DataFrame) -> DataFrame:
    """Nodes as a walk meets them, parents before children, with their depth."""
    return nodes.withColumn("depth", F.size("path")).orderBy("doc_key", "path")


def visit(nodes: DataFrame, per_node: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A visitor: any transformation of the node table with its depth."""
    return nodes.withColumn("depth", F.size("path")).transform(per_node)


def number_children(rows: DataFrame, key: str, parent: str, order: Column, levels: int) -> DataFrame:
    """Paths for rows that name their parent: sibling ranks, then one join for each level."""
    from pyspark.sql import Window

    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(parent).orderBy(order)))
    done = ranked.where(F.col(parent).isNull()).withColumn("path", F.array("__n"))
    out = done
    for _ in range(levels - 1):
        up = done.select(F.col(key).alias("__up"), F.col("path").alias("__path"))
        done = ranked.join(up, F.col(parent) == F.col("__up")).withColumn("path", F.concat("__path", F.array("__n"))).drop("__up", "__path")
        out = out.unionByName(done)
    return out.drop("__n")


def find_by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("type") == node_type).orderBy("doc_key", "path")


def count_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_key").agg(F.count("*").alias("n"))


# Operation lists: (pos, id, op) rows, where a repeated id means its last row in lookups.


def last_by_id(ops: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    rest = [c for c in ops.columns if c != key]
    return ops.groupBy(key).agg(F.max_by(F.struct(*rest), pos).alias("__r")).select(key, "__r.*")


def by_id(ops: DataFrame, wanted: str, first: bool = False) -> DataFrame:
    """The row of an id: the last one as an index has it, or the first as a scan finds it."""
    rest = [c for c in ops.columns if c != "id"]
    pick = F.min_by if first else F.max_by
    return ops.where(F.col("id") == wanted).groupBy("id").agg(pick(F.struct(*rest), "pos").alias("__r")).select("id", "__r.*")


def by_ids(ops: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows for each (request_pos, id) wanted, in that order; unknown ids are skipped and repeats kept."""
    return wanted.join(last_by_id(ops), "id").orderBy("request_pos")


def has(ops: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, found) for each id wanted."""
    known = ops.select("id").distinct().withColumn("found", F.lit(True))
    return wanted.join(known, "id", "left").select(*wanted.columns, F.coalesce("found", F.lit(False)).alias("found"))


def spotlight(examples: Column) -> Column:
    return F.filter(examples, lambda e: e["isSpotlight"])


def example_count(examples: Column) -> Column:
    return F.coalesce(F.size(examples), F.lit(0))


def total_examples(ops: DataFrame) -> DataFrame:
    """One row; repeated operations count each time."""
    return ops.agg(F.coalesce(F.sum(example_count(F.col("op.examples"))), F.lit(0)).cast("long").alias("total"))


def grouped(long: DataFrame) -> DataFrame:
    """(category, operations): (category, cat_pos, op_pos, op) rows as ordered lists."""
    return long.groupBy("category").agg(F.min("cat_pos").alias("cat_pos"), F.array_sort(F.collect_list(F.struct("op_pos", "op")), lambda x, y: x["op_pos"] - y["op_pos"]).alias("l")).select("category", "cat_pos", F.transform("l", lambda x: x["op"]).alias("operations"))


def of_category(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """The list of each wanted category, empty where there is none."""
    kind = groups.schema["operations"].dataType
    return wanted.join(groups, "category", "left").select("category", F.coalesce("operations", F.array().cast(kind)).alias("operations"))
