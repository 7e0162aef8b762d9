"""Assignment of operations to categories where the first category that lists one takes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_match(ops: DataFrame, categories: DataFrame) -> DataFrame:
    """Operations with the first category (in file order) that lists them.

    `ops` has op_id, pos and op, of which the last row of an id counts; `categories` has category, cat_pos,
    op_pos and op_id. Adds op_no, the number within the category.
    """
    last = ops.groupBy("op_id").agg(F.max_by("op", "pos").alias("op"))
    took = categories.groupBy("op_id").agg(F.min(F.struct("cat_pos", "op_pos", "category")).alias("c"))
    met = last.join(took, "op_id").select("op_id", "op", "c.category", "c.cat_pos", "c.op_pos")
    return met.withColumn("op_no", F.row_number().over(Window.partitionBy("cat_pos").orderBy("op_pos")))


def uncategorized(ops: DataFrame, categories: DataFrame) -> DataFrame:
    """The ids that no category lists, each once."""
    return ops.select("op_id").distinct().join(categories.select("op_id"), "op_id", "left_anti")
