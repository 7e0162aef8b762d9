"""API specifications: decoding, statistics, and conversion to document trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import schema as S
from docloom.functions import text as X
from docloom.functions.yaml12 import spec_frames


def decode(texts: DataFrame) -> DataFrame:
    """Specifications of (path, text) rows: path, info, operations, error; a bad text gives its error and nulls."""
    raw = texts.select("path", "text").mapInPandas(spec_frames, "path string, spec string, error string")
    body = S.SPEC["info"].dataType.simpleString(), S.SPEC["operations"].dataType.simpleString()
    parsed = raw.withColumn("s", F.from_json("spec", f"info {body[0]}, operations {body[1]}"))
    return parsed.select("path", "s.info", "s.operations", "error")


def valid(specs: DataFrame) -> DataFrame:
    """(path, valid): whether a specification was decoded and no required field is missing."""
    ops = F.forall("operations", lambda o: o["id"].isNotNull() & o["title"].isNotNull() & F.forall(o["examples"], lambda e: e["id"].isNotNull() & e["name"].isNotNull()))
    good = F.col("error").isNull() & F.col("info.id").isNotNull() & F.col("info.title").isNotNull() & ops
    return specs.select("path", F.coalesce(good, F.lit(False)).alias("valid"))


def stats(specs: DataFrame) -> DataFrame:
    """Operations, examples and examples per operation (0 without operations) of each specification."""
    n = F.size("operations")
    total = F.aggregate("operations", F.lit(0), lambda a, o: a + F.size(o["examples"]))
    return specs.select("path", n.alias("operationCount"), total.alias("exampleCount"), F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0)).alias("avgExamplesPerOperation"))


def operations(specs: DataFrame) -> DataFrame:
    """(path, pos, op) of every operation in order, repeated ids included."""
    return specs.select("path", F.posexplode("operations").alias("pos", "op"))


def _block(kind: str, content: Column, language: Column | str | None = None, note: str | None = None) -> Column:
    lang = language if isinstance(language, Column) else F.lit(language).cast("string")
    extra = F.create_map(F.lit("type"), F.lit(note)) if note else F.lit(None)
    whole = F.struct(F.lit(kind).alias("type"), lang.alias("language"), content.alias("content"), extra.cast(S.TEXT_MAP).alias("annotations"))
    return F.when(F.length(content) > 0, whole)


def operation_blocks(op: Column) -> Column:
    return F.array_compact(F.array(_block(S.PROSE, op["description"]), _block(S.PROSE, op["notes"])))


def example_blocks(ex: Column) -> Column:
    parts = _block(S.PROSE, ex["description"]), _block(S.CODE, ex["code"], X.infer_language(ex["code"])), _block(S.DATA, ex["dataSql"], "sql", "schema"), _block(S.DATA, ex["response"], "json", "response")
    return F.array_compact(F.array(*parts))


def _operation_nodes(placed: DataFrame) -> DataFrame:
    """Nodes of (doc_key, place, op): the operation and its examples."""
    op = F.col("op")
    own = placed.select(
        "doc_key", F.col("place").alias("path"), F.lit(S.OPERATION).alias("type"), op["id"].alias("id"), op["title"].alias("title"), op["description"].alias("description"),
        operation_blocks(op).alias("content"), F.create_map(F.lit("operationId"), op["id"], F.lit("notes"), op["notes"]).alias("metadata"),
    )
    ex = F.col("ex")
    items = placed.select("doc_key", "place", F.posexplode(op["examples"]).alias("k", "ex")).select(
        "doc_key", F.concat("place", F.array(F.col("k") + 1)).alias("path"), F.lit(S.ITEM).alias("type"), ex["id"].alias("id"), ex["name"].alias("title"), ex["description"].alias("description"),
        example_blocks(ex).alias("content"), F.create_map(F.lit("exampleId"), ex["id"], F.lit("isSpotlight"), ex["isSpotlight"].cast("string")).alias("metadata"),
    )
    return own.unionByName(items)


def _roots(specs: DataFrame) -> DataFrame:
    i = F.col("info")
    return specs.select(
        F.col("path").alias("doc_key"), F.array().cast("array<int>").alias("path"), F.lit(S.ROOT).alias("type"), i["id"].alias("id"), i["title"].alias("title"), i["description"].alias("description"),
        F.array().cast(S.NODE["content"].dataType).alias("content"),
        F.map_filter(F.create_map(F.lit("format"), F.lit(S.OPENREF), F.lit("sdk"), i["id"], F.lit("title"), i["title"], F.lit("specUrl"), i["specUrl"]), lambda k, v: v.isNotNull()).alias("metadata"),
    )


def document_nodes(specs: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """The trees of decoded specifications.

    With `categories` (category, cat_pos, op_pos, op_id) an operation stands under each category that lists
    it and uncategorised ones are left out; without, all stand in their own order, repeated ids too.
    """
    good = specs.where("error is null")
    if categories is None:
        placed = operations(good).select(F.col("path").alias("doc_key"), F.array(F.col("pos") + 1).alias("place"), "op")
        return _roots(good).unionByName(_operation_nodes(placed))
    met = categorize_multi(operations(good).select("path", "pos", F.col("op.id").alias("op_id"), "op"), categories)
    heads = met.groupBy("path", "cat_no", "category").agg(F.first("category").alias("t")).select(
        F.col("path").alias("doc_key"), F.array("cat_no").alias("path"), F.lit(S.CATEGORY).alias("type"), F.col("category").alias("id"), F.col("t").alias("title"), F.lit("").alias("description"),
        F.array().cast(S.NODE["content"].dataType).alias("content"), F.create_map().cast(S.TEXT_MAP).alias("metadata"),
    )
    placed = met.select(F.col("path").alias("doc_key"), F.array("cat_no", "op_no").alias("place"), "op")
    return _roots(good).unionByName(heads).unionByName(_operation_nodes(placed))


def categorize_multi(ops: DataFrame, categories: DataFrame) -> DataFrame:
    """Operations under each category that lists them: `ops` has path, pos, op_id and op; the last of a repeated id counts.

    Adds cat_no and op_no, dense numbers among what was found.
    """
    from pyspark.sql import Window

    last = ops.groupBy("path", "op_id").agg(F.max_by("op", "pos").alias("op"))
    met = last.join(categories, "op_id")
    by = Window.partitionBy("path")
    return met.select(
        "*", F.dense_rank().over(by.orderBy("cat_pos")).alias("cat_no"), F.row_number().over(Window.partitionBy("path", "cat_pos").orderBy("op_pos")).alias("op_no")
    )
