"""Renderer of document trees: numbered headings in document order, from node tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import schema as S
from docloom.functions import text as X

GAP = "\n\n"


@dataclass(frozen=True)
class Options:
    """What a rendering may set; empty strings count as not set. `date` is shown as it is."""

    date: str = ""
    filename_prefix: str | None = None
    title: str | None = None
    system_prompt: str | None = None
    include_metadata: bool = True

    @property
    def prefix(self) -> str:
        return self.filename_prefix or "documentation"


def heading(depth: Column) -> Column:
    return F.repeat(F.lit("#"), F.least(depth + 1, F.lit(4)))


def block_text(b: Column) -> Column:
    code = F.concat(F.lit("```"), X.or_default(b["language"], "text"), F.lit("\n"), b["content"], F.lit("\n```" + GAP))
    note = X.or_default(F.try_element_at(b["annotations"], F.lit("type")), "data")
    data = F.concat(F.lit("\n// "), note, F.lit("\n/*\n"), b["content"], F.lit("\n*/" + GAP))
    return F.when(b["type"] == S.PROSE, F.concat(b["content"], F.lit(GAP))).when(b["type"] == S.CODE, code).when(b["type"] == S.DATA, data).otherwise("")


def node_text(numbers: Column) -> Column:
    """Heading, description and blocks of a node; the root shows nothing of itself."""
    head = F.concat(heading(F.size(numbers)), F.lit(" "), F.array_join(numbers.cast("array<string>"), "."), F.lit(". "), F.col("title"), F.lit(GAP))
    description = F.when(F.length("description") > 0, F.concat("description", F.lit(GAP))).otherwise("")
    return F.when(F.col("type") == S.ROOT, "").otherwise(F.concat(head, description, F.array_join(F.transform("content", block_text), "")))


def _document() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "t"))), lambda x: x["t"]), "").alias("body")


def _top(column: str) -> Column:
    """The top node's value, in an aggregation or a window over its tree."""
    return F.first(F.when(F.size("path") == 0, F.col(column)), ignorenulls=True)


def _title(options: Options) -> Column:
    return F.lit(options.title) if options.title else F.col("top_title")


def header(options: Options) -> Column:
    """Of a row with top_title and top_metadata."""
    title = _title(options)
    prompt = F.lit(options.system_prompt) if options.system_prompt else F.concat(F.lit("This is the complete developer documentation for "), title, F.lit("."))
    kind = X.or_default(F.try_element_at(F.col("top_metadata"), F.lit("format")), "unknown")
    meta = F.concat(F.lit("<!-- Format: "), kind, F.lit(f", Generated: {options.date} -->" + GAP)) if options.include_metadata else F.lit("")
    return F.concat(F.lit("<SYSTEM>"), prompt, F.lit("</SYSTEM>" + GAP), meta, F.lit("# "), title, F.lit(GAP))


def full(nodes: DataFrame, options: Options) -> DataFrame:
    """(doc_key, filename, content) of each tree."""
    rows = nodes.select("doc_key", "path", "title", "metadata", node_text(F.col("path")).alias("t"))
    bodies = rows.groupBy("doc_key").agg(_document(), _top("title").alias("top_title"), _top("metadata").alias("top_metadata")).where("top_title is not null")
    return bodies.select("doc_key", F.lit(f"{options.prefix}-full-llms.txt").alias("filename"), F.concat(header(options), "body").alias("content"))


def modular(nodes: DataFrame, options: Options) -> DataFrame:
    """(doc_key, filename, content) of each category right under the top; of equal names the last one stays."""
    n = F.coalesce(F.get("path", F.lit(0)), F.lit(0))
    numbers = F.slice("path", F.lit(2), F.size("path"))
    head = F.when((F.col("type") == S.CATEGORY) & (F.size("path") == 1), F.struct("id", "title", "description"))
    rows = nodes.select("doc_key", n.alias("n"), "path", "title", head.alias("head"), F.when(F.size("path") > 0, node_text(numbers)).otherwise("").alias("t"))
    parts = rows.groupBy("doc_key", "n").agg(_document(), F.first("head", ignorenulls=True).alias("c"), _top("title").alias("own_title"))
    parts = parts.withColumn("top_title", F.max("own_title").over(Window.partitionBy("doc_key"))).where("c is not null and top_title is not null")
    title = _title(options)
    top = F.concat(
        F.lit("<SYSTEM>This is the developer documentation for "), title, F.lit(" - "), F.col("c.title"), F.lit(".</SYSTEM>" + GAP),
        F.lit("# "), title, F.lit(" "), F.col("c.title"), F.lit(" Documentation" + GAP),
        F.when(F.length("c.description") > 0, F.concat("c.description", F.lit(GAP))).otherwise(""),
    )
    named = parts.select("doc_key", "n", F.concat(F.lit(f"{options.prefix}-"), "c.id", F.lit("-llms.txt")).alias("filename"), F.concat(top, "body").alias("content"))
    return named.groupBy("doc_key", "filename").agg(F.max_by("content", "n").alias("content"))


def files(nodes: DataFrame, options: Options) -> DataFrame:
    """All files of each tree; a category whose id is full replaces the full file."""
    both = full(nodes, options).withColumn("k", F.lit(0)).unionByName(modular(nodes, options).withColumn("k", F.lit(1)))
    return both.groupBy("doc_key", "filename").agg(F.max_by("content", "k").alias("content"))
