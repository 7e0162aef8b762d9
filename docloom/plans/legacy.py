"""Renderer of specifications by category, with flat numbers in module files and nested ones in the full file.

Content is (category, cat_no, op_no, op) rows; every text is put together by ordered aggregation, so one
category or one specification is one group and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

GAP = "\n\n"


def _nonempty(c: Column, *parts: Column | str) -> Column:
    return F.when(F.length(c) > 0, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).otherwise("")


def example_text(ex: Column, mark: str, number: Column) -> Column:
    """One example under its heading; the data and the response need code to be shown."""
    note = lambda head, body: _nonempty(body, f"\n// {head}\n/*\n", X.strip_fences(body), "\n*/\n")
    code = _nonempty(ex["code"], ex["code"], "\n", note("Data Source", ex["dataSql"]), note("Response", ex["response"]), "\n")
    return F.concat(F.lit(mark + " "), number, F.lit(". "), ex["name"], F.lit(GAP), code, _nonempty(ex["description"], "\n// Note: ", ex["description"], "\n"))


def operation_text(op: Column, mark: str, number: Column) -> Column:
    """One operation with its examples, whose headings are a level deeper."""
    examples = F.transform(op["examples"], lambda ex, i: example_text(ex, mark + "#", F.concat(number, F.lit("."), (i + 1).cast("string"))))
    return F.concat(F.lit(mark + " "), number, F.lit(". "), op["title"], F.lit(GAP), _nonempty(op["description"], op["description"], GAP), _nonempty(op["notes"], op["notes"], GAP), F.array_join(examples, ""))


def _joined(order: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")


def system_line(prompt: Column) -> Column:
    return F.concat(F.lit("<SYSTEM>"), prompt, F.lit("</SYSTEM>"), F.lit(GAP))


def modules(met: DataFrame, categories: DataFrame, display: Column) -> DataFrame:
    """(category, content): a text for each category that got operations."""
    texts = met.withColumn("t", operation_text(F.col("op"), "#", F.col("op_no").cast("string"))).groupBy("category").agg(_joined("op_no", "t").alias("body"))
    head = F.concat(system_line(X.first_replaced(F.col("systemPrompt"), "{sdk_name}", display)), F.lit("# "), display, F.lit(" "), F.col("title"), F.lit(" Documentation" + GAP), F.col("description"), F.lit(GAP))
    return texts.join(categories.select("category", "title", "description", "systemPrompt"), "category").select("category", F.concat(head, "body").alias("content"))


def full_header(display: Column, sdk: Column, version: Column, spec_path: Column, date: Column) -> Column:
    return F.concat(
        system_line(F.concat(F.lit("This is the complete developer documentation for "), display, F.lit("."))),
        F.lit("<!-- Generated from: "), spec_path, F.lit(" -->\n<!-- SDK: "), sdk, F.lit(", Version: "), version, F.lit(", Generated: "), date, F.lit(" -->" + GAP),
        F.lit("# "), display, F.lit(" Reference" + GAP), F.lit("Complete reference for "), display, F.lit(" covering all modules." + GAP),
    )


def numbered(met: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds cat_no: the dense number of the categories that got operations, by `order`, then file order."""
    used = met.select("category").distinct().join(categories.select("category", "title", "description", "systemPrompt", "order", F.col("cat_pos").alias("__pos")).distinct(), "category")
    used = used.withColumn("cat_no", F.row_number().over(Window.orderBy("order", "__pos"))).drop("order", "__pos")
    return met.drop("cat_pos").join(F.broadcast(used), "category")


def full(met: DataFrame, categories: DataFrame, header: Column, display: Column) -> DataFrame:
    """(content,): one text of all categories. A prompt of several lines leaks all but its first one and the next."""
    n = F.col("cat_no").cast("string")
    rows = numbered(met, categories)
    rows = rows.withColumn("t", operation_text(F.col("op"), "###", F.concat(n, F.lit("."), F.col("op_no").cast("string"))))
    prompt = X.first_replaced(F.col("systemPrompt"), "{sdk_name}", display)
    head = F.concat(system_line(prompt), F.lit("## "), n, F.lit(". "), F.col("title"), F.lit(GAP), F.col("description"), F.lit(GAP))
    parts = rows.groupBy("cat_no").agg(F.first(head).alias("h"), _joined("op_no", "t").alias("body"))
    whole = F.concat("h", "body")
    # the first two lines go: the system line and the blank one after it, if the prompt has no line feed
    cut = F.array_join(F.slice(F.split(whole, "\n", -1), 3, 2_000_000_000), "\n")
    parts = parts.select("cat_no", F.concat(cut, F.lit(GAP)).alias("t"))
    return parts.groupBy().agg(F.concat(header, _joined("cat_no", "t")).alias("content"))


def files(met: DataFrame, categories: DataFrame, prefix: str, header: Column, display: Column) -> DataFrame:
    """(filename, content) of all module files and the full file; a category named full gives way to it."""
    module_rows = modules(met, categories, display).where("category <> 'full'").select(F.concat(F.lit(f"{prefix}-"), "category", F.lit("-llms.txt")).alias("filename"), "content")
    return module_rows.unionByName(full(met, categories, header, display).select(F.lit(f"{prefix}-full-llms.txt").alias("filename"), "content"))
