"""Markdown texts to section tables and document trees.

The lexer reads each text once and tells, with every token, which heading it stands under and what the place
of a heading in the tree is. A tree is then one aggregation by (path, section), on one exchange by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import schema as S
from docloom.functions import text as X
from docloom.functions.blocks import lex_batches


def _spread(texts: DataFrame) -> DataFrame:
    """In as many tasks as an exchange has: where the texts come from one file or a broadcast join they lie in one, and the lexer's work is not told by their bytes."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def tokens(texts: DataFrame) -> DataFrame:
    """Block tokens of (path, text) rows; the text is cleaned first."""
    cleaned = _spread(texts).select("path", X.clean_docc(F.col("text")).alias("text"))
    return cleaned.mapInArrow(lex_batches, S.TOKEN)


def block_of(token_type: Column, text: Column, raw: Column, lang: Column) -> Column:
    """The content block of a token, null for white space."""
    body = F.when(token_type.isin("code", "paragraph", "text", "blockquote"), F.coalesce(text, F.lit(""))).otherwise(X.or_default(text, F.coalesce(raw, F.lit(""))))
    kept = token_type.isin("code", "paragraph", "text", "blockquote") | (F.length(X.trim(body)) > 0)
    none = F.lit(None).cast("string")
    code = token_type == "code"
    style = F.when(token_type == "blockquote", F.create_map(F.lit("style"), F.lit("blockquote"))).cast(S.TEXT_MAP)
    block = F.struct(F.when(code, S.CODE).otherwise(S.PROSE).alias("type"), F.when(code, X.or_default(lang, "text")).otherwise(none).alias("language"), body.alias("content"), style.alias("annotations"))
    return F.when((token_type != "space") & (token_type != "heading") & kept, block)


def sections(toks: DataFrame) -> DataFrame:
    """Headings as (path, pos, level, title, slug, parent_pos, place): place is the numbers from the top."""
    heads = toks.where("type = 'heading'")
    return heads.select("path", "pos", F.col("depth").alias("level"), F.col("text").alias("title"), X.slugify(F.col("text")).alias("slug"), F.col("parent").alias("parent_pos"), "place")


def section_blocks(toks: DataFrame) -> DataFrame:
    """(path, section_pos, pos, block): what stands before the first heading belongs to it; without headings nothing stays."""
    block = block_of(F.col("type"), F.col("text"), F.col("raw"), F.col("lang"))
    return toks.select("path", F.col("section").alias("section_pos"), "pos", block.alias("block")).where("section_pos is not null and block is not null")


def node_type(level: Column, map_h2: bool) -> Column:
    out = F.when(level == 3, S.OPERATION).when(level >= 4, S.ITEM)
    return (out.when(level == 2, S.CATEGORY) if map_h2 else out).otherwise(S.SECTION)


def titles(toks: DataFrame) -> DataFrame:
    """(path, title): the first heading of depth 1, null if there is none."""
    return toks.groupBy("path").agg(F.min_by("text", F.when((F.col("type") == "heading") & (F.col("depth") == 1), F.col("pos"))).alias("title"))


def document_nodes(texts: DataFrame, top_type: str = S.FILE_TOP, map_h2: bool = True) -> DataFrame:
    """The trees of (path, text) rows: a top node for each file, then its sections."""
    cleaned = _spread(texts).select("path", X.clean_docc(F.col("text")).alias("text"), F.regexp_extract("text", "(?s)\\A---\\n.*?\\n---", 0).alias("front"))
    toks = cleaned.mapInArrow(lex_batches, S.TOKEN)
    top = F.col("type") == "top"
    head = F.when(top | (F.col("type") == "heading"), F.struct(F.col("text").alias("title"), "depth", "place", F.when(top, F.col("raw")).alias("front")))
    block = F.when(~top, block_of(F.col("type"), F.col("text"), F.col("raw"), F.col("lang")))
    rows = toks.where("section is not null").select("path", "section", "pos", head.alias("head"), block.alias("block")).where("head is not null or block is not null")
    # all that follows is by path, so this is the only exchange of tokens
    ordered = F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("pos", "block"))), lambda x, y: x["pos"] - y["pos"])
    nodes = rows.repartition("path").groupBy("path", "section").agg(F.first("head", ignorenulls=True).alias("h"), ordered.alias("b"))
    top, front = F.col("section") == -1, F.map_filter(X.front_matter(F.col("h.front")), lambda k, v: ~k.isin("format", "path"))
    return nodes.select(
        F.col("path").alias("doc_key"), F.when(top, F.array().cast("array<int>")).otherwise(F.col("h.place")).alias("path"), F.when(top, top_type).otherwise(node_type(F.col("h.depth"), map_h2)).alias("type"),
        F.when(top, X.id_from_path(F.col("path"))).otherwise(X.slugify(F.col("h.title"))).alias("id"), F.when(top, F.coalesce("h.title", X.title_from_path(F.col("path")))).otherwise(F.col("h.title")).alias("title"),
        F.lit("").alias("description"), F.transform("b", lambda x: x["block"]).alias("content"),
        F.when(top, F.map_concat(front, F.create_map(F.lit("format"), F.lit(S.MARKDOWN), F.lit("path"), F.col("path")))).otherwise(F.create_map(F.lit("level"), F.col("h.depth").cast("string"))).alias("metadata"),
    )


def by_component(path: Column) -> Column:
    """What paths are ordered by: directory by directory, not as strings."""
    return F.split(path, "/", -1)


def merge(texts: DataFrame, root_title: str) -> DataFrame:
    """One tree of all files: a root, each file a section in path order, no categories."""
    # the rank is a global order of file paths only; its single partition holds nothing else
    order = texts.select(F.col("path").alias("doc_key"), F.row_number().over(Window.orderBy(by_component(F.col("path")))).alias("n"))
    files = document_nodes(texts, S.SECTION, False).join(order, "doc_key")
    files = files.select(F.lit("root").alias("doc_key"), F.concat(F.array("n"), "path").alias("path"), "type", "id", "title", "description", "content", "metadata")
    n = texts.agg(F.count("*").cast("string").alias("n"))
    root = n.select(
        F.lit("root").alias("doc_key"), F.array().cast("array<int>").alias("path"), F.lit(S.ROOT).alias("type"), F.lit("root").alias("id"), F.lit(root_title).alias("title"), F.lit("").alias("description"),
        F.array().cast(S.NODE["content"].dataType).alias("content"), F.create_map(F.lit("format"), F.lit(S.MARKDOWN), F.lit("count"), F.col("n")).alias("metadata"),
    )
    return root.unionByName(files)
