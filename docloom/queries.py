"""Queries over the engine's own operators, each on its whole tables, and SQL that gives the same rows.

The inputs are composed from relational tables: customers are operations and their orders the examples,
nations are specifications, market segments are categories, and a Markdown file tells of each customer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import categorize, ir, markdown, openref
from docloom.plans import legacy, universal
from docloom.sources import config, detect


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """(o_custkey, examples): the orders of each customer as examples, by key."""
    ex = F.struct(
        F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("let total = "), F.col("o_orderkey").cast("string")).alias("code"),
        F.when(F.col("o_orderstatus") == "F", "Done.").otherwise("").alias("description"), F.when(F.col("o_orderkey") % 3 == 0, "```sql\nselect 1\n```").otherwise("").alias("dataSql"),
        F.when(F.col("o_orderkey") % 2 == 0, "```json\n[]\n```").otherwise("").alias("response"), (F.col("o_orderstatus") == "O").alias("isSpotlight"),
    )
    pairs = _table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", ex.alias("e")))).alias("l"))
    return pairs.select("o_custkey", F.transform("l", lambda x: x["e"]).alias("examples"))


def _operations(spark: SparkSession, d: str) -> DataFrame:
    """(path, pos, op_id, op): customers as operations of their nation's specification; ids repeat within a segment and hundred."""
    c = _table(spark, d, "customer").join(_examples(spark, d), F.col("c_custkey") == F.col("o_custkey"), "left")
    none = F.array().cast("array<struct<id:string,name:string,code:string,description:string,dataSql:string,response:string,isSpotlight:boolean>>")
    op_id = F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 100).cast("string"))
    op = F.struct(op_id.alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("Serves "), "c_mktsegment", F.lit(".")).alias("description"), F.lit("").alias("notes"), F.coalesce("examples", none).alias("examples"))
    return c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), F.col("c_custkey").alias("pos"), op_id.alias("op_id"), op.alias("op"))


def _categories(spark: SparkSession, d: str) -> DataFrame:
    """(category, cat_pos, op_pos, op_id): three overlapping categories of ids, of which some are unknown."""
    ids = _table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 120).cast("string")).alias("op_id"), (F.col("c_custkey") % 120).alias("k")).distinct()
    pos = F.struct("k", "op_id")
    some = [("even", 0, "k % 2 = 0"), ("third", 1, "k % 3 = 0"), ("low", 2, "k < 50")]
    rows = [ids.where(test).select(F.lit(name).alias("category"), F.lit(n).alias("cat_pos"), F.row_number().over(Window.orderBy(pos)).alias("op_pos"), "op_id") for name, n, test in some]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): a Markdown file for each customer, with its orders under it."""
    o = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")))
    part = F.transform("l", lambda x: F.concat(F.lit("## Order "), x["o_orderkey"].cast("string"), F.lit("\n\nStatus "), x["o_orderstatus"], F.lit(".\n\n### "), x["o_orderpriority"], F.lit("\n\n```sql\nselect 1\n```\n\n")))
    orders = _table(spark, d, "orders").groupBy("o_custkey").agg(o.alias("l")).select("o_custkey", F.array_join(part, "").alias("body"))
    c = _table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(
        F.concat(F.lit("docs/c"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("---\nseg: "), "c_mktsegment", F.lit("\n---\n<!-- x -->\n\n# "), "c_name", F.lit("\n\nAbout <doc:Them>.\n\n\n\n"), F.coalesce("body", F.lit(""))).alias("text"),
    )


def _body(texts: DataFrame) -> DataFrame:
    """Without the front matter, which would be content too."""
    return texts.select("path", F.regexp_replace("text", "(?s)\\A---\\n.*?\\n---\\n", "").alias("text"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return markdown.document_nodes(_body(_texts(spark, d)))


# Markdown


def md_clean(spark: SparkSession, d: str) -> DataFrame:
    """Pages without directives and comments."""
    return _table(spark, d, "pages").select("page_id", X.clean_docc(F.col("html")).alias("text"))


def md_slug(spark: SparkSession, d: str) -> DataFrame:
    """The slug of every page's title."""
    return _table(spark, d, "pages").select("page_id", X.slugify(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("slug"))


def md_front_matter(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("path", F.try_element_at(X.front_matter(F.col("text")), F.lit("seg")).alias("seg"))


def md_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every heading with its level and place."""
    s = markdown.sections(markdown.tokens(_body(_texts(spark, d))))
    return s.select("path", "level", "title", "slug", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"))


def md_titles(spark: SparkSession, d: str) -> DataFrame:
    return markdown.titles(markdown.tokens(_body(_texts(spark, d)))).select("path", "title")


def md_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of all trees by type."""
    return _nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.size("content")).alias("blocks"))


def md_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of block, in a text for each customer."""
    k = F.col("c_custkey").cast("string")
    parts = [
        "# Head ", k, " #\n\nSetext ", k, "\n======\n\nLower ", k, "\n---\n\n- one\n- two ", k, "\n\n1. first\n2. second\n\n| a | b |\n|---|---|\n| ", k, " | 2 |\n\n> quote ", k, "\n> goes on\n\n<div>\n", k, "\n</div>\n\n",
        "[ref", k, "]: http://x.com/", k, "\n\n    indented ", k, "\n\n***\n\n~~~swift\nlet a = ", k, "\n~~~\n\npara ", k, "\nof two lines",
    ]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    toks = markdown.tokens(_table(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("path"), text.alias("text")))
    rank = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    return toks.where("type <> 'space'").select("path", rank.alias("n"), "type", "depth", "lang", F.btrim(F.coalesce("text", "raw"), F.lit("\n")).alias("body"))


def md_merge(spark: SparkSession, d: str) -> DataFrame:
    """All files under one root, each numbered by its path."""
    nodes = markdown.merge(_body(_texts(spark, d)), "All")
    return nodes.where(F.size("path") <= 1).select("doc_key", F.array_join(F.col("path").cast("array<string>"), ".").alias("place"), "type", "id", "title")


def ir_depths(spark: SparkSession, d: str) -> DataFrame:
    """A visitor that counts the nodes of each depth."""
    return ir.visit(_nodes(spark, d), lambda n: n.groupBy("depth").agg(F.count("*").alias("n")))


def _headless(spark: SparkSession, d: str) -> DataFrame:
    """Trees of files without a title, so that their orders are categories right under the top."""
    texts = _body(_texts(spark, d)).select("path", F.regexp_replace("text", "# Customer[^\n]*\n", "").alias("text"))
    return markdown.document_nodes(texts)


def universal_modular(spark: SparkSession, d: str) -> DataFrame:
    """A file for each order, as a category of its customer's tree."""
    return universal.modular(_headless(spark, d), universal.Options(filename_prefix="m")).select("doc_key", "filename", "content")


def universal_files(spark: SparkSession, d: str) -> DataFrame:
    """How many files each tree has: the full one and those of its categories."""
    return universal.files(_headless(spark, d), universal.Options(date="today")).groupBy("doc_key").agg(F.count("*").alias("files"), F.sum((F.col("filename") == "documentation-full-llms.txt").cast("long")).alias("whole"))


def ir_count_nodes(spark: SparkSession, d: str) -> DataFrame:
    return ir.count_nodes(_nodes(spark, d))


def ir_find_by_type(spark: SparkSession, d: str) -> DataFrame:
    return ir.find_by_type(_nodes(spark, d), "category").select("doc_key", "id", "title")


def universal_full(spark: SparkSession, d: str) -> DataFrame:
    """The full text of every customer's file."""
    return universal.full(_nodes(spark, d), universal.Options(date="today")).select("doc_key", "filename", "content")


# Operation lists and specifications


def ir_last_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Of each repeated id, the last operation."""
    ops = _operations(spark, d).select(F.col("op_id").alias("id"), "pos", F.col("op.title").alias("title"))
    return ir.last_by_id(ops).select("id", "pos", "title")


def ir_first_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Of one repeated id, the first operation and the last."""
    ops = _operations(spark, d).select(F.col("op_id").alias("id"), "pos", F.col("op.title").alias("title"))
    return ir.by_id(ops, "BUILDING-7", first=True).withColumn("way", F.lit("first")).unionByName(ir.by_id(ops, "BUILDING-7").withColumn("way", F.lit("last"))).select("way", "id", "pos", "title")


def ir_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """The operations that parts ask for by id, in the order of asking."""
    wanted = _table(spark, d, "part").select(F.col("p_partkey").alias("request_pos"), F.concat(F.when(F.col("p_size") > 25, "BUILDING-").otherwise("NOTHING-"), F.col("p_size").cast("string")).alias("id"))
    ops = _operations(spark, d).select(F.col("op_id").alias("id"), "pos", F.col("op.title").alias("title"))
    return ir.by_ids(ops, wanted).select("request_pos", "id", "title")


def ir_has(spark: SparkSession, d: str) -> DataFrame:
    wanted = _categories(spark, d).select(F.col("op_id").alias("id")).distinct()
    return ir.has(_operations(spark, d).select(F.col("op_id").alias("id")), wanted)


def ir_total_examples(spark: SparkSession, d: str) -> DataFrame:
    return ir.total_examples(_operations(spark, d))


def ir_spotlight(spark: SparkSession, d: str) -> DataFrame:
    """Operations with the number of their examples and of those in the spotlight."""
    ex = F.col("op.examples")
    return _operations(spark, d).select("pos", ir.example_count(ex).alias("examples"), F.size(ir.spotlight(ex)).alias("spotlight"))


def ir_grouped(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each category as a list."""
    g = ir.grouped(_categories(spark, d).withColumnRenamed("op_id", "op"))
    return g.select("category", F.array_join("operations", ",").alias("ids"))


def _specs(spark: SparkSession, d: str) -> DataFrame:
    """Specifications decoded from YAML text, one for each nation; every second customer has an example."""
    ops = _table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("l"))
    one = lambda c: F.concat(F.lit("  - id: c"), c["c_custkey"].cast("string"), F.lit("\n    title: "), c["c_name"], F.when(c["c_custkey"] % 2 == 0, "\n    examples: [{id: e, name: on, code: x}]").otherwise(""), F.lit("\n"))
    text = F.concat(F.lit("info: {id: n, title: T}\nfunctions:\n"), F.array_join(F.transform("l", one), ""))
    return openref.decode(ops.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), text.alias("text")))


def openref_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of each specification."""
    return openref.stats(_specs(spark, d))


def openref_valid(spark: SparkSession, d: str) -> DataFrame:
    """Specifications that decode and those that don't: of every third nation, the text ends in the middle of a list."""
    n = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("info: {id: n, title: T}\nfunctions: [{id: a, title: "), F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise("}]"))
    specs = openref.decode(_table(spark, d, "nation").select(F.concat(F.lit("n"), n).alias("path"), text.alias("text")))
    return openref.valid(specs).join(specs.select("path", F.col("error").isNotNull().alias("failed"), F.col("operations")[0]["title"].alias("title")), "path")


def openref_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The trees of specifications: each node with its place and title."""
    nodes = openref.document_nodes(_specs(spark, d))
    return nodes.select("doc_key", F.array_join(F.col("path").cast("array<string>"), ".").alias("place"), "type", "id", "title")


def openref_language(spark: SparkSession, d: str) -> DataFrame:
    """The language that a snippet for each part looks like."""
    marks = ["const a", "func a", "def a", "public class A", "using A", "void a", "let a", "plain", "import a", "class A {"]
    code = F.concat(F.get(F.array(*[F.lit(m) for m in marks]), (F.col("p_size") % 10).cast("int")), F.lit(" "), "p_name")
    return _table(spark, d, "part").select("p_partkey", X.infer_language(code).alias("language"))


def openref_multi(spark: SparkSession, d: str) -> DataFrame:
    """Operations of each specification under every category that lists them."""
    met = openref.categorize_multi(_operations(spark, d), _categories(spark, d))
    return met.select("path", "category", "cat_no", "op_no", "op_id", F.col("op.title").alias("title"))


def first_match(spark: SparkSession, d: str) -> DataFrame:
    """Operations under the first category that lists them."""
    return categorize.first_match(_operations(spark, d), _categories(spark, d)).select("op_id", "category", "op_no", F.col("op.title").alias("title"))


def uncategorized(spark: SparkSession, d: str) -> DataFrame:
    return categorize.uncategorized(_operations(spark, d), _categories(spark, d))


def _legacy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cats = _categories(spark, d)
    heads = cats.select("category", "cat_pos").distinct().select("category", "cat_pos", F.upper("category").alias("title"), F.lit("About.").alias("description"), F.lit("Docs for {sdk_name}.").alias("systemPrompt"), (3 - F.col("cat_pos")).cast("double").alias("order"))
    return categorize.first_match(_operations(spark, d), cats), heads


def legacy_modules(spark: SparkSession, d: str) -> DataFrame:
    """The module text of each category."""
    met, heads = _legacy(spark, d)
    return legacy.modules(met, heads, F.lit("Demo"))


def legacy_files(spark: SparkSession, d: str) -> DataFrame:
    """All files of the specification renderer by name."""
    met, heads = _legacy(spark, d)
    lit: list[Column] = [F.lit(x) for x in ("Demo", "demo", "v1", "p", "today")]
    return legacy.files(met, heads, "demo", legacy.full_header(*lit), F.lit("Demo"))


def legacy_full(spark: SparkSession, d: str) -> DataFrame:
    """The full text of all categories, in their order."""
    met, heads = _legacy(spark, d)
    lit: list[Column] = [F.lit(x) for x in ("Demo", "demo", "v1", "p", "today")]
    return legacy.full(met, heads, legacy.full_header(*lit), F.lit("Demo"))


# Texts, paths and configuration


def text_trim(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations, padded in several ways, trimmed as fields of a specification are."""
    padded = F.concat(F.when(F.col("turn") % 3 == 0, " \t").otherwise(""), F.col("text"), F.when(F.col("turn") % 2 == 0, "\r").otherwise("\n"))
    return _table(spark, d, "conversations").select("conv_id", "turn", X.trim_if_edged(padded).alias("text"))


def text_fences(spark: SparkSession, d: str) -> DataFrame:
    """Documents put into fences and taken out of them again."""
    return _table(spark, d, "documents").select("doc_id", X.strip_fences(F.concat(F.lit("```sql\n"), "text", F.lit("\n```\n```ts\n```"))).alias("text"))


def text_paths(spark: SparkSession, d: str) -> DataFrame:
    """What the path of each page's URL says: extension, title and id."""
    p = F.concat("url", F.when(F.col("page_id") % 2 == 0, "/My File.md").otherwise(""))
    return _table(spark, d, "pages").select("page_id", X.file_extension(p).alias("extension"), X.title_from_path(p).alias("title"), X.id_from_path(p).alias("id"))


def text_dates(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select("o_orderkey", X.long_date(F.col("o_orderdate")).alias("shown"))


def config_latest(spark: SparkSession, d: str) -> DataFrame:
    """For each supplier's nation as an SDK, its greatest version."""
    s = _table(spark, d, "supplier").select(F.col("s_nationkey").alias("sdk"), F.concat(F.lit("v"), (F.col("s_suppkey") % 7).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".5").otherwise("")).alias("version"), F.col("s_suppkey").alias("version_pos"))
    return config.latest(s)


def config_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions of SDKs in a JSON text for each nation: its suppliers, with defaults filled in."""
    s = _table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("l"))
    one = lambda k: F.concat(F.lit('"v'), k.cast("string"), F.lit('": {"displayName": "V '), k.cast("string"), F.lit('", "spec": {"url": "http://x/'), k.cast("string"), F.lit('"'), F.when(k % 2 == 0, ', "format": "markdown"').otherwise(""), F.lit('}, "output": {"baseDir": "o", "filenamePrefix": "p"}}'))
    text = F.concat(F.lit('{"sdks": {"s'), F.col("s_nationkey").cast("string"), F.lit('": {"name": "N", "language": "L", "versions": {'), F.array_join(F.transform("l", one), ", "), F.lit("}}}}"))
    found = config.sdks_of(s.select(text.alias("text")))
    return found.select("sdk", "version", "version_pos", "displayName", F.col("spec.url").alias("url"), F.col("spec.format").alias("format"), config.sdk_problem().isNull().alias("valid"))


def config_operations(spark: SparkSession, d: str) -> DataFrame:
    """What the categories of a JSON text for each region list, in order."""
    n = _table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    text = F.concat(F.lit('{"categories": {"r'), F.col("n_regionkey").cast("string"), F.lit('": {"title": "t", "description": "", "systemPrompt": "p", "order": 1, "operations": ["'), F.array_join("l", '", "'), F.lit('"]}}}'))
    return config.listed_operations(config.categories_of(n.select(text.alias("text")))).select("category", "op_pos", "op_id")


def config_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of a JSON text for each region, checked."""
    n = _table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    one = lambda x: F.concat(F.lit('"'), x["n_name"], F.lit('": {"title": "t", "description": "", "systemPrompt": "p", "operations": ["a"], "order": '), (x["n_nationkey"] % 3).cast("string"), F.lit("}"))
    texts = n.select(F.concat(F.lit('{"categories": {'), F.array_join(F.transform("l", one), ", "), F.lit("}}")).alias("text"))
    return config.checked(config.categories_of(texts), config.category_problem(), "category").select("category", "valid")


def detect_format(spark: SparkSession, d: str) -> DataFrame:
    """Which format the texts of documents have by the names that they are given."""
    ends = F.get(F.array(*[F.lit(x) for x in (".yml", ".md", ".MARKDOWN", ".yaml")]), (F.col("doc_id") % 4).cast("int"))
    rows = _table(spark, d, "documents").select(F.concat(F.lit("a/d"), F.col("doc_id").cast("string"), ends).alias("path"), F.concat(F.when(F.col("doc_id") % 3 == 0, "info: x\n").otherwise("id: y\n"), F.col("text")).alias("text"))
    return rows.select("path", detect.guess(X.file_extension(F.col("path"))).alias("guess"), detect.looks_openref(F.col("path"), F.col("text")).alias("openref"), detect.looks_markdown(F.col("path")).alias("markdown"))


_ALL = (
    md_clean, md_slug, md_front_matter, md_sections, md_titles, md_nodes, md_blocks, md_merge, ir_count_nodes, ir_depths, ir_find_by_type, universal_full, universal_modular, universal_files, ir_last_by_id, ir_first_by_id, ir_by_ids, ir_has, ir_total_examples, ir_spotlight, ir_grouped,
    openref_stats, openref_valid, openref_nodes, openref_language, openref_multi, first_match, uncategorized, legacy_modules, legacy_full, legacy_files, text_trim, text_fences, text_paths, text_dates, config_latest, config_versions, config_operations, config_categories, detect_format,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
