"""The worked examples of the blueprint's fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import categorize, ir, markdown, openref
from docloom.plans import legacy, universal
from docloom.sources import config, detect, sink

YAML = """info: {id: demo, title: Demo SDK, description: "  Demo.  "}
functions:
  - id: select
    title: Fetch rows
    description: Reads rows.
    notes: |
      - Limited.
    examples:
      - id: basic
        name: Basic
        code: "func run() {}"
        data: {sql: "```sql\\ncreate table t (id int);\\n```"}
        response: "```json\\n[]\\n```"
        description: One call.
        isSpotlight: true
"""


@pytest.fixture
def specs(spark):
    return openref.decode(spark.createDataFrame([("demo.yml", YAML)], "path string, text string"))


def test_legacy_files(spark, specs):
    cats = spark.createDataFrame([("db", 0, "Rows", "Row access", "Docs for {sdk_name}.", ["select", "missing"], 1.0)], "category string, cat_pos int, title string, description string, systemPrompt string, operations array<string>, order double")
    ops = openref.operations(specs).select("pos", F.col("op.id").alias("op_id"), "op")
    met = categorize.first_match(ops, config.listed_operations(cats))
    head = legacy.full_header(*map(F.lit, ("Demo SDK v1", "demo", "v1", "PATH", "DATE")))
    got = {r.filename: r.content for r in legacy.files(met, cats, "demo-v1", head, F.lit("Demo SDK v1")).collect()}
    code = "func run() {}\n\n// Data Source\n/*\ncreate table t (id int);\n*/\n\n// Response\n/*\n[]\n*/\n\n\n// Note: One call.\n"
    assert got["demo-v1-db-llms.txt"] == (
        "<SYSTEM>Docs for Demo SDK v1.</SYSTEM>\n\n# Demo SDK v1 Rows Documentation\n\nRow access\n\n# 1. Fetch rows\n\nReads rows.\n\n- Limited.\n\n## 1.1. Basic\n\n" + code
    )
    assert got["demo-v1-full-llms.txt"] == (
        "<SYSTEM>This is the complete developer documentation for Demo SDK v1.</SYSTEM>\n\n<!-- Generated from: PATH -->\n<!-- SDK: demo, Version: v1, Generated: DATE -->\n\n# Demo SDK v1 Reference\n\n"
        "Complete reference for Demo SDK v1 covering all modules.\n\n## 1. Rows\n\nRow access\n\n### 1.1. Fetch rows\n\nReads rows.\n\n- Limited.\n\n#### 1.1.1. Basic\n\n" + code + "\n\n"
    )


def test_universal_openref(specs):
    nodes = openref.document_nodes(specs)
    got = universal.full(nodes, universal.Options(date="DATE")).first().content
    assert got == (
        "<SYSTEM>This is the complete developer documentation for Demo SDK.</SYSTEM>\n\n<!-- Format: openref, Generated: DATE -->\n\n# Demo SDK\n\n"
        "## 1. Fetch rows\n\nReads rows.\n\nReads rows.\n\n- Limited.\n\n### 1.1. Basic\n\nOne call.\n\nOne call.\n\n```swift\nfunc run() {}\n```\n\n"
        "\n// schema\n/*\n```sql\ncreate table t (id int);\n```\n*/\n\n\n// response\n/*\n```json\n[]\n```\n*/\n\n"
    )


def test_universal_markdown(spark):
    text = "Intro text.\n\n# Title\n\nBody.\n\n## First part\n\n```swift\nlet a = 1\n```\n\n> Quote\n\n### Deep *one*\n\n- a\n- b\n\n#### Item\n\nEnd <doc:Ref>.\n"
    nodes = markdown.document_nodes(spark.createDataFrame([("docs/My File.md", text)], "path string, text string"))
    by = {r.title: r for r in nodes.where("size(path) > 0").collect()}
    assert [by[t].type for t in ("Title", "First part", "Deep *one*", "Item")] == ["section", "category", "operation", "item"]
    top = nodes.where("size(path) = 0").first()
    assert (top.type, top.id) == ("SECTION", "my-file")
    got = universal.full(nodes, universal.Options(date="DATE")).first().content
    assert got == (
        "<SYSTEM>This is the complete developer documentation for Title.</SYSTEM>\n\n<!-- Format: markdown, Generated: DATE -->\n\n# Title\n\n# . Title\n\n## 1. Title\n\nIntro text.\n\nBody.\n\n"
        "### 1.1. First part\n\n```swift\nlet a = 1\n```\n\nQuote\n\n#### 1.1.1. Deep *one*\n\n- a\n- b\n\n#### 1.1.1.1. Item\n\nEnd Ref.\n\n"
    )
    assert universal.modular(nodes, universal.Options()).count() == 0


@pytest.mark.parametrize(("text", "error"), [("", True), ("functions: []", False), ("info: {id: 5}", True), ("info: {id: a, description: 5}", False), ("info: {specUrl: null}", True), ("a: 1\na: 2", True), ("functions: [{id: on}]", False)])
def test_decode_variants(spark, text, error):
    got = openref.decode(spark.createDataFrame([("x", text)], "path string, text string")).first()
    assert (got.error is not None) == error


def test_lookups(spark):
    ops = spark.createDataFrame([("a", 0, "A"), ("b", 1, "B"), ("a", 2, "C")], "id string, pos int, title string")
    wanted = spark.createDataFrame([(0, "b"), (1, "x"), (2, "a"), (3, "b")], "request_pos int, id string")
    assert [(r.request_pos, r.title) for r in ir.by_ids(ops, wanted).collect()] == [(0, "B"), (2, "C"), (3, "B")]
    assert ir.by_id(ops, "a").first().title == "C" and ir.by_id(ops, "a", first=True).first().title == "A"
    assert dict(ir.has(ops, wanted.select("id").distinct()).collect()) == {"a": True, "b": True, "x": False}


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(X.slugify(F.lit("Ärger  a--b!"))) == "rger-a-b"
    assert one(X.trim_if_edged(F.lit("\xa0a\r"))) == "\xa0a\r" and one(X.trim_if_edged(F.lit(" a\xa0"))) == "a"
    assert one(X.file_extension(F.lit("../a.docc/b"))) == "docc/b"
    assert one(X.first_replaced(F.lit("x {n} {n}"), "{n}", F.lit("$&"))) == "x $& {n}"
    assert one(F.to_json(X.front_matter(F.lit("---\na: 1: 2\n:bad\nb: x\na: 3\n---\n")))) == '{"a":"3","b":"x"}'


def test_latest_and_checks(spark):
    rows = spark.createDataFrame([("s", "v2", 0), ("s", "v1.5", 1), ("t", "beta", 0), ("t", "alpha", 1)], "sdk string, version string, version_pos int")
    assert dict(config.latest(rows).collect()) == {"s": "v1.5", "t": "beta"}
    assert dict(config.first_listed(rows).collect()) == {"s": "v2", "t": "beta"}


def test_detection_and_sink(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.yml").write_text("uuid: 1")
    assert detect.detect_format(str(tmp_path / "a.md")) == "markdown" and detect.detect_format(str(tmp_path / "b.yml")) == "openref"
    assert detect.detect_format(str(tmp_path)) == "markdown"
    files = spark.createDataFrame([("x-llms.txt", "é\n")], "filename string, content string")
    assert sink.write_files(files, str(tmp_path / "out")).collect()[0]["size"] == 2
    assert (tmp_path / "out/x-llms.txt").read_text(encoding="utf-8") == "é\n"
