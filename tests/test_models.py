"""Lookups over operation lists: empty inputs, repeats, request order, and lists by category."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom import schema as S
from docloom.operators import categorize, ir, openref

EX = "array<struct<id:string,name:string,code:string,description:string,dataSql:string,response:string,isSpotlight:boolean>>"
ROWS = f"id string, pos int, op struct<title:string,examples:{EX}>"


def example(name: str, spotlight: bool) -> tuple:
    return (name, name.upper(), "code", "", "", "", spotlight)


ONE = ("op1", 0, ("First", [example("a", True), example("b", False)]))
TWO = ("op2", 1, ("Second", [example("c", True)]))


@pytest.fixture(scope="module")
def ops(spark):
    return spark.createDataFrame([ONE, TWO], ROWS)


def test_index(spark, ops):
    assert sorted(r.id for r in ir.last_by_id(ops).collect()) == ["op1", "op2"] and ir.total_examples(ops).first().total == 3
    none = spark.createDataFrame([], ROWS)
    assert ir.last_by_id(none).count() == 0 and ir.total_examples(none).first().total == 0


def test_by_id(spark, ops):
    assert ir.by_id(ops, "op1").first().op.title == "First" and ir.by_id(ops, "nonexistent").count() == 0
    twice = ops.unionByName(spark.createDataFrame([("op1", 2, ("Third", []))], ROWS))
    assert ir.by_id(twice, "op1").first().op.title == "Third" and ir.by_id(twice, "op1", first=True).first().op.title == "First"


def test_by_ids(spark, ops):
    wanted = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "request_pos int, id string")
    titles = lambda found: [r.op.title for r in found.collect()]
    assert titles(ir.by_ids(ops, wanted("op1", "op2"))) == ["First", "Second"] and titles(ir.by_ids(ops, wanted("op2", "op1"))) == ["Second", "First"]
    assert titles(ir.by_ids(ops, wanted("op1", "nonexistent", "op2"))) == ["First", "Second"] and titles(ir.by_ids(ops, wanted("nonexistent"))) == []
    assert titles(ir.by_ids(ops, wanted("op1", "op1"))) == ["First", "First"] and ir.by_ids(ops, wanted("x").limit(0)).count() == 0


def test_has_and_spotlight(spark, ops):
    assert dict(ir.has(ops, spark.createDataFrame([("op1",), ("nonexistent",)], "id string")).collect()) == {"op1": True, "nonexistent": False}
    ex = F.col("op.examples")
    got = {r.id: ([e.id for e in r.s], r.n) for r in ops.select("id", ir.spotlight(ex).alias("s"), ir.example_count(ex).alias("n")).collect()}
    assert got == {"op1": (["a"], 2), "op2": (["c"], 1)}
    plain = spark.createDataFrame([("x", 0, ("X", [example("b", False)])), ("y", 1, ("Y", None))], ROWS)
    assert [(r.s, r.n) for r in plain.select(ir.spotlight(ex).alias("s"), F.coalesce(ir.example_count(ex), F.lit(0)).alias("n")).collect()][0] == ([], 1)


def test_lists_by_category(spark):
    """Adding to a list appends to it; a category that nobody added to has an empty list."""
    long = spark.createDataFrame([("database", 0, 0, "op1"), ("auth", 1, 0, "op3"), ("database", 0, 1, "op2")], "category string, cat_pos int, op_pos int, op string")
    groups = ir.grouped(long)
    assert {r.category: r.operations for r in groups.collect()} == {"database": ["op1", "op2"], "auth": ["op3"]}
    wanted = spark.createDataFrame([("database",), ("none",)], "category string")
    assert {r.category: r.operations for r in ir.of_category(groups, wanted).collect()} == {"database": ["op1", "op2"], "none": []}
    assert ir.grouped(long.limit(0)).count() == 0


def test_categories(spark):
    ops = spark.createDataFrame([("a", 0, "A"), ("b", 1, "B"), ("a", 2, "A2"), ("c", 3, "C")], "op_id string, pos int, op string")
    cats = spark.createDataFrame([("x", 0, 0, "b"), ("x", 0, 1, "a"), ("y", 1, 0, "a"), ("y", 1, 1, "zz")], "category string, cat_pos int, op_pos int, op_id string")
    assert sorted(map(tuple, categorize.first_match(ops, cats).select("category", "op_no", "op").collect())) == [("x", 1, "B"), ("x", 2, "A2")]
    assert [r.op_id for r in categorize.uncategorized(ops, cats).collect()] == ["c"]
    many = openref.categorize_multi(ops.withColumn("path", F.lit("p")), cats)
    assert sorted(map(tuple, many.select("category", "cat_no", "op_no", "op").collect())) == [("x", 1, 1, "B"), ("x", 1, 2, "A2"), ("y", 2, 1, "A2")]


def test_nodes_made_and_walked(spark):
    cols = ir.node(S.SECTION, F.col("k"), F.upper("k"), content=F.array(ir.content_block(S.CODE, F.lit("x"), F.lit("swift"))))
    rows = spark.createDataFrame([("a", None, 0), ("b", "a", 0), ("c", "a", 1), ("d", "c", 0), ("e", None, 1)], "k string, up string, o int")
    placed = ir.number_children(rows, "k", "up", F.col("o"), 3)
    nodes = placed.select(F.lit("doc").alias("doc_key"), "path", *cols)
    assert [c for c in nodes.columns] == [f.name for f in S.NODE] and nodes.schema["content"].dataType == S.NODE["content"].dataType
    assert [(r.id, r.depth, r.path) for r in ir.in_order(nodes).collect()] == [("a", 1, [1]), ("b", 2, [1, 1]), ("c", 2, [1, 2]), ("d", 3, [1, 2, 1]), ("e", 1, [2])]
    first = nodes.where("id = 'a'").first()
    assert (first.title, first.description, first.metadata, first.content[0].language, first.content[0].annotations) == ("A", "", {}, "swift", None)


def test_shapes(spark):
    v = lambda text: spark.range(1).select(F.parse_json(F.lit(text)).alias("v"))
    holds = lambda text, test: v(text).select(test(F.col("v")).alias("t")).first().t
    assert holds('{"type": "root", "id": "a", "title": "t", "children": []}', ir.is_node) and not holds('{"type": "root", "id": "a", "title": "t", "children": 1}', ir.is_node) and not holds('{"id": "a"}', ir.is_node)
    assert holds('{"id": "a", "name": "n", "code": "c"}', ir.is_example) and not holds('{"id": "a", "name": "n"}', ir.is_example)
    assert holds('{"id": "a", "title": "n", "examples": []}', ir.is_operation) and not holds('{"id": "a"}', ir.is_operation)
