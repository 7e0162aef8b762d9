"""What the Markdown lexer holds, and over how many tasks it is spread."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import blocks
from docloom.operators import markdown


def batches(texts: list[str]) -> list[pa.RecordBatch]:
    return pa.Table.from_pydict({"path": [f"p{i}" for i in range(len(texts))], "text": texts, "front": [""] * len(texts)}).to_batches()


def peak_mb(texts: list[str]) -> tuple[float, int, int]:
    """MB at most, tokens, tokens of the largest batch."""
    given, total, most = batches(texts), 0, 0
    tracemalloc.start()
    for batch in blocks.lex_batches(iter(given)):
        total, most = total + batch.num_rows, max(most, batch.num_rows)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, total, most


def test_tokens_leave_in_batches_of_bounded_size():
    text = "Intro\n\n# Title\n\n" + "## Part\n\nBody.\n\n" * 10
    for texts in ([text] * 700, ["Intro\n\n# Title\n\n" + "## Part\n\nBody.\n\n" * 7000], ["Body.\n\n" * 10000]):
        peak, total, most = peak_mb(texts)
        assert total > 20000 - 1 and most <= blocks.BATCH_TOKENS
        assert peak < 4


def test_long_texts_end_a_batch():
    got = list(blocks.lex_batches(iter(batches([f"# T{i}\n\n" + "x" * (blocks.BATCH_CHARS // 2) for i in range(20)]))))
    assert len(got) >= 20 and sum(b.num_rows for b in got) == 20 * 3
    assert max(b.nbytes for b in got) < 4 * blocks.BATCH_CHARS


def test_tokens_before_the_first_heading_and_the_title():
    rows = pa.Table.from_batches(blocks.lex_batches(iter(batches(["Intro\n\n## Sub\n\nBody\n\n# Title\n\n## A\n", "", "no heading"])))).to_pylist()
    assert [(r["path"], r["type"], r["section"], r["place"]) for r in rows if r["type"] != "space"] == [
        ("p0", "paragraph", 2, None), ("p0", "heading", 2, [1]), ("p0", "paragraph", 2, None), ("p0", "heading", 5, [2]), ("p0", "heading", 6, [2, 1]), ("p0", "top", -1, None),
        ("p1", "top", -1, None), ("p2", "paragraph", None, None), ("p2", "top", -1, None),
    ]
    assert [r["text"] for r in rows if r["type"] == "top"] == ["Title", None, None]


def test_texts_of_one_task_are_lexed_in_many(spark):
    texts = spark.createDataFrame([(f"p{i}", f"# T{i}\n\nBody.\n") for i in range(64)], "path string, text string").coalesce(1)
    for lexed in (markdown.tokens(texts), markdown.document_nodes(texts)):
        assert lexed.count() > 64
    tasks = markdown.tokens(texts).select("path", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in tasks}) == 4 and len(tasks) == 64
