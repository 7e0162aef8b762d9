"""Listing and reading files as DataFrames of (path, text)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TEXTS = "path string, text string"


def markdown_files(folder: str) -> list[str]:
    """All *.md files below a folder, hidden ones too, in component order. Spark's own listing skips names that start with a dot or underscore."""
    found = [os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f.endswith(".md")]
    return sorted(found, key=lambda p: p.split("/"))


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = []
        for path in frame["path"]:
            with open(path, encoding="utf-8", errors="replace", newline="") as f:
                texts.append(f.read())
        yield pd.DataFrame({"path": frame["path"], "text": texts})


def texts_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files of a shared file system, read where the tasks run."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(_read, TEXTS)


def tree_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Whole files below a folder of any Hadoop file system, listed by Spark: hidden names are left out."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return read.selectExpr("_metadata.file_path AS path", "value AS text")


def exists(path: str) -> bool:
    return os.path.exists(path)


def head(path: str, size: int = 100) -> str:
    """The first UTF-16 units of a text, of which only as many bytes as they can take are read."""
    with open(path, "rb") as f:
        text = f.read(4 * size).decode("utf-8", "ignore")
    return text.encode("utf-16-le")[: 2 * size].decode("utf-16-le", "replace")
