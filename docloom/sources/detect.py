"""Format detection, the registry of formats, and validation reports."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schema as S
from docloom.functions import text as X
from docloom.functions import blocks, yaml12
from docloom.operators import markdown, openref
from docloom.sources import files

SNIFF = 200


class ParserError(Exception):
    """A source that a parser can't read."""

    def __init__(self, parser: str, message: str) -> None:
        super().__init__(f"[{parser}] {message}")
        self.parser = parser


def guess(extension: Column) -> Column:
    """The format that an extension suggests."""
    e = F.lower(extension)
    return F.when(e.isin("yml", "yaml"), S.OPENREF).when(e.isin("md", "markdown"), S.MARKDOWN).otherwise(S.AUTO)


def looks_openref(path: Column, text: Column) -> Column:
    """YAML whose first characters mention a key of specifications, wherever it stands."""
    start = F.substring(text, 1, SNIFF)
    keys = F.contains(start, F.lit("info:")) | F.contains(start, F.lit("functions:")) | F.contains(start, F.lit("id:"))
    return X.file_extension(path).isin("yml", "yaml") & F.coalesce(keys, F.lit(False))


def looks_markdown(path: Column) -> Column:
    return X.file_extension(path).isin("md", "markdown")


def detected(rows: DataFrame, hint: str = S.AUTO) -> DataFrame:
    """(path, format) of (path, text) rows: the hint as it is, else the first format that accepts; null if none does."""
    if hint != S.AUTO:
        return rows.select("path", F.lit(hint).alias("format"))
    return rows.select("path", F.when(looks_openref(F.col("path"), F.col("text")), S.OPENREF).when(looks_markdown(F.col("path")), S.MARKDOWN).alias("format"))


@dataclass(frozen=True)
class Format:
    """A format: its name, whether it accepts a path, and how a path becomes a node table."""

    name: str
    accepts: Callable[[str], bool]
    parse: Callable[[SparkSession, str], DataFrame]


def looks_like_markdown(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in (".md", ".markdown")


def _openref_accepts(path: str) -> bool:
    if os.path.splitext(path)[1].lower() not in (".yml", ".yaml") or not os.path.exists(path):
        return False
    start = files.head(path, SNIFF)
    return any(k in start for k in ("info:", "functions:", "id:"))


def _markdown_accepts(path: str) -> bool:
    if os.path.isdir(path):
        return any(n.endswith(".md") for n in os.listdir(path))
    return looks_like_markdown(path) and os.path.exists(path)


def parse_openref(spark: SparkSession, path: str, categories: DataFrame | None = None) -> DataFrame:
    specs = openref.decode(files.texts_of(spark, [path]))
    bad = specs.where("error is not null").select("error").first()
    if bad:
        raise ParserError(S.OPENREF, bad[0])
    return openref.document_nodes(specs, categories)


def parse_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A file's tree, with its second-level headings as categories, or a folder's files merged under one root."""
    if os.path.isfile(path):
        return markdown.document_nodes(files.texts_of(spark, [path]))
    if not os.path.isdir(path):
        raise ParserError(S.MARKDOWN, f"not a file or folder: {path}")
    found = files.markdown_files(path)
    if not found:
        raise ParserError(S.MARKDOWN, f"no Markdown files in {path}")
    return markdown.merge(files.texts_of(spark, found), path.rsplit("/", 1)[-1] or "Documentation")


class Registry:
    """Formats in the order in which they are asked."""

    def __init__(self) -> None:
        self.formats: list[Format] = [Format(S.OPENREF, _openref_accepts, parse_openref), Format(S.MARKDOWN, _markdown_accepts, parse_markdown)]

    def register(self, found: Format) -> None:
        self.formats.append(found)

    def names(self) -> list[str]:
        return [f.name for f in self.formats]

    def get(self, name: str) -> Format | None:
        return next((f for f in self.formats if f.name == name), None)

    def detect(self, path: str, hint: str = S.AUTO) -> str:
        if hint != S.AUTO:
            return hint
        extension = path.rsplit(".", 1)[1].lower() if "." in path else ""
        guessed = self.get({"yml": S.OPENREF, "yaml": S.OPENREF, "md": S.MARKDOWN, "markdown": S.MARKDOWN}.get(extension, S.AUTO))
        for f in [guessed, *self.formats] if guessed else self.formats:
            if f.accepts(path):
                return f.name
        raise ParserError("detector", f"no format accepts {path}; there are {', '.join(self.names())}")


_default: list[Registry] = []


def registry() -> Registry:
    if not _default:
        _default.append(Registry())
    return _default[0]


def detect_format(path: str, hint: str = S.AUTO) -> str:
    return registry().detect(path, hint)


def parse(spark: SparkSession, path: str, hint: str = S.AUTO) -> DataFrame:
    """The node table of a source of any registered format."""
    return registry().get(detect_format(path, hint)).parse(spark, path)


def _checked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path in frame["path"]:
            message = None
            try:
                if not os.path.exists(path):
                    message = f"file not found: {path}"
                elif os.path.isdir(path):
                    message = None if files.markdown_files(path) else f"no Markdown files in {path}"
                elif looks_like_markdown(path):
                    with open(path, encoding="utf-8", errors="replace") as f:
                        list(blocks.lex(f.read()))
                elif os.path.splitext(path)[1].lower() in (".yml", ".yaml"):
                    with open(path, encoding="utf-8") as f:
                        yaml12.spec(f.read())
            except (ValueError, OSError, yaml.YAMLError) as e:
                message = str(e)
            rows.append((path, message is None, message and "error", message, message and path, None, None))
        yield pd.DataFrame(rows, columns=[f.name for f in S.REPORT]).astype({"line": "Int32", "column": "Int32"})


def validate(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A report row for each path: whether it is there and can be read. There are no warnings."""
    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(_checked, S.REPORT)
