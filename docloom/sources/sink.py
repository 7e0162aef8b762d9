"""Writing (filename, content) rows as files of exactly these names, and specifications as JSON."""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _inside(name: str) -> str:
    """The name, which must stay in the folder."""
    out = posixpath.normpath(name)
    if out.startswith(("/", "../")) or out in (".", ".."):
        raise ValueError(f"not a name within the folder: {name}")
    return out


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def _writer(folder: str):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _system(folder)
        for frame in frames:
            sizes = []
            for name, content in zip(frame["filename"], frame["content"], strict=True):
                target = posixpath.join(base, _inside(name))
                system.create_dir(posixpath.dirname(target), recursive=True)
                part = f"{target}.{os.getpid()}.part"
                with system.open_output_stream(part) as f:
                    f.write(content.encode())
                system.move(part, target)  # a repeated task leaves the same file
                sizes.append(len(content))
            yield pd.DataFrame({"filename": frame["filename"], "size": sizes})

    return write


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write where the tasks run, on a file system that all of them share (a path or a URI); (filename, size) of what was written."""
    system, base = _system(folder)
    system.create_dir(base, recursive=True)
    return rows.select("filename", "content").mapInPandas(_writer(folder), "filename string, size long")


def _number(text: str) -> float | int:
    x = float(text)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


@F.arrow_udf(T.StringType())
def _rendered(specs: pa.Array) -> pa.Array:
    """JSON with two spaces of indentation, numbers and brackets as JavaScript writes them; parameters are the objects that they were."""
    out = []
    for text in specs.to_pylist():
        spec = json.loads(text)
        for op in spec.get("operations") or ():
            if "overwriteParams" in op:
                op["overwriteParams"] = [json.loads(p, parse_float=_number) for p in op["overwriteParams"]]
        out.append(json.dumps(spec, indent=2, ensure_ascii=False))
    return pa.array(out, pa.string())


def spec_json(info: Column, operations: Column) -> Column:
    """A specification as JSON with two spaces of indentation and its null fields left out."""
    return _rendered(F.to_json(F.struct(info.alias("info"), operations.alias("operations"))))


def spec_files(specs: DataFrame, name: Column) -> DataFrame:
    return specs.where("error is null").select(name.alias("filename"), spec_json(F.col("info"), F.col("operations")).alias("content"))
