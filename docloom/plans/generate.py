"""From specifications to files: the whole job of the `generate` command as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom import log
from docloom.operators import categorize, openref
from docloom.plans import legacy, universal
from docloom.sources import config, detect, fetch, files, sink


@dataclass(frozen=True)
class Outcome:
    sdk: str
    version: str
    operations: int = 0
    examples: int = 0
    files: int = 0
    error: str | None = None


def tasks(conf: config.Config, sdk: str, version: str) -> list[tuple[str, str]]:
    """The (sdk, version) pairs that `all` or single names mean."""
    if sdk != "all":
        conf.sdk(sdk)
    rows = config.pairs(conf.sdks() if sdk == "all" else conf.sdk(sdk))
    if version == "all":
        return [(r["sdk"], r["version"]) for r in rows.collect()]
    names = [r["sdk"] for r in rows.groupBy("sdk").agg(F.min("sdk_pos").alias("p")).orderBy("p").collect()]
    return [(n, version) for n in names]


def one(spark: SparkSession, conf: config.Config, sdk: str, version: str, output: str, cache: fetch.Cache, date: str, force: bool = False) -> Outcome:
    """Find, parse and save one specification, then write its module files and the full file."""
    # a download takes `latest` as the first version listed, the renderer as the one of the greatest number
    found = version if version != "latest" else config.first_listed(conf.sdk(sdk)).first()["version"]
    path = fetch.resolve(conf.version(sdk, found), cache, force)
    shown = conf.version(sdk, version)
    specs = openref.decode(files.texts_of(spark, [path])).cache()
    bad = specs.where("error is not null").first()
    if bad:
        raise detect.ParserError("openref", bad["error"])
    target = os.path.join(output, sdk, found)
    sink.write_files(sink.spec_files(specs, F.lit(f"parsed/{sdk}-{found}.json")), target).count()
    ops = openref.operations(specs).select("pos", F.col("op.id").alias("op_id"), "op")
    listed = config.listed_operations(conf.categories())
    left = [r[0] for r in categorize.uncategorized(ops, listed).orderBy("op_id").collect()]
    if left:
        log.logger.warning("%d operations without a category: %s", len(left), ", ".join(left))
    display = F.lit(shown["displayName"])
    literal = conf.sdk(sdk).where(F.col("version") == version).first()
    spec_path = (literal["spec"]["localPath"] if literal else None) or ""
    header = legacy.full_header(display, F.lit(sdk), F.lit(version), F.lit(spec_path), F.lit(date))
    rows = legacy.files(categorize.first_match(ops, listed), conf.categories(), shown["output"]["filenamePrefix"], header, display)
    n = sink.write_files(rows, os.path.join(target, "llm-docs")).count()
    s = openref.stats(specs).first()
    specs.unpersist()
    return Outcome(sdk, found, s["operationCount"], s["exampleCount"], n)


def many(spark: SparkSession, conf: config.Config, pairs: list[tuple[str, str]], output: str, cache: fetch.Cache, date: str, force: bool = False, done: Callable[[Outcome], None] = lambda o: None) -> list[Outcome]:
    """All tasks; one that fails leaves an error in its outcome and the others go on."""
    out = []
    for sdk, version in pairs:
        try:
            o = one(spark, conf, sdk, version, output, cache, date, force)
        except (config.ConfigError, fetch.FetchError, detect.ParserError, OSError) as e:
            o = Outcome(sdk, version, error=str(e))
        out.append(o)
        done(o)
    return out


def source(spark: SparkSession, path: str, output: str, hint: str, options: universal.Options) -> int:
    """Render any source of a known format; the number of files written."""
    nodes = detect.parse(spark, path, hint)
    return sink.write_files(universal.files(nodes, options), output).count()
