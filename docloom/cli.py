"""Command line: generate, list-sdks, validate."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession

from docloom import log
from docloom.operators import openref
from docloom.plans import generate, universal
from docloom.sources import config, detect, fetch, files


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docloom", description="Documentation sources to text files for language models.")
    top.add_argument("--config", default="config", help="folder of sdks.json and categories.json")
    top.add_argument("--verbose", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="write the text files of specifications, or of any source")
    g.add_argument("--sdk", help="an SDK's name, or all")
    g.add_argument("--sdk-version", default="latest", help="a version, latest, or all")
    g.add_argument("--source", help="a file or folder instead of an SDK")
    g.add_argument("--format", default="auto", help="the source's format")
    g.add_argument("--output", default="output")
    g.add_argument("--force", action="store_true", help="download even if a copy is there")
    g.add_argument("--title")
    g.add_argument("--prefix")
    sub.add_parser("list-sdks", help="show the SDKs and their versions")
    v = sub.add_parser("validate", help="read a specification and count what it has")
    v.add_argument("--sdk", required=True)
    v.add_argument("--sdk-version", default="latest")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    log.set_level(log.DEBUG if args.verbose else log.INFO)
    spark = spark or SparkSession.builder.appName("docloom").getOrCreate()
    today = datetime.date.today()
    date = f"{today:%B} {today.day}, {today.year}"
    cache = fetch.Cache(args.config)
    try:
        if args.command == "generate" and args.source:
            options = universal.Options(date=date, filename_prefix=args.prefix, title=args.title)
            log.plain(f"{generate.source(spark, args.source, args.output, args.format, options)} files in {args.output}")
            return 0
        conf = config.Config(spark, args.config)
        if args.command == "list-sdks":
            for r in config.pairs(conf.sdks()).join(conf.sdks().select("sdk", "version", "name", "displayName"), ["sdk", "version"]).orderBy("sdk_pos", "version_pos").collect():
                log.plain(f"{r['sdk']}\t{r['name']}\t{r['version']}\t{r['displayName']}")
            return 0
        if args.command == "validate":
            version = args.sdk_version if args.sdk_version != "latest" else config.first_listed(conf.sdk(args.sdk)).first()["version"]
            path = fetch.resolve(conf.version(args.sdk, version), cache)
            specs = openref.decode(files.texts_of(spark, [path]))
            row = specs.first()
            if row["error"]:
                raise detect.ParserError("openref", row["error"])
            s = openref.stats(specs).first()
            log.plain(f"{args.sdk} {version}: {s['operationCount']} operations, {s['exampleCount']} examples")
            return 0
        if not args.sdk:
            log.plain("generate needs --sdk or --source")
            return 1
        say = lambda o: log.plain(f"{o.sdk} {o.version}: " + (o.error or f"{o.operations} operations, {o.examples} examples, {o.files} files"))
        outcomes = generate.many(spark, conf, generate.tasks(conf, args.sdk, args.sdk_version), args.output, cache, date, args.force, say)
        return int(any(o.error for o in outcomes))
    except (config.ConfigError, fetch.FetchError, detect.ParserError) as e:
        log.plain(str(e))
        return 1


if __name__ == "__main__":
    sys.exit(main())
