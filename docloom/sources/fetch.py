"""Finding a specification: a local file, the cache, or a download that is then cached."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT_S = 30


class FetchError(Exception):
    pass


@dataclass(frozen=True)
class Cache:
    """Downloaded specifications in one folder, named by prefix, SDK and version; they don't expire."""

    folder: str = "config"
    prefix: str = "spec_"

    def path(self, sdk: str, version: str) -> str:
        return os.path.join(self.folder, f"{self.prefix}{sdk}_{version}.yml")

    def has(self, sdk: str, version: str) -> bool:
        return os.path.exists(self.path(sdk, version))

    def get(self, sdk: str, version: str) -> str | None:
        return self.path(sdk, version) if self.has(sdk, version) else None

    def clear(self, sdk: str | None = None, version: str | None = None) -> int:
        """Remove one entry if both are given, else everything; how many went."""
        if sdk and version:
            names = [os.path.basename(self.path(sdk, version))]
        else:
            names = [n for n in (os.listdir(self.folder) if os.path.isdir(self.folder) else []) if n.startswith(self.prefix) and n.endswith(".yml")]
        gone = [n for n in names if os.path.exists(os.path.join(self.folder, n))]
        for n in gone:
            os.remove(os.path.join(self.folder, n))
        return len(gone)


def download(url: str, timeout: float = TIMEOUT_S) -> str:
    """The body of a GET; any status but 200 is an error, and nothing is tried again."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            if answer.status not in (200, None):
                raise FetchError(f"{url}: status {answer.status}")
            return answer.read().decode("utf-8")
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        raise FetchError(f"{url}: {e}") from e


def download_to(url: str, path: str, timeout: float = TIMEOUT_S) -> str:
    text = download(url, timeout)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def resolve(row, cache: Cache, force: bool = False) -> str:
    """The path of a version's specification (a row of the SDK table)."""
    local = row["spec"]["localPath"]
    if local and not force and os.path.exists(local):
        return local
    if not force and cache.has(row["sdk"], row["version"]):
        return cache.path(row["sdk"], row["version"])
    return download_to(row["spec"]["url"], cache.path(row["sdk"], row["version"]))


def plan(versions: DataFrame, force: bool = False) -> DataFrame:
    """Where each version would come from, given whether its files are there (columns local_exists, cache_exists)."""
    way = F.when(F.lit(not force) & F.col("spec.localPath").isNotNull() & (F.col("spec.localPath") != "") & F.col("local_exists"), "local").when(F.lit(not force) & F.col("cache_exists"), "cache").otherwise("download")
    return versions.withColumn("way", way)


def downloads(urls: DataFrame, timeout: float = TIMEOUT_S) -> DataFrame:
    """(url, text, error) of many URLs, fetched by the tasks."""

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    rows.append((url, download(url, timeout), None))
                except FetchError as e:
                    rows.append((url, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "text", "error"])

    return urls.select("url").mapInPandas(fetch, "url string, text string, error string")
