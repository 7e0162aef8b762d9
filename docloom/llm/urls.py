"""URL filtering: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed entry is a canonical URL, or a host or a path prefix of one with its closing slash. A URL is hit by
an entry that equals one of its keys: the canonical URL, the same without its query, and each of its parent
paths up to the bare host and that host's parent domains. The keys are made and hashed in the JVM; blocks of
256 bits, one bit in each of eight words, let possible hits pass; the hash join on the whole strings removes
those that only collide. A filter has MAX_BYTES at most: with more entries it lets more other keys pass to
the join, which gives the same rows.

Canonical form: lower-case scheme and host without user, default port, trailing dot and `www.`; no scheme and
no fragment; path without trailing slash (the bare host keeps one); query without tracking parameters, the
others sorted.

Defined results: a null URL, or one without a host, has no canonical form and is not hit. Null and empty
entries list nothing; repeated entries count once. Of several entries that hit, the longest is reported, then
the first in order. Rows repeat as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import cut, free_name, maybe_broadcast, scratch, whole_id

#: Names of query parameters that do not choose a page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
BITS_PER_KEY = 12
MAX_BYTES = 64 << 20
_SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def host_of(url: Column) -> Column:
    """Null without a host."""
    raw = F.lower(F.regexp_extract(F.btrim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(raw, r"\.?(?::(?:80|443)?)?$", ""), r"^www\.", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Without trailing slashes; empty at the top."""
    return F.regexp_replace(F.regexp_extract(F.btrim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), "/+$", "")


def _query_of(url: Column) -> Column:
    raw = F.regexp_extract(F.btrim(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(raw, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)")))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")


def with_parts(rows: DataFrame) -> DataFrame:
    """With columns __host, __path and __query of column url, each computed once."""
    url = F.col("url")
    return rows.withColumns({"__host": host_of(url), "__path": path_of(url), "__query": _query_of(url)})


def _bare() -> Column:
    return F.concat("__host", F.when(F.col("__path") == "", "/").otherwise(F.col("__path")))


def canonical() -> Column:
    """Of a row `with_parts`."""
    return F.concat(_bare(), "__query")


def keys() -> Column:
    """Everything an entry can be to hit the URL of a row `with_parts`; null for a URL without a host."""
    host, steps, labels = F.col("__host"), F.split("__path", "/"), F.split("__host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat(host, F.array_join(F.slice(steps, 1, n), "/"), F.lit("/")))
    ups = F.when(F.size(labels) > 2, F.sequence(F.lit(2), F.size(labels) - 1)).otherwise(F.array().cast("array<int>"))
    domains = F.transform(ups, lambda n: F.concat(F.array_join(F.slice(labels, n, F.size(labels)), "."), F.lit("/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(F.array(canonical(), _bare()), parents, domains)))


class BlockedBloom:
    """A filter of 64-bit hashes: each has one block of eight 32-bit words and one bit in each of them."""

    def __init__(self, n: int) -> None:
        self.blocks = max(1, min(MAX_BYTES // 32, -(-n * BITS_PER_KEY // 256)))
        self.words = np.zeros(self.blocks * 8, np.uint32)

    @staticmethod
    def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        u = h.view(np.uint64)
        low = u & np.uint64(0xFFFFFFFF)
        block = ((u >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        bit = ((low[:, None] * _SALT) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        return (block[:, None] * np.uint64(8) + np.arange(8, dtype=np.uint64)).astype(np.int64), (np.uint64(1) << bit).astype(np.uint32)

    def partial(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, their values) of a filter of these hashes."""
        at, bit = (x.ravel() for x in self._places(h, self.blocks))
        order = np.argsort(at, kind="stable")
        at, bit = at[order], bit[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return at[first], np.bitwise_or.reduceat(bit, first)

    def add(self, h: np.ndarray) -> None:
        if len(h):
            at, value = self.partial(h)
            self.words[at] |= value

    def may_have(self, h: np.ndarray) -> np.ndarray:
        at, bit = self._places(h, self.blocks)
        return ((self.words[at] & bit) == bit).all(1)


def bloom_of(entries: DataFrame, n: int) -> BlockedBloom:
    """The filter of column `entry`, made from the tasks' partial filters."""
    out = BlockedBloom(n)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [b.column("h").to_numpy() for b in batches]
        if sum(map(len, hashes)):
            at, value = BlockedBloom(n).partial(np.concatenate(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value.astype(np.int64))], ["at", "word"])

    got = entries.select(F.xxhash64("entry").alias("h")).mapInArrow(partial, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out.words[got["at"].to_numpy()] = got["word"].to_numpy().astype(np.uint32)
    return out


def hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """(url, entry) of each distinct URL that an entry hits. `urls` has a column url, `listed` a column entry."""
    spark = urls.sparkSession
    entries, _ = cut(listed.select(F.col("entry").cast("string").alias("entry")).where("entry is not null and entry <> ''").distinct(), "listed")
    n = entries.count()
    keyed = with_parts(urls.select(F.col("url").cast("string").alias("url"))).select("url", F.explode(keys()).alias("key"))
    shared = spark.sparkContext.broadcast(bloom_of(entries, n))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.may_have(h.to_numpy(np.int64)), index=h.index)

    met = keyed.where(possible(F.xxhash64("key"))).join(maybe_broadcast(entries, n, 80), F.col("key") == F.col("entry"))
    return met.groupBy("url").agg(F.min(F.struct(-F.length("entry"), "entry")).alias("e")).select("url", F.col("e.entry").alias("entry"))


def judged(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Every page as (page_id, url, canonical_url, entry): the entry that lists it, null for a page that may stay."""
    rows = pages.select(whole_id(pages, "page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    with scratch(pages.sparkSession):
        found, _ = cut(hits(rows, listed), "url-hits", keep=True)
    return with_parts(rows).join(maybe_broadcast(found, found.count(), 160), "url", "left").select("page_id", "url", canonical().alias("canonical_url"), "entry")


def allowed(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """The pages that no entry hits, all columns as they were."""
    with scratch(pages.sparkSession):
        found, _ = cut(hits(pages.select(F.col("url").cast("string").alias("url")), listed), "url-hits", keep=True)
    key = free_name(pages, "__gone")
    gone = found.select(F.col("url").alias(key))
    return pages.join(maybe_broadcast(gone, found.count(), 80), pages["url"].cast("string") == gone[key], "left_anti")
