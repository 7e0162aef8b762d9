"""Main text of web pages by differencing each page with its nearest page of the same host.

A page becomes lines of text: blocks of the markup end a line, inline marks don't. What a host repeats from
page to page (menus, banners, footers) is found by comparison: each line of a page names the nearest page by
URL path, before and after it within the host, that has the line too, and the page named by most lines is the
pair; of several the nearest before it, else the nearest after it. The lines of the two are aligned by longest
common subsequence, and the lines in it are deleted from the page.

Pairs are found without gathering a host anywhere: lines are ranked by (host, line, place of the page in URL
order) over range partitions, which may end within a host and within a line's run; the runs are joined over
the ends of partitions. Only hashes of lines are exchanged; texts are cut again where the page lies.

A copy of a page says nothing about the host's template and is no pair for it. Lines that more than FEW pages
and more than MOST of a host's pages have are its template for sure and don't count in what follows; a page
that has no other lines has nothing to keep and no pair. A page that shares more than COPY_SHARE of its text with another is a copy of that page, unless it is a short page of the other's template:
what they share is less of the other's text, and it is not the page's body, the lines that at most FEW pages of
the table have. Copies are grouped transitively, and a line whose nearest page is in the group of its own
page names the next page in the line's run that isn't. If that one turns out to be a copy too, it is no pair.

Defined results: a null html has a null text; an empty page, or one of markup only, an empty text. A page
without a pair (a null or hostless URL, a host with one page, nothing shared) keeps all lines. Repeated rows
of one page count once and get the same text. Unclosed comments, scripts and styles reach to the end; an
unclosed head ends where the page's body begins.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import textvec as tv
from docloom.llm.components import components
from docloom.llm.shared import cut, delete, maybe_broadcast, scratch, small_batches, whole_id
from docloom.llm.urls import host_of, path_of

#: Share of a page's text, and of its body, from which on what it has in common with another makes it a copy.
COPY_SHARE = 0.75
#: Share of its host's pages past which a line is template for sure.
MOST = 0.75
#: Pages of the table that a line of a body is on at most: templates are on more, copies of one page seldom are.
FEW = 3
#: What is no markup inside; unclosed, it reaches to the end.
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Parts without text for readers: whole if they are closed, else only their tags. A head ends where the page begins, too.
_PARTS = re.compile(
    r"<svg\b[^>]*/>|<(noscript|template|svg)\b[^>]*>.*?</\1\s*>"
    r"|<head\b[^>]*>(?:(?!<(?:body|p|div|main|article|section|nav|header|footer|aside|h[1-6]|ul|ol|dl|table|form|pre|blockquote|a|img|span|hr)\b).)*?(?:</head\s*>|(?=<(?:body|p|div|main|article|section|nav|header|footer|aside|h[1-6]|ul|ol|dl|table|form|pre|blockquote|a|img|span|hr)\b)|\Z)",
    re.S | re.I,
)
_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|bdo|cite|code|data|dfn|em|font|i|kbd|label|mark|q|s|samp|small|span|strong|sub|sup|time|tt|u|var|wbr)\b[^>]*>", re.I)
_TAG = re.compile(r"<(?:/?[A-Za-z][^>]*|![^>]*|\?[^>]*)>")


def lines_of(page: str) -> list[str]:
    """The lines of a page that have text, white space squeezed."""
    page = _TAG.sub("\n", _INLINE.sub("", _PARTS.sub(" ", _RAW.sub(" ", page))))
    return [y for x in html.unescape(page).split("\n") if (y := " ".join(x.split()))]


def _hashed(lines: list[str]) -> np.ndarray:
    data, offsets = tv.flat(pa.array(lines, pa.large_string()))
    return tv.text_hash(data, offsets).view(np.int64)


def common(a: list[int], b: list[int]) -> list[int]:
    """The places of `a` in a longest common subsequence of the two: of several, the one found from the end on.

    Elements that only one has can be in none, so they are left out first. Rows of the table are bit sets
    held in integers, one bit for each element of `b`.
    """
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    b = [x for x in b if x in both]
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for i in at:
        rows.append(v)
        u = v & where[a[i]]
        v = ((v + u) | (v - u)) & full
    # bit j of a row is clear where the length grows with element j, so lengths are counts of clear bits
    out, j = [], len(b)
    now = v
    for k in range(len(at) - 1, -1, -1):
        low = (1 << j) - 1
        before, here = rows[k] & low, now & low
        if here.bit_count() < before.bit_count():  # element k adds to the length
            out.append(at[k])
            j = _last_match(where[a[at[k]]], before, here, j)
        now = rows[k]
    return out[::-1]


def _last_match(match: int, before: int, here: int, j: int) -> int:
    """The place below j that element k is matched to: the longest prefix of `b` that gains by it, less its last element."""
    want = j - here.bit_count()
    while j:
        low = (1 << (j - 1)) - 1
        if (j - 1) - (here & low).bit_count() < want:
            return j - 1
        j -= 1
    return 0


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's lines by hash, and the bytes that each distinct one makes up, in the order they come first."""
    for batch in batches:
        kept, hashes, sizes = [], [], []
        for i, page in enumerate(batch.column("html")):
            text = lines_of(page.as_py())
            if text:
                kept.append(i)
                h = _hashed(text)
                size: dict[int, int] = {}
                for x, t in zip(h.tolist(), text, strict=True):
                    size[x] = size.get(x, 0) + len(t)
                hashes.append(h)
                sizes.append(list(size.values()))
        same = batch.take(pa.array(kept, pa.int64()))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(same.column(c) for c in ("host", "page_id", "uid")), pa.array(hashes, longs), pa.array(sizes, longs)],
            ["host", "page_id", "uid", "hashes", "sizes"],
        )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each row to the next in its run of one key; and the partition's first and last row.

    Rows are sorted by (key, place); of a link, `size` is that of the line.
    """
    part, last, first = TaskContext.get().partitionId(), None, None
    names = ["kind", "part", "key", "a", "b", "size"]
    for batch in batches:
        if not batch.num_rows:
            continue
        key, place, size = (batch.column(c).to_numpy() for c in ("key", "place", "size"))
        if first is None:
            first = key[0], place[0], size[0]
        if last is not None:
            key, place, size = (np.concatenate(([x], y)) for x, y in zip(last, (key, place, size), strict=True))
        last = key[-1], place[-1], size[-1]
        same = np.flatnonzero(key[1:] == key[:-1])
        if len(same):
            n = len(same)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), *map(pa.array, (key[same], place[same], place[same + 1], size[same]))], names)
    if first is not None:
        ends = [first, last]
        yield pa.RecordBatch.from_arrays(
            [pa.array([1, 2], pa.int32()), pa.array([part] * 2, pa.int32()), pa.array([int(e[0]) for e in ends]), pa.array([int(e[1]) for e in ends]), pa.array([0, 0]), pa.array([int(e[2]) for e in ends])], names
        )


def _links(occurrences: DataFrame) -> DataFrame:
    """(key, a, b, size) for each row and the next in the runs of (key, place, size) rows, which may be longer than a partition."""
    ranged = occurrences.repartitionByRange("key", "place").sortWithinPartitions("key", "place")
    found, _ = cut(ranged.mapInArrow(_neighbours, "kind int, part int, key long, a long, b long, size long"), "links")
    # two rows for each partition: joining the runs over their ends takes one small window
    ends = found.where("kind > 0").withColumn("up", F.lag(F.struct("part", "key", "a")).over(Window.orderBy("part", "kind")))
    over = ends.where("kind = 1 and up.part <> part and up.key = key").select("key", F.col("up.a").alias("a"), F.col("a").alias("b"), "size")
    return found.where("kind = 0").select("key", "a", "b", "size").unionByName(over)


def _both_ways(links: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return links.select("key", ends.alias("e"), "size").select("key", "e.a", "e.b", "size")


def _past_copies(links: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """The links, those within a group of copies moved on along their run to the next page outside it.

    All pages that a link skips are in its page's group, so the pages it meets have skipped as many: rounds
    grow with the logarithm of the number of copies.
    """
    group = maybe_broadcast(roots, n)

    def marked(some: DataFrame) -> DataFrame:
        of = lambda end: group.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}"))
        both = some.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.select("key", "a", "b", "size", (F.coalesce("of_a", "a") == F.coalesce("of_b", "b")).alias("stuck"))

    # of all links only those that are stuck are written again
    now = marked(links)
    done, stuck = now.where("not stuck").drop("stuck"), cut(now.where("stuck").drop("stuck"), "links")[0]
    every = links
    while stuck.limit(1).count():
        on = every.select("key", F.col("a").alias("b"), F.col("b").alias("c"))
        now, _ = cut(marked(stuck.join(on, ["key", "b"]).where("(b > a) = (c > b)").select("key", "a", F.col("c").alias("b"), "size")), "links")
        done, stuck = done.unionByName(now.where("not stuck").drop("stuck")), now.where("stuck").drop("stuck")
        every = done.unionByName(stuck)
    return done


def _votes(links: DataFrame, pages: DataFrame, ways: int) -> DataFrame:
    """(a, b, votes, copy) for each page b that lines of a name; the sizes of lines of a body are negative. Links of two ways are given one way."""
    votes = links.groupBy("a", "b").agg(F.count("*").alias("votes"), F.sum(F.abs("size")).alias("common"), F.sum(F.greatest(-F.col("size"), F.lit(0))).alias("both"))
    of = lambda end: pages.select(F.col("place").alias(end), F.struct(F.col("place").alias("at"), "total", "body").alias(f"of_{end}"))
    way = lambda a, b: F.struct(F.col(f"of_{a}").alias("mine"), F.col(f"of_{b}").alias("theirs"))
    met = votes.join(of("a"), "a").join(of("b"), "b").select("votes", "common", "both", F.explode(F.array(*[way("a", "b"), way("b", "a")][:ways])).alias("e"))
    met = met.select(F.col("e.mine.at").alias("a"), F.col("e.theirs.at").alias("b"), "votes", "common", "both", "e.mine.total", "e.mine.body", F.col("e.theirs.total").alias("other")).where("total > 0")
    most = lambda c: F.col("common") > COPY_SHARE * F.col(c)
    copy = most("total") & (most("other") | (F.col("body") == 0) | (F.col("both") > COPY_SHARE * F.col("body")))
    return cut(met.select("a", "b", "votes", copy.alias("copy")), "votes")[0]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = [common(a, b) for a, b in zip(batch.column("hashes").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("pair_id"), pa.array(gone, pa.list_(pa.int32()))], ["uid", "pair_id", "gone"])


def shared_lines(rows: DataFrame) -> DataFrame:
    """(uid, pair_id, gone): the pair of each page that has one, and the numbers of its lines to delete."""
    held = rows.where("host is not null and html is not null")
    order = ["host", "path", "page_id", "uid"]
    # the id grows along the sorted partitions, so it is the place in URL order; lines aren't moved for it
    places, _ = cut(held.select(*order).dropDuplicates(["uid"]).repartitionByRange(*order).sortWithinPartitions(*order).select("uid", F.monotonically_increasing_id().alias("place")), "places")
    texts = held.select(F.xxhash64("host").alias("host"), "page_id", "uid", "html")
    lined = texts.mapInArrow(_line_rows, "host long, page_id long, uid binary, hashes array<long>, sizes array<long>").dropDuplicates(["uid"])
    pages, _ = cut(lined.join(maybe_broadcast(places, places.count(), 24), "uid").select("place", "page_id", "uid", "host", "hashes", "sizes"), "page-lines")
    each = pages.select("place", "host", F.explode(F.arrays_zip(F.array_distinct("hashes").alias("line"), F.col("sizes").alias("size"))).alias("l")).select("place", "host", "l.line", "l.size")
    # of a line: 0 on most pages of its host, -1 on few pages of the table, else 1
    per_host, of_hosts = cut(each.groupBy("host", "line").agg(F.count("*").alias("on")), "host-lines")
    # the lines that are on more pages are the fewer, so these are joined
    often, _ = cut(per_host.groupBy("line").agg(F.sum("on").alias("all")).where(F.col("all") > FEW).select("line", F.lit(1).alias("often")), "often-lines")
    hosts = pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > FEW)
    most, _ = cut(per_host.where(F.col("on") > FEW).join(maybe_broadcast(hosts, hosts.count()), "host").where(F.col("on") > MOST * F.col("n")).select("host", "line", F.lit(0).alias("most")), "most-lines")
    delete(rows.sparkSession, of_hosts)
    marked = each.join(maybe_broadcast(often, often.count()), "line", "left").join(maybe_broadcast(most, most.count(), 24), ["host", "line"], "left")
    seen, of_keys = cut(marked.select(F.xxhash64("host", "line").alias("key"), "place", (F.col("size") * F.coalesce("most", "often", F.lit(-1))).alias("size")), "page-keys")
    sums = seen.groupBy("place").agg(F.sum(F.abs("size")).alias("total"), F.sum(F.greatest(-F.col("size"), F.lit(0))).alias("body"))
    sums, _ = cut(sums, "page-sizes")
    links = _links(seen)
    delete(rows.sparkSession, of_keys)
    named = _votes(links, sums, 2)
    copies = named.where("copy").select("a", "b")
    if copies.limit(1).count():
        named = _votes(_past_copies(_both_ways(links), *components(copies)), sums, 1)
    named = named.where("not copy")
    near = F.struct("votes", (F.col("b") < F.col("a")).alias("earlier"), F.when(F.col("b") < F.col("a"), F.col("b")).otherwise(-F.col("b")).alias("near"))
    pairs = named.groupBy("a").agg(F.max_by("b", near).alias("b"))
    mine = pages.select(F.col("place").alias("a"), "uid", "hashes")
    theirs = pages.select(F.col("place").alias("b"), F.col("page_id").alias("pair_id"), F.col("hashes").alias("other"))
    return pairs.join(mine, "a").join(theirs, "b").select("uid", "pair_id", "hashes", "other").mapInArrow(_aligned, "uid binary, pair_id long, gone array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, pair_id, n_lines, n_deleted, text) of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(whole_id(pages, "page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    uid = F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "url", "html")))
    rows = rows.withColumn("uid", uid)
    with scratch(pages.sparkSession):
        found, _ = cut(shared_lines(rows), "shared-lines", keep=True)

    @F.pandas_udf("n_lines int, n_deleted int, text string")
    def kept(page: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for p, g in zip(page, gone, strict=True):
            if p is None:
                out.append((None, None, None))
                continue
            text = lines_of(p)
            drop = set() if g is None else set(g.tolist())
            out.append((len(text), len(drop), "\n".join(x for i, x in enumerate(text) if i not in drop)))
        return pd.DataFrame({"n_lines": pd.array([o[0] for o in out], "Int32"), "n_deleted": pd.array([o[1] for o in out], "Int32"), "text": pd.Series([o[2] for o in out], dtype=object)})

    met = rows.join(maybe_broadcast(found, found.count(), 120), "uid", "left")
    return met.select("page_id", "url", "pair_id", kept("html", "gone").alias("k")).select("page_id", "url", "pair_id", "k.*")
