"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, html_text, jpeg_writer, language_model, line_dedup, media, quality, simhash_dedup, token_counts, urls
from docloom.llm.shared import path_in_shared
from docloom.llm.tables import table

#: The vocabulary that the queries use; the operators take its path as a parameter.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Hosts that the URL query lists whole.
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.org", "ads-track.example.org")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that a group of near copies can spare, with the one that stays."""
    return simhash_dedup.duplicates(table(spark, sf_dir, "documents"))[0]


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log-probability under a model of all the documents."""
    return language_model.train_and_score(table(spark, sf_dir, "documents"))


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of the URL query: a few whole hosts, and the pages that are labelled toxic."""
    hosts = spark.createDataFrame([(f"{h}/",) for h in LISTED_HOSTS], "entry string")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    pages = table(spark, sf_dir, "pages").select("page_id", "url").join(toxic, "page_id", "left_semi")
    return hosts.unionByName(urls.with_parts(pages).select(urls.canonical().alias("entry")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its canonical URL and the listed entry that hits it, if one does."""
    return urls.judged(table(spark, sf_dir, "pages"), listed_urls(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are not rejected, with their scores."""
    found, score, threshold = quality.kept(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.col(score).alias("score"), F.col(threshold).alias("threshold"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without the lines that it shares with its pair."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, through a cache that an earlier count of the English ones has filled in part."""
    docs, cache = table(spark, sf_dir, "documents"), path_in_shared(spark, "token-cache")
    token_counts.counts(docs.where("lang = 'en'"), BYTE_BPE, cache)
    return token_counts.counts(docs, BYTE_BPE, cache)


def pictures(embeddings: DataFrame) -> DataFrame:
    """The embeddings as pictures: no table has media files, so each vector is drawn as one, by label in colour and with restarts."""

    @F.pandas_udf("binary")
    def draw(vector: pd.Series, label: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else jpeg_writer.picture(np.asarray(v, float), k % 2 == 1, k % 3 * 2) for v, k in zip(vector, label.fillna(0).astype(int), strict=True)], dtype=object)

    return embeddings.select("vec_id", draw("embedding", "label").alias("image"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions and thumbnail hashes of a picture of each embedding."""
    return media.media_columns(pictures(table(spark, sf_dir, "embeddings")), "vec_id", "image")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether decoding them gives the text again."""
    return bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps of documents with test items."""
    return decontaminate.overlaps_with(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that an earlier line replaces, with that line."""
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_dedup, op2_lm_score, op3_url_filter, op4_quality, op5_html_text, op6_token_counts, op7_media, op8_byte_bpe, op9_decontaminate, op10_line_dedup)
}

_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)), '\.?(?::(?:80|443)?)?$', ''), '^www\.', '')"
_PATH = r"regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '')"
_QUERY = rf"list_sort(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(?:{urls.TRACKING})(?:=|$)')))"
ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": f"""
with cut as (select page_id, url, nullif({_HOST}, '') as host, {_PATH} as path, {_QUERY} as q from pages),
whole as (select *, host || case when path = '' then '/' else path end as bare, case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as tail from cut),
keyed as (select distinct url, bare || tail as canonical_url, unnest(list_concat([bare || tail, bare],
    list_transform(range(1, len(string_split(path, '/')) + 1), lambda n: host || array_to_string(list_slice(string_split(path, '/'), 1, n), '/') || '/'),
    list_transform(range(2, len(string_split(host, '.'))), lambda n: array_to_string(list_slice(string_split(host, '.'), n, len(string_split(host, '.'))), '.') || '/'))) as key from whole where host is not null),
entries as (select unnest([{", ".join(f"'{h}/'" for h in LISTED_HOSTS)}]) as entry
    union select bare || tail from whole where page_id in (select doc_id from labels where toxic = 1) and host is not null),
best as (select url, entry, row_number() over (partition by url order by length(entry) desc, entry) as n from (select distinct url, entry from keyed join entries on key = entry))
select page_id, whole.url, bare || tail as canonical_url, entry from whole left join best on whole.url = best.url and n = 1
""",
}
