"""Configuration files as tables: SDKs with their versions, and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import schema as S


class ConfigError(Exception):
    pass


def sdks_of(texts: DataFrame) -> DataFrame:
    """(sdk, sdk_pos, name, language, version, version_pos, displayName, spec, output) of JSON texts, in file order."""
    parsed = texts.select(F.from_json("text", S.SDKS).alias("j"))
    sdk = parsed.select(F.posexplode(F.map_entries("j.sdks")).alias("sdk_pos", "e"))
    versions = F.posexplode_outer(F.map_entries("e.value.versions")).alias("version_pos", "v")
    rows = sdk.select(F.col("e.key").alias("sdk"), "sdk_pos", "e.value.name", "e.value.language", versions)
    spec = F.struct(F.col("v.value.spec.url").alias("url"), F.col("v.value.spec.localPath").alias("localPath"), F.coalesce("v.value.spec.format", F.lit("openref-0.1")).alias("format"))
    return rows.select("sdk", "sdk_pos", "name", "language", F.col("v.key").alias("version"), "version_pos", F.col("v.value.displayName").alias("displayName"), spec.alias("spec"), F.col("v.value.output").alias("output"))


def categories_of(texts: DataFrame) -> DataFrame:
    """(category, cat_pos, title, description, systemPrompt, operations, order) of JSON texts, in file order."""
    parsed = texts.select(F.from_json("text", S.CATEGORIES).alias("j"))
    rows = parsed.select(F.posexplode(F.map_entries("j.categories")).alias("cat_pos", "e"))
    return rows.select(F.col("e.key").alias("category"), "cat_pos", "e.value.title", "e.value.description", "e.value.systemPrompt", "e.value.operations", F.col("e.value.order").alias("order"))


def sdk_problem() -> Column:
    """What is wrong with an SDK row, null if nothing is."""
    url = F.col("spec.url").rlike("^[A-Za-z][A-Za-z0-9+.-]*:.+")
    whole = F.col("name").isNotNull() & F.col("language").isNotNull() & F.col("displayName").isNotNull() & F.col("output.baseDir").isNotNull() & F.col("output.filenamePrefix").isNotNull()
    return F.when(F.col("version").isNull(), F.lit(None)).when(~whole, "a required field is missing or of another type").when(~F.coalesce(url, F.lit(False)), "spec.url is not a URL")


def category_problem() -> Column:
    whole = F.col("title").isNotNull() & F.col("description").isNotNull() & F.col("systemPrompt").isNotNull() & F.col("operations").isNotNull() & F.forall(F.coalesce("operations", F.array(F.lit(None).cast("string"))), lambda o: o.isNotNull())
    order = (F.col("order") > 0) & (F.col("order") == F.floor("order"))
    return F.when(~whole, "a required field is missing or of another type").when(~F.coalesce(order, F.lit(False)), "order is not a positive whole number")


def checked(rows: DataFrame, problem: Column, name: str) -> DataFrame:
    """(name, valid, error): the check that doesn't throw."""
    return rows.select(F.col(name), problem.isNull().alias("valid"), problem.alias("error"))


def by_order(categories: DataFrame) -> DataFrame:
    return categories.orderBy("order", "cat_pos")


def listed_operations(categories: DataFrame) -> DataFrame:
    """(category, cat_pos, op_pos, op_id): what each category lists."""
    return categories.select("category", "cat_pos", F.posexplode("operations").alias("op_pos", "op_id"))


def version_number(version: Column) -> Column:
    """All digits of a version's name as one number; 0 without digits or with too many."""
    return F.coalesce(F.regexp_replace(version, "\\D", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def latest(sdks: DataFrame) -> DataFrame:
    """(sdk, version): of the greatest number, the first one listed."""
    best = Window.partitionBy("sdk").orderBy(version_number(F.col("version")).desc(), "version_pos")
    return sdks.where("version is not null").withColumn("__n", F.row_number().over(best)).where("__n = 1").select("sdk", "version")


def first_listed(sdks: DataFrame) -> DataFrame:
    """(sdk, version): the first one listed, which is what a download of the latest takes."""
    return sdks.where("version is not null").groupBy("sdk").agg(F.min_by("version", "version_pos").alias("version"))


def pairs(sdks: DataFrame) -> DataFrame:
    """Every SDK with each of its versions, in file order."""
    return sdks.where("version is not null").select("sdk", "version", "sdk_pos", "version_pos").orderBy("sdk_pos", "version_pos")


class Config:
    """Both files, checked, with lookups that fail by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        read = lambda f: spark.read.text(f"{folder}/{f}", wholetext=True).selectExpr("value AS text")
        self._sdks = sdks_of(read("sdks.json")).cache()
        self._categories = categories_of(read("categories.json")).cache()
        for rows, problem, key in ((self._sdks, sdk_problem(), "sdk"), (self._categories, category_problem(), "category")):
            bad = checked(rows, problem, key).where("not valid").first()
            if bad or rows.isEmpty():
                raise ConfigError(f"{bad[0]}: {bad[2]}" if bad else f"no {key} in {folder}")

    def sdks(self) -> DataFrame:
        return self._sdks

    def categories(self) -> DataFrame:
        return self._categories

    def sdk(self, name: str) -> DataFrame:
        found = self._sdks.where(F.col("sdk") == name)
        if found.isEmpty():
            raise ConfigError(f"unknown SDK: {name}")
        return found

    def category(self, name: str) -> DataFrame:
        found = self._categories.where(F.col("category") == name)
        if found.isEmpty():
            raise ConfigError(f"unknown category: {name}")
        return found

    def version(self, sdk: str, version: str = "latest"):
        """The row of a version; `latest` is the one of the greatest number."""
        rows = self.sdk(sdk).where("version is not null")
        if version == "latest":
            got = latest(rows).first()
            if got is None:
                raise ConfigError(f"{sdk} has no versions")
            version = got["version"]
        found = rows.where(F.col("version") == version).first()
        if found is None:
            raise ConfigError(f"unknown version {version} of {sdk}; there are {', '.join(r[0] for r in rows.orderBy('version_pos').select('version').collect())}")
        return found

    def has_sdk(self, name: str) -> bool:
        return not self._sdks.where(F.col("sdk") == name).isEmpty()

    def has_category(self, name: str) -> bool:
        return not self._categories.where(F.col("category") == name).isEmpty()

    def clear(self) -> None:
        self._sdks.unpersist()
        self._categories.unpersist()
