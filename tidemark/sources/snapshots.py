"""Series snapshots as JSON files: reading, broken ones aside, and a table of them that changes by commits.

A series is one file below its source and name: keys in order, one point a line,
so equal content gives equal bytes. A commit writes the files that changed into
a folder of its own name and then a manifest that says for every series where its
file is; readers follow the last whole manifest.

    data/name=<commit>/source=<source>/slug=<slug>/    one file
    log/number=<n>/                                    series, place and digest
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.commits import following, head
from tidemark.functions.numbers import text_of
from tidemark.functions.text import slugify
from tidemark.store import written

VERSION = 1
#: Entries of meta that are columns of the raw schema, and how each is read back.
COLUMNS = {"fetched_at": "timestamp", "partial_rule": "string", "upload_date": "date", "last_period_incomplete": "boolean", "truncated_before": "date"}
NAMES = {"last_period_incomplete": "last_incomplete"}
POINTS = "array<struct<ts:string,value:double,contributors:double,top_share:double,raw_count:double,imputed:boolean>>"
SCHEMA = f"series string, source string, query string, freq string, scale string, meta map<string,string>, points {POINTS}, _broken string"
MANIFEST = "series string, source string, slug string, name string, digest string"


def files_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], f"{SCHEMA}, file string")
    options = {"multiLine": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "recursiveFileLookup": True}
    return spark.read.schema(SCHEMA).options(**options).json(paths).withColumn("file", F.input_file_name())


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw buckets with their file, broken files)."""
    at = lambda k: F.try_element_at("meta", F.lit(k))
    good = F.col("_broken").isNull() & F.col("source").isNotNull() & F.coalesce(F.col("freq").isin("D", "W", "M"), F.lit(False)) & at("fetched_at").isNotNull()
    rows = files.where(good).select("file", "source", F.col("query").alias("topic"), "freq", "scale", "meta", F.coalesce("series", F.concat_ws("/", "source", "query", "freq")).alias("series_id"), F.posexplode("points").alias("ordinal", "p"))
    entry = lambda k, kind: F.substring(at(k), 1, 10).try_cast(kind) if kind == "date" else at(k).try_cast(kind)
    raw = rows.select(
        "series_id", "topic", "source", "freq", "scale", F.to_date(F.substring("p.ts", 1, 10)).alias("ts"), "p.value",
        F.col("p.contributors").cast("long").alias("contributors"), "p.top_share", F.col("p.raw_count").cast("long").alias("raw_count"), F.coalesce("p.imputed", F.lit(False)).alias("imputed"),
        F.col("ordinal").cast("long").alias("ordinal"), *[entry(k, kind).alias(NAMES.get(k, k)) for k, kind in COLUMNS.items()], "meta", "file",
    )
    return raw, files.where(~good).select("file")


def read(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(raw buckets, broken files) of snapshot files. A file without source, frequency or fetch time is broken too.

    meta keeps every entry of the file; those of COLUMNS are columns besides.
    """
    raw, broken = parsed(files_of(spark, list(paths)))
    return raw.drop("file"), broken


def meta_of(raw: DataFrame) -> Column:
    """All of a row's meta as a map of texts: its own entries, and the columns of the raw schema over them."""
    own = F.coalesce("meta", F.create_map().cast("map<string,string>")) if "meta" in raw.columns else F.create_map().cast("map<string,string>")
    shown = {"fetched_at": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), "upload_date": lambda c: F.date_format(c, "yyyy-MM-dd"), "truncated_before": lambda c: F.date_format(c, "yyyy-MM-dd")}
    told = [F.struct(F.lit(k).alias("key"), shown.get(k, lambda c: c.cast("string"))(F.col(NAMES.get(k, k))).alias("value")) for k in COLUMNS if NAMES.get(k, k) in raw.columns]
    said = F.map_from_entries(F.filter(F.array(*told), lambda e: e["value"].isNotNull()))
    return F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(said, k)), said)


def texts(raw: DataFrame) -> DataFrame:
    """(series, source, slug, text, digest) of each series: its file, and a digest of all but its fetch time."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    point = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("ts"), finite.alias("value"), "contributors", "top_share", "raw_count", "imputed")
    line = F.to_json(point, {"ignoreNullFields": "false"})
    meta = F.array_sort(F.map_entries(meta_of(raw)))
    rows = raw.groupBy("series_id", "topic", "source", "freq", "scale").agg(F.array_sort(F.collect_list(F.struct("ts", "ordinal", line.alias("line"))))["line"].alias("lines"), F.max(meta).alias("meta"))
    json = lambda meta: F.to_json(F.struct("freq", F.map_from_entries(meta).alias("meta"), F.col("topic").alias("query"), "scale", F.lit(VERSION).alias("schema"), F.col("series_id").alias("series"), "source"))
    whole = lambda meta: F.concat(F.regexp_replace(json(meta), r"\}$", ""), F.lit(',"points":[\n'), F.array_join("lines", ",\n"), F.lit("\n]}"))
    bare = F.filter("meta", lambda e: e["key"] != "fetched_at")
    slug = F.concat_ws("-", F.nullif(slugify(F.col("series_id")), F.lit("")), F.substring(F.md5("series_id"), 1, 6))
    return rows.select(F.col("series_id").alias("series"), "source", slug.alias("slug"), whole(F.col("meta")).alias("text"), F.sha2(whole(bare), 256).alias("digest"))


def manifest(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/log/number={number}") if number else spark.createDataFrame([], MANIFEST)


def write(raw: DataFrame, path: str) -> DataFrame:
    """Commits series to the table at path; the names (series) of those whose files were written.

    A series of which nothing but the fetch time changed keeps its file. Series
    that are not in raw stay.
    """
    spark = raw.sparkSession
    at, name = head(spark, path), uuid.uuid4().hex
    number, before = following(spark, path), manifest(spark, path, at)
    every = written(texts(raw), "snapshot_texts")
    new = every.join(before.select("series", "digest"), ["series", "digest"], "left_anti")
    new.repartition("source", "slug").select("source", "slug", F.col("text").alias("value")).write.partitionBy("source", "slug").text(f"{path}/data/name={name}")
    said = written(new.select("series", "source", "slug", F.lit(name).alias("name"), "digest"), "snapshot_new")
    before.join(said.select("series"), "series", "left_anti").unionByName(said).write.parquet(f"{path}/log/number={number}")
    return said.select("series")


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """read() of the files that the last whole commit names; folders are as many as commits that still have a file in it."""
    places = manifest(spark, path, head(spark, path)).select(F.col("series").alias("series_id"), "name")
    folders = [f"{path}/data/name={r.name}" for r in places.select("name").distinct().collect()]
    raw, broken = parsed(files_of(spark, folders))
    name = F.regexp_extract("file", "/name=([0-9a-f]+)/", 1)
    return raw.withColumn("name", name).join(places, ["series_id", "name"], "left_semi").drop("name", "file"), broken


def write_collected(days: DataFrame, path: str) -> None:
    """Collected days as CSV below series=: days in order, shares with four decimals, unknown ones blank."""
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), F.col("value").cast("long").cast("string"), F.col("contributors").cast("string"), F.coalesce(text_of(F.col("top_share"), 4), F.lit("")))
    whole = days.groupBy(F.col("series_id").alias("series")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    whole.repartition("series").select("series", F.concat(F.lit("date,count,contributors,top_share\n"), "lines").alias("value")).write.mode("overwrite").partitionBy("series").text(path)


def age(fetched_at, now):
    """Whole days since the fetch, 0 at least."""
    return F.greatest(F.datediff(now, fetched_at), F.lit(0))
