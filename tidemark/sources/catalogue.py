"""A folder of a source's snapshot files, chosen by preference: JSON before CSV, a CSV with its sidecar.

Files are named by the slug of their topic: slug.json, slug.csv and slug.meta.json,
which tells when the CSV was fetched. What is chosen is told by names alone: a
listing does not read the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import csv, snapshots
from tidemark.sources.contracts import caveats_of

#: By ending, the longest first.
KINDS = {".meta.json": "sidecar", ".json": "json", ".csv": "csv"}
FAULT = "slug string, file string, reason string"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, slug, kind, modified) of the files that are named as snapshots."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("modified"))
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.coalesce(*[F.when(file.endswith(end), k) for end, k in KINDS.items()])
    slug = F.coalesce(*[F.when(file.endswith(end), F.left(file, F.length(file) - len(end))) for end in KINDS])
    return files.select("path", file.alias("file"), slug.alias("slug"), kind.alias("kind"), "modified").where("kind is not null")


def preferred(files: DataFrame) -> DataFrame:
    """One file of each slug: its JSON, else its CSV."""
    json = files.where("kind = 'json'")
    return json.unionByName(files.where("kind = 'csv'").join(json.select("slug"), "slug", "left_anti").select(*json.columns))


def present(files: DataFrame, source: str) -> DataFrame:
    """(slug, source) of topics that have a snapshot."""
    return files.where("kind = 'json'").select("slug", F.lit(source).alias("source")).distinct()


def absent(found: DataFrame, sources: list[str]) -> DataFrame:
    """(slug, sources): of each topic in present() rows, the sources without a snapshot, in the order given."""
    return found.groupBy("slug").agg(F.array_except(F.array(*[F.lit(s) for s in sources]), F.collect_set("source")).alias("sources"))


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, fetched_at) of each sidecar; null where it does not tell a time."""
    reader = spark.read.schema("fetched_at string, _broken string").options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", pathGlobFilter="*.meta.json")
    rows = reader.json(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.meta\.json$", 1).alias("slug"), F.col("fetched_at").try_cast("timestamp").alias("fetched_at"))
    return rows.groupBy("slug").agg(F.max("fetched_at").alias("fetched_at"))


def load(spark: SparkSession, folder: str, now: Column, source: str, stale_days: int = 14) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw buckets, faults, caveats) of the preferred snapshots, each series named by its slug.

    A topic whose preferred file is broken is a fault: no other file takes its
    place. Without a sidecar a CSV counts as fetched when the file was written, and
    its last period as incomplete; a sidecar that does not tell a time is a fault.
    """
    files = listing(spark, folder)
    chosen = preferred(files).select("slug", "file", "kind", "modified")
    raw, broken = snapshots.parsed(snapshots.files_of(spark, [f"{folder}/*.json"]))
    name = lambda ending: F.regexp_extract("file", rf"([^/]+){ending}$", 1)
    foreign = raw.where(F.col("source") != source).select(name(r"\.json").alias("slug"), F.concat(F.lit("a snapshot of "), "source").alias("reason")).distinct()
    of_json = raw.withColumn("series_id", name(r"\.json")).where(F.col("source") == source).drop("file")
    faults = foreign.unionByName(broken.where(~F.col("file").endswith(".meta.json")).select(name(r"\.json").alias("slug"), F.lit("could not be read").alias("reason")))
    points, errors = csv.read(spark, f"{folder}/*.csv")
    own = chosen.where("kind = 'csv'").join(sidecars(spark, folder).withColumn("told", F.lit(True)), "slug", "left")
    bad = own.where("told and fetched_at is null").select("slug", F.lit("its sidecar tells no time").alias("reason"))
    wrong = errors.join(own.select(F.col("file").alias("series_id"), "slug"), "series_id").groupBy("slug").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" fault(s), the first: "), F.min_by("reason", F.coalesce("line", F.lit(0)))).alias("reason"))
    good = own.where("told is null or fetched_at is not null").select(F.col("file").alias("series_id"), "slug", F.coalesce("fetched_at", "modified").alias("fetched_at"), F.col("told").isNull().alias("last_incomplete"))
    rows = points.drop("name").join(good, "series_id").withColumn("series_id", F.col("slug"))
    fixed = {"topic": F.col("slug"), "source": F.lit(source), "partial_rule": F.lit("upload_date"), "upload_date": F.to_date("fetched_at")}
    gaps = {"contributors": F.lit(None).cast("long"), "top_share": F.lit(None).cast("double"), "raw_count": F.lit(None).cast("long")}
    of_csv = rows.withColumns(fixed | gaps).drop("slug")
    every = of_json.unionByName(of_csv, allowMissingColumns=True)
    said = faults.unionByName(bad).unionByName(wrong).join(chosen.select("slug", "file"), "slug").select("slug", "file", "reason")
    aged = every.groupBy("series_id").agg(snapshots.age(F.max("fetched_at"), now).alias("days"))
    old = aged.where(F.col("days") > stale_days).select("series_id", F.format_string("the snapshot is %d days old", "days").alias("caveat"))
    kept = aged.select("series_id", F.lit("from a snapshot").alias("caveat"))
    return every, said, caveats_of(kept, old)
