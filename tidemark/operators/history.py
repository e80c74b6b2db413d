"""Incremental state as batch operators: merging a refresh into history, upserts, manifests, unchanged writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ("source", "freq", "scale")
#: Entries of a series' meta that tell what it measures.
MEASURED = ("article", "project", "agent", "tags", "resolved_query")
MERGED_DAYS = "merged_days"


def measured(df: DataFrame) -> Column:
    """What a series measures, by its meta, as entries in order: maps themselves can't be compared. None without meta."""
    if "meta" not in df.columns:
        return F.array().cast("array<struct<key:string,value:string>>")
    return F.coalesce(F.array_sort(F.map_entries(F.map_filter("meta", lambda k, v: k.isin(*MEASURED) & v.isNotNull()))), F.array().cast("array<struct<key:string,value:string>>"))


def can_merge(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """series_id of pairs that measure the same on the same scale, which is not relative to its own window."""
    a, b = (df.select("series_id", *IDENTITY, measured(df).alias("measured")).distinct().alias(n) for df, n in ((previous, "a"), (fresh, "b")))
    same = F.col("a.series_id") == F.col("b.series_id")
    for k in (*IDENTITY, "measured"):
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    # A series whose rows disagree on what they measure is not merged.
    single = lambda n: F.count(F.lit(1)).over(Window.partitionBy(f"{n}.series_id")) == 1
    a, b = a.withColumn("__single", single("a")).where("__single").drop("__single").alias("a"), b.withColumn("__single", single("b")).where("__single").drop("__single").alias("b")
    return a.join(b, same).where(F.col("a.scale") != "relative_0_100").select(F.col("a.series_id").alias("series_id"))


def merge_history(previous: DataFrame, fresh: DataFrame, max_days: int = 1095) -> DataFrame:
    """Fresh points, and the previous ones from before each series' first fresh one; the last max_days days of all.

    Where rows have meta (a map of texts), all of a fresh series have its meta
    afterwards, with the number of earlier days that were kept (merged_days).
    """
    first = fresh.groupBy("series_id").agg(F.min("ts").alias("first"), *([F.max_by("meta", "ts").alias("__meta")] if "meta" in fresh.columns else []))
    older = previous.join(first.select("series_id", "first"), "series_id", "left").where(F.col("first").isNull() | (F.col("ts") < F.col("first"))).drop("first")
    both = older.unionByName(fresh, allowMissingColumns=True).withColumn("__last", F.max("ts").over(Window.partitionBy("series_id")))
    both = both.where(F.col("ts") > F.date_sub("__last", max_days)).drop("__last")
    if "meta" not in fresh.columns:
        return both
    both = both.join(first, "series_id", "left").withColumn("__kept", F.count_if(F.col("ts") < F.col("first")).over(Window.partitionBy("series_id")))
    none = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce("__meta", none), lambda k, v: k != MERGED_DAYS)
    kept = F.when(F.col("__kept") > 0, F.create_map(F.lit(MERGED_DAYS), F.col("__kept").cast("string"))).otherwise(none)
    return both.withColumn("meta", F.when(F.col("first").isNull(), F.col("meta")).otherwise(F.map_concat(own, kept))).drop("first", "__meta", "__kept")


def merged_caveats(rows: DataFrame) -> DataFrame:
    """(series_id, caveat) of series whose earlier days come from previous refreshes."""
    kept = F.try_element_at("meta", F.lit(MERGED_DAYS))
    return rows.groupBy("series_id").agg(F.max(kept.cast("long")).alias("n")).where("n > 0").select("series_id", F.format_string("%d earlier day(s) were kept from previous refreshes", "n").alias("caveat"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; for a key in both, the new one."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def manifest(previous: DataFrame, run: DataFrame, keep: DataFrame) -> DataFrame:
    """(topic, source, status, n): this run's entries over previous ones, for the topics that are kept."""
    a, b = run.alias("a"), previous.alias("b")
    both = a.join(b, ["topic", "source"], "full_outer").select("topic", "source", F.coalesce("a.status", "b.status").alias("status"), F.when(F.col("a.status").isNotNull(), F.col("a.n")).otherwise(F.col("b.n")).alias("n"))
    return both.join(keep.select("topic").distinct(), "topic", "left_semi")


def source_status(entries: DataFrame) -> DataFrame:
    """Per source: ok, partial, failed or skipped; whatever is neither failed nor skipped went well."""
    n = entries.groupBy("source").agg(F.count_if(~F.col("status").isin("failed", "skipped")).alias("ok"), F.count_if(F.col("status") == "failed").alias("bad"))
    return n.select("source", F.when((F.col("ok") > 0) & (F.col("bad") > 0), "partial").when(F.col("ok") > 0, "ok").when(F.col("bad") > 0, "failed").otherwise("skipped").alias("status"))


def changed(old: DataFrame, new: DataFrame, ignore: tuple[str, ...] = ("fetched_at",)) -> DataFrame:
    """series_id of series whose content differs, columns to ignore left out: sums of row hashes, not rows, meet."""
    def mark(df, name):
        columns = sorted(c for c in df.columns if c not in ignore)
        # A map has no hash of its own; its entries in order have.
        hashed = [F.array_sort(F.map_entries(c)) if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in columns]
        return df.groupBy("series_id").agg(F.sum(F.xxhash64(*hashed).cast("decimal(38,0)")).alias(name), F.count(F.lit(1)).alias(f"{name}_n"))

    both = mark(old, "a").join(mark(new, "b"), "series_id", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b")) | ~F.col("a_n").eqNullSafe(F.col("b_n"))).select("series_id")


def live_and_collected(live: DataFrame, collected: DataFrame) -> DataFrame:
    """Live days, and collected ones from before the live coverage of their series."""
    return merge_history(collected, live, 10**5)
