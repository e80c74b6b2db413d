"""A refresh of every topic and source in one job.

A fault of one source never touches another: it is a row of the entries, and
what was stored of that series stays. Fetched series are merged into their
history, and only those whose content differs replace what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import slugify
from tidemark.functions.wording import display_name
from tidemark.operators.history import can_merge, changed, merge_history, source_status
from tidemark.store import written

#: Sources whose fetch holds their collected history already, so that nothing is merged. Fixed value.
WHOLE = ("reddit",)
#: Columns that may differ in an unchanged series.
INCIDENTAL = ("fetched_at", "ordinal")


def refresh(previous: DataFrame, fresh: DataFrame, faults: DataFrame, asked: DataFrame, max_days: int = 1095) -> tuple[DataFrame, DataFrame]:
    """(stored rows, entries), every input keyed by series_id.

    previous, fresh: rows of series with topic, source, freq, scale, ts, value
    and fetched_at; fresh may say that it is a stored copy (snapshot). faults:
    error and disabled. asked: topic and source of the series to refresh;
    others are left as stored and have no entry. Entries: status (updated,
    unchanged, failed, skipped), fetched_at, points and error; what is not
    updated has the stored series' fetch time and size. A series with a fault
    and rows counts as failed; one with neither has failed too.
    """
    asked = asked.select("series_id", "topic", "source").dropDuplicates(["series_id"])
    faults = faults.groupBy("series_id").agg(F.min("error").alias("fault"), F.bool_and("disabled").alias("disabled"))
    copied = F.coalesce("snapshot", F.lit(False)) if "snapshot" in fresh.columns else F.lit(False)
    fetched = fresh.join(asked.select("series_id"), "series_id", "left_semi").withColumn("__copied", copied).drop("snapshot")
    heads = fetched.groupBy("series_id").agg(F.bool_or("__copied").alias("copied"))
    good = heads.where("not copied").join(faults, "series_id", "left_anti").select("series_id")
    rows = fetched.drop("__copied").join(good, "series_id", "left_semi")
    mergeable = can_merge(previous, rows.where(~F.col("source").isin(*WHOLE)))
    merged = merge_history(previous.join(mergeable, "series_id", "left_semi"), rows, max_days)
    merged = written(merged.withColumn("fetched_at", F.max("fetched_at").over(Window.partitionBy("series_id"))), "merged")
    columns = [c for c in merged.columns if c in previous.columns]
    old = previous.join(good, "series_id", "left_semi").select(*columns)
    new = written(changed(old, merged.select(*columns), INCIDENTAL), "changed")
    stored = previous.join(new, "series_id", "left_anti").unionByName(merged.join(new, "series_id", "left_semi"), allowMissingColumns=True)
    size = lambda df, p: df.groupBy("series_id").agg(F.count(F.lit(1)).alias(f"{p}_points"), F.max("fetched_at").alias(f"{p}_at"))
    both = asked.join(faults, "series_id", "left").join(heads, "series_id", "left").join(size(previous, "old"), "series_id", "left").join(size(merged, "new"), "series_id", "left").join(new.withColumn("is_new", F.lit(True)), "series_id", "left")
    name = display_name(F.col("source"))
    fault = F.when(F.col("fault").isNotNull(), F.concat(F.lit("Couldn't fetch "), name, F.lit(": "), "fault")).when(F.col("copied"), F.concat(name, F.lit(": a stored copy is no new result"))).when(F.col("copied").isNull(), F.concat(name, F.lit(": nothing was fetched")))
    status = F.when(F.col("fault").isNotNull() & F.coalesce("disabled", F.lit(False)), "skipped").when(fault.isNotNull(), "failed").when(F.col("is_new"), "updated").otherwise("unchanged")
    kept = lambda c: F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))
    return stored, both.select("series_id", "topic", "source", status.alias("status"), kept("at").alias("fetched_at"), kept("points").alias("points"), fault.alias("error"))


def source_counts(entries: DataFrame) -> DataFrame:
    """Per source: its status and how many series were updated, unchanged, failed and skipped."""
    counts = entries.groupBy("source").agg(*[F.count_if(F.col("status") == k).alias(k) for k in ("updated", "unchanged", "failed", "skipped")])
    return counts.join(source_status(entries), "source")


def manifest_rows(entries: DataFrame) -> DataFrame:
    """A JSON document per topic, keys in order: its name and each source's entry, without what is null."""
    entry = F.struct(F.col("error"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"), F.col("points"), F.col("status"))
    by = entries.groupBy(slugify(F.col("topic")).alias("topic")).agg(F.min("topic").alias("query"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", entry.alias("entry"))))).alias("sources"))
    return by.select("topic", F.to_json(F.struct("query", "sources")).alias("json"))
