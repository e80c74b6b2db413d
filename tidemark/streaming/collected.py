"""Day rows that streams and re-fetches write together, and verdicts of the series they touch.

A commit rewrites the days it touches and nothing else, into a folder of its own
name; then a manifest says for every day which commit's folder has its rows, and
for every stream which of its batches went in last. Spark marks a manifest as
whole when all of it is there: that mark is the pointer readers follow. So a
commit is seen whole or not at all, a batch that comes twice goes in once, and a
stream with a new checkpoint adds to what is there.

    data/name=<commit>/day=<day>/    rows as the commit left them, never changed
    changes/number=<n>/              series and days whose rows the commit changed
    log/number=<n>/                  its manifest
    verdicts/number=<n>/             verdicts of the series touched up to it

A table has one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.commits import following, head, names, numbers
from tidemark.config import Settings
from tidemark.operators.history import upsert
from tidemark.plans import verdict as V
from tidemark.sources import tables as T
from tidemark.sources.contracts import post_points
from tidemark.store import removed, written

KEYS = ["series_id", "ts"]
SCHEMA = "series_id string, ts date, value double, contributors long, top_share double, raw_count long, imputed boolean"
MANIFEST = "day date, name string, query string, batch long"
CHANGES = "series_id string, first_day date, last_day date"
#: Whole days that a re-fetch repairs: what is late comes within them.
REPAIRED_DAYS = 7


def manifest(spark: SparkSession, path: str, number: int) -> DataFrame:
    if not number:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/log/number={number}")


def read(spark: SparkSession, path: str, number: int | None = None, days: DataFrame | None = None) -> DataFrame:
    """The rows of the last commit, or of another that is still there; days: only those (day)."""
    number = head(spark, path) if number is None else number
    if not number:
        return spark.createDataFrame([], SCHEMA)
    places = manifest(spark, path, number).where("day is not null").select("day", "name")
    if days is not None:
        places = places.join(days.select("day").distinct(), "day", "left_semi")
    rows = spark.read.schema(f"{SCHEMA}, name string, day date").parquet(f"{path}/data")
    return rows.join(places, ["name", "day"]).drop("name", "day")


def commit(spark: SparkSession, path: str, rows: DataFrame, query: str | None = None, batch: int | None = None) -> int | None:
    """Writes rows over those of the same series and day; the commit's number, or None for a batch that went in before.

    Rows have series_id, ts and value; other columns of SCHEMA may lack. Of
    several rows of a series and day one goes in, the largest in all columns.
    """
    at = head(spark, path)
    before = manifest(spark, path, at)
    if query is not None and before.where((F.col("query") == query) & (F.col("batch") >= batch)).limit(1).count():
        return None
    number = following(spark, path)
    name = f"{number:08d}-{uuid.uuid4().hex}"
    given = rows.select(*[(F.col(f[0]) if f[0] in rows.columns else F.lit(None)).cast(f[1]).alias(f[0]) for f in (x.split() for x in SCHEMA.split(", "))])
    rest = [c for c in given.columns if c not in KEYS]
    new = written(given.groupBy(*KEYS).agg(F.max(F.struct(*rest)).alias("row")).select(*KEYS, "row.*"), "collected")
    days = new.select(F.col("ts").alias("day")).distinct()
    old = written(read(spark, path, at, days), "collected_before")
    upsert(old, new, KEYS).withColumn("day", F.col("ts")).repartition("day").write.partitionBy("day").parquet(f"{path}/data/name={name}")
    both = new.select(*KEYS, F.struct(*rest).alias("new")).join(old.select(*KEYS, F.struct(*rest).alias("old")), KEYS, "left")
    changed = both.where(~F.col("new").eqNullSafe(F.col("old"))).groupBy("series_id").agg(F.min("ts").alias("first_day"), F.max("ts").alias("last_day"))
    # An unfinished commit may have left changes of this number.
    changed.write.mode("overwrite").parquet(f"{path}/changes/number={number}")
    kept = before.where("day is not null").join(days, "day", "left_anti").select("day", "name").unionByName(days.select("day", F.lit(name).alias("name")))
    said = before.where("day is null").where(~F.col("query").eqNullSafe(F.lit(query).cast("string"))).select("query", "batch")
    if query is not None:
        said = said.unionByName(spark.createDataFrame([(query, batch)], "query string, batch long"))
    kept.unionByName(said, allowMissingColumns=True).select("day", "name", "query", "batch").coalesce(1).write.parquet(f"{path}/log/number={number}")
    return number


def touched(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """(series_id, first_day, last_day) of the days that commits after ``since`` changed."""
    later = [n for n, whole in numbers(spark, f"{path}/log").items() if whole and n > since]
    if not later:
        return spark.createDataFrame([], CHANGES)
    rows = spark.read.schema(CHANGES).parquet(*[f"{path}/changes/number={n}" for n in later])
    return rows.groupBy("series_id").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def refetch(spark: SparkSession, path: str, posts: DataFrame, series: DataFrame, today: str, most: int, days: int = REPAIRED_DAYS) -> int | None:
    """Collects the last whole days before today anew and writes them over what is there.

    posts: series_id, ts, author and place, as a listing gives them (``most`` of a
    series at the most); series: what was asked. Days without posts are zero,
    and days that a full listing does not reach stay as they are.
    """
    first, last = (spark.sql(f"SELECT date_sub(DATE'{today}', {n})").first()[0].isoformat() for n in (days, 1))
    points, _, _ = post_points(posts, most, first, last, series=series)
    return commit(spark, path, points)


def daily_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "1 day") -> DataFrame:
    """Counts by day and key. A day is given out once, when the watermark has passed its end: partial days never are."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    days = stamped.groupBy(F.window("__ts", "1 day").alias("w"), F.col(key).alias("series_id")).agg(F.count(F.lit(1)).alias("value"))
    return days.select("series_id", F.to_date("w.start").alias("ts"), F.col("value").cast("double").alias("value"), F.col("value").alias("raw_count"))


def start(events: DataFrame, path: str, checkpoint: str, begin: str | None = None, **options) -> StreamingQuery:
    """Runs a stream of events into a table until all there is has been read.

    begin: the first day that the stream sees whole. A new checkpoint whose
    source no longer has earlier events must name it, else a part of a day would
    go over the whole one.
    """
    days = daily_counts(events, **options)
    if begin is not None:
        days = days.where(F.col("ts") >= F.lit(begin).cast("date"))

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commit(spark, path, batch, spark.sparkContext.getLocalProperty("sql.streaming.queryId"), number)

    return days.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()


def judge(spark: SparkSession, path: str, topic: str, source: str, s: Settings | None = None) -> int:
    """Writes verdicts of the series touched since the last ones; the number they are up to."""
    done = max((n for n, whole in numbers(spark, f"{path}/verdicts").items() if whole), default=0)
    at = head(spark, path)
    if at > done:
        series = written(touched(spark, path, done).select("series_id"), "touched")
        points = read(spark, path, at).join(series, "series_id", "left_semi")
        raw = T.complete(points.withColumn("imputed", F.coalesce("imputed", F.lit(False))), topic, source, "D")
        V.verdicts(raw, s).select(*V.SHORT).write.mode("overwrite").parquet(f"{path}/verdicts/number={at}")
    return at


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The newest verdict of every series that was judged, and the commit it is up to (number)."""
    judged = [n for n, whole in numbers(spark, f"{path}/verdicts").items() if whole]
    rows = spark.read.option("basePath", f"{path}/verdicts").parquet(*[f"{path}/verdicts/number={n}" for n in judged])
    return rows.groupBy("series_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "series_id"]), "number").alias("v")).select("series_id", "v.*")


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the folders that the last commit does not need: unfinished and overwritten ones; how many. Older commits can't be read afterwards, and verdicts must be up to date."""
    at, gone = head(spark, path), []
    # At most a commit a day is in a manifest.
    needed = {r.name for r in manifest(spark, path, at).where("name is not null").select("name").distinct().collect()}
    gone += [f"{path}/data/{n}" for n in names(spark, f"{path}/data") if n.removeprefix("name=") not in needed]
    gone += [f"{path}/{kind}/number={n}" for kind in ("log", "changes") for n in numbers(spark, f"{path}/{kind}") if n != at]
    for folder in gone:
        removed(spark, folder)
    return len(gone)

