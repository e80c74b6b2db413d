"""Series from item tables: one bucket per period, with who is behind it.

A source says which items make a series; the aggregation is by person first, so
that a period with very many items is a few rows per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.store import written

RAW = ["series_id", "topic", "source", "freq", "scale", "ts", "value", "contributors", "top_share", "raw_count", "imputed", "ordinal", "fetched_at", "partial_rule", "upload_date", "last_incomplete"]
FETCHED = "2100-01-01"


def bucket(ts: Column, freq: str) -> Column:
    return {"D": ts.cast("date"), "W": F.date_trunc("week", ts).cast("date"), "M": F.trunc(ts.cast("date"), "MM")}[freq]


def breadth(items: DataFrame, keys: list[str], origin: str) -> DataFrame:
    """Per key: items, known origins, and the largest known origin's share of all items (0 without a known one)."""
    return shares(items.groupBy(*keys, F.col(origin).alias("origin")).agg(F.count(F.lit(1)).alias("n")), keys)


def shares(by: DataFrame, keys: list[str]) -> DataFrame:
    """breadth, from rows of keys, origin and n items."""
    top = F.coalesce(F.max(F.when(F.col("origin").isNotNull(), F.col("n"))), F.lit(0))
    return by.groupBy(*keys).agg(F.sum("n").alias("raw_count"), F.count("origin").alias("contributors"), (top / F.sum("n")).alias("top_share"))


def complete(points: DataFrame, topic: str, source: str, freq: str, scale: str = "count") -> DataFrame:
    """The raw schema, for points of series_id, ts, value, contributors, top_share, raw_count, imputed."""
    fixed = {"topic": F.lit(topic), "source": F.lit(source), "freq": F.lit(freq), "scale": F.lit(scale), "ordinal": F.lit(0).cast("long"), "fetched_at": F.lit(FETCHED).cast("timestamp"), "partial_rule": F.lit("fetched_at"), "upload_date": F.lit(None).cast("date"), "last_incomplete": F.lit(False)}
    return points.withColumns(fixed).select(*RAW)


def zero_filled(points: DataFrame, step: str = "1 day") -> DataFrame:
    """Missing periods between a series' first and last are zero and imputed. Points are made once: each brings those that are missing up to the next."""
    after = F.lead("ts").over(Window.partitionBy("series_id").orderBy("ts"))
    rows = points.where("ts is not null").withColumn("__last", F.greatest(F.col("ts"), F.date_sub(after, 1)))
    rows = rows.select("*", F.posexplode(F.expr(f"sequence(ts, coalesce(__last, ts), interval {step})")).alias("__place", "__ts"))
    own = F.col("__place") == 0
    others = [c for c in points.columns if c not in ("series_id", "ts")]
    out = rows.select("series_id", F.col("__ts").alias("ts"), *[F.when(own, F.col(c)).alias(c) for c in others])
    return out.withColumns({"imputed": F.coalesce("imputed", F.col("value").isNull()), "value": F.coalesce("value", F.lit(0.0))})


def counted(items: DataFrame, name: Column, ts: str, origin: str, freq: str) -> DataFrame:
    """Items per period and series, with breadth."""
    rows = items.select(name.alias("series_id"), bucket(F.col(ts), freq).alias("ts"), F.col(origin))
    return breadth(rows, ["series_id", "ts"], origin).withColumns({"value": F.col("raw_count").cast("double"), "imputed": F.lit(False)})


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily series per event type; users are the origins; days without events are zero."""
    return complete(zero_filled(counted(read(spark, sf_dir, "events"), F.concat(F.lit("events/"), "event_type"), "ts", "user_id", "D")), "events", "events", "D")


def orders(spark: SparkSession, sf_dir: str, freq: str) -> DataFrame:
    """A series of orders per priority; customers are the origins; days without orders are gaps."""
    name = F.concat(F.lit(f"orders/{freq}/"), F.substring("o_orderpriority", 1, 1))
    return complete(counted(read(spark, sf_dir, "orders"), name, "o_orderdate", "o_custkey", freq), "trade", "orders", freq)


def shipments(spark: SparkSession, sf_dir: str, freq: str) -> DataFrame:
    """A series of shipped lines per return flag; suppliers are the origins; periods without are zero."""
    name = F.concat(F.lit(f"lines/{freq}/"), "l_returnflag")
    points = counted(read(spark, sf_dir, "lineitem"), name, "l_shipdate", "l_suppkey", freq)
    return complete(zero_filled(points, {"D": "1 day", "W": "7 day", "M": "1 month"}[freq]), "trade", "lines", freq)


def all_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series above, daily, weekly and monthly. A table's items are moved once, to their origin: all periods of an origin are counted there, and only counts by period move on."""
    out = events_daily(spark, sf_dir)
    kinds = (
        ("orders", "orders", F.substring("o_orderpriority", 1, 1), "o_orderdate", "o_custkey", None),
        ("lineitem", "lines", F.col("l_returnflag"), "l_shipdate", "l_suppkey", {"D": "1 day", "W": "7 day", "M": "1 month"}),
    )
    for table, source, key, ts, origin, fill in kinds:
        # Some origin with very many items still is one row a day: the days' counts meet, not the items.
        by = read(spark, sf_dir, table).groupBy(key.alias("key"), bucket(F.col(ts), "D").alias("day"), F.col(origin).alias("origin")).agg(F.count(F.lit(1)).alias("n"))
        by = written(by, "days").repartition("key", "origin")
        for freq in ("D", "W", "M"):
            periods = by.groupBy("key", bucket(F.col("day"), freq).alias("ts"), "origin").agg(F.sum("n").alias("n"))
            points = shares(periods, ["key", "ts"]).withColumns({"value": F.col("raw_count").cast("double"), "imputed": F.lit(False)})
            points = points.withColumn("series_id", F.concat(F.lit(f"{source}/{freq}/"), "key")).drop("key")
            out = out.unionByName(complete(zero_filled(points, fill[freq]) if fill else points, "trade", source, freq))
    return out
