import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.plans import refresh as U
from tidemark.sources import tables as T

D, OLD, NEW = dt.date, dt.datetime(2026, 1, 9), dt.datetime(2026, 1, 12)
ROW = "series_id string, topic string, source string, freq string, scale string, ts date, value double, fetched_at timestamp"


def rows(source, topic, days, value, at, scale="count"):
    return [(f"{source}/{topic}", topic, source, "D", scale, D(2026, 1, d), float(value + d), at) for d in days]


def test_refresh(spark):
    previous = rows("x", "grown", range(1, 9), 0, OLD) + rows("x", "same", range(1, 9), 0, OLD) + rows("x", "down", range(1, 9), 0, OLD) + rows("x", "unasked", range(1, 3), 0, OLD)
    previous += rows("google_trends", "grown", range(1, 9), 0, OLD, "relative_0_100") + rows("reddit", "grown", range(1, 9), 0, OLD) + rows("csv", "copy", range(1, 3), 0, OLD)
    fresh = rows("x", "grown", range(7, 12), 50, NEW) + rows("x", "same", range(5, 9), 0, NEW) + rows("x", "new", range(5, 7), 0, NEW) + rows("x", "unasked", range(5, 7), 0, NEW)
    fresh += rows("google_trends", "grown", range(7, 10), 0, NEW, "relative_0_100") + rows("reddit", "grown", range(7, 10), 0, NEW)
    copies = [(*r, True) for r in rows("csv", "copy", range(1, 5), 0, NEW)]
    fresh = spark.createDataFrame([(*r, None) for r in fresh] + copies, ROW + ", snapshot boolean")
    faults = spark.createDataFrame([("x/down", "no answer", False), ("x/off", "switched off", True)], "series_id string, error string, disabled boolean")
    asked = [(f"{s}/{t}", t, s) for s, t in (("x", "grown"), ("x", "same"), ("x", "down"), ("x", "off"), ("x", "new"), ("x", "empty"), ("google_trends", "grown"), ("reddit", "grown"), ("csv", "copy"))]
    stored, entries = U.refresh(spark.createDataFrame(previous, ROW), fresh, faults, spark.createDataFrame(asked, "series_id string, topic string, source string"), 8)
    got = {r.series_id: (r.status, r.points, r.fetched_at, r.error) for r in entries.collect()}
    assert got == {
        "x/grown": ("updated", 8, NEW, None),
        "x/same": ("unchanged", 8, OLD, None),
        "x/down": ("failed", 8, OLD, "Couldn't fetch X: no answer"),
        "x/off": ("skipped", None, None, "Couldn't fetch X: switched off"),
        "x/new": ("updated", 2, NEW, None),
        "x/empty": ("failed", None, None, "X: nothing was fetched"),
        "google_trends/grown": ("updated", 3, NEW, None),
        "reddit/grown": ("updated", 3, NEW, None),
        "csv/copy": ("failed", 2, OLD, "Uploaded CSV: a stored copy is no new result"),
    }
    kept = {r.series_id: sorted(r.v) for r in stored.groupBy("series_id").agg(F.collect_list("value").alias("v")).collect()}
    assert kept["x/grown"] == [4, 5, 6, 57, 58, 59, 60, 61] and kept["x/down"] == list(range(1, 9)) and kept["x/unasked"] == [1, 2] and len(kept) == 8
    counts = {r.source: (r.updated, r.unchanged, r.failed, r.skipped, r.status) for r in U.source_counts(entries).collect()}
    assert counts["x"] == (2, 1, 2, 1, "partial") and counts["csv"] == (0, 0, 1, 0, "failed")
    doc = {r.topic: json.loads(r.json) for r in U.manifest_rows(entries).collect()}
    assert doc["grown"]["sources"]["x"] == {"fetched_at": "2026-01-12T00:00:00", "points": 8, "status": "updated"} and doc["off"]["sources"]["x"]["error"].endswith("switched off")


def test_refresh_of_nothing(spark):
    none = spark.createDataFrame([], ROW)
    stored, entries = U.refresh(none, none, spark.createDataFrame([], "series_id string, error string, disabled boolean"), spark.createDataFrame([], "series_id string, topic string, source string"))
    assert stored.count() == 0 and entries.count() == 0


def test_all_series_is_the_sum_of_its_parts(spark):
    sf, columns = "/root/testdata/sf0.001", ["series_id", "source", "freq", "ts", "value", "contributors", "raw_count", F.round("top_share", 9), "imputed"]
    parts = T.events_daily(spark, sf)
    for freq in ("D", "W", "M"):
        parts = parts.unionByName(T.orders(spark, sf, freq)).unionByName(T.shipments(spark, sf, freq))
    whole, parts = T.all_series(spark, sf).select(*columns), parts.select(*columns)
    assert whole.count() > 1000 and whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0
