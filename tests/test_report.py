import datetime as dt

from pyspark.sql import functions as F

from tests.test_analysis import frame, noise, series
from tidemark.plans import report as R
from tidemark.plans import verdict as V

D = dt.date


def test_sentences(spark):
    rows = [
        ("two", "wikipedia", D(2026, 9, 1), D(2026, 9, 29), "TREND up"),
        ("two", "x", D(2026, 9, 1), D(2026, 9, 29), "FLUKE"),
        ("two", "my_feed", D(2026, 9, 2), D(2026, 9, 30), "TREND up"),
        ("two", "csv", D(2020, 1, 1), D(2020, 1, 29), "FLUKE"),
        ("two", "reddit", None, None, None),
        ("one", "csv", D(2026, 8, 25), D(2026, 9, 29), "NO_CHANGE"),
        ("none", "csv", None, None, "INCONCLUSIVE"),
        ("none", "x", None, None, None),
    ]
    windows = spark.createDataFrame(rows, "topic string, source string, start date, end date, outcome string")
    got = {r.topic: r.sentence for r in R.topic_sentences(windows).collect()}
    assert got == {
        "two": "2 of 3 sources show an upward trend over 1–28 Sep 2026; X looks like a fluke; Uploaded CSV is not comparable (different period); Reddit has no usable result.",
        "one": "Uploaded CSV shows no change over 25 Aug–28 Sep 2026.",
        "none": "No sources could be compared over a common period; Uploaded CSV and X have no usable result.",
    }


def test_condition_texts(spark):
    flat, spike = noise(90), noise(90, seed=2)
    spike[-5] *= 4
    got = {r.series_id: r for r in R.with_texts(V.verdicts(frame(spark, series("flat", flat), series("spike", spike), series("short", flat[:10])))).collect()}
    assert {k: v.badge for k, v in got.items()} == {"flat": "No change", "spike": "Fluke", "short": "Inconclusive"}
    assert got["short"].condition_texts == ["Need 18 more days of data to decide (10 observed, at least 28 required)."]
    up = got["flat"].conditions[0]
    assert up.kind == "unusual" and got["flat"].condition_texts[0] == f"A value above {up.threshold:.1f} or below {up.base:.1f} would be unusual (|z| ≥ 3.5)."
    stay = got["spike"].conditions[0].threshold
    assert got["spike"].condition_texts == [f"If the next 7 days all stay above {stay:.1f} (baseline median + 2 MADs), this becomes a trend."]
    assert all(len(r.conditions) == len(r.condition_texts) and None not in r.condition_texts for r in got.values())


def test_topic_table(spark):
    entries = spark.createDataFrame([("a", "p", "ok"), ("a", "q", "failed"), ("b", "q", "ok")], "topic string, source string, status string")
    got = [tuple(r) for r in R.topic_table(entries, ["p", "q", "r"]).orderBy(F.col("topic")).collect()]
    assert got == [("a", "ok", "failed", "—"), ("b", "—", "ok", "—")]
