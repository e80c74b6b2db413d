import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import text as X
from tidemark.operators import history as H
from tidemark.operators import preprocess as P
from tidemark.plans import cross_source as S
from tidemark.plans import verdict as V
from tidemark.sources import snapshots

RAW = "series_id string, topic string, source string, freq string, scale string, ts date, value double, contributors long, top_share double, raw_count long, imputed boolean, ordinal long, fetched_at timestamp, partial_rule string, upload_date date, last_incomplete boolean"
LATE = dt.datetime(2100, 1, 1)


def series(name, values, freq="D", scale="value", start=dt.date(2024, 1, 1), **over):
    rows = []
    for i, v in enumerate(values):
        ts = start + dt.timedelta(days=i * {"D": 1, "W": 7}[freq]) if freq != "M" else dt.date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1)
        row = {"contributors": None, "top_share": None, "raw_count": None, "imputed": False, "fetched_at": LATE, "partial_rule": "fetched_at", "upload_date": None, "last_incomplete": False} | over
        v = None if v is None or v != v else float(v)
        rows.append((name, "topic", "source", freq, scale, ts, v, row["contributors"], row["top_share"], row["raw_count"], row["imputed"], i, row["fetched_at"], row["partial_rule"], row["upload_date"], row["last_incomplete"]))
    return rows


def frame(spark, *parts):
    return spark.createDataFrame([r for p in parts for r in p], RAW)


def noise(n, level=100.0, share=0.05, seed=1):
    return level * (1 + share * np.random.default_rng(seed).normal(size=n))


def test_verdicts_of_plain_shapes(spark):
    r = np.random.default_rng(5)
    flat, spike, ramp, step = noise(90), noise(90, seed=2), noise(90, seed=3), noise(90, seed=4)
    spike[-5] *= 4
    ramp[-25:] *= 1 + 0.05 * np.arange(25)
    step[-15:] *= 1.8
    t = np.arange(52 * 4)
    wave = 100 + 60 * np.maximum(0, np.cos(2 * np.pi * (t - 205) / 52)) ** 4 + r.normal(size=len(t))
    raw = frame(spark, series("flat", flat), series("spike", spike), series("ramp", ramp), series("step", step), series("short", flat[:10]), series("wave", wave, "W"))
    got = {x.series_id: x for x in V.verdicts(raw).collect()}
    assert {k: v.label for k, v in got.items()} == {"flat": "NO_CHANGE", "spike": "FLUKE", "ramp": "TREND", "step": "TREND", "short": "INCONCLUSIVE", "wave": "SEASONAL"}
    assert got["ramp"].direction == got["step"].direction == got["spike"].direction == "up"
    assert got["short"].rule == "R1" and [c.kind for c in got["short"].conditions] == ["more_history"] and got["short"].conditions[0].periods == 18
    assert [c.kind for c in got["spike"].conditions] == ["stay_above"] and [c.kind for c in got["wave"].conditions] == ["beyond_last_year"]
    assert got["ramp"].confidence in ("medium", "high") and got["short"].confidence == "low"
    assert all(len(v.conditions) <= 3 for v in got.values())


def test_one_origin_and_low_counts(spark):
    one = series("one", noise(60, 50), scale="count", top_share=0.7, contributors=5, raw_count=50)
    few = series("few", [1, 0, 2, 0, 1, 0, 0] * 8, scale="count")
    more = series("more", [0, 0, 1, 0, 0, 0, 0] * 7 + [4, 3, 5, 4, 6, 5, 4], scale="count")
    got = {x.series_id: x for x in V.verdicts(frame(spark, one, few, more)).collect()}
    assert got["one"].label == "FLUKE" and got["one"].reason.startswith("few origins")
    assert got["few"].low_count_active and got["few"].low_count_too_few
    assert got["more"].low_count_stance == "supports_trend" and got["more"].low_count_direction == "up"


def test_duplicates_anchors_and_partial_periods(spark):
    day = lambda d: dt.date(2024, 1, d)
    rows = [("d", "t", "s", "D", "value", day(x), float(v), None, None, None, False, i, LATE, "fetched_at", None, False) for i, (x, v) in enumerate([(3, 3), (1, 1), (2, 20), (2, 2), (1, 10)])]
    rows += [("w", "t", "s", "W", "value", dt.date(2026, 1, x), float(i), None, None, None, False, i, LATE, "fetched_at", None, False) for i, x in enumerate((4, 11, 14, 18))]
    out = P.snapped(spark.createDataFrame(rows, RAW)).orderBy("series_id", "ts").collect()
    assert [(r.ts, r.value) for r in out if r.series_id == "d"] == [(day(1), 10.0), (day(2), 2.0), (day(3), 3.0)]
    assert [r.value for r in out if r.series_id == "w"] == [0.0, 2.0, 3.0] and {r.n_duplicates for r in out if r.series_id == "d"} == {2}
    end = dt.datetime(2024, 1, 10)
    cases = {"over": {"fetched_at": end + dt.timedelta(days=1)}, "running": {"fetched_at": end}, "uploaded": {"partial_rule": "upload_date", "upload_date": dt.date(2024, 1, 10)}, "older": {"partial_rule": "upload_date", "upload_date": dt.date(2024, 1, 11)}, "said": {"last_incomplete": True}}
    got = P.without_partial(P.snapped(frame(spark, *[series(k, range(10), **v) for k, v in cases.items()]))).groupBy("series_id").count().collect()
    assert {r.series_id: r["count"] for r in got} == {"over": 10, "running": 9, "uploaded": 9, "older": 10, "said": 9}


def test_gaps_are_filled_up_to_two(spark):
    v = [None, *map(float, range(39))]
    for i in (5, 11, 12, 20, 21, 22):
        v[i] = None
    rows = series("g", v)
    raw = frame(spark, [r for k, r in enumerate(rows) if k not in (11, 20)])
    out = P.preprocess(raw).orderBy("idx").collect()
    assert len(out) == 39 and out[0].ts == rows[1][5] and out[0].n_observed == 33
    assert [r.ts.day for r in out if r.was_filled] == [rows[i][5].day for i in (5, 11, 12)]
    assert [round(r.work_filled, 6) for r in out if r.was_filled] == [4.0, 10.0, 11.0]
    assert all((r.work_filled is None) == (r.ts in {rows[i][5] for i in (20, 21, 22)}) for r in out)


def test_negative_counts_are_no_series(spark):
    got = V.verdicts(frame(spark, series("n", [5.0] * 39 + [-1], scale="count"))).first()
    assert got.label == "INCONCLUSIVE" and not got.sufficient


def test_empty_input(spark):
    assert V.verdicts(frame(spark, [])).collect() == []


def test_cross_source_moves_its_anchor(spark):
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("t", "a", d(0), d(7), "FLUKE"), ("t", "b", d(3), d(10), "FLUKE"), ("t", "c", d(6), d(13), "TREND up"), ("t", "x", None, None, None), ("u", "a", d(0), d(7), "FLUKE")]
    got = {r.topic: r for r in S.compare_sources(spark.createDataFrame(rows, "topic string, source string, start date, end date, outcome string")).collect()}
    assert (got["t"].window_end, got["t"].n_compared, got["t"].n_apart, got["t"].n_unavailable, got["t"].agreement) == (d(7), 2, 1, 1, "agree")
    assert got["u"].agreement == "not comparable"


def test_history(spark):
    d = lambda n: dt.date(2024, 1, n)
    make = lambda rows: spark.createDataFrame(rows, "series_id string, ts date, value double")
    old, new = make([("a", d(i), 1.0) for i in range(1, 8)]), make([("a", d(i), 2.0) for i in range(6, 11)])
    got = sorted((r.ts.day, r.value) for r in H.merge_history(old, new, 7).collect())
    assert got == [(4, 1.0), (5, 1.0), *[(i, 2.0) for i in range(6, 11)]]
    assert H.changed(old, old).collect() == [] and [r.series_id for r in H.changed(old, new).collect()] == ["a"]
    head = lambda scale: spark.createDataFrame([("a", "s", "D", scale)], "series_id string, source string, freq string, scale string")
    assert H.can_merge(head("count"), head("count")).count() == 1
    assert H.can_merge(head("relative_0_100"), head("relative_0_100")).count() == 0 and H.can_merge(head("count"), head("value")).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("  Éa  B!c ", "up 1,200 to 3.5% on 2024-01-02")], "a string, t string")
    r = df.select(X.slugify(F.col("a")).alias("s"), X.normalised_query(F.col("a")).alias("q")).first()
    assert (r.s, r.q) == ("a-b-c", "éa b!c")


def test_snapshots(spark, tmp_path):
    raw = frame(spark, series("s", [1.0, float("nan"), 3.0]))
    snapshots.write(raw, f"{tmp_path}/out")
    back, broken = snapshots.stored(spark, f"{tmp_path}/out")
    assert [(r.ts.day, r.value) for r in back.orderBy("ts").collect()] == [(1, 1.0), (2, None), (3, 3.0)] and broken.count() == 0
    (tmp_path / "bad.json").write_text("{nothing")
    assert snapshots.read(spark, f"{tmp_path}/bad.json")[1].count() == 1


@pytest.mark.parametrize("n, freq, want", [(30, "D", 7), (100, "D", 20), (400, "D", 28), (26, "W", 5), (24, "M", 5)])
def test_recent_length(spark, n, freq, want):
    row = spark.range(1).select(F.lit(freq).alias("freq")).select(P.recent_length(F.lit(n), Settings()).alias("k")).first()
    assert row.k == want and math.floor(0.2 * n + 0.5) >= 0
