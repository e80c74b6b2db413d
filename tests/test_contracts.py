import datetime as dt

from pyspark.sql import functions as F

from tidemark.sources import contracts as C

DAY = dt.date(2025, 3, 1)
day = lambda n: DAY + dt.timedelta(days=n)
at = lambda n, h: dt.datetime(2025, 3, 1, h) + dt.timedelta(days=n)


def test_titles(spark):
    topics = spark.createDataFrame([("cars", None), ("jam", None), ("jazz", "Jazz (disambiguation)"), ("x", "gone"), ("none", None)], "topic string, override string")
    titles = spark.createDataFrame([("cars", "Car", 0, False, False), ("jam", None, 0, False, True), ("Jazz (disambiguation)", None, 0, False, True), ("gone", None, 0, True, False), ("none", None, 4, False, False)], "title string, target string, ns int, missing boolean, disambiguation boolean")
    found = spark.createDataFrame([("jam", 2, "Traffic jam", False), ("jam", 1, "Jam", True), ("jam", 3, "Fruit jam", None), ("x", 1, "X", False)], "topic string, rank int, title string, disambiguation boolean")
    got = {r.topic: (r.title, r.reason) for r in C.resolved_titles(topics, titles, found).collect()}
    assert got == {"cars": ("Car", None), "jam": ("Traffic jam", None), "jazz": ("Jazz (disambiguation)", None), "x": (None, "no article gone"), "none": (None, "no article found for none")}
    assert {r.topic: r.titles for r in C.ordered_candidates(found, 1).collect()} == {"jam": ["Traffic jam"], "x": ["X"]}


def test_page_views(spark):
    items = spark.createDataFrame([("a", "2025030100", 5), ("a", "2025030400", 7)], "series_id string, timestamp string, views long")
    assert [(r.ts, r.value, r.imputed) for r in C.page_views(items).orderBy("ts").collect()] == [(day(0), 5, False), (day(1), 0, True), (day(2), 0, True), (day(3), 7, False)]


def test_story_points(spark):
    counts = spark.createDataFrame([("a", day(0), 40, True), ("a", day(1), 9, True), ("a", day(2), 3, False), ("a", day(3), 50, True)], "series_id string, ts date, n long, approximate boolean")
    hits = spark.createDataFrame([("a", day(1), x) for x in ("p", "p", None)] + [("a", day(2), "q")] * 3 + [("a", day(3), f"u{i}") for i in range(4)], "series_id string, ts date, author string")
    points, caveats = C.story_points(counts, hits, 4)
    got = [(r.value, r.contributors, r.raw_count, None if r.top_share is None else round(r.top_share, 3)) for r in points.orderBy("ts").collect()]
    assert got == [(40, None, None, None), (3, 1, 3, 0.667), (3, 1, 3, 1.0), (50, 4, 4, 0.25)]
    assert caveats.first().caveats == ["counts of 2 day(s) are estimates, the first on 2025-03-01", "breadth of 1 day(s) is told from the newest 4 items only"]


def test_breadth_days(spark):
    days = spark.createDataFrame([("a", day(i)) for i in range(40)], "series_id string, ts date")
    got = sorted(r.ts for r in C.breadth_days(days, F.lit(at(39, 12))).collect())
    assert got == [day(i) for i in range(31, 40)]  # eight of the 39 complete days, and the one that is not over


def test_capped_posts(spark):
    posts = [("a", at(d, h), f"u{h % 3}", "p") for d in range(6) for h in range(4)] + [("b", at(4, 1), None, "q")]
    posts = spark.createDataFrame(posts, "series_id string, ts timestamp, author string, place string")
    old = spark.createDataFrame([("a", day(i), 9.0, 2, None) for i in range(6)], "series_id string, ts date, value double, contributors long, top_share double")
    points, span, caveats = C.post_points(posts, 10, str(day(0)), str(day(5)), old)
    got = {s: [(r.ts, r.value, r.contributors, r.top_share) for r in points.where(F.col("series_id") == s).orderBy("ts").collect()] for s in "ab"}
    assert {r.series_id: (r.capped, r.coverage_start) for r in span.collect()} == {"a": (True, day(4)), "b": (False, day(0))}
    assert got["a"] == [(day(i), 9.0, 2, None) for i in range(4)] + [(day(i), 4.0, 3, 1.0) for i in (4, 5)]
    assert [v for _, v, *_ in got["b"]] == [0, 0, 0, 0, 1, 0] and got["b"][4][2:] == (0, 1.0) and got["b"][0][2:] == (0, None)
    assert caveats.first().caveats == ["4 earlier day(s) were collected before", "the listing ended at 10 posts: live days begin on 2025-03-05"]


def test_counts_with_breadth(spark):
    buckets = spark.createDataFrame([("a", at(d, h), 2) for d in range(30) if d != 27 for h in (0, 12)], "series_id string, start timestamp, n long")
    posts = spark.createDataFrame([("a", at(d, h), f"u{h}") for d in range(30) for h in range(6)], "series_id string, ts timestamp, author string")
    got = {r.ts: r for r in C.counted_posts(buckets, posts, F.lit(at(29, 12)), 4).collect()}
    assert len(got) == 30 and got[day(27)].value == 0 and got[day(27)].imputed and got[day(3)].value == 4
    assert sorted(d for d, r in got.items() if r.raw_count) == [day(i) for i in range(23, 30)] and got[day(28)].contributors == 4
    short = C.counted_posts(buckets, posts, F.lit(at(29, 12)), 4, recent_days=7)
    assert short.agg(F.min("ts")).first()[0] == day(23)


def test_interest(spark):
    assert [spark.range(1).select(C.granularity(F.lit(n))).first()[0] for n in (90, 91, 1825, 1826)] == ["D", "W", "W", "M"]
    live = spark.createDataFrame([("a", day(0), 1.0)], "series_id string, ts date, value double")
    kept = spark.createDataFrame([("a", day(0), 9.0, at(0, 0)), ("b", day(0), 2.0, at(0, 0)), ("c", day(0), 3.0, at(28, 0))], "series_id string, ts date, value double, fetched_at timestamp")
    failed = spark.createDataFrame([("b", "blocked")], "series_id string, reason string")
    points, caveats = C.live_or_snapshot(live, kept, failed, F.lit(at(30, 0)))
    assert {(r.series_id, r.value) for r in points.collect()} == {("a", 1.0), ("b", 2.0), ("c", 3.0)}
    assert {r.series_id: r.caveats for r in caveats.collect()} == {"b": ["from a snapshot: blocked", "the snapshot is 30 days old"], "c": ["from a snapshot: no live data"]}


def test_history_range(spark):
    first, last = C.history_range(F.lit(None).cast("date"), F.lit("2030-01-01").cast("date"), 3, F.lit(DAY))
    assert tuple(spark.range(1).select(first, last).first()) == (day(-2), day(0))


def test_points_and_buckets_are_made_once(spark):
    from tidemark.plans import verdict as V
    from tidemark.sources import tables as T

    rows = spark.range(120).selectExpr("'s' AS series_id", "date_add(date'2024-01-01', cast(id + id div 60 as int)) AS ts", "double(id) AS value", "id AS contributors", "0.1D AS top_share", "id AS raw_count", "false AS imputed")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    filled = T.zero_filled(rows)
    assert plan(filled).count("Range (") == 1
    got = {str(r.ts): r for r in filled.collect()}
    assert len(got) == 121 and [r.value for r in got.values() if r.imputed] == [0.0] and got["2024-03-01"].imputed and got["2024-03-01"].contributors is None
    verdicts = V.verdicts(T.complete(filled, "t", "s", "D"))
    assert plan(verdicts).count("Range (") == 0
