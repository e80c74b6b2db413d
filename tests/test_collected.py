import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import collected as C

D = dt.date
POSTS = "series_id string, ts timestamp, author string, place string"
EVENTS = "ts timestamp, event_type string"


def rows(spark, path, number=None):
    return sorted((r.series_id, r.ts.day, r.value) for r in C.read(spark, path, number).collect())


def points(spark, *of):
    return spark.createDataFrame([(s, D(2024, 1, d), None if v is None else float(v)) for s, d, v in of], "series_id string, ts date, value double")


def at(d, h):
    return dt.datetime(2024, 1, d, h)


def test_commits_change_touched_days_only(spark, tmp_path):
    path = str(tmp_path)
    assert C.head(spark, path) == 0 and rows(spark, path) == [] and C.touched(spark, path).count() == 0
    assert C.commit(spark, path, points(spark, ("a", 1, 5), ("a", 2, 6), ("b", 2, 7))) == 1
    assert C.commit(spark, path, points(spark, ("a", 2, 60), ("b", 2, 7), ("b", 3, 8))) == 2
    assert rows(spark, path) == [("a", 1, 5.0), ("a", 2, 60.0), ("b", 2, 7.0), ("b", 3, 8.0)]
    assert rows(spark, path, 1) == [("a", 1, 5.0), ("a", 2, 6.0), ("b", 2, 7.0)]
    assert sorted(map(tuple, C.touched(spark, path, 1).collect())) == [("a", D(2024, 1, 2), D(2024, 1, 2)), ("b", D(2024, 1, 3), D(2024, 1, 3))]
    names = {(r.day.day, r.name) for r in C.manifest(spark, path, 2).where("day is not null").collect()}
    assert {d for d, n in names if n.startswith("00000001")} == {1} and {d for d, n in names if n.startswith("00000002")} == {2, 3}
    assert C.vacuum(spark, path) == 2 and rows(spark, path) == [("a", 1, 5.0), ("a", 2, 60.0), ("b", 2, 7.0), ("b", 3, 8.0)]
    C.commit(spark, path, points(spark, ("c", 1, 1), ("c", 1, 2), ("c", 1, None)))
    assert ("c", 1, 2.0) in rows(spark, path) and ("a", 1, 5.0) in rows(spark, path)


def test_a_batch_that_comes_twice_goes_in_once(spark, tmp_path):
    path = str(tmp_path)
    assert C.commit(spark, path, points(spark, ("a", 1, 1)), "q", 0) == 1
    assert C.commit(spark, path, points(spark, ("a", 1, 2)), None) == 2
    assert C.commit(spark, path, points(spark, ("a", 1, 1)), "q", 0) is None
    assert rows(spark, path) == [("a", 1, 2.0)]
    assert C.commit(spark, path, points(spark, ("a", 1, 3)), "q", 1) == 3 and C.commit(spark, path, points(spark, ("a", 2, 3)), "other", 0) == 4
    assert {(r.query, r.batch) for r in C.manifest(spark, path, 4).where("day is null").collect()} == {("q", 1), ("other", 0)}


@pytest.mark.parametrize("until", ["data", "changes", "log"])
def test_a_half_written_commit_is_not_seen(spark, tmp_path, until, monkeypatch):
    """The writer dies after some of a commit's folders are there, or while the manifest is written."""
    path = str(tmp_path)
    C.commit(spark, path, points(spark, ("a", 1, 1), ("a", 2, 1)), "q", 0)
    C.commit(spark, path, points(spark, ("a", 2, 5), ("a", 3, 5)), "q", 1)
    if until == "log":
        (tmp_path / "log/number=2/_SUCCESS").unlink()
    else:
        for folder in ("log", "changes")[: 1 if until == "changes" else 2]:
            C.removed(spark, f"{path}/{folder}/number=2")
    assert C.head(spark, path) == 1 and rows(spark, path) == [("a", 1, 1.0), ("a", 2, 1.0)]
    assert C.commit(spark, path, points(spark, ("a", 2, 5), ("a", 3, 5)), "q", 1) in (2, 3)
    assert rows(spark, path) == [("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 5.0)]
    C.vacuum(spark, path)
    assert rows(spark, path) == [("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 5.0)]


def test_refetch_repairs_the_last_seven_days(spark, tmp_path):
    path = str(tmp_path)
    late = [("a", at(d, h), f"u{h}", "p") for d in range(1, 11) for h in range(1, 4)] + [("a", at(9, 5), "[deleted]", "p")]
    early = [r for r in late if r[1].hour < 3]
    count = lambda posts: spark.createDataFrame(posts, POSTS).groupBy("series_id", F.to_date("ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    C.commit(spark, path, count(early))
    series = spark.createDataFrame([("a",), ("quiet",)], "series_id string")
    C.refetch(spark, path, spark.createDataFrame(late, POSTS), series, "2024-01-11", 1000)
    got = {(r.series_id, r.ts.day): r for r in C.read(spark, path).collect()}
    assert [got["a", d].value for d in range(1, 11)] == [2, 2, 2, 3, 3, 3, 3, 3, 4, 3]
    assert [got["quiet", d].value for d in range(4, 11)] == [0] * 7 and ("quiet", 3) not in got
    assert got["a", 9].contributors == 3 and got["a", 9].raw_count == 4
    # A full listing that reaches back two days repairs those only.
    C.refetch(spark, path, spark.createDataFrame([r for r in late if r[1].hour == 1], POSTS), series, "2024-01-11", 3)
    assert [r[2] for r in rows(spark, path) if r[0] == "a"] == [2, 2, 2, 3, 3, 3, 3, 3, 1, 1]


def test_streams_add_to_one_table(spark, tmp_path):
    """Batches of one checkpoint, then of a new one whose source begins later, give the days of one run over everything."""
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    parts = [[(at(1, 1), "a"), (at(1, 5), "a"), (at(1, 7), "b")], [(at(2, 1), "a"), (at(5, 1), "a")], [(at(9, 1), "b"), (at(9, 2), "b"), (at(14, 1), "a")]]
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        C.start(spark.readStream.schema(EVENTS).parquet(source), path, f"{tmp_path}/one").awaitTermination()
    first = rows(spark, path)
    assert first == [("a", 1, 2.0), ("a", 2, 1.0), ("a", 5, 1.0), ("b", 1, 1.0), ("b", 9, 2.0)]
    later = f"{tmp_path}/later"
    spark.createDataFrame([(at(9, 2), "b"), (at(10, 1), "b"), (at(14, 1), "a"), (at(20, 1), "a")], EVENTS).write.parquet(later)
    C.start(spark.readStream.schema(EVENTS).parquet(later), path, f"{tmp_path}/two", begin="2024-01-10").awaitTermination()
    assert rows(spark, path) == sorted([*first, ("b", 10, 1.0), ("a", 14, 1.0)])
    assert len({r.query for r in C.manifest(spark, path, C.head(spark, path)).where("day is null").collect()}) == 2


def test_only_touched_series_are_judged_anew(spark, tmp_path):
    path = str(tmp_path)
    days = [(s, (D(2024, 1, 1) + dt.timedelta(days=i)), float(100 + i % 3 + (400 * (i >= 50) if s == "b" else 0))) for s in ("a", "b") for i in range(60)]
    frame = lambda rs: spark.createDataFrame(rs, "series_id string, ts date, value double")
    C.commit(spark, path, frame(days))
    assert C.judge(spark, path, "t", "s") == 1
    old = {r.series_id: (r.label, r.number) for r in C.verdicts(spark, path).collect()}
    assert set(old) == {"a", "b"} and {n for _, n in old.values()} == {1}
    C.commit(spark, path, frame([(s, d, v + 900 if s == "a" and d >= D(2024, 2, 15) else v) for s, d, v in days if d >= D(2024, 2, 10)]))
    assert C.judge(spark, path, "t", "s") == 2
    new = {r.series_id: (r.label, r.number) for r in C.verdicts(spark, path).collect()}
    assert new["b"] == old["b"] and new["a"][1] == 2 and new["a"][0] != old["a"][0]
    assert C.judge(spark, path, "t", "s") == 2 and C.verdicts(spark, path).count() == 2
