import datetime as dt
import json
from pathlib import Path

from pyspark.sql import functions as F

from tests.test_analysis import frame, noise, series
from tidemark.operators import history as H
from tidemark.sources import contracts, snapshots

D = dt.date


def full(spark, values=(1.0, None, 3.5), at="2026-01-09 10:00:00", article="Old", name="a b"):
    raw = frame(spark, series(name, list(values)))
    own = {"fetched_at": F.lit(at).cast("timestamp"), "partial_rule": F.lit("upload_date"), "upload_date": F.lit("2026-01-08").cast("date"), "last_incomplete": F.lit(True), "truncated_before": F.lit("2024-01-01").cast("date")}
    return raw.withColumns(own | {"meta": F.create_map(F.lit("article"), F.lit(article), F.lit("odd"), F.lit('"x",\n y'))})


def files(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in Path(path).rglob("part-*") if "/log/" not in str(p)}


def test_every_meta_field_comes_back(spark, tmp_path):
    raw = full(spark)
    assert [r.series for r in snapshots.write(raw, str(tmp_path)).collect()] == ["a b"]
    back, broken = snapshots.stored(spark, str(tmp_path))
    assert broken.count() == 0
    columns = ["series_id", "topic", "source", "freq", "scale", "ts", "value", "contributors", "imputed", "fetched_at", "partial_rule", "upload_date", "last_incomplete", "truncated_before"]
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, raw.select(*columns).collect()))
    meta = back.first().meta
    assert meta["article"] == "Old" and meta["odd"] == '"x",\n y' and meta["last_period_incomplete"] == "true"


def test_equal_content_gives_equal_bytes_one_point_a_line(spark, tmp_path):
    for folder, parts in (("one", 1), ("two", 7)):
        snapshots.write(full(spark, noise(40)).repartition(parts), str(tmp_path / folder))
    one, two = files(tmp_path / "one"), files(tmp_path / "two")
    assert list(one.values()) == list(two.values()) and len(one) == 1
    lines = next(iter(one.values())).decode().splitlines()
    doc = json.loads("\n".join(lines))
    assert len(lines) == 42 and list(doc) == sorted(set(doc) - {"points"}) + ["points"] and list(doc["meta"]) == sorted(doc["meta"])
    assert doc["points"][0]["ts"] == "2024-01-01" and all(json.loads(x.rstrip(",")) for x in lines[1:-1])
    assert "/source=" in next(iter(one)) and "/slug=a-b-" in next(iter(one))


def test_only_changed_series_are_written(spark, tmp_path):
    path = str(tmp_path)
    both = full(spark).unionByName(full(spark, name="other"))
    assert snapshots.write(both, path).count() == 2
    before = files(tmp_path)
    later = full(spark, at="2026-02-01 00:00:00").unionByName(full(spark, (1.0, 2.0, 3.5), at="2026-02-01 00:00:00", name="other"))
    assert [r.series for r in snapshots.write(later, path).collect()] == ["other"]
    assert {k: files(tmp_path)[k] for k in before} == before
    got = {(r.series_id, r.ts.day): (r.value, r.fetched_at.month) for r in snapshots.stored(spark, path)[0].collect()}
    assert got["a b", 2] == (None, 1) and got["other", 2] == (2.0, 2) and len(got) == 6


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path)
    snapshots.write(full(spark), path)
    snapshots.write(full(spark, (9.0, 9.0, 9.0)), path)
    (tmp_path / "log/number=2/_SUCCESS").unlink()
    assert [r.value for r in snapshots.stored(spark, path)[0].orderBy("ts").collect()] == [1.0, None, 3.5]
    snapshots.write(full(spark, (9.0, 9.0, 9.0)), path)
    assert [r.value for r in snapshots.stored(spark, path)[0].orderBy("ts").collect()] == [9.0, 9.0, 9.0]
    assert snapshots.stored(spark, f"{path}/none")[0].count() == 0


def test_another_article_is_another_history(spark):
    rows = lambda days, article, tags=None, topic="t": [("s", "wikipedia", "D", "count", D(2026, 1, d), float(d), {k: v for k, v in (("article", article), ("tags", tags), ("note", str(days))) if v}) for d in days]
    make = lambda r: spark.createDataFrame(r, "series_id string, source string, freq string, scale string, ts date, value double, meta map<string,string>")
    old = make(rows(range(1, 6), "Old"))
    assert H.can_merge(old, make(rows(range(4, 8), "Old"))).count() == 1
    assert H.can_merge(old, make(rows(range(4, 8), "New"))).count() == 0 and H.can_merge(old, make(rows(range(4, 8), "Old", "x"))).count() == 0
    assert H.can_merge(old, make(rows(range(4, 8), None))).count() == 0 and H.can_merge(make(rows(range(1, 3), None)), make(rows(range(4, 8), None))).count() == 1
    assert H.can_merge(make(rows(range(1, 3), "Old") + rows(range(3, 5), "New")), make(rows(range(4, 8), "New"))).count() == 0
    merged = H.merge_history(old, make(rows(range(4, 8), "Old")), 6)
    assert sorted(r.ts.day for r in merged.collect()) == [2, 3, 4, 5, 6, 7] and {r.meta["merged_days"] for r in merged.collect()} == {"2"}
    assert [r.caveat for r in H.merged_caveats(merged).collect()] == ["2 earlier day(s) were kept from previous refreshes"]
    again = H.merge_history(merged, make(rows(range(2, 8), "Old")), 6)
    assert "merged_days" not in again.first().meta and H.merged_caveats(again).count() == 0
    assert H.changed(merged, merged).count() == 0 and H.changed(merged, again).count() == 1


def test_collected_csv_round_trip(spark, tmp_path):
    rows = [("a", D(2026, 1, 2), 5.0, 3, 0.12345), ("a", D(2026, 1, 1), 0.0, 0, None), ("b", D(2026, 1, 1), 1.0, 1, 1.0)]
    snapshots.write_collected(spark.createDataFrame(rows, "series_id string, ts date, value double, contributors long, top_share double"), f"{tmp_path}/csv")
    text = next(Path(f"{tmp_path}/csv/series=a").glob("part-*")).read_text()
    assert text == f"date,count,contributors,top_share\n2026-01-01,0,0,\n2026-01-02,5,3,{0.12345:.4f}\n"
    back = contracts.collected_days(spark, f"{tmp_path}/csv/series=a").orderBy("ts").collect()
    assert [(r.ts.day, r.value, r.contributors, r.top_share) for r in back] == [(1, 0.0, 0, None), (2, 5.0, 3, float(text.splitlines()[2].split(",")[3]))]
