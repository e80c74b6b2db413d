import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.sources import catalogue as C


def doc(source="interest", value=1.0, at="2026-01-01T00:00:00"):
    return json.dumps({"source": source, "query": "q", "freq": "D", "scale": "relative_0_100", "meta": {"fetched_at": at}, "points": [{"ts": "2025-12-30", "value": value}, {"ts": "2025-12-31", "value": value + 1}]})


def table(days=3, value=50):
    return "\n".join(["Day,q: (Worldwide)", *[f"2025-12-{d + 1:02d},{value + d}" for d in range(days)]])


def test_preference_sidecars_and_faults(spark, tmp_path):
    files = {
        "both.json": doc(value=5.0), "both.csv": table(), "only-json.json": doc(at="2026-01-30T00:00:00"), "only-csv.csv": table(), "with-sidecar.csv": table(value=20), "with-sidecar.meta.json": json.dumps({"fetched_at": "2026-01-20T10:00:00"}),
        "broken.json": "{nothing", "broken.csv": table(), "odd.csv": table(), "odd.meta.json": json.dumps({"fetched": 1}), "foreign.json": doc("reddit"), "bad-cells.csv": table() + "\n2025-13-01,5", "notes.txt": "x",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    raw, faults, caveats = C.load(spark, str(tmp_path), F.lit("2026-02-01").cast("date"), "interest")
    got = {}
    for r in raw.collect():
        got.setdefault(r.series_id, []).append(r)
    assert set(got) == {"both", "only-json", "only-csv", "with-sidecar"}
    assert sorted(r.value for r in got["both"]) == [5.0, 6.0] and sorted(r.value for r in got["only-csv"]) == [50, 51, 52]
    side = got["with-sidecar"][0]
    assert (side.fetched_at, side.last_incomplete, side.upload_date, side.scale) == (dt.datetime(2026, 1, 20, 10), False, dt.date(2026, 1, 20), "relative_0_100")
    assert all(r.last_incomplete for r in got["only-csv"]) and not got["both"][0].last_incomplete
    told = {r.slug: (r.file, r.reason) for r in faults.collect()}
    assert told == {
        "broken": ("broken.json", "could not be read"), "odd": ("odd.csv", "its sidecar tells no time"), "foreign": ("foreign.json", "a snapshot of reddit"), "bad-cells": ("bad-cells.csv", "1 fault(s), the first: not a date"),
    }
    said = {r.series_id: r.caveats for r in caveats.collect()}
    assert said["both"] == ["from a snapshot", "the snapshot is 31 days old"] and said["only-json"] == ["from a snapshot"]


def test_sources_with_and_without_a_snapshot(spark, tmp_path):
    for source, names in (("interest", ("a.json", "b.csv")), ("reddit", ("a.json", "c.json", "c.meta.json"))):
        (tmp_path / source).mkdir()
        for name in names:
            (tmp_path / source / name).write_text("{}")
    found = C.present(C.listing(spark, f"{tmp_path}/interest"), "interest").unionByName(C.present(C.listing(spark, f"{tmp_path}/reddit"), "reddit"))
    assert sorted(map(tuple, found.collect())) == [("a", "interest"), ("a", "reddit"), ("c", "reddit")]
    assert {r.slug: r.sources for r in C.absent(found, ["x", "interest", "reddit"]).collect()} == {"a": ["x"], "c": ["x", "interest"]}
