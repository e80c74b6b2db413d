import json

from tests.test_analysis import frame, noise, series
from tidemark.plans import results as E


def test_cards_and_summaries(spark):
    flat, spike, rise = noise(90), noise(90, seed=2), noise(90, seed=3)
    spike[-5] *= 4
    rise = [v + (6 * max(0, i - 60)) for i, v in enumerate(rise)]
    raw = frame(spark, series("flat", flat), series("spike", spike), series("rise", rise), series("short", flat[:10]))
    rows = E.results(raw).collect()
    cards = {r.series_id: json.loads(r.json) for r in rows if r.kind == "card"}
    assert set(cards) == {"flat", "spike", "rise", "short"} and sum(r.kind == "summary" for r in rows) == len({r.topic for r in rows})
    assert cards["spike"]["badge"] == {"text": "Fluke", "key": "FLUKE"} and cards["rise"]["badge"]["key"] == "TREND_up"
    for name, card in cards.items():
        chart = card["chart"]
        assert len(chart["observed"]) == (10 if name == "short" else 90)
        assert chart["peak"] == max(p["value"] for p in chart["observed"])
        assert card["label"] in card["narration"] and len(card["narration"].split()) <= 120
        assert {e["check"] for e in card["evidence"]} | {e["check"] for e in card["skipped"]} == set(E.V.CHECKS)
        assert all(e["summary"] and e["name"] for e in card["evidence"]) and all(e["reason"] for e in card["skipped"]) and card["fetched_at"]
    marks = {m["label"]: m for m in cards["spike"]["chart"]["annotations"]}
    assert marks["largest period"]["value"] == max(spike) and marks["recent window"]["end"] == cards["spike"]["chart"]["observed"][-1]["ts"]
    assert marks["usual values"]["lower"] < marks["usual values"]["upper"]


def test_narrations_say_what_they_may(spark):
    spike = noise(90, seed=2)
    spike[-5] *= 4
    gap = [None if i in (40, 41, 60) else v for i, v in enumerate(noise(90, seed=6))]
    rows = E.told(frame(spark, series("spike", spike), series("short", spike[:12]), series("gap", gap))).select("series_id", "narration", "issues", "payload", "caveats").collect()
    assert len(rows) == 3 and all(r.issues == [] for r in rows), [(r.narration, r.issues) for r in rows]
    by = {r.series_id: r for r in rows}
    assert "Few periods carry the change" in by["spike"].narration
    said = {e["check"]: e for e in json.loads(by["spike"].payload)["evidence"]}
    assert len(said) == 7 and isinstance(said["outliers"]["numbers"]["max_abs_z"], float) and said["outliers"]["numbers"]["max_date"].startswith("20")
    assert "3 days of 90 have no value; 3 of them were filled from their neighbours." in by["gap"].caveats


def test_failures_and_articles_on_cards(spark):
    rows = E.told(frame(spark, series("a", noise(40))))
    topic = rows.first().topic
    articles = spark.createDataFrame([("a", "A page", True, ["A", "B"])], "series_id string, article string, overridden boolean, candidates array<string>")
    failures = spark.createDataFrame([(topic, "b", "reddit", "switched off", True)], "topic string, series_id string, source string, message string, disabled boolean")
    got = {r.series_id: json.loads(r.json) for r in E.cards(rows, articles, failures).collect()}
    assert got["a"]["article"] == {"article": "A page", "overridden": True, "candidates": ["A", "B"]} and got["b"] == {"source": "reddit", "title": "Reddit", "series_id": "b", "message": "switched off", "disabled": True, "snapshot": False}
    summary = json.loads(E.summaries(rows).first().json)
    assert sum(summary["outcomes"].values()) == 1 and set(summary["overlaps"]) == {"a"} and summary["kind"] == "topic"
