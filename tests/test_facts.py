import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import narration as N
from tidemark.plans import facts as X

PAYLOAD = {
    "source": "Forum 7",
    "verdict": {"label": "TREND", "reason": "rose since 2026-09-01"},
    "evidence": [
        {"check": "a", "stance": "supports_trend", "summary": "up", "numbers": {"share_pct": 12.3, "deep": [{"x": [[4.25]]}, 99]}},
        {"check": "b", "stance": "supports_trend", "numbers": {"when": "2026-09-28", "flag": True, "none": None}},
        {"check": "c", "stance": "skipped", "numbers": {}},
    ],
    "change_my_mind": [{"text": "above -3,000"}],
    "caveats": [],
    "odd [key": "brackets } in ] strings \"{[",
}


def flat(value, key=None):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flat(v, k)
    elif isinstance(value, list):
        for v in value:
            yield from flat(v, key)
    else:
        yield key, value


def facts_of(spark, *docs):
    rows = spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "series_id int, payload string")
    return {r.series_id: r.known for r in X.payload_facts(rows).collect()}


def test_numbers_and_dates_of_nested_documents(spark):
    got = facts_of(spark, PAYLOAD, {}, None, "no json {", [1, [2, {"k_percent": 3}]], 5)
    numbers = sorted((float(n.value), n.percent) for n in got[0].numbers)
    # Lengths: three checks, two that ran, one condition, no caveat, two and one of each stance.
    want = [(12.3, True), (4.25, False), (99.0, False), (7.0, False), (-3000.0, False)] + [(float(n), False) for n in (3, 2, 1, 0, 2, 1)]
    assert numbers == sorted(want)
    assert sorted(d.isoformat() for d in got[0].dates) == ["2026-09-01", "2026-09-28"]
    assert sum(isinstance(v, float | int) and not isinstance(v, bool) for _, v in flat(PAYLOAD)) == 3
    assert sorted((float(n.value), n.percent) for n in got[4].numbers) == [(0.0, False)] * 4 + [(1.0, False), (2.0, False), (3.0, True)]
    assert sorted(float(n.value) for n in got[5].numbers) == [0, 0, 0, 0, 5]
    assert got[1].dates == [] and set(got) == set(range(6))
    assert facts_of(spark) == {}


CASES = [
    ("TREND: 12.3% or 0.123 of it, below -3000, two checks and 4.2 since 28 September 2026", []),
    ("", ["empty"]),
    ("TREND " + "word " * 120, ["too_long"]),
    ("nothing", ["label_missing"]),
    ("TREND, not FLUKE", ["wrong_label"]),
    ("TREND on 2026-09-02", ["date"]),
    ("TREND by 13%", ["number"]),
    ("TREND of nine", ["number_word"]),
    ("TREND of 3000 and -12.3", ["number"]),
]


@pytest.mark.parametrize("text,codes", CASES)
def test_issue_codes_against_a_payload(spark, text, codes):
    rows = spark.createDataFrame([(1, json.dumps(PAYLOAD), text)], "series_id int, payload string, text string")
    known = X.payload_facts(rows.select("series_id", "payload"))
    got = N.with_issues(rows.join(known, "series_id"), F.col("text"), F.lit("TREND"), F.col("known")).first().issues
    assert [i.code for i in got] == codes


@pytest.mark.parametrize("text,depth", [("{}", 1), ("[[1],[2,[3]]]", 3), ('{"a":"[[[","b":["\\"]"]}', 2), ("5", 0), ("", 0)])
def test_nesting(spark, text, depth):
    assert spark.createDataFrame([(text,)], "t string").select(X.nesting(F.col("t")).alias("n")).first().n == depth


def test_a_document_in_parts_has_the_facts_of_the_whole_one(spark):
    whole = json.dumps(PAYLOAD | {"evidence": [*PAYLOAD["evidence"], {}, 7, []], "change_my_mind": {"a": 1, "b": [2, 3]}, "caveats": "41 more"})
    parts = [{k: v} for k, v in json.loads(whole).items() if k != "evidence"] + [{"evidence": [x]} for x in json.loads(whole)["evidence"]]
    docs = spark.createDataFrame([(1, whole), *[(2, json.dumps(p)) for p in parts], (3, None), (4, "no json {"), (None, "[5]")], "id int, json string")
    known = {r.id: r.known for r in X.payload_facts(docs, "id", "json").collect()}
    assert sorted(known[1].numbers) == sorted(known[2].numbers) and sorted(known[1].dates) == sorted(known[2].dates)
    # Six items of evidence, two of which are empty; two conditions; a caveat that is no list.
    assert sorted(float(n.value) for n in known[1].numbers) == sorted([12.3, 99, 4.25, 7, 7, 1, 2, 3, 41] + [6, 2, 0, 2, 2, 1])
    totals = {r.id: r for r in X.fact_totals(docs, "id", "json").collect()}
    assert set(totals) == set(known) == {1, 2, 3, 4, None}
    for k, t in totals.items():
        numbers = known[k].numbers
        assert (t.n_numbers, t.n_percent, t.dates) == (len(numbers), sum(n.percent for n in numbers), sorted(known[k].dates))
        assert t.total == pytest.approx(sum(float(n.value) for n in numbers))


def test_every_value_is_taken_apart_once(spark):
    docs = spark.createDataFrame([(1, "[[[[[[1]]]]]]")], "id int, json string")
    plan = X.fact_totals(docs, "id", "json")._jdf.queryExecution().optimizedPlan().toString()
    # Once for numbers and once for texts, whatever the depth.
    assert plan.count("try_parse_json") + plan.count("parseJson") == 2
