import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_analysis import frame, noise, series
from tidemark.config import Settings
from tidemark.functions import narration as T
from tidemark.functions import numbers as N
from tidemark.plans import evidence as E
from tidemark.plans import verdict as V


def exact(value, decimals):
    """Half to even on the binary value, by decimals without rounding before."""
    return Decimal(value).quantize(Decimal(1).scaleb(-decimals), rounding=ROUND_HALF_EVEN)


@pytest.mark.parametrize("decimals", [0, 1, 2, 3])
def test_rounding_against_exact_decimals(spark, decimals):
    r = random.Random(decimals)
    values = [2.675, -0.04, 0.25, 2.5, 0.5, 1.5, -2.5, -0.5, 0.125, 0.375, 1.005, 0.0, -0.0, 1e15 + 0.5, 4503599627370495.5, 1e17, -1e18, 0.05, 0.15, 0.35, 1e-300, 5e-324, 0.49999999999999994, 8.5e14 + 0.25]
    values += [r.uniform(-1000, 1000) for _ in range(500)] + [r.randint(-4000, 4000) / 8 for _ in range(300)] + [round(r.uniform(-9, 9), decimals) + 0.5 * 10**-decimals for _ in range(500)] + [r.uniform(0, 1e13) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", N.rounded(F.col("v"), decimals).alias("r"), N.text_of(F.col("v"), decimals).alias("t")).collect()
    for x in rows:
        want = exact(x.v, decimals)
        assert x.r == round(x.v, decimals) and math.copysign(1, x.r) == (1 if want == 0 else math.copysign(1, x.v)), x
        assert x.t == (f"{want:f}" if want != 0 else f"{abs(want):f}"), x


def test_what_is_not_finite_is_null(spark):
    row = spark.createDataFrame([(float("nan"), float("inf"), None)], "a double, b double, c double")
    got = row.select(*[N.sentence("x ", N.value("k", F.col(c))).alias(c) for c in row.columns], *[N.rounded(F.col(c), 1).alias(f"r{c}") for c in row.columns]).first()
    assert list(got) == [None] * 6


def test_parts_show_and_record(spark):
    row = spark.createDataFrame([(0.0004, 0.0123, 0.12345, 7, "2024-03-05")], "tiny double, p double, share double, n int, d string")
    c = F.col
    said = N.sentence("a ", N.p_value("p1", c("tiny")), " b ", N.p_value("p2", c("p")), " c ", N.percent("s", c("share")), " ", N.count("n", c("n")), " on ", N.date("d", c("d").cast("date")), N.optional(c("n") > 9, " big ", N.count("big", c("n"))))
    got = row.select(said.alias("x")).first().x
    assert got.text == "a p < 0.001 b p = 0.012 c 12.3% 7 on 2024-03-05"
    assert {x.key: x.number if x.number is not None else x.text for x in got.numbers} == {"p1": 0.0, "p1_bound": 0.001, "p2": 0.012, "s": 12.3, "n": 7.0, "d": "2024-03-05"}


def test_every_number_of_every_sentence_is_recorded(spark):
    flat, spike, rise, rare = noise(90), noise(90, seed=2), noise(90, seed=3), [float(i % 4 == 0) for i in range(90)]
    spike[-5] *= 4
    rise = [v + (6 * max(0, i - 60)) for i, v in enumerate(rise)]
    step = [v + 90 * (i >= 75) for i, v in enumerate(noise(90, seed=4))]
    year = [100 + 50 * math.sin(i / 364 * 2 * math.pi) + i % 3 for i in range(900)]
    gap = [None if i % 9 == 4 else v for i, v in enumerate(noise(90, seed=6))]
    raw = frame(spark, series("flat", flat), series("spike", spike), series("rise", rise), series("rare", rare, scale="count"), series("one", noise(60, 50), scale="count", top_share=0.7, contributors=5, raw_count=50), series("short", flat[:10]), series("step", step), series("year", year), series("gap", gap))
    rows = E.with_evidence(V.verdicts(raw), Settings()).withColumn("lead", E.lead()).collect()
    seen = set()
    for r in rows:
        assert len(r.evidence) + len(r.skipped) == len(V.CHECKS) and [e.check for e in r.evidence] == [c for c in V.CHECKS if c in {e.check for e in r.evidence}]
        for e in [*r.evidence, *r.skipped]:
            text = e.summary if "summary" in e else e.reason
            assert text and "None" not in text, (r.series_id, e)
            seen.add((e.check, "summary" in e))
    flatten = spark.createDataFrame([((e.summary if "summary" in e else e.reason), e.numbers) for r in rows for e in [*r.evidence, *r.skipped]], f"text string, numbers array<{N.NUMBER}>")
    bad = T.with_undisplayed(flatten, F.col("text"), F.col("numbers"), "bad").where("size(bad) > 0").collect()
    assert bad == []
    assert {c for c, ran in seen if ran} >= {"persistence", "concentration", "outliers", "level_shift", "low_count", "breadth"} and {c for c, ran in seen if not ran} >= {"seasonality", "breadth", "low_count", "concentration"}
    by = {r.series_id: r for r in rows}
    assert by["spike"].lead.startswith("Few periods carry the change") and by["short"].lead is None
    shift = next(e for e in by["step"].evidence if e.check == "level_shift")
    assert "The level rose" in shift.summary


def test_numbers_that_are_not_recorded_are_found(spark):
    numbers = [("a", 12.3, "12.3"), ("d", None, "2024-03-05"), ("n", 2.0, "2")]
    texts = {"12.3 on 2024-03-05, two": [], "12.34 and 12": ["12.34", "12"], "on 2024-03-06": ["2024-03-06"], "three of 2": ["three"], "-12.3": ["-12.3"], "": []}
    df = spark.createDataFrame([(t, numbers) for t in texts], f"text string, numbers array<{N.NUMBER}>")
    assert {r.text: r.b for r in T.with_undisplayed(df, F.col("text"), F.col("numbers"), "b").collect()} == texts
