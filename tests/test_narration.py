import pytest
from pyspark.sql import functions as F

from tidemark.functions import narration as N

KNOWN = ["The window ran from 2026-09-01 to 2026-09-28; it grew by 12.3% and fell by -0.9 once; 1,234 views."]
CASES = [
    ("", ["empty:"]),
    (None, ["empty:"]),
    ("TREND up by 12% over 1–28 Sep 2026, 2.5x the 1,234 of before; September 1st.", []),
    ("NO CHANGE here.", ["label_missing:TREND", "wrong_label:NO_CHANGE"]),
    ("TREND of 77 in 2025.", ["number:77", "date:2025"]),
    ("TREND since 2026 and 5 October 2026.", ["date:5 October 2026"]),
    ("TREND until November, as it may.", ["date:November"]),
    ("TREND in seven of one case, two is known.", ["number_word:seven"]),
    ("TREND fell -0.9, not -12.3%.", ["number:-12.3%"]),
    ("TREND at 0.123, and 3 of 2.5.", []),
    ("TREND " + "word " * 120, ["too_long:121"]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_issues(spark, text, expected):
    df = spark.createDataFrame([(text, KNOWN, [2.5, 2.0])], "text string, known array<string>, numbers array<double>")
    df = N.with_facts(df, F.col("known"), F.col("numbers"), name="facts")
    got = N.with_issues(df, F.col("text"), F.lit("TREND"), F.col("facts"), name="i").first().i
    assert [f"{x.code}:{x.token}" for x in got] == expected


def test_rounding_and_paragraphs(spark):
    row = spark.sql("select cast(2.675 as decimal(30,12)) v, cast(2.68 as decimal(30,12)) up, cast(2.67 as decimal(30,12)) no, cast(2.5 as decimal(30,12)) h, cast(2 as decimal(30,12)) even, cast(3 as decimal(30,12)) odd, array('a b c', null, 'd e', 'f') p")
    d = lambda n: F.lit(n)
    got = row.select(N.shows(F.col("up"), d(2), F.col("v")).alias("a"), N.shows(F.col("no"), d(2), F.col("v")).alias("b"), N.shows(F.col("even"), d(0), F.col("h")).alias("c"), N.shows(F.col("odd"), d(0), F.col("h")).alias("e"), N.paragraph(F.col("p"), 4).alias("p")).first()
    assert (got.a, got.b, got.c, got.e, got.p) == (True, False, True, True, "a b c f")


TOKENS = [
    ("2x, x2, R4, v2.5 and 1,23", ["number:2", "number:2", "number:5", "number:1", "number:23"]),
    ("1,234,567.5 12 % 3 per cent 4 percent", ["number:1234567.5", "number:12%", "number:3%", "number:4%"]),
    ("-5 a-5 (-6) \u22127 3-4", ["number:-5", "number:5", "number:-6", "number:-7", "number:3", "number:4"]),
    ("2024-02-30 and 2024-1-1", ["date:2024-02-[30]", "number:2024", "number:1", "number:1"]),
    ("1st to 3rd of March, 2024; Sept. 5; dec 2020, the 21st", ["date:2024-03-[1, 3]", "date:None-09-[5]", "date:2020-12-[]", "number:21"]),
    ("May, March 3\u20135 2024 Marching", ["month:5", "date:2024-03-[3, 5]"]),
    ("NO CHANGE NO_CHANGE TREND_ TREND Twenty one", ["label:NO_CHANGE", "label:NO_CHANGE", "label:TREND", "word:20", "word:1"]),
    ("12\x003 March\x002024", ["number:12", "date:None-03-[3]", "number:2024"]),
    ("", []),
]


@pytest.mark.parametrize("text,expected", TOKENS)
def test_tokens(text, expected):
    def shown(t):
        if t["kind"] == "date":
            return f"date:{t['year']}-{t['month']:02d}-{t['days']}"
        if t["kind"] in ("number", "word"):
            return f"{t['kind']}:{'-' * t['negative']}{t['digits']}{'%' * t['percent']}"
        return f"{t['kind']}:{t.get('month') or t['text']}"

    assert [shown(t) for t in N.Scan(text).tokens()] == expected
