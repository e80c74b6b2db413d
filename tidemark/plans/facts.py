"""Facts walked from any result document: numbers and dates that a text about it may mention.

A document is JSON; rows of one id are parts of one document, so a large one need
not be a single value. Its values are taken apart level by level as variants, all
documents at once, in one plan without a shuffle: what is no object or array goes
on as it is, and there are as many levels as the deepest document has. A number is
a fact, as a percentage where its key says so; numbers and dates inside strings are
facts; so are the counts that a reader can see: of evidence, of checks that ran, of
each stance, of conditions and of caveats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import narration as N

#: Endings of keys whose numbers are percentages, and lists whose lengths are facts.
PERCENT_KEYS = ("_pct", "_percent")
COUNTED = ("evidence", "change_my_mind", "caveats")
STANCE, SKIPPED = "stance", "skipped"
#: A string in JSON.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def marks(json: Column) -> Column:
    """A document's brackets; strings are not looked into."""
    return F.regexp_replace(F.regexp_replace(json, f"(?s){STRING}", ""), r"[^\[\]{}]++", "")


def depth(marks: Column) -> Column:
    """How deep brackets lie in each other."""
    step = lambda a, m: F.struct((a["now"] + F.when(m.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(m.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(marks, ""), lambda m: m != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def nesting(json: Column) -> Column:
    """How deep a document's objects and arrays lie in each other."""
    return depth(marks(json))


def deepest(docs: DataFrame, json_col: str) -> int:
    """The nesting of the deepest document; documents of one form are looked at once."""
    forms = docs.select(marks(F.col(json_col)).alias("marks")).distinct()
    return forms.agg(F.coalesce(F.max(depth(F.col("marks"))), F.lit(0))).first()[0]


def leaves(docs: DataFrame, id_col: str, json_col: str, levels: int) -> DataFrame:
    """(id, number, percent, text, stance, opens, top) of every value that is no object or array; a document without any has one row.

    top is the outermost key; opens: whether the value is the first of an item of
    the list (or object) there. What is no JSON has no values.
    """
    spark, read = docs.sparkSession, F.try_parse_json(F.col(json_col))
    # Only what holds something is taken apart; other values wait beside it.
    holds = lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    apart = lambda df, v: df.withColumn("__holds", holds(v)).withColumns({"leaf": F.coalesce("leaf", F.when(~F.col("__holds"), v)), "v": F.when(F.col("__holds"), v)})
    now = docs.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("top"), F.lit(False).alias("opens"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("leaf"), read.alias("__value"))
    now = apart(now, F.col("__value")).select("id", "top", "opens", "key", "leaf", "v")
    inner = spark.tvf.variant_explode_outer(F.col("v").outer()).select(F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__value"))
    for level in range(levels):
        now = now.lateralJoin(inner)
        opens = {0: F.lit(False), 1: F.col("__pos").isNotNull()}.get(level, F.col("opens") & (F.coalesce("__pos", F.lit(0)) == 0))
        now = apart(now.withColumns({"opens": opens, "top": F.col("__key") if level == 0 else F.col("top"), "key": F.coalesce("__key", "key")}), F.col("__value")).select("id", "top", "opens", "key", "leaf", "v")
    now = now.select("id", "top", "opens", "key", F.col("leaf").alias("v"))
    kind = F.schema_of_variant("v")
    text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))
    return now.select(
        "id",
        F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("v", "$", N.DECIMAL)).alias("number"),
        F.coalesce(F.col("key").endswith(PERCENT_KEYS[0]) | F.col("key").endswith(PERCENT_KEYS[1]), F.lit(False)).alias("percent"),
        text.alias("text"),
        F.when((F.col("top") == "evidence") & (F.col("key") == STANCE), text).alias("stance"),
        "opens",
        "top",
    )


def facts(docs: DataFrame, id_col: str, json_col: str, name: str, own: dict[str, Column], put: dict[str, Column]) -> DataFrame:
    """(id, what put makes, name): facts of each document from its texts and counts, and aggregates of its numbers.

    own: aggregates over a document's values of one stance, put: over those. Only
    texts with digits are gathered: without one, a text holds no number or date.
    """
    levels = deepest(docs, json_col)
    per = leaves(docs, id_col, json_col, levels).groupBy("id", "stance").agg(F.count("stance").alias("n_stance"), *[F.count_if(F.col("opens") & (F.col("top") == k)).alias(f"n_{k}") for k in COUNTED], *[c.alias(k) for k, c in own.items()])
    stances = F.collect_list(F.when(F.col("stance").isNotNull(), F.struct("stance", "n_stance")))
    per = per.groupBy("id").agg(stances.alias("stances"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in COUNTED], *[c.alias(k) for k, c in put.items()])
    some = docs.where(F.array_join(F.regexp_extract_all(F.col(json_col), F.lit(f"(?s){STRING}"), F.lit(0)), "").rlike("[0-9]"))
    texts = leaves(some, id_col, json_col, levels).where(F.col("text").rlike("[0-9]")).groupBy(F.col("id").alias("__id")).agg(F.array_join(F.collect_list("text"), N.BREAK).alias("texts"))
    rows = N.with_tokens(per.join(texts, F.col("id").eqNullSafe(F.col("__id")), "left"), F.col("texts"))
    ran = F.aggregate(F.filter("stances", lambda x: x["stance"] != SKIPPED), F.lit(0).cast("long"), lambda a, x: a + x["n_stance"])
    counts = F.concat(F.array(*[F.col(f"n_{k}") for k in COUNTED], ran), F.transform("stances", lambda x: x["n_stance"]))
    counts = F.transform(counts, lambda n: F.struct(n.cast(N.DECIMAL).alias("value"), F.lit(False).alias("percent"))).cast(N.NUMBERS)
    return rows.select(F.col("id").alias(id_col), *put, N.known(F.col("__read"), counts).alias(name))


def payload_facts(docs: DataFrame, id_col: str = "series_id", json_col: str = "payload", name: str = "known") -> DataFrame:
    """(id_col, name): what texts about each document may use, for narration.with_issues.

    A document's facts meet in one row, as its text does.
    """
    number = F.when(F.col("number").isNotNull(), F.struct(F.col("number").alias("value"), "percent"))
    out = facts(docs, id_col, json_col, name, {"__n": F.collect_list(number)}, {"__n": F.flatten(F.collect_list("__n"))})
    return out.select(id_col, F.struct(F.concat(F.col("__n").cast(N.NUMBERS), F.col(f"{name}.numbers")).alias("numbers"), F.col(f"{name}.dates").alias("dates")).alias(name))


def fact_totals(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id_col, n_numbers, n_percent, total, dates): payload_facts summed up; a document's numbers are not gathered."""
    seen = F.col("number").isNotNull()
    own = {"n_numbers": F.count("number"), "n_percent": F.count_if(seen & F.col("percent")), "total": F.coalesce(F.sum(F.col("number").cast("double")), F.lit(0.0))}
    out = facts(docs, id_col, json_col, "known", own, {k: F.sum(k) for k in own})
    numbers = F.col("known.numbers")
    return out.select(
        id_col,
        (F.col("n_numbers") + F.size(numbers)).alias("n_numbers"),
        (F.col("n_percent") + F.size(F.filter(numbers, lambda x: x["percent"]))).alias("n_percent"),
        F.aggregate(numbers, F.col("total"), lambda a, x: a + x["value"].cast("double")).alias("total"),
        F.array_sort("known.dates").alias("dates"),
    )
