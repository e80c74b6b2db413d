"""Results as JSON for a page: a card per series with its chart, a summary per topic.

Rows, not one document: a topic's summary and each of its cards are rows, so
nothing is gathered beyond one series' points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import narration as N
from tidemark.functions import wording as W
from tidemark.plans import evidence as E
from tidemark.plans import report as R
from tidemark.plans import verdict as V
from tidemark.plans.cross_source import source_windows
from tidemark.plans.facts import payload_facts

SCHEMA_VERSION = 1
MARK = "struct<label:string,start:string,end:string,lower:double,upper:double,ts:string,value:double>"


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def charts(raw: DataFrame, points: DataFrame) -> DataFrame:
    """Per series: observed (a gap has a day and no value), imputed, dropped_partial (a last period that was left out), bounds of both windows, peak (the largest value drawn)."""
    filled = F.coalesce("value", V.original(F.col("work_filled")))
    series = lambda cond, v: F.array_sort(F.collect_list(F.when(cond, F.struct(day(F.col("ts")).alias("ts"), v.alias("value")))))
    within = lambda f, segment: day(f(F.when(F.col("segment") == segment, F.col("ts"))))
    made = F.col("imputed") | F.col("was_filled")
    out = points.groupBy("series_id").agg(
        series(F.lit(True), F.col("value")).alias("observed"),
        series(made, filled).alias("imputed"),
        F.struct(within(F.min, "baseline").alias("baseline_start"), within(F.max, "baseline").alias("baseline_end"), within(F.min, "recent").alias("recent_start"), within(F.max, "recent").alias("recent_end")).alias("window"),
        F.max(filled).alias("peak"),
        F.max("ts").alias("__last"),
    )
    last = raw.groupBy("series_id").agg(F.max(F.struct("ts", "value")).alias("__end"))
    return out.join(last, "series_id").withColumn("dropped_partial", F.when(F.col("__end.ts") > F.col("__last"), F.struct(day(F.col("__end.ts")).alias("ts"), F.col("__end.value").alias("value")))).drop("__end", "__last")


def annotations(s: Settings) -> Column:
    """Marks of a chart, equal ones once: the band of usual values, the recent window, the largest period and the strongest outlier. Null where there is none."""

    def mark(label: str, **parts: Column) -> Column:
        fields = {"label": F.lit(label)} | parts
        return F.struct(*[fields.get(f.split(":")[0], F.lit(None)).alias(f.split(":")[0]) for f in MARK[7:-1].split(",")]).cast(MARK)

    edge = lambda k: V.original(F.col("median") + k * F.col("mad"))
    value_at = lambda ts: F.try_element_at(F.filter("observed", lambda p: p["ts"] == day(ts)), F.lit(1))["value"]
    point = lambda label, ts: F.when(ts.isNotNull(), mark(label, ts=day(ts), value=value_at(ts)))
    marks = [
        F.when(F.col("window.baseline_start").isNotNull() & F.col("mad").isNotNull(), mark("usual values", start=F.col("window.baseline_start"), end=F.col("window.baseline_end"), lower=edge(-s.band_mads), upper=edge(s.band_mads))),
        F.when(F.col("window.recent_start").isNotNull(), mark("recent window", start=F.col("window.recent_start"), end=F.col("window.recent_end"))),
        point("largest period", F.col("concentration_top1_ts")),
        point("strongest outlier", F.col("outliers_ts")),
    ]
    every = F.array_distinct(F.filter(F.array(*marks), lambda m: m.isNotNull()))
    return F.when(F.size(every) > 0, every)


def caveats() -> Column:
    """What preprocessing did to a series, in order, each once."""
    n, missing, filled = F.col("n_duplicates"), F.col("n") - F.col("n_observed"), F.coalesce("n_filled", F.lit(0))
    units = lambda c: W.period_words(c, F.col("freq"))
    said = F.array(
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" repeated "), units(n), F.lit(" replaced by the last value given."))),
        F.when(F.col("dropped_partial_flag"), F.concat(F.lit("The last "), W.mapped(F.col("freq"), W.PERIODS), F.lit(" is not over and was left out."))),
        F.when(F.col("truncated_before").isNotNull(), F.concat(F.lit("Nothing is known before "), day(F.col("truncated_before")), F.lit("."))),
        F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" "), units(missing), F.lit(" of "), F.col("n").cast("string"), F.lit(" have no value; "), filled.cast("string"), F.lit(" of them were filled from their neighbours."))),
        F.when(F.col("recent_imputed"), F.lit("Values of the recent window were filled in.")),
    )
    return F.array_distinct(F.filter(said, lambda c: c.isNotNull()))


def window_text() -> Column:
    """The periods compared, in a sentence; null without a recent window."""
    w = F.col("window")
    return F.concat(F.lit("The recent window ("), w["recent_start"], F.lit(" to "), w["recent_end"], F.lit(") was compared with a baseline from "), w["baseline_start"], F.lit(" to "), w["baseline_end"], F.lit("."))


def payload() -> Column:
    """All that a narration of a row may use, as JSON."""
    evidence = F.transform("evidence", lambda e: F.struct(e["check"].alias("check"), e["stance"].alias("stance"), e["summary"].alias("summary"), recorded(e["numbers"]).alias("numbers")))
    skipped = F.transform("skipped", lambda e: F.struct(e["check"].alias("check"), F.lit("skipped").alias("stance"), e["reason"].alias("summary"), recorded(e["numbers"]).alias("numbers")))
    parts = {
        "source": W.display_name(F.col("source")),
        "verdict": F.struct("label", "direction", "confidence", F.col("rule").alias("rule_fired"), "reason"),
        "evidence": F.concat(evidence, skipped),
        "change_my_mind": F.transform("condition_texts", lambda t: F.struct(t.alias("text"))),
        "caveats": F.col("caveats"),
        "window": F.struct("window.*", W.mapped(F.col("freq"), W.PERIODS).alias("period")),
    }
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]))


def recorded(numbers: Column) -> Column:
    """A sentence's recorded numbers and dates by key, as they are shown."""
    value = lambda n: F.parse_json(F.when(n["number"].isNull(), F.concat(F.lit('"'), n["text"], F.lit('"'))).otherwise(n["text"]))
    return F.map_from_entries(F.transform(numbers, lambda n: F.struct(n["key"], value(n))))


def told(raw: DataFrame, s: Settings | None = None) -> DataFrame:
    """Verdict rows with texts, evidence, charts, marks, caveats, a payload, a narration and its issues."""
    s = s or Settings()
    points, rows = V.analysed(raw, s)
    filled = points.groupBy("series_id").agg(F.count_if("was_filled").alias("n_filled"))
    fetched = raw.groupBy("series_id").agg(F.max("fetched_at").alias("fetched_at"))
    rows = R.with_texts(rows, s).withColumnRenamed("dropped_partial", "dropped_partial_flag").join(charts(raw, points), "series_id", "left").join(filled, "series_id", "left").join(fetched, "series_id", "left")
    rows = E.with_evidence(rows, s).withColumns({"annotations": annotations(s), "caveats": caveats(), "window_text": window_text()})
    text = N.narration(W.display_name(F.col("source")), F.col("label"), F.col("direction"), F.col("confidence"), F.col("rule"), F.col("reason"), E.lead(), F.try_element_at("condition_texts", F.lit(1)), F.col("window_text"))
    rows = V.written(rows.withColumns({"payload": payload(), "narration": text}), "told_rows")
    known = payload_facts(rows, "series_id", "payload").withColumnRenamed("series_id", "__series")
    rows = rows.join(known, F.col("series_id") == F.col("__series")).drop("__series")
    return N.with_issues(rows, F.col("narration"), F.col("label"), F.col("known"))


def cards(rows: DataFrame, articles: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """(topic, series_id, json) of told() rows, and of what gave no series.

    articles (series_id, article, overridden, candidates): what was looked up for
    a series. failures (topic, series_id, source, message, disabled): a card each,
    with the message in place of a verdict.
    """
    if articles is not None:
        rows = rows.join(articles.select("series_id", F.struct("article", "overridden", "candidates").alias("article")), "series_id", "left")
    key = F.concat_ws("_", "label", F.when(F.col("label") == "TREND", F.col("direction")))
    copied = F.coalesce("snapshot", F.lit(False)) if "snapshot" in rows.columns else F.lit(False)
    card = F.struct(
        "source", W.display_name(F.col("source")).alias("title"), "series_id", F.lit(None).cast("string").alias("message"), F.lit(False).alias("disabled"), copied.alias("snapshot"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"),
        F.struct(F.col("badge").alias("text"), key.alias("key")).alias("badge"), "label", "direction", "confidence", "rule", "reason", "window_text",
        F.transform("evidence", lambda e: F.struct(e["check"].alias("check"), e["name"].alias("name"), e["stance"].alias("stance"), e["stance_text"].alias("stance_text"), e["summary"].alias("summary"))).alias("evidence"),
        F.transform("skipped", lambda e: F.struct(e["check"].alias("check"), e["name"].alias("name"), e["reason"].alias("reason"))).alias("skipped"),
        F.col("condition_texts").alias("change_my_mind"), "caveats", *(["article"] if articles is not None else []), F.col("narration"),
        F.struct("freq", "scale", "observed", "imputed", "dropped_partial", "window", "annotations", "peak").alias("chart"),
    )
    out = rows.select("topic", "series_id", F.to_json(card).alias("json"))
    if failures is not None:
        none = F.struct("source", W.display_name(F.col("source")).alias("title"), "series_id", "message", "disabled", F.lit(False).alias("snapshot"))
        out = out.unionByName(failures.select("topic", "series_id", F.to_json(none).alias("json")))
    return out


def summaries(rows: DataFrame, s: Settings | None = None, kind: str = "topic", generated_at: Column | None = None) -> DataFrame:
    """(topic, json): the sentence over a topic's sources, which were compared, over which days, how many gave each outcome, and whether they agree."""
    windows = source_windows(rows)
    said = R.topic_sentences(windows, s)
    outcomes = windows.where("outcome is not null").groupBy("topic", "outcome").agg(F.count(F.lit(1)).alias("n")).groupBy("topic").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    covers = windows.join(said.select("topic", "window_start", "window_end", "days"), "topic")
    inner = F.greatest(F.datediff(F.least("end", "window_end"), F.greatest("start", "window_start")), F.lit(0)) / F.col("days")
    overlaps = covers.where("outcome is not null").groupBy("topic").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.round(inner, 4).alias("share"))))).alias("overlaps"))
    said = said.join(outcomes, "topic", "left").join(overlaps, "topic", "left")
    when = F.date_format(generated_at if generated_at is not None else F.lit(None).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    summary = F.struct(F.lit(SCHEMA_VERSION).alias("schema"), F.lit(kind).alias("kind"), F.col("topic").alias("query"), when.alias("generated_at"), "sentence", F.col("sources").alias("comparable"), "overlaps", "outcomes", "n_apart", "n_unavailable", "agreement")
    return said.select("topic", F.to_json(summary).alias("json"))


def results(raw: DataFrame, s: Settings | None = None, kind: str = "topic", generated_at: Column | None = None, articles: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """(topic, kind, series_id, json): a summary a topic and a card a series."""
    rows = V.written(told(raw, s), "told")
    of = lambda df, k: df.select("topic", F.lit(k).alias("kind"), F.col("series_id") if "series_id" in df.columns else F.lit(None).cast("string").alias("series_id"), "json")
    return of(summaries(rows, s, kind, generated_at), "summary").unionByName(of(cards(rows, articles, failures), "card"))
