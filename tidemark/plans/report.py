"""What readers see: a sentence per topic over its sources, conditions in words, a table of topics by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import wording as W
from tidemark.plans.cross_source import OUTCOMES, compare_sources


def topic_sentences(windows: DataFrame, s: Settings | None = None) -> DataFrame:
    """compare_sources' rows with window_start and one sentence a topic.

    A window without days counts as a failed source. Sources are told in the
    order of their names; what is gathered per topic is one name a source.
    """
    windows = windows.withColumn("outcome", F.when(F.datediff("end", "start") > 0, F.col("outcome")))
    found = compare_sources(windows, s)
    rows = windows.join(found.select("topic", "sources", "lead"), "topic")
    within = F.coalesce(F.array_contains("sources", F.col("source")), F.lit(False))
    role = F.when(F.col("outcome").isNull(), "failed").when(~within, "apart").when(F.col("outcome") == F.col("lead"), "lead").otherwise(F.col("outcome"))
    told = rows.groupBy("topic", role.alias("role")).agg(F.array_sort(F.collect_list(F.struct("source", W.display_name(F.col("source")).alias("name")))).alias("n"))
    told = told.groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("role", F.col("n.name").alias("names")))).alias("told"))
    names = lambda k: F.try_element_at("told", F.lit(k))
    last = F.date_sub("window_end", 1)
    out = found.join(told, "topic").withColumn("window_start", F.date_sub("window_end", F.col("days").cast("int")))
    head = F.when(F.col("n_compared") == 1, W.joined(names("lead"))).otherwise(F.concat(F.col("n_lead"), F.lit(" of "), F.col("n_compared"), F.lit(" sources")))
    head = F.concat(head, F.lit(" "), W.phrase(F.col("lead"), F.col("n_lead")), F.lit(" over "), W.day_range(F.col("window_start"), last))
    clause = lambda k, say: F.when(names(k).isNotNull(), F.concat(W.joined(names(k)), F.lit(" "), say(F.size(names(k)))))
    clauses = [
        F.when(F.col("n_compared") > 0, head).otherwise("No sources could be compared over a common period"),
        *[clause(o, lambda n, o=o: W.phrase(F.lit(o), n)) for o in OUTCOMES],
        clause("apart", lambda n: F.when(n == 1, "is not comparable (different period)").otherwise("are not comparable (different period)")),
        clause("failed", lambda n: F.when(n == 1, "has no usable result").otherwise("have no usable result")),
    ]
    return out.withColumn("sentence", F.concat(F.concat_ws("; ", *clauses), F.lit("."))).drop("told")


# What a condition would mean, by label and kind of condition.
MEANS = {
    "FLUKE stay": "this becomes a trend",
    "TREND fall": "this was a fluke",
    "NO_CHANGE stay": "that would be a trend",
    "INCONCLUSIVE stay": "it is a trend",
    "INCONCLUSIVE fall": "the change was a fluke",
}


# The sentences of conditions below, and the clauses of topic_sentences above, are published texts that must match.
def condition_text(c: Column, s: Settings) -> Column:
    """A condition of verdicts() in words; its row's label, freq and counts are read beside it."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind, n, at, base = c["kind"], c["periods"].cast("string"), W.fixed(c["threshold"]), W.fixed(c["base"])
    units = W.period_words(c["periods"], F.col("freq"))
    means = lambda what: W.mapped(F.concat(F.col("label"), F.lit(f" {what}")), MEANS)
    far, near, z = W.multiplier(s.exceed_mads), W.multiplier(s.fallback_mads), W.multiplier(s.outlier_z)
    word = W.mapped(F.col("freq"), W.PERIODS)
    lower = c["threshold"] < c["base"]
    texts = {
        "stay_above": text("If the next ", n, " ", units, " all stay above ", at, f" (baseline median + {far} MADs), ", means("stay"), "."),
        "stay_below": text("If the next ", n, " ", units, " all stay below ", at, f" (baseline median - {far} MADs), ", means("stay"), "."),
        "fall_back_below": text("If the next ", n, " ", units, " fall back below ", at, f" (baseline median + {near} MAD), ", means("fall"), "."),
        "rise_back_above": text("If the next ", n, " ", units, " rise back above ", at, f" (baseline median - {near} MAD), ", means("fall"), "."),
        "unusual": text("A value above ", at, F.coalesce(text(" or below ", base), F.lit("")), f" would be unusual (|z| ≥ {z})."),
        "beyond_last_year": text(
            "If the next ", word, F.when(lower, " falls short of").otherwise(" exceeds"), " last year's same-", word, " value (", base, ", ", word, " of ", F.date_format("last_year_ts", "yyyy-MM-dd"),
            ") by more than ", W.fixed(F.abs(c["threshold"] - c["base"])), " (", F.when(lower, "below ").otherwise("above "), at, "), something beyond seasonality is happening.",
        ),
        "annual_history": text("With ", n, " more ", units, " of history the annual-pattern check can run; if the usual yearly pattern explains the change, it is seasonal rather than a trend."),
        "more_history": text("Need ", n, " more ", units, " of data to decide (", F.col("n_observed").cast("string"), " observed, at least ", F.col("min_required").cast("string"), " required)."),
        "broader_origins": text("If the recent volume spreads out so that the top origin's share drops below ", W.fixed(c["threshold"] * 100), "%, it would no longer look like a fluke."),
        "contributor_data": F.lit("Contributor data (distinct authors or sites per period) would show whether a single origin drives the change."),
    }
    return F.coalesce(*[F.when(kind == k, v) for k, v in texts.items()])


def with_texts(verdicts: DataFrame, s: Settings | None = None) -> DataFrame:
    """Verdicts with badge and condition_texts, an array in the order of conditions."""
    s = s or Settings()
    return verdicts.withColumns({"badge": W.badge(F.col("label"), F.col("direction")), "condition_texts": F.transform("conditions", lambda c: condition_text(c, s))})


def topic_table(entries: DataFrame, sources: list[str]) -> DataFrame:
    """A row a topic, a column for each of the named sources with its status, a dash where there is none."""
    wide = entries.groupBy("topic").pivot("source", sources).agg(F.max("status"))
    return wide.select("topic", *[F.coalesce(F.col(f"`{c}`"), F.lit("—")).alias(c) for c in sources])
