"""Do several sources of a topic say the same? Their recent windows must overlap to be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Settings

#: Order in which equally frequent outcomes lead. Fixed by the published behaviour.
OUTCOMES = ("TREND up", "TREND down", "FLUKE", "SEASONAL", "NO_CHANGE", "INCONCLUSIVE")


def overlap(start, end, days):
    """Covered share of a window of so many days that ends (exclusive) at end."""
    def covered(s, e):
        inner = F.datediff(F.least(e, end), F.greatest(s, start))
        return F.greatest(inner, F.lit(0)) / days

    return covered


def compare_sources(windows: DataFrame, s: Settings | None = None) -> DataFrame:
    """Per topic, from rows (topic, source, start, end exclusive, outcome; null outcome: the source failed).

    The common length is the shortest window. Each window's end is tried as the
    anchor; the one with most comparable windows wins, the later of equals, and
    then moves to the earliest end among those. A source is compared if at
    least min_overlap of the common window, to four decimals, is its own.
    Topics are joined with themselves only: anchors are a topic's own ends.
    """
    s = s or Settings()
    live = windows.where("outcome is not null").withColumn("days", F.min(F.datediff("end", "start")).over(Window.partitionBy("topic")))
    anchors = live.select("topic", F.col("end").alias("anchor")).distinct()
    tried = live.join(anchors, "topic").withColumn("fits", overlap(F.date_sub("anchor", F.col("days").cast("int")), F.col("anchor"), F.col("days"))(F.col("start"), F.col("end")) >= s.min_overlap)
    best = tried.groupBy("topic", "anchor").agg(F.count_if("fits").alias("n"), F.min(F.when(F.col("fits"), F.col("end"))).alias("first_end"))
    best = best.groupBy("topic").agg(F.max(F.struct("n", "anchor", "first_end"))["first_end"].alias("anchor"))
    placed = live.join(best, "topic").withColumn("share", F.round(overlap(F.date_sub("anchor", F.col("days").cast("int")), F.col("anchor"), F.col("days"))(F.col("start"), F.col("end")), 4))
    placed = placed.withColumn("compared", F.col("share") >= s.min_overlap)
    counts = placed.groupBy("topic", "outcome").agg(F.count_if("compared").alias("k"))
    order = F.create_map(*[x for i, o in enumerate(OUTCOMES) for x in (F.lit(o), F.lit(i))])
    lead = counts.where("k > 0").groupBy("topic").agg(F.max(F.struct("k", (-order[F.col("outcome")]).alias("o"), "outcome"))["outcome"].alias("lead"), F.max("k").alias("n_lead"), F.count(F.lit(1)).alias("n_outcomes"))
    whole = placed.groupBy("topic").agg(F.max("anchor").alias("window_end"), F.max("days").cast("long").alias("days"), F.count_if("compared").alias("n_compared"), F.count_if(~F.col("compared")).alias("n_apart"), F.array_sort(F.collect_list(F.when(F.col("compared"), F.col("source")))).alias("sources"))
    failed = windows.groupBy("topic").agg(F.count_if(F.col("outcome").isNull()).alias("n_unavailable"))
    out = failed.join(whole, "topic", "left").join(lead, "topic", "left")
    agree = F.when(F.coalesce("n_compared", F.lit(0)) < 2, "not comparable").when(F.col("n_outcomes") == 1, "agree").otherwise("differ")
    return out.withColumn("agreement", agree)


def source_windows(verdicts: DataFrame) -> DataFrame:
    """The rows of compare_sources, from verdict rows; the source is the series."""
    end = F.when(F.col("freq") == "M", F.add_months("last_ts", 1)).when(F.col("freq") == "W", F.date_add("last_ts", 7)).otherwise(F.date_add("last_ts", 1))
    return verdicts.select("topic", F.col("series_id").alias("source"), F.col("window_start").alias("start"), end.alias("end"), F.when(F.col("label") == "TREND", F.concat_ws(" ", "label", "direction")).otherwise(F.col("label")).alias("outcome"))
