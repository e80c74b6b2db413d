"""From raw buckets to regular series, windows and robust statistics.

Everything is keyed by series_id and stays in the JVM. Rows come with their
series' settings on them (``raw`` schema), so that one shuffle by series_id
serves every window below.

raw: series_id, freq, scale, ts date, value double (null: gap), contributors,
top_share, raw_count, imputed, ordinal (order of input), fetched_at timestamp,
partial_rule, upload_date, last_incomplete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Settings

SERIES = ["series_id", "freq", "scale"]
META = ["fetched_at", "partial_rule", "upload_date", "last_incomplete"]


def over_series(*order):
    """A window over one series; windows need a session, so they are made when a plan is."""
    w = Window.partitionBy("series_id")
    return w.orderBy(*order) if order else w


def per_freq(values: dict, freq: str | Column = "freq") -> Column:
    """The value of a frequency."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col(freq) if isinstance(freq, str) else freq]


def week_anchor(raw: DataFrame) -> DataFrame:
    """(series_id, anchor): the most common weekday (Monday 0) of weekly series; ties go to the earliest."""
    days = raw.where("freq = 'W'").groupBy("series_id", F.weekday("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy("series_id").agg(F.max(F.struct("n", (-F.col("day")).alias("d")))["d"].alias("d")).select("series_id", (-F.col("d")).alias("anchor"))


def period_start(ts: Column, freq: Column, anchor: Column) -> Column:
    """The day itself, the latest anchor weekday, or the first of the month."""
    return F.when(freq == "M", F.trunc(ts, "MM")).when(freq == "W", F.date_sub(ts, F.pmod(F.weekday(ts) - anchor, F.lit(7)).cast("int"))).otherwise(ts)


def period_end(start: Column, freq: Column) -> Column:
    """The first day after a period."""
    return F.when(freq == "M", F.add_months(start, 1)).when(freq == "W", F.date_add(start, 7)).otherwise(F.date_add(start, 1))


def snapped(raw: DataFrame) -> DataFrame:
    """Rows at their period's start, the last in input order for each, and how many went."""
    rows = raw.join(week_anchor(raw), "series_id", "left")
    rows = rows.withColumn("ts", period_start(F.col("ts").cast("date"), F.col("freq"), F.coalesce("anchor", F.lit(0)))).drop("anchor")
    last = Window.partitionBy("series_id", "ts").orderBy(F.desc("ordinal"))
    rows = rows.withColumn("__n", F.row_number().over(last))
    return rows.withColumn("n_duplicates", F.count_if(F.col("__n") > 1).over(over_series())).where("__n = 1").drop("__n", "ordinal")


def without_partial(rows: DataFrame) -> DataFrame:
    """Drops a last period that is not over: said so, ends after the fetch, or holds the upload date."""
    end = period_end(F.col("ts"), F.col("freq"))
    partial = F.coalesce("last_incomplete", F.lit(False)) | F.when(
        F.coalesce("partial_rule", F.lit("fetched_at")) == "fetched_at", end.cast("timestamp") > F.col("fetched_at")
    ).otherwise((F.col("ts") <= F.col("upload_date")) & (F.col("upload_date") < end))
    rows = rows.withColumn("__drop", (F.col("ts") == F.max("ts").over(over_series())) & F.coalesce(partial, F.lit(False)))
    return rows.withColumn("dropped_partial", F.bool_or("__drop").over(over_series())).where("not __drop").drop("__drop")


def regular(rows: DataFrame) -> DataFrame:
    """Every period from the first observed one to the last; missing ones are null and not imputed."""
    first = F.min(F.when(F.col("value").isNotNull(), F.col("ts")))
    ends = rows.groupBy(*SERIES).agg(first.alias("first"), F.max("ts").alias("last"), F.max("n_duplicates").alias("n_duplicates"), F.bool_or("dropped_partial").alias("dropped_partial")).where("first is not null")
    step = lambda s: F.expr(f"sequence(first, last, interval {s})")
    days = F.when(F.col("freq") == "M", step("1 month")).when(F.col("freq") == "W", step("7 day")).otherwise(step("1 day"))
    calendar = ends.select(*SERIES, "n_duplicates", "dropped_partial", F.explode(days).alias("ts"))
    seen = rows.select("series_id", "ts", "value", "contributors", "top_share", "raw_count", "imputed")
    return calendar.join(seen, ["series_id", "ts"], "left").withColumn("imputed", F.coalesce("imputed", F.lit(False)))


def recent_length(n: Column, s: Settings) -> Column:
    """A share of the periods, rounded half up, within the frequency's bounds."""
    return F.least(F.greatest(F.floor(n * s.recent_frac + 0.5).cast("int"), per_freq(s.recent_min)), per_freq(s.recent_max))


def with_stats(points: DataFrame, column: str, prefix: str, s: Settings) -> DataFrame:
    """Median and scaled MAD of a column's baseline: <prefix>median, <prefix>mad_unfloored, <prefix>mad."""
    base = F.when(F.col("segment") == "baseline", F.col(column))
    out = points.withColumn(f"{prefix}median", F.median(base).over(over_series()))
    spread = F.when(F.col("segment") == "baseline", F.abs(F.col(column) - F.col(f"{prefix}median")))
    out = out.withColumn(f"{prefix}mad_unfloored", F.median(spread).over(over_series()) * s.mad_scale)
    floor = s.mad_floor * F.greatest(F.col(f"{prefix}median"), F.lit(1.0))
    return out.withColumn(f"{prefix}mad", F.when(F.col(f"{prefix}mad_unfloored") == 0, floor).otherwise(F.col(f"{prefix}mad_unfloored")))


def windowed(points: DataFrame, s: Settings) -> DataFrame:
    """Positions, working scale, windows, history and baseline statistics.

    A series with a negative value on a log scale has no working values
    (``negative`` is true): it is an error, not a series with gaps.
    """
    log = F.col("scale").isin(*s.log_scales)
    out = points.withColumns({"idx": F.row_number().over(over_series("ts")) - 1, "n": F.count(F.lit(1)).over(over_series()), "n_observed": F.count("value").over(over_series()), "negative": log & F.coalesce(F.min("value").over(over_series()) < 0, F.lit(False))})
    out = out.withColumns(
        {
            "transform": F.when(log, "log1p").otherwise("identity"),
            "work": F.when(~F.col("negative"), F.when(log, F.log1p("value")).otherwise(F.col("value"))),
            "n_recent": recent_length(F.col("n"), s),
            "min_required": per_freq(s.min_history),
        }
    )
    out = out.withColumns({"recent_start": F.col("n") - F.col("n_recent"), "sufficient": (F.col("n_observed") >= F.col("min_required")) & ~F.col("negative")})
    out = out.withColumn("segment", F.when(F.col("idx") < F.col("recent_start"), "baseline").otherwise("recent"))
    return with_stats(with_stats(out, "work", "", s), "value", "original_", s)


def gap_filled(points: DataFrame, column: str, s: Settings) -> DataFrame:
    """<column>_filled and was_filled: inner runs of up to gap_fill_max missing periods, on the line between their neighbours."""
    before, after = over_series("ts").rowsBetween(Window.unboundedPreceding, 0), over_series("ts").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("idx").alias("i"), F.col(column).alias("v")))
    out = points.withColumns({"__a": F.last(known, ignorenulls=True).over(before), "__b": F.first(known, ignorenulls=True).over(after)})
    run = F.col("__b.i") - F.col("__a.i") - 1
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("idx") - F.col("__a.i")) / F.nullif(F.col("__b.i") - F.col("__a.i"), F.lit(0))
    fill = F.col(column).isNull() & F.coalesce(run <= s.gap_fill_max, F.lit(False))
    return out.withColumns({f"{column}_filled": F.when(fill, line).otherwise(F.col(column)), "was_filled": fill}).drop("__a", "__b")


def preprocess(raw: DataFrame, s: Settings | None = None) -> DataFrame:
    """Snap and deduplicate, drop a partial last period, regularise, transform, window, fill short gaps."""
    s = s or Settings()
    return gap_filled(windowed(regular(without_partial(snapped(raw))), s), "work", s)


def truncated(raw: DataFrame, as_of: str) -> DataFrame:
    """Only periods that end by a day (months are cut by their start, as published)."""
    span = F.when(F.col("freq") == "W", 6).otherwise(0)
    return raw.where(F.date_add(F.col("ts").cast("date"), span.cast("int")) <= F.lit(as_of).cast("date"))


def weekly_sums(daily: DataFrame) -> DataFrame:
    """Complete Monday-to-Sunday sums of daily rows: all seven days observed; imputed if any is."""
    week = F.date_trunc("week", "ts").cast("date").alias("ts")
    sums = daily.groupBy("series_id", week).agg(F.sum("value").alias("value"), F.count("value").alias("days"), F.bool_or(F.coalesce("imputed", F.lit(False))).alias("imputed"))
    return sums.where("days = 7").drop("days")
