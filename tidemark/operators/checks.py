"""The seven checks. Four are column expressions; the kernels behind the others run once per series.

Every check gives, per series, ``ran`` and a stance (supports_trend,
supports_fluke, supports_seasonal, supports_no_change, neutral or skipped).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import kernels as K
from tidemark.functions.intervals import rate_ratios
from tidemark.operators.preprocess import over_series

SKIPPED = "skipped"


def in_recent():
    return F.col("segment") == "recent"


def concentration(points: DataFrame, s: Settings) -> DataFrame:
    """How much of the recent excess its one and two largest periods carry; ties go to the earlier one."""
    seen = points.where(in_recent() & F.col("sufficient") & F.col("work").isNotNull()).withColumn("excess", F.col("work") - F.col("median"))
    seen = seen.withColumn("sum", F.sum("excess").over(over_series())).withColumn("part", F.greatest(F.when(F.col("sum") > 0, F.col("excess")).otherwise(-F.col("excess")), F.lit(0.0)))
    seen = seen.withColumn("place", F.row_number().over(over_series(F.desc("part"), "idx")))
    out = seen.groupBy("series_id").agg(
        F.max("sum").alias("excess"),
        F.count(F.lit(1)).alias("n_seen"),
        F.max("mad").alias("mad"),
        F.try_divide(F.sum(F.when(F.col("place") <= 1, F.col("part"))), F.sum("part")).alias("top1"),
        F.try_divide(F.sum(F.when(F.col("place") <= 2, F.col("part"))), F.sum("part")).alias("top2"),
        F.max(F.when(F.col("place") == 1, F.col("ts"))).alias("top1_ts"),
    )
    ran = F.abs("excess") >= s.concentration_min_mads * F.col("mad") * F.col("n_seen")
    fluke = (F.col("top1") >= s.concentration_top1) | (F.col("top2") >= s.concentration_top2)
    return out.select(
        "series_id",
        F.when(~ran, SKIPPED).when(fluke, "supports_fluke").otherwise("neutral").alias("stance"),
        F.when(ran, F.when(F.col("excess") > 0, "up").otherwise("down")).alias("direction"),
        F.when(ran, F.col("top1")).alias("top1"),
        F.when(ran, F.col("top2")).alias("top2"),
        F.when(ran, F.col("top1_ts")).alias("top1_ts"),
    )


def outliers(points: DataFrame, s: Settings, column: str = "work", prefix: str = "") -> DataFrame:
    """Recent periods far from the baseline, on a column with its own baseline statistics; unobserved periods do not count."""
    z = F.try_divide(F.col(column) - F.col(f"{prefix}median"), F.col(f"{prefix}mad"))
    seen = points.where(in_recent() & F.col("sufficient") & F.col("work").isNotNull()).withColumn("z", z).where("z is not null")
    out = seen.groupBy("series_id").agg(
        F.count_if(F.abs("z") >= s.outlier_z).alias("n_flagged"),
        F.max(F.abs("z")).alias("max_z"),
        F.max(F.when(F.abs("z") >= s.outlier_z, F.struct(F.abs("z").alias("a"), (-F.col("idx")).alias("i"), "z", "ts"))).alias("top"),
    )
    stance = F.when(F.col("n_flagged") == 0, "supports_no_change").when(F.col("n_flagged") <= s.isolated_max_points, "supports_fluke").otherwise("neutral")
    return out.select("series_id", stance.alias("stance"), "n_flagged", "max_z", F.when(F.col("top.z") > 0, "up").when(F.col("top.z") < 0, "down").alias("direction"), F.col("top.ts").alias("ts"))


def breadth(points: DataFrame, s: Settings) -> DataFrame:
    """Whether one origin, or few, are behind the recent volume."""
    v, items = F.col("value"), F.coalesce(F.col("raw_count").cast("double"), F.col("value"))
    both, some = v.isNotNull() & F.col("top_share").isNotNull() & (v > 0), F.col("contributors").isNotNull() & (items > 0)
    out = points.where(in_recent() & F.col("sufficient")).groupBy("series_id").agg(
        F.try_divide(F.sum(F.when(both, v * F.col("top_share"))), F.sum(F.when(both, v))).alias("share"),
        F.try_divide(F.sum(F.when(some, F.col("contributors").cast("double"))), F.sum(F.when(some, items))).alias("ratio"),
    )
    fluke = F.coalesce(F.col("share") >= s.breadth_top_share_max, F.lit(False)) | F.coalesce(F.col("ratio") < s.breadth_min_contrib_ratio, F.lit(False))
    return out.withColumn("stance", F.when(F.col("share").isNull() & F.col("ratio").isNull(), SKIPPED).when(fluke, "supports_fluke").otherwise("neutral"))


def low_count(points: DataFrame, s: Settings) -> DataFrame:
    """Counts in both windows; where the baseline is thin, whether their rates can differ by chance (exact interval)."""
    v, base = F.col("value"), F.col("segment") == "baseline"
    sums = points.where("sufficient").groupBy("series_id").agg(
        F.max("scale").alias("scale"),
        F.avg(F.when(base, v)).alias("mean"),
        F.coalesce(F.sum(F.when(base, F.rint(v))), F.lit(0.0)).cast("long").alias("k0"),
        F.coalesce(F.sum(F.when(in_recent(), F.rint(v))), F.lit(0.0)).cast("long").alias("k1"),
        F.count(F.when(base, v)).alias("n0"),
        F.count(F.when(in_recent(), v)).alias("n1"),
    )
    level = s.ci_level

    @F.pandas_udf("lower double, upper double")
    def interval(k1: pd.Series, n1: pd.Series, k0: pd.Series, n0: pd.Series) -> pd.DataFrame:
        lower, upper = rate_ratios(k1, n1, k0, n0, level)
        return pd.DataFrame({"lower": lower, "upper": upper})

    active = (F.col("scale") == "count") & (F.col("mean") < s.low_count_threshold) & (F.col("k0") + F.col("k1") > 0) & (F.col("n1") > 0)
    sums = sums.withColumn("active", F.coalesce(active, F.lit(False)))
    thin = sums.where("active").withColumn("ci", interval("k1", "n1", "k0", "n0")).select("series_id", F.col("ci.lower").alias("lower"), F.col("ci.upper").alias("upper"))
    out = sums.join(thin, "series_id", "left")
    open_ = (F.col("lower") <= 1) & (F.col("upper") >= 1)
    return out.select(
        "series_id", "active", "k0", "n0", "k1", "n1", "lower", "upper",
        F.when(~F.col("active"), SKIPPED).when(open_, "neutral").otherwise("supports_trend").alias("stance"),
        F.coalesce(F.col("active") & open_, F.lit(False)).alias("too_few"),
        F.when(F.col("active") & ~open_, F.when(F.col("lower") > 1, "up").otherwise("down")).alias("direction"),
    )


def trend_pairs(points: DataFrame, s: Settings) -> DataFrame:
    """Mann-Kendall's S and Sen's slope from the pairs of the tested segment (at most 35 periods, so at most 595 pairs a
    series): the recent window and up to seven periods before it."""
    start = F.col("recent_start") - F.least(F.lit(s.persistence_context), F.col("recent_start"))
    seg = points.where(F.col("sufficient") & (F.col("idx") >= start) & F.col("work").isNotNull()).select("series_id", "idx", "work")
    # The join stays inside series_id: both sides have the partitioning that windows made.
    a, b = seg.alias("a"), seg.alias("b")
    pairs = a.join(b, (F.col("a.series_id") == F.col("b.series_id")) & (F.col("a.idx") < F.col("b.idx")))
    rise, run = F.col("b.work") - F.col("a.work"), F.col("b.idx") - F.col("a.idx")
    out = pairs.groupBy(F.col("a.series_id").alias("series_id")).agg(F.sum(F.signum(rise)).cast("long").alias("s"), F.median(rise / run).alias("slope"), F.count(F.lit(1)).alias("pairs"))
    return out.where(F.col("pairs") >= s.min_points * (s.min_points - 1) // 2)


def trailing_run(points: DataFrame, slopes: DataFrame, s: Settings) -> DataFrame:
    """Latest periods in a row beyond the baseline band in the slope's direction; a missing one ends the run."""
    half = s.band_mads * F.col("mad")
    beyond = F.when(F.col("slope") > 0, F.col("work") > F.col("median") + half).when(F.col("slope") < 0, F.col("work") < F.col("median") - half)
    start = F.col("recent_start") - F.least(F.lit(s.persistence_context), F.col("recent_start"))
    seg = points.where(F.col("idx") >= start).join(slopes.select("series_id", "slope"), "series_id")
    broken = F.max(F.when(~F.coalesce(beyond, F.lit(False)), F.col("idx")))
    return seg.groupBy("series_id").agg((F.max("n") - 1 - F.coalesce(broken, F.min("idx") - 1)).cast("long").alias("run"))


KERNEL = (
    "series_id string, trend_n int, trend_test string, trend_p double, trend_slope double, trend_slope_norm double, trend_direction string, trend_run int, "
    "shift_ran boolean, shift_points array<int>, shift_at int, shift_before double, shift_after double, shift_share double, shift_sustained boolean, "
    "season_skip string, season_share double, season_left boolean, season_explained boolean, adjusted_trend boolean, adjusted_shift boolean, "
    "weekly array<double>"
)


def robust(values: np.ndarray, start: int, s: Settings) -> tuple[float, float]:
    base = values[:start]
    base = base[np.isfinite(base)]
    median = float(np.median(base))
    mad = s.mad_scale * float(np.median(np.abs(base - median)))
    return median, mad if mad != 0 else s.mad_floor * max(median, 1.0)


def trend_of(values: np.ndarray, start: int, stats, transform: str, s: Settings) -> dict | None:
    first = start - min(s.persistence_context, start)
    seg = values[first:]
    x = np.flatnonzero(np.isfinite(seg))
    if len(x) < s.min_points:
        return None
    y = seg[x]
    p, test = K.mann_kendall(y, s.mk_alpha, s.hamed_rao_min_n)
    slope = 0.0 if np.ptp(y) == 0 else K.sen_slope(y, x.astype(float))[0]
    norm = math.expm1(slope) if transform == "log1p" else slope / max(abs(stats[0]), s.slope_level_floor)
    way = int(np.sign(slope))
    beyond = way * (seg - stats[0]) > s.band_mads * stats[1] if way else np.zeros(len(seg), bool)
    run = int(np.argmin(np.append(beyond[::-1], False)))
    large = abs(norm) >= s.min_slope
    return {"n": len(x), "test": test, "p": p, "slope": slope, "norm": norm, "direction": {1: "up", -1: "down", 0: "flat"}[way], "run": run, "supports": p < s.mk_alpha and large}


def shift_of(values: np.ndarray, start: int, stats, freq: str, s: Settings) -> dict | None:
    if not np.isfinite(values).all():
        return None
    n, least = len(values), s.min_persist[freq]
    points = K.change_points((values - stats[0]) / stats[1], least, s.pen_beta * math.log(n))
    late = [c for c in points if c >= start - s.recent_tolerance[freq]]
    out = {"points": points, "at": None, "before": None, "after": None, "share": None, "sustained": False, "direction": None}
    if late:
        at = late[-1]
        before, after = float(np.median(values[:at])), float(np.median(values[at:]))
        middle = (before + after) / 2
        share = float((values[at:] > middle if after >= before else values[at:] < middle).mean())
        moved = "up" if after > before else "down" if after < before else None
        out |= {"at": at, "before": before, "after": after, "share": share, "direction": moved, "sustained": n - at >= least and share >= s.hold_fraction and moved is not None}
    return out


def season_of(values: np.ndarray, start: int, stats, freq: str, transform: str, s: Settings) -> dict:
    n = len(values)
    if n < s.annual_min_points[freq]:
        return {"skip": "history"}
    if not np.isfinite(values).all():
        return {"skip": "gaps"}
    rise = float(values[start:].mean()) - stats[0]
    if abs(rise) < s.seasonality_min_mads * stats[1]:
        return {"skip": "no_rise"}
    period, block, cycle = s.annual_period[freq], s.weekly_period, s.annual_cycle[freq]
    if freq == "D":
        lead = n % block
        weeks = K.stl_seasonal(values[lead:].reshape(-1, block).mean(axis=1), period, s.stl_robust, s.stl_seasonal_degree)
        fitted = np.concatenate((np.full(lead, weeks[0]), np.repeat(weeks, block)))
    else:
        fitted = K.stl_seasonal(values, period, s.stl_robust, s.stl_seasonal_degree)
    expected = fitted.copy()
    for t in range(start, n):
        same = np.arange(t % cycle, min(start, t), cycle)
        if len(same):
            expected[t] = fitted[same].mean()
    share = float(np.clip((expected[start:].mean() - expected[:start].mean()) / rise, 0, 1))
    adjusted = values - expected
    own = robust(adjusted, start, s)
    trend, shift = trend_of(adjusted, start, own, transform, s), shift_of(adjusted, start, own, freq, s)
    moved = bool(trend and trend["supports"]), bool(shift and shift["sustained"])
    way = "up" if rise > 0 else "down"
    left = (moved[0] and trend["direction"] == way) or (moved[1] and shift["direction"] == way)
    return {"skip": None, "share": share, "left": bool(left), "explained": share >= s.seasonal_explained_min, "trend": moved[0], "shift": moved[1]}


def weekly_of(values: np.ndarray, start: int, freq: str, s: Settings) -> list[float] | None:
    """Daily series without gaps: the correction of each day of the cycle, by position."""
    period = s.weekly_period
    if freq != "D" or len(values) < s.weekly_min_weeks * period or not np.isfinite(values).all():
        return None
    seasonal = K.stl_seasonal(values, period, s.stl_robust, s.stl_seasonal_degree)
    if start < period:
        return seasonal.tolist()
    return [float(seasonal[:start][k::period].mean()) for k in range(period)]


def series_kernels(points: DataFrame, s: Settings) -> DataFrame:
    """Trend, level shift, seasonality and weekly profile of every series with enough history.

    One grouped call a series, over seven columns; a series is as long as its
    calendar (some thousand periods), whatever the number of items behind it.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        head = part.iloc[0]
        work, filled = part["work"].to_numpy(float), part["work_filled"].to_numpy(float)
        start, stats, freq, transform = int(head["recent_start"]), (float(head["median"]), float(head["mad"])), head["freq"], head["transform"]
        t, c = trend_of(work, start, stats, transform, s), shift_of(filled, start, stats, freq, s)
        e, weekly = season_of(filled, start, stats, freq, transform, s), weekly_of(filled, start, freq, s)
        t, c = t or {}, c or {}
        row = {"series_id": head["series_id"], "shift_ran": bool(c), "weekly": weekly}
        row |= {f"trend_{k}": t.get(v) for k, v in (("n", "n"), ("test", "test"), ("p", "p"), ("slope", "slope"), ("slope_norm", "norm"), ("direction", "direction"), ("run", "run"))}
        row |= {f"shift_{k}": c.get(k) for k in ("points", "at", "before", "after", "share", "sustained")}
        row |= {"season_skip": e["skip"], "season_share": e.get("share"), "season_left": e.get("left"), "season_explained": e.get("explained"), "adjusted_trend": e.get("trend"), "adjusted_shift": e.get("shift")}
        return pd.DataFrame([row], columns=[f.split()[0] for f in KERNEL.split(", ")]).astype(object)

    columns = ["series_id", "freq", "transform", "idx", "recent_start", "work", "work_filled", "median", "mad"]
    return points.where("sufficient").select(*columns).groupBy("series_id").applyInPandas(run, KERNEL)


def without_weekday(points: DataFrame, weekly: DataFrame, s: Settings) -> DataFrame:
    """points with ``even``: the working scale without the weekly pattern where a series has one, else as it is."""
    rows = points.join(weekly.select("series_id", "weekly"), "series_id", "left")
    spot = F.when(F.size("weekly") == s.weekly_period, F.pmod(F.col("idx"), F.lit(s.weekly_period))).otherwise(F.col("idx"))
    return rows.withColumn("even", F.when(F.col("weekly").isNull(), F.col("work")).otherwise(F.col("work_filled") - F.try_element_at("weekly", (spot + 1).cast("int")))).drop("weekly")

