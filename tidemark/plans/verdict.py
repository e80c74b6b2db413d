"""One verdict a series: TREND, FLUKE, SEASONAL, NO_CHANGE or INCONCLUSIVE, with confidence and what would change it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import checks as C
from tidemark.operators.preprocess import META, SERIES, per_freq, preprocess, with_stats
from tidemark.store import written

CHECKS = ("persistence", "concentration", "seasonality", "outliers", "level_shift", "low_count", "breadth")


def persistence_stance(s: Settings) -> Column:
    significant = F.col("trend_p") < s.mk_alpha
    large, slight = F.abs("trend_slope_norm") >= s.min_slope, F.abs("trend_slope_norm") < s.negligible_slope
    return F.when(F.col("trend_p").isNull(), "skipped").when(significant & large, "supports_trend").when(~significant | slight, "supports_no_change").otherwise("neutral")


def evidence(points: DataFrame, s: Settings) -> DataFrame:
    """One row a series with enough history: every check's stance and what the decision reads."""
    kernels = written(C.series_kernels(points, s), "kernels")
    even = with_stats(C.without_weekday(points, kernels, s), "even", "even_", s)
    named = lambda df, p: df.select("series_id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "series_id"])
    out = kernels.drop("weekly")
    for name, df in (("concentration", C.concentration(points, s)), ("outliers", C.outliers(even, s, "even", "even_")), ("low_count", C.low_count(points, s)), ("breadth", C.breadth(points, s))):
        out = out.join(named(df, name), "series_id", "left")
    shift = F.when(~F.col("shift_ran"), "skipped").when(F.col("shift_at").isNull() | (F.col("shift_before") == F.col("shift_after")), "supports_no_change").when(F.col("shift_sustained"), "supports_trend").otherwise("neutral")
    out = out.withColumns(
        {
            "persistence_stance": persistence_stance(s),
            "level_shift_stance": shift,
            "level_shift_direction": F.when(F.col("shift_after") > F.col("shift_before"), "up").when(F.col("shift_after") < F.col("shift_before"), "down"),
            "seasonality_stance": F.when(F.col("season_skip").isNotNull(), "skipped").when(F.col("season_explained") & ~F.col("season_left"), "supports_seasonal").otherwise("neutral"),
        }
    )
    return out.withColumns({f"{c}_stance": F.coalesce(f"{c}_stance", F.lit("skipped")) for c in CHECKS})


def stance(name: str, what: str) -> Column:
    return F.col(f"{name}_stance") == what


def decided(rows: DataFrame, s: Settings) -> DataFrame:
    """label, direction and rule: the first of six rules that holds."""
    trend, fluke, shift = stance("persistence", "supports_trend"), stance("concentration", "supports_fluke"), F.coalesce("shift_sustained", F.lit(False))
    way = lambda c: F.when(F.col(c).isin("up", "down"), F.col(c))
    votes = F.array(
        F.when(trend, way("trend_direction")),
        F.when(shift, F.col("level_shift_direction")),
        F.when(stance("low_count", "supports_trend"), F.col("low_count_direction")),
        F.when(~stance("concentration", "skipped"), F.col("concentration_direction")),
    )
    votes = F.array_distinct(F.filter(votes, lambda v: v.isNotNull()))
    alone = F.lit(s.fluke_from_isolated_outliers) & stance("concentration", "skipped") & stance("outliers", "supports_fluke") & ~trend & ~shift
    rules = {
        "R1": ~F.coalesce("sufficient", F.lit(False)),
        "R2": stance("seasonality", "supports_seasonal"),
        "R3": (fluke & ~trend) | stance("breadth", "supports_fluke") | alone,
        "R4": (trend | shift) & ~fluke & ~F.coalesce("low_count_too_few", F.lit(False)) & (F.size(votes) == 1),
        "R5": stance("persistence", "supports_no_change") & ~stance("outliers", "skipped") & (F.col("outliers_n_flagged") == 0) & F.col("shift_at").isNull(),
    }
    rule = F.coalesce(*[F.when(F.coalesce(held, F.lit(False)), k) for k, held in rules.items()], F.lit("R6"))
    label = F.create_map(*[F.lit(x) for x in ("R1", "INCONCLUSIVE", "R2", "SEASONAL", "R3", "FLUKE", "R4", "TREND", "R5", "NO_CHANGE", "R6", "INCONCLUSIVE")])
    out = rows.withColumn("rule", rule)
    out = out.withColumn("label", F.element_at(label, F.col("rule")))
    single = F.when(F.col("rule") == "R3", F.coalesce("concentration_direction", "outliers_direction")).when(F.col("rule") == "R4", F.try_element_at(votes, F.lit(1)))
    blocked = (trend | shift) & ~fluke
    reason = (
        F.when(F.col("rule") == "R1", F.concat(F.lit("history: "), "n_observed", F.lit(" of "), "min_required", F.lit(" periods")))
        .when(F.col("rule") == "R2", "annual pattern explains the change")
        .when(F.col("rule") == "R3", F.when(fluke & ~trend, "few periods carry the change").when(stance("breadth", "supports_fluke"), "few origins carry the volume").otherwise("isolated outliers"))
        .when(F.col("rule") == "R4", F.concat_ws(" and ", F.when(trend, "large significant trend"), F.when(shift, "lasting level shift")))
        .when(F.col("rule") == "R5", "no slope, outlier or recent shift")
        .otherwise(F.concat_ws("; ", *[F.when(~stance(c, "skipped"), F.concat(F.lit(f"{c}: "), f"{c}_stance")) for c in CHECKS], F.when(blocked & F.coalesce("low_count_too_few", F.lit(False)), "blocked: too few events").when(blocked & (F.size(votes) != 1), "blocked: directions disagree")))
    )
    return out.withColumns({"direction": single, "reason": reason})


# Which stances speak for and against a label, and the order of the rules above.
AGREES = {"TREND": "supports_trend", "FLUKE": "supports_fluke", "SEASONAL": "supports_seasonal", "NO_CHANGE": "supports_no_change"}
AGAINST = {
    "TREND": ("supports_fluke", "supports_no_change", "supports_seasonal"),
    "FLUKE": ("supports_trend", "supports_seasonal"),
    "SEASONAL": ("supports_fluke",),
    "NO_CHANGE": ("supports_trend", "supports_fluke", "supports_seasonal"),
}
CLAIMS = {"persistence": "trend_direction", "concentration": "concentration_direction", "level_shift": "level_shift_direction", "low_count": "low_count_direction"}


def confidence(rows: DataFrame, s: Settings) -> DataFrame:
    """score and confidence: a point for every check that agrees, one less for each that contradicts and for each weakness of the data."""
    parts = []
    for c in CHECKS:
        st, claim = F.col(f"{c}_stance"), F.col(CLAIMS[c]) if c in CLAIMS else F.lit(None).cast("string")
        other = (F.col("label") == "TREND") & (st == "supports_trend") & claim.isin("up", "down") & (claim != F.col("direction"))
        agrees = F.coalesce(*[F.when(F.col("label") == k, st == v) for k, v in AGREES.items()], F.lit(False))
        against = F.coalesce(*[F.when(F.col("label") == k, st.isin(*v)) for k, v in AGAINST.items()], F.lit(False))
        parts.append(F.when(F.coalesce(other, F.lit(False)), -1).when(agrees, 1).when(against, -1).otherwise(0))
    weak = [
        F.col("n_observed") < s.history_multiple * F.col("min_required"),
        F.col("low_count_active"),
        (F.col("freq") != "D") & F.col("season_skip").isin("history", "gaps"),
        F.col("truncated_before").isNotNull() | F.col("recent_imputed"),
    ]
    score = sum(parts, F.lit(0)) - sum((F.when(F.coalesce(w, F.lit(False)), 1).otherwise(0) for w in weak), F.lit(0))
    out = rows.withColumn("score", score)
    return out.withColumn("confidence", F.when(F.col("label") == "INCONCLUSIVE", "low").when(F.col("score") >= s.conf_high, "high").when(F.col("score") >= s.conf_medium, "medium").otherwise("low"))


def original(work: Column) -> Column:
    """A working-scale value on the series' own scale, as charts show it."""
    return F.round(F.when(F.col("transform") == "log1p", F.greatest(F.expm1(work), F.lit(0.0))).otherwise(work), 1)


CONDITION = "struct<kind:string,periods:int,threshold:double,base:double>"


def conditions(rows: DataFrame, s: Settings) -> DataFrame:
    """Up to max_conditions observations that would change the verdict, in order of weight. base: the lower bound of unusual values, or last year's value."""
    none = F.lit(None).cast(CONDITION)
    make = lambda kind, n, at, base=F.lit(None): F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("periods"), at.cast("double").alias("threshold"), base.cast("double").alias("base"))
    edge = lambda k: original(F.col("median") + k * F.col("mad"))
    n, nothing = per_freq(s.min_persist), F.lit(None)
    down = F.coalesce("direction", F.when(F.col("recent_median") >= F.col("median"), "up").otherwise("down")) == "down"
    real = lambda e: (e > 0) | (F.col("least") < 0)
    up_stay, down_stay = make("stay_above", n, edge(s.exceed_mads)), F.when(real(edge(-s.exceed_mads)), make("stay_below", n, edge(-s.exceed_mads)))
    stay, stay_either = F.when(down, down_stay).otherwise(up_stay), F.coalesce(F.when(down, down_stay), up_stay)
    fall = F.when(down, F.when(real(edge(-s.fallback_mads)), make("rise_back_above", n, edge(-s.fallback_mads)))).otherwise(make("fall_back_below", n, edge(s.fallback_mads)))
    more = F.when((F.col("season_skip") == "history") & (per_freq(s.annual_min_points) > F.col("n")), make("annual_history", per_freq(s.annual_min_points) - F.col("n"), nothing))
    broad = F.when(~stance("breadth", "skipped"), make("broader_origins", nothing, F.lit(s.breadth_top_share_max)))
    who = F.when((F.col("scale") == "count") & stance("breadth", "skipped"), make("contributor_data", nothing, nothing))
    year = F.when(F.col("last_year").isNotNull(), make("beyond_last_year", F.lit(1), original(F.col("last_year") + F.when(down, -1).otherwise(1) * s.exceed_mads * F.col("mad")), original(F.col("last_year"))))
    by = {
        "R1": [make("more_history", F.col("min_required") - F.col("n_observed"), nothing)],
        "R2": [year],
        "R3": [stay, broad],
        "R4": [fall, more],
        "R5": [make("unusual", nothing, edge(s.outlier_z), F.when(real(edge(-s.outlier_z)), edge(-s.outlier_z))), stay_either],
        "R6": [stay_either, fall, who],
    }
    every = F.coalesce(*[F.when(F.col("rule") == k, F.array(*[F.coalesce(x.cast(CONDITION), none) for x in v])) for k, v in by.items()])
    return rows.withColumn("conditions", F.slice(F.filter(every, lambda x: x.isNotNull()), 1, s.max_conditions))


def headers(points: DataFrame, s: Settings) -> DataFrame:
    """One row a series: windows, statistics and what the sums above need."""
    recent = F.col("segment") == "recent"
    keep = ["n", "n_observed", "n_recent", "recent_start", "min_required", "sufficient", "transform", "median", "mad", "original_median", "n_duplicates", "dropped_partial"]
    return points.groupBy(*SERIES).agg(
        *[F.first(c).alias(c) for c in keep],
        F.bool_or(recent & (F.col("imputed") | F.col("was_filled"))).alias("recent_imputed"),
        F.median(F.when(recent, F.col("work"))).alias("recent_median"),
        F.min("value").alias("least"),
        F.min(F.when(recent, F.col("ts"))).alias("window_start"),
        F.max("ts").alias("last_ts"),
        F.max(F.when(F.col("idx") == F.col("n") - per_freq(s.annual_cycle), F.col("work"))).alias("last_year"),
        F.max(F.when(F.col("idx") == F.col("n") - per_freq(s.annual_cycle), F.col("ts"))).alias("last_year_ts"),
    )


def verdicts(raw: DataFrame, s: Settings | None = None) -> DataFrame:
    """A row per series of the raw schema: label, direction, confidence, rule, reason, score, conditions and windows."""
    return analysed(raw, s)[1]


def analysed(raw: DataFrame, s: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(regular points, verdict rows)."""
    s = s or Settings()
    # Buckets and regular points are read by several checks; each is made once.
    raw = written(raw, "buckets")
    told = raw.groupBy("series_id").agg(F.first("topic").alias("topic"), F.first("source").alias("source"), (F.min("truncated_before") if "truncated_before" in raw.columns else F.lit(None).cast("date")).alias("truncated_before"))
    points = written(preprocess(raw.select("series_id", "freq", "scale", "ts", "value", "contributors", "top_share", "raw_count", "imputed", "ordinal", *META), s), "points")
    rows = headers(points, s).join(told, "series_id").join(evidence(points, s), "series_id", "left")
    rows = rows.withColumns({f"{c}_stance": F.coalesce(f"{c}_stance", F.lit("skipped")) for c in CHECKS})
    return points, conditions(confidence(decided(rows, s), s), s)


SHORT = ["series_id", "topic", "source", "freq", "label", "direction", "confidence", "rule", "reason", "score", "window_start", "last_ts", "n", "n_recent", "conditions"]
