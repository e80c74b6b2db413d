"""What each check found, in a sentence with its recorded numbers, or why it did not run.

All are columns over a verdict row; wordings are this library's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions import numbers as N
from tidemark.functions import wording as W
from tidemark.operators.preprocess import per_freq
from tidemark.plans import verdict as V

NAMES = {
    "persistence": "Slope of the recent window",
    "concentration": "Share of the largest periods",
    "seasonality": "Yearly pattern",
    "outliers": "Unusual periods",
    "level_shift": "Level shift",
    "low_count": "Rates of rare events",
    "breadth": "Breadth of origins",
}
STANCES = {
    "supports_trend": "speaks for a trend",
    "supports_fluke": "speaks for a fluke",
    "supports_seasonal": "speaks for a seasonal effect",
    "supports_no_change": "speaks for no change",
    "neutral": "speaks for nothing in particular",
}
EVIDENCE = f"struct<check:string,name:string,stance:string,stance_text:string,summary:string,numbers:array<{N.NUMBER}>>"
REASON = f"struct<check:string,name:string,reason:string,numbers:array<{N.NUMBER}>>"


def date_at(place: Column) -> Column:
    """The date of a place in a series' calendar."""
    back = (F.col("n") - 1 - place).cast("int")
    return F.when(F.col("freq") == "M", F.add_months("last_ts", -back)).otherwise(F.date_sub("last_ts", back * F.when(F.col("freq") == "W", 7).otherwise(1)))


def sentences(s: Settings) -> dict[str, Column]:
    """A sentence for each check that ran."""
    word, periods = W.mapped(F.col("freq"), W.PERIODS), lambda n: W.period_words(n, F.col("freq"))
    median = N.value("baseline_median", V.original(F.col("median")))
    slope = N.percent("slope_pct", F.abs("trend_slope_norm"))
    way = F.when(F.col("trend_direction") == "up", "rise").when(F.col("trend_direction") == "down", "fall").otherwise("stay level, a change of")
    band = [N.value(f"band_{side}", V.original(F.col("median") + k * s.band_mads * F.col("mad"))) for side, k in (("lower", -1), ("upper", 1))]
    run = N.optional(F.col("trend_run") > 0, "; the latest ", N.count("run_length", F.col("trend_run")), " ", periods(F.col("trend_run")), " lie outside the usual band of ", band[0], " to ", band[1])
    head = F.when(V.stance("persistence", "supports_trend"), "A lasting slope").when(V.stance("persistence", "supports_no_change"), "No lasting slope").otherwise("A slope that settles nothing")
    over = ("over ", N.count("n_tested", F.col("trend_n")), " ", periods(F.col("trend_n")))
    top = F.when(V.stance("concentration", "supports_fluke"), "Few periods carry the change").otherwise("The change is spread out")
    moved = F.when(F.col("level_shift_direction") == "up", "rose").when(F.col("level_shift_direction") == "down", "fell").otherwise("stayed")
    since = F.col("n") - F.col("shift_at")
    held = F.when(F.col("shift_sustained"), "which lasts").otherwise("which does not last")
    shift = N.sentence("The level ", moved, " from ", N.value("before_median", V.original(F.col("shift_before"))), " to ", N.value("after_median", V.original(F.col("shift_after"))), " on ", N.date("change_date", date_at(F.col("shift_at"))), ", ", held, ": ", N.percent("share_new_side_pct", F.col("shift_share")), " of ", N.count("n_post", since), " ", periods(since), " since are on the new side.")
    none = F.col("outliers_n_flagged") == 0
    z = ("|z| ≥ ", N.stat("outlier_z", F.lit(s.outlier_z)))
    recent = (N.count("n_recent", F.col("n_recent")), " recent ", periods(F.col("n_recent")))
    rate = F.col("low_count_k1") / F.col("low_count_n1") / (F.col("low_count_k0") / F.col("low_count_n0"))
    upper = N.optional(F.col("low_count_upper") < float("inf"), N.stat("ratio_upper", F.col("low_count_upper")))
    without = F.when(F.col("low_count_upper") < float("inf"), "").otherwise("no upper bound")
    share, per = F.col("breadth_share"), F.col("breadth_ratio")
    return {
        "persistence": N.sentence(head, ": values ", way, " by ", slope, " a ", word, " ", *over, " (", N.p_value("p_value", F.col("trend_p")), ")", run, "."),
        "concentration": N.sentence(top, ": the largest ", word, " (", N.date("top1_date", F.col("concentration_top1_ts")), ") has ", N.percent("top1_share_pct", F.col("concentration_top1")), " of what lies ", F.when(F.col("concentration_direction") == "up", "above").otherwise("below"), " the baseline's ", median, ", the first ", N.count("top_k", F.lit(2)), " have ", N.percent("top2_share_pct", F.col("concentration_top2")), "."),
        "seasonality": N.sentence(F.when(V.stance("seasonality", "supports_seasonal"), "The yearly pattern explains the change").otherwise("The yearly pattern does not explain all"), ": its share is ", N.percent("seasonal_share_pct", F.col("season_share")), " (", N.percent("explained_min_pct", F.lit(s.seasonal_explained_min)), " or more is needed)", F.when(F.col("season_left"), ", and what is left still moves the same way").otherwise(""), "."),
        "outliers": F.when(none, N.sentence("No period is unusual: none of ", *recent, " reach ", *z, " (at most ", N.stat("max_abs_z", F.col("outliers_max_z")), ").")).otherwise(N.sentence("Unusual periods: ", N.count("n_flagged", F.col("outliers_n_flagged")), " of ", *recent, " reach ", *z, ", the strongest on ", N.date("max_date", F.col("outliers_ts")), " with ", N.stat("max_abs_z", F.col("outliers_max_z")), ".")),
        "level_shift": F.when(F.col("shift_at").isNull(), N.sentence("No level shift was found in ", *recent, " (penalty ", N.stat("penalty", s.pen_beta * F.log(F.col("n").cast("double"))), ").")).otherwise(shift),
        "low_count": N.sentence(N.count("k_recent", F.col("low_count_k1")), " events in ", N.count("n_recent", F.col("low_count_n1")), " recent ", periods(F.col("low_count_n1")), " against ", N.count("k_baseline", F.col("low_count_k0")), " in ", N.count("n_baseline", F.col("low_count_n0")), " before", N.optional((F.col("low_count_k0") > 0) & (F.col("low_count_n0") > 0), ", a ratio of ", N.stat("rate_ratio", rate)), "; at ", N.percent("ci_level_pct", F.lit(s.ci_level)), " confidence it lies between ", N.stat("ratio_lower", F.col("low_count_lower")), " and ", upper, without, F.when(F.col("low_count_too_few"), ", too few events to call.").otherwise(".")),
        "breadth": N.sentence(F.when(V.stance("breadth", "supports_fluke"), "Few are behind it").otherwise("Many are behind it"), N.optional(share.isNotNull(), "; the largest origin has ", N.percent("top_share_pct", share), " (narrow from ", N.percent("top_share_max_pct", F.lit(s.breadth_top_share_max)), ")"), N.optional(per.isNotNull(), "; there are ", N.stat("contributors_per_item", per), " contributors an item (narrow below ", N.stat("min_contrib_ratio", F.lit(s.breadth_min_contrib_ratio)), ")"), "."),
    }


def reasons(s: Settings) -> dict[str, Column]:
    """Why a check did not run."""
    word, periods = W.mapped(F.col("freq"), W.PERIODS), lambda n: W.period_words(n, F.col("freq"))
    missing = F.col("n") - F.col("n_observed")
    gaps = N.sentence(N.count("n_missing", missing), " ", periods(missing), " are missing")
    close = lambda k: N.sentence("the recent window is within ", N.stat("min_mads", F.lit(k)), " MADs of the baseline")
    need = per_freq(s.annual_min_points)
    own = {
        "persistence": N.sentence("fewer than ", N.count("min_points", F.lit(s.min_points)), " periods of the window were observed"),
        "concentration": close(s.concentration_min_mads),
        "seasonality": F.when(F.col("season_skip") == "history", N.sentence("a yearly pattern takes ", N.count("min_points", need), " ", periods(need), " and there are ", N.count("n_points", F.col("n")))).when(F.col("season_skip") == "gaps", gaps).otherwise(close(s.seasonality_min_mads)),
        "outliers": N.sentence("no ", word, " of the recent window was observed"),
        "level_shift": gaps,
        "low_count": N.sentence("the series does not count rare events (fewer than ", N.value("low_count_threshold", F.lit(s.low_count_threshold)), " a ", word, ")"),
        "breadth": N.sentence("who is behind the values is not known"),
    }
    short = N.sentence("there are ", N.count("n_observed", F.col("n_observed")), " of ", N.count("min_required", F.col("min_required")), " ", periods(F.col("min_required")), " of history")
    return {c: F.when(~F.coalesce("sufficient", F.lit(False)), short).otherwise(x) for c, x in own.items()}


def with_evidence(rows: DataFrame, s: Settings) -> DataFrame:
    """Verdict rows with evidence (checks that ran) and skipped (those that did not), in the order of the checks."""
    said, why = sentences(s), reasons(s)
    ran, not_run = [], []
    for c in V.CHECKS:
        st, skipped = F.col(f"{c}_stance"), F.col(f"{c}_stance") == "skipped"
        ran.append(F.when(~skipped, F.struct(F.lit(c), F.lit(NAMES[c]), st, W.mapped(st, STANCES), said[c]["text"], said[c]["numbers"]).cast(EVIDENCE)))
        not_run.append(F.when(skipped, F.struct(F.lit(c), F.lit(NAMES[c]), why[c]["text"], why[c]["numbers"]).cast(REASON)))
    there = lambda parts: F.filter(F.array(*parts), lambda e: e.isNotNull())
    return rows.withColumns({"evidence": there(ran), "skipped": there(not_run)})


def lead() -> Column:
    """The sentence of the first check that agrees with the label; null without one."""
    wanted = W.mapped(F.col("label"), V.AGREES)
    return F.try_element_at(F.filter("evidence", lambda e: e["stance"] == wanted), F.lit(1))["summary"]
