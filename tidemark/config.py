"""Settings of the analysis, as values that plans use as literals.

``Settings()`` has the published defaults; ``load`` reads overrides from a YAML
mapping of field names and reports every fault at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

FREQS = ("D", "W", "M")
SCALES = ("relative_0_100", "count", "pageviews", "value")
LABELS = ("TREND", "FLUKE", "SEASONAL", "NO_CHANGE", "INCONCLUSIVE")


def by_freq(d, w, m):
    return field(default_factory=lambda: {"D": d, "W": w, "M": m})


# They decide verdicts and must stay as published.
@dataclass(frozen=True)
class Settings:
    min_history: dict = by_freq(28, 26, 24)
    recent_frac: float = 0.2
    recent_min: dict = by_freq(7, 4, 3)
    recent_max: dict = by_freq(28, 13, 6)
    gap_fill_max: int = 2
    mad_scale: float = 1.4826
    mad_floor: float = 0.05
    log_scales: tuple = ("count", "pageviews")
    persistence_context: int = 7
    hamed_rao_min_n: int = 10
    mk_alpha: float = 0.05
    min_slope: float = 0.0125
    negligible_slope: float = 0.005
    band_mads: float = 2.0
    min_points: int = 5
    slope_level_floor: float = 1.0
    concentration_min_mads: float = 1.0
    concentration_top1: float = 0.4
    concentration_top2: float = 0.8
    weekly_period: int = 7
    weekly_min_weeks: int = 2
    annual_min_points: dict = by_freq(730, 104, 24)
    annual_period: dict = by_freq(52, 52, 12)
    annual_cycle: dict = by_freq(364, 52, 12)
    stl_robust: bool = True
    stl_seasonal_degree: int = 0
    seasonality_min_mads: float = 0.5
    outlier_z: float = 3.5
    isolated_max_points: int = 2
    pen_beta: float = 3.0
    min_persist: dict = by_freq(7, 3, 2)
    hold_fraction: float = 0.8
    recent_tolerance: dict = by_freq(7, 3, 2)
    low_count_threshold: float = 5.0
    ci_level: float = 0.95
    breadth_top_share_max: float = 0.5
    breadth_min_contrib_ratio: float = 0.3
    seasonal_explained_min: float = 0.7
    fluke_from_isolated_outliers: bool = True
    conf_high: int = 3
    conf_medium: int = 1
    history_multiple: float = 2.0
    exceed_mads: float = 2.0
    fallback_mads: float = 1.0
    max_conditions: int = 3
    min_overlap: float = 0.5
    max_history_days: int = 1095
    decimals: int = 1


class SettingsError(ValueError):
    """Every fault of some settings."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


SHARES = ("recent_frac", "mk_alpha", "concentration_top1", "concentration_top2", "hold_fraction", "ci_level", "breadth_top_share_max", "seasonal_explained_min", "min_overlap")


def check(s: Settings) -> Settings:
    """s itself, or SettingsError with all faults."""
    faults = [f"{k} must lie between 0 and 1" for k in SHARES if not 0 < getattr(s, k) <= 1]
    for f in fields(s):
        v = getattr(s, f.name)
        if isinstance(v, dict):
            if set(v) != set(FREQS):
                faults.append(f"{f.name} needs exactly the keys D, W and M")
            elif any(not isinstance(x, int) or x < 1 for x in v.values()):
                faults.append(f"{f.name} must be whole numbers of 1 or more")
    if not faults:
        faults += [f"recent_min exceeds recent_max for {k}" for k in FREQS if s.recent_min[k] > s.recent_max[k]]
        faults += [f"min_history leaves no baseline for {k}" for k in FREQS if s.min_history[k] <= s.recent_max[k] and s.min_history[k] <= s.recent_min[k]]
    if s.negligible_slope > s.min_slope:
        faults.append("negligible_slope exceeds min_slope")
    if s.concentration_top1 > s.concentration_top2:
        faults.append("concentration_top1 exceeds concentration_top2")
    if s.conf_medium > s.conf_high:
        faults.append("conf_medium exceeds conf_high")
    if faults:
        raise SettingsError(faults)
    return s


def load(overrides: dict | None = None) -> Settings:
    """Defaults with overrides; unknown names and wrong types are faults too."""
    known, base = {f.name for f in fields(Settings)}, Settings()
    faults, good = [], {}
    for k, v in (overrides or {}).items():
        if k not in known:
            faults.append(f"unknown setting {k}")
        elif isinstance(getattr(base, k), bool) != isinstance(v, bool) or (isinstance(getattr(base, k), (int, float)) and not isinstance(v, (int, float))) or (isinstance(getattr(base, k), dict) and not isinstance(v, dict)):
            faults.append(f"{k} has the wrong type")
        else:
            good[k] = tuple(v) if isinstance(v, list) else v
    if faults:
        raise SettingsError(faults)
    return check(replace(base, **good))
