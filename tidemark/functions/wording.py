"""Column functions that word names, dates, periods and outcomes for readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import text_of

# Names and phrases as published.
NAMES = {
    "csv": "Uploaded CSV",
    "google_trends": "Google Trends",
    "reddit": "Reddit",
    "wikipedia": "Wikipedia",
    "hackernews": "Hacker News",
    "x": "X",
}
#: (one source, several sources) by outcome, in the order in which equally frequent outcomes are told.
PHRASES = {
    "TREND up": ("shows an upward trend", "show an upward trend"),
    "TREND down": ("shows a downward trend", "show a downward trend"),
    "FLUKE": ("looks like a fluke", "look like a fluke"),
    "SEASONAL": ("shows the usual seasonal pattern", "show the usual seasonal pattern"),
    "NO_CHANGE": ("shows no change", "show no change"),
    "INCONCLUSIVE": ("is inconclusive", "are inconclusive"),
}
LABEL_WORDS = {"TREND": "Trend", "FLUKE": "Fluke", "SEASONAL": "Seasonal", "NO_CHANGE": "No change", "INCONCLUSIVE": "Inconclusive"}
ARROWS = {"up": "↑", "down": "↓"}
PERIODS = {"D": "day", "W": "week", "M": "month"}
DASH = "–"


def mapped(key: Column, values: dict[str, str]) -> Column:
    """The value of a key, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def display_name(source: Column) -> Column:
    """A source's published name, else its own with blanks for underscores, each word capitalised."""
    return F.coalesce(mapped(source, NAMES), F.initcap(F.translate(source, "_", " ")))


def joined(names: Column) -> Column:
    """A; A and B; A, B and C."""
    n = F.size(names)
    several = F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(names, F.lit(-1)))
    return F.when(n > 1, several).otherwise(F.array_join(names, ""))


def phrase(outcome: Column, n: Column) -> Column:
    """What n sources of an outcome do."""
    return F.when(n == 1, mapped(outcome, {k: v[0] for k, v in PHRASES.items()})).otherwise(mapped(outcome, {k: v[1] for k, v in PHRASES.items()}))


def day_range(first: Column, last: Column) -> Column:
    """Days from first to last, both inclusive, without what they share at the front: 1–28 Sep 2026, 25 Aug–28 Sep 2026."""
    head = F.when(F.year(first) != F.year(last), F.date_format(first, "d MMM yyyy")).when(F.month(first) != F.month(last), F.date_format(first, "d MMM")).otherwise(F.date_format(first, "d"))
    return F.when(first == last, F.date_format(last, "d MMM yyyy")).otherwise(F.concat(head, F.lit(DASH), F.date_format(last, "d MMM yyyy")))


def period_words(n: Column, freq: Column) -> Column:
    """days, week: the number is not in it."""
    return F.concat(mapped(freq, PERIODS), F.when(n == 1, "").otherwise("s"))


def badge(label: Column, direction: Column) -> Column:
    """The label in words, a trend's arrow and direction."""
    way = F.when((label == "TREND") & direction.isNotNull(), F.concat(mapped(direction, ARROWS), F.lit(" "), direction))
    return F.concat_ws(" ", mapped(label, LABEL_WORDS), way)


def fixed(value: Column, decimals: int = 1) -> Column:
    """A value with so many decimals, half to even on its binary value; never a negative zero."""
    return text_of(value, decimals)


def multiplier(value: float) -> str:
    """A setting with the fewest decimals, three at most, that show it."""
    return f"{value:.3f}".rstrip("0").rstrip(".")
