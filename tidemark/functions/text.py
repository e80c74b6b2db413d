"""Column functions on names, keys, numbers and narrations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(name: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one dash, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def normalised_query(query: Column) -> Column:
    """Lower case, white space runs as one blank, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(query, r"\s+", " ")))


def cache_key(source: Column, query: Column, params: Column) -> Column:
    """The source and a digest of the normalised query and its parameters as JSON."""
    return F.concat_ws(":", source, F.sha2(F.concat_ws("\x1f", normalised_query(query), params), 256))


def epoch_day(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def plural(n: Column, word: str) -> Column:
    return F.when(n == 1, word).otherwise(word + "s")


def p_text(p: Column) -> Column:
    return F.when(F.round(p, 3) == 0, "p < 0.001").otherwise(F.concat(F.lit("p = "), F.format_number(p, 3)))
