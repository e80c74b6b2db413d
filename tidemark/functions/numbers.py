"""Numbers that a sentence shows and records at once, rounded half to even on their exact binary value.

A sentence is a struct of a text and of the numbers in it: what is shown and what
is recorded come from one rounded value, so they cannot differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "struct<key:string,number:double,text:string>"
SENTENCE = f"struct<text:string,numbers:array<{NUMBER}>>"
#: Decimals of values, statistics, percentages and p-values. Fixed values.
VALUE, STAT, PERCENT, P = 1, 2, 1, 3
#: Products from here on are whole numbers whose factor is the rounded value itself.
WHOLE = float(1 << 53)
#: Splits a double into halves whose products are exact.
SPLIT = float((1 << 27) + 1)


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once however often it is used."""
    return F.try_element_at(F.transform(F.array(value), then), F.lit(1))


def units(value: Column, decimals: int) -> Column:
    """value times a power of ten as the nearest whole number, ties to even, as a double.

    The product's rounding error is found exactly (by halves of the factors), so
    2.675 is below its tie and 0.125 is on it.
    """
    scale = float(10**decimals)

    def product(v: Column) -> Column:
        high = v * SPLIT - (v * SPLIT - v)
        return F.struct((v * scale).alias("p"), high.alias("high"), (v - high).alias("rest"))

    def above(x: Column) -> Column:
        low = F.floor(x["p"]).cast("double")
        error = (x["high"] * scale - x["p"]) + x["rest"] * scale
        return F.struct(x["p"].alias("p"), low.alias("low"), (((x["p"] - low) - 0.5) + error).alias("above"))

    def near(x: Column) -> Column:
        even = 2 * F.floor((x["low"] + 1) / 2).cast("double")
        return F.when(F.abs(x["p"]) < WHOLE, F.when(x["above"] > 0, x["low"] + 1).when(x["above"] < 0, x["low"]).otherwise(even)).otherwise(x["p"])

    return let(value.cast("double"), lambda v: let(product(v), lambda x: let(above(x), near)))


def shown(value: Column, decimals: int) -> Column:
    """struct(number, text): the double nearest to the rounded value, and it with so many decimals; never a negative zero, null for what is not finite."""
    scale = float(10**decimals)
    string = lambda x: x.cast("decimal(38,0)").cast("string")

    def digits(n: Column) -> Column:
        if not decimals:
            return string(F.abs(n))
        padded = lambda d: F.lpad(d, F.greatest(F.length(d), F.lit(decimals + 1)), F.lit("0"))
        return let(padded(string(F.abs(n))), lambda d: F.concat(F.left(d, F.length(d) - decimals), F.lit("."), F.right(d, F.lit(decimals))))

    def small(v: Column) -> Column:
        return let(units(v, decimals), lambda n: F.struct((F.when(n == 0, 0.0).otherwise(n) / scale).alias("number"), F.concat(F.when(n < 0, "-").otherwise(""), digits(n)).alias("text")))

    def large(v: Column) -> Column:
        """A large value is its own nearest double; its fraction has few bits, so it is rounded by itself."""
        if not decimals:
            text = string(F.abs(v))
        else:
            whole = F.floor(F.abs(v)).cast("double")
            ends = let(units(F.abs(v) - whole, decimals), lambda n: F.concat(string(F.when(n >= scale, whole + 1).otherwise(whole)), F.lit("."), F.lpad(string(F.when(n >= scale, 0.0).otherwise(n)), decimals, "0")))
            text = F.when(F.abs(v) < WHOLE, ends).otherwise(F.concat(string(F.abs(v)), F.lit("." + "0" * decimals)))
        return F.struct(v.alias("number"), F.concat(F.when(v < 0, "-").otherwise(""), text).alias("text"))

    return let(value.cast("double"), lambda v: F.when(F.abs(v) < float("inf"), F.when(F.abs(v * scale) < WHOLE, small(v)).otherwise(large(v))))


def rounded(value: Column, decimals: int) -> Column:
    return shown(value, decimals)["number"]


def text_of(value: Column, decimals: int) -> Column:
    return shown(value, decimals)["text"]


@dataclass
class Shown:
    """A part of a sentence: its text and what it records."""

    text: Column
    numbers: list[Column]


def _record(key: str, number: Column, text: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), number.cast("double").alias("number"), text.cast("string").alias("text")).cast(NUMBER)


def fixed(key: str, value: Column, decimals: int) -> Shown:
    record = let(shown(value, decimals), lambda x: _record(key, x["number"], x["text"]))
    return Shown(record["text"], [F.when(record["text"].isNotNull(), record)])


def value(key: str, column: Column) -> Shown:
    """A value on a series' own scale."""
    return fixed(key, column, VALUE)


def stat(key: str, column: Column) -> Shown:
    """A statistic, ratio or penalty."""
    return fixed(key, column, STAT)


def percent(key: str, share: Column) -> Shown:
    """A share as a percentage, which is what is recorded."""
    part = fixed(key, 100.0 * share, PERCENT)
    return Shown(F.concat(part.text, F.lit("%")), part.numbers)


def count(key: str, column: Column) -> Shown:
    whole = column.cast("long")
    return Shown(whole.cast("string"), [_record(key, whole, whole)])


def date(key: str, column: Column) -> Shown:
    """An ISO date, recorded as its text."""
    said = F.date_format(column, "yyyy-MM-dd")
    return Shown(said, [_record(key, F.lit(None), said)])


def p_value(key: str, p: Column) -> Shown:
    """p = 0.012; where it rounds to zero p < 0.001, with zero and the bound recorded."""
    record, bound = let(shown(p, P), lambda x: _record(key, x["number"], x["text"])), f"{10.0**-P:.{P}f}"
    tiny = record["number"] == 0
    return Shown(F.when(tiny, F.lit(f"p < {bound}")).otherwise(F.concat(F.lit("p = "), record["text"])), [record, F.when(tiny, _record(f"{key}_bound", F.lit(10.0**-P), F.lit(bound)))])


def _part(part) -> Shown:
    return part if isinstance(part, Shown) else Shown(F.lit(part) if isinstance(part, str) else part, [])


def optional(cond: Column, *parts) -> Shown:
    """Parts that are there where a condition holds."""
    shown = [_part(p) for p in parts]
    held = F.coalesce(cond, F.lit(False))
    return Shown(F.when(held, F.concat(*[p.text for p in shown])).otherwise(""), [F.when(held, n) for p in shown for n in p.numbers])


def sentence(*parts) -> Column:
    """SENTENCE of texts, columns and shown numbers; null where a part is null."""
    shown = [_part(p) for p in parts]
    text = F.concat(*[p.text for p in shown])
    records = [n for p in shown for n in p.numbers]
    kept = F.filter(F.array(*records), lambda n: n.isNotNull()) if records else F.array()
    return F.when(text.isNotNull(), F.struct(text.alias("text"), kept.cast(f"array<{NUMBER}>").alias("numbers")).cast(SENTENCE))
