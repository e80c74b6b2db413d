"""Texts about verdicts held against the facts they may use.

A text is cut into lexemes once (runs of letters, digits and white space, single
marks); what they make together is a token of one class: a date, a number, a
month that stands alone, a number word or a label. All rules are column
expressions over the tokens of a text: facts are an array of numbers and one of
dates, a text's faults an array of (code, token).
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.wording import mapped

# Months, number words, labels and the word limit as published.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
EXEMPT_WORDS = ("one",)
AMBIGUOUS_MONTHS = ("may", "march", "mar")
LABELS = ("TREND", "FLUKE", "SEASONAL", "NO_CHANGE", "INCONCLUSIVE")
MAX_WORDS = 120

#: Short names: the first three letters, and one of four.
MONTH_OF = {name: i + 1 for i, m in enumerate(MONTHS) for name in (m, m[:3])} | {"sept": 9}
ORDINALS = ("st", "nd", "rd", "th")
MINUS, DASHES, TIMES = ("-", "\u2212"), ("-", "\u2013", "\u2014"), ("x", "X", "\u00d7")
DECIMAL = "decimal(30,12)"
NUMBERS = f"array<struct<value:{DECIMAL},percent:boolean>>"
TOKENS = "array<struct<kind:string,text:string,digits:string,negative:boolean,percent:boolean,year:int,month:int,days:array<int>>>"
#: Between texts that are scanned together: no token goes over it.
BREAK = "\x00"


def lexemes(text: str) -> list[str]:
    """Runs of letters, of digits and of white space, and single marks."""
    kind = lambda c: "a" if c.isalpha() else "d" if c in "0123456789" else "s" if c.isspace() else None
    out = []
    for k, run in groupby(text, kind):
        out += ["".join(run)] if k else list(run)
    return out


class Scan:
    """Reads tokens off the lexemes of a text; ``at`` of one beyond either end is the empty text."""

    def __init__(self, text: str):
        self.parts = lexemes(text)

    def at(self, i: int) -> str:
        return self.parts[i] if 0 <= i < len(self.parts) else ""

    def gap(self, i: int) -> int:
        """The place behind white space at i."""
        return i + 1 if self.at(i).isspace() else i

    def digits(self, i: int, *lengths: int) -> bool:
        part = self.at(i)
        return part.isdigit() and part.isascii() and (not lengths or len(part) in lengths)

    def day(self, i: int):
        """(day, place behind it) of a day of a month, with or without an ordinal's ending."""
        if not self.digits(i, 1, 2):
            return None
        return int(self.at(i)), i + 1 + (self.at(i + 1).lower() in ORDINALS)

    def days(self, i: int):
        """(days, place behind them) of a day or of a first and a last one."""
        if (first := self.day(i)) is None:
            return None
        j = self.gap(first[1])
        if self.at(j) in DASHES or (self.at(j).lower() == "to" and j > first[1]):
            last = self.day(self.gap(j + 1))
            if last is not None:
                return [first[0], last[0]], last[1]
        return [first[0]], first[1]

    def year(self, i: int, comma: bool = True):
        """(year, place behind it) of a year that follows after white space."""
        j = i + 1 if comma and self.at(i) == "," else i
        if self.gap(j) > j and self.digits(j + 1, 4) and self.at(j + 1)[:2] in ("19", "20"):
            return int(self.at(j + 1)), j + 2
        return None

    def month(self, i: int):
        """(month, place behind its name and full stop)."""
        found = MONTH_OF.get(self.at(i).lower())
        return (found, i + 1) if found else None

    def date(self, i: int):
        """(year, month, days, place behind) of a date that begins at i."""
        if self.digits(i, 4) and self.digits(i + 2, 2) and self.digits(i + 4, 2) and self.at(i + 1) == self.at(i + 3) == "-":
            return int(self.at(i)), int(self.at(i + 2)), [int(self.at(i + 4))], i + 5
        if (days := self.days(i)) is not None and not (self.at(i - 1).isalpha() or self.at(i - 1) in ("_", ".")):
            j = self.gap(days[1])
            if self.at(j).lower() == "of" and j > days[1]:
                j = self.gap(j + 1)
            if j > days[1] and (month := self.month(j)) is not None:
                j = month[1]
                year = self.year(j) or self.year(j + 1 if self.at(j) == "." else j)
                return year[0] if year else None, month[0], days[0], year[1] if year else j
        if (month := self.month(i)) is not None and self.at(i - 1) != "_" and not self.digits(i - 1):
            j = month[1] + (self.at(month[1]) == ".")
            if self.gap(j) > j and (days := self.days(j + 1)) is not None and not (self.digits(j + 1) and self.at(days[1]).isalpha()):
                year = self.year(days[1])
                return year[0] if year else None, month[0], days[0], year[1] if year else days[1]
            if (year := self.year(j)) is not None:
                return year[0], month[0], [], year[1]
        return None

    def number(self, i: int):
        """(digits, negative, percent, first place, place behind) of a number whose digits begin at i. Digits behind a letter are a name's."""
        before = self.at(i - 1)
        if not self.digits(i) or before == "_" or (before.isalpha() and (before not in TIMES or self.at(i - 2).isalnum())):
            return None
        digits, j = self.at(i), i + 1
        while len(self.at(i)) <= 3 and self.at(j) == "," and self.digits(j + 1, 3):
            digits, j = digits + self.at(j + 1), j + 2
        if self.at(j) == "." and self.digits(j + 1):
            digits, j = f"{digits}.{self.at(j + 1)}", j + 2
        earlier = self.at(i - 2)
        negative = before in MINUS and not (earlier.isalnum() or earlier in ("_", ".", ",", ")"))
        if self.at(j).lower() in ORDINALS or self.at(j) in TIMES:
            return digits, negative, False, i - negative, j
        k = self.gap(j)
        if self.at(k) == "%":
            return digits, negative, True, i - negative, k + 1
        if k > j and self.at(k).lower() == "percent":
            return digits, negative, True, i - negative, k + 1
        if k > j and self.at(k).lower() == "per" and self.at(self.gap(k + 1)).lower() == "cent":
            return digits, negative, True, i - negative, self.gap(k + 1) + 1
        return digits, negative, False, i - negative, j

    def tokens(self) -> list[dict]:
        out, i = [], 0
        token = lambda kind, a, b, **more: {"kind": kind, "text": "".join(self.parts[a:b])} | more
        while i < len(self.parts):
            part, j = self.at(i), i + 1
            if (date := self.date(i)) is not None:
                year, month, days, j = date
                out.append(token("date", i, j, year=year, month=month, days=days))
            elif (number := self.number(i)) is not None:
                digits, negative, percent, first, j = number
                out.append(token("number", first, j, digits=digits, negative=negative, percent=percent))
            elif part.isalpha() and self.at(i - 1) != "_" and not self.digits(i - 1):
                if part == "NO" and self.at(j) in ("_", " ") and self.at(j + 1) == "CHANGE" and self.at(j + 2) != "_":
                    j += 2
                    out.append(token("label", i, j) | {"text": "NO_CHANGE"})
                elif part in LABELS and self.at(j) != "_":
                    out.append(token("label", i, j))
                elif part.lower() in NUMBER_WORDS and self.at(j) != "_" and not self.digits(j):
                    out.append(token("word", i, j, digits=str(NUMBER_WORDS.index(part.lower())), negative=False, percent=False))
                elif part.lower() in MONTH_OF and part.istitle():
                    out.append(token("month", i, j, month=MONTH_OF[part.lower()]))
            i = j
        return out


def scanned(texts: pa.Array) -> pa.Array:
    fields = [("kind", pa.string()), ("text", pa.string()), ("digits", pa.string()), ("negative", pa.bool_()), ("percent", pa.bool_()), ("year", pa.int32()), ("month", pa.int32()), ("days", pa.list_(pa.int32()))]
    return pa.array([Scan(t or "").tokens() for t in texts.to_pylist()], pa.list_(pa.struct(fields)))


def with_tokens(rows: DataFrame, text: Column, name: str = "__read") -> DataFrame:
    """rows with TOKENS of a text in order; of several texts, joined by BREAK, all of theirs. Each text is read once, whatever then looks at its tokens."""
    return rows.withColumn(name, F.arrow_udf(scanned, TOKENS).asNondeterministic()(F.coalesce(text, F.lit(""))))


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda t: t["kind"].isin(*kinds))


def size(t: Column) -> Column:
    return t["digits"].try_cast(DECIMAL)


def decimals(t: Column) -> Column:
    return F.when(F.contains(t["digits"], F.lit(".")), F.least(F.length(F.substring_index(t["digits"], ".", -1)), F.lit(6))).otherwise(0)


def signed(t: Column) -> Column:
    return F.when(t["negative"], -size(t)).otherwise(size(t)).cast(DECIMAL)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def known(found_: Column, numbers: Column) -> Column:
    """Facts: the numbers and whole dates among tokens, and numbers (NUMBERS) besides."""
    said = F.transform(F.filter(of_kind(found_, "number"), lambda t: size(t).isNotNull()), lambda t: F.struct(signed(t).alias("value"), t["percent"].alias("percent")))
    whole = F.filter(of_kind(found_, "date"), lambda t: t["year"].isNotNull())
    day = lambda t, d: F.try_make_date(t["year"], t["month"], d) if hasattr(F, "try_make_date") else F.concat_ws("-", F.lpad(t["year"].cast("string"), 4, "0"), t["month"].cast("string"), d.cast("string")).try_cast("date")
    dates = F.flatten(F.transform(whole, lambda t: F.transform(t["days"], lambda d: day(t, d))))
    return F.struct(F.filter(F.concat(said.cast(NUMBERS), numbers.cast(NUMBERS)), lambda n: n["value"].isNotNull()).alias("numbers"), F.array_distinct(F.filter(dates, lambda d: d.isNotNull())).alias("dates"))


def with_facts(rows: DataFrame, texts: Column, numbers: Column, percents: Column | None = None, name: str = "known") -> DataFrame:
    """rows with what a narration may use: numbers and whole dates of texts, and numbers by themselves; percents: numbers that are shown as percent."""
    plain = lambda values, percent: F.transform(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))), lambda v: F.struct(v.try_cast(DECIMAL).alias("value"), F.lit(percent).alias("percent"))).cast(NUMBERS)
    every = plain(numbers, False) if percents is None else F.concat(plain(numbers, False), plain(percents, True))
    return with_tokens(rows, F.array_join(texts, BREAK)).withColumn(name, known(F.col("__read"), every)).drop("__read")


def with_undisplayed(rows: DataFrame, text: Column, numbers: Column, name: str = "undisplayed") -> DataFrame:
    """rows with the numbers, dates and number words of a text that its recorded numbers (key, number, text) do not show."""
    rest = F.filter("__read", lambda t: ~t["kind"].isin("label", "month"))
    held = lambda t: F.exists(numbers, lambda n: F.coalesce(n["text"] == t["text"], F.lit(False)) | F.coalesce((t["kind"] != "date") & (signed(t) == n["number"].try_cast(DECIMAL)), F.lit(False)))
    return with_tokens(rows, text).withColumn(name, F.transform(F.filter(rest, lambda t: ~held(t)), lambda t: F.btrim(t["text"]))).drop("__read")


def with_issues(rows: DataFrame, text: Column, label: Column, known: Column, max_words: int = MAX_WORDS, name: str = "issues") -> DataFrame:
    """rows with the faults of a text about a verdict."""
    return with_tokens(rows, text).withColumn(name, issues(text, F.col("__read"), label, known, max_words)).drop("__read")


def shows(shown: Column, places: Column, value: Column) -> Column:
    """Whether a size is a value as it stands, or rounded to the size's decimals, halves up or to even."""
    power = mapped(places, {0: 1, 1: 10, 2: 100, 3: 1000, 4: 10_000, 5: 100_000, 6: 1_000_000}).cast("decimal(8,0)")
    scaled, want = (value * power).cast("decimal(38,12)"), (shown * power).cast("decimal(38,12)")
    low = F.floor(scaled)
    part = scaled - low
    return (shown == value) | (want == low + F.when(part >= F.lit("0.5").cast("decimal(2,1)"), 1).otherwise(0)) | ((part == F.lit("0.5").cast("decimal(2,1)")) & (low % 2 == 0) & (want == low))


def licensed(t: Column, numbers: Column) -> Column:
    """Whether a fact shows a number: a minus sign needs a negative fact, a percent also a fraction, and a fraction a percent."""

    def by(f: Column) -> Column:
        value = F.abs(f["value"])
        other = F.when(t["percent"], value * 100).when(f["percent"], value / 100)
        return (~t["negative"] | (f["value"] < 0)) & (shows(size(t), decimals(t), value) | F.coalesce(shows(size(t), decimals(t), other.cast(DECIMAL)), F.lit(False)))

    return F.coalesce(F.exists(numbers, by), F.lit(False))


def issues(text: Column, read: Column, label: Column, known: Column, max_words: int = MAX_WORDS) -> Column:
    """Faults of a text about a verdict, by its tokens: empty, too_long, label_missing, wrong_label, date, number and number_word. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    numbers, dates = known["numbers"], known["dates"]
    fault = lambda code, token: F.struct(F.lit(code).alias("code"), token.cast("string").alias("token"))
    one = lambda cond, code, token: F.when(cond, F.array(fault(code, token))).otherwise(F.array().cast("array<struct<code:string,token:string>>"))
    words = F.size(found(text, r"\S+"))
    labels = F.array_sort(F.array_distinct(of_kind(read, "label")["text"]))
    fits = lambda t, d, x: (F.month(x) == t["month"]) & F.coalesce(F.year(x) == t["year"], F.lit(True)) & F.coalesce(F.day(x) == d, F.lit(True))
    any_day = F.array(F.lit(None).cast("int"))
    told = lambda t: F.forall(F.when(F.size(t["days"]) > 0, t["days"]).otherwise(any_day), lambda d: F.exists(dates, lambda x: fits(t, d, x)))
    alone = F.filter(of_kind(read, "month"), lambda t: ~F.lower(t["text"]).isin(*AMBIGUOUS_MONTHS) & ~F.exists(dates, lambda x: F.month(x) == t["month"]))
    is_year = lambda t: ~t["percent"] & ~F.contains(t["digits"], F.lit(".")) & size(t).between(1900, 2099)
    loose = F.filter(of_kind(read, "number"), lambda t: ~(is_year(t) & F.exists(dates, lambda x: F.year(x) == size(t))) & ~licensed(t, numbers))
    said = F.filter(of_kind(read, "word"), lambda t: ~F.lower(t["text"]).isin(*EXEMPT_WORDS) & ~licensed(t, numbers))
    every = F.concat(
        one(words > max_words, "too_long", words),
        one(~F.array_contains(labels, label), "label_missing", label),
        F.transform(F.filter(labels, lambda x: x != label), lambda x: fault("wrong_label", x)),
        F.transform(F.filter(of_kind(read, "date"), lambda t: ~told(t)), lambda t: fault("date", F.btrim(t["text"]))),
        F.transform(alone, lambda t: fault("date", t["text"])),
        F.transform(loose, lambda t: F.struct(F.when(is_year(t), "date").otherwise("number").alias("code"), t["text"].alias("token"))),
        F.transform(said, lambda t: fault("number_word", t["text"])),
    )
    return F.when(words == 0, F.array(fault("empty", F.lit("")))).otherwise(every)


def paragraph(pieces: Column, max_words: int = MAX_WORDS) -> Column:
    """Sentences in order, each only while the text stays within the word limit; the first one always."""
    n = lambda t: F.size(found(t, r"\S+"))
    add = lambda text, p: F.when(text == "", p).when(n(text) + n(p) <= max_words, F.concat_ws(" ", text, p)).otherwise(text)
    return F.aggregate(F.filter(pieces, lambda p: p.isNotNull() & (p != "")), F.lit(""), add)


def opening(name: Column, label: Column, direction: Column) -> Column:
    """How a text about a source begins."""
    blip = F.when(direction == "up", "spike").when(direction == "down", "dip").otherwise("blip")
    by = {
        "TREND": F.concat(name, F.lit(" shows a sustained "), F.coalesce(direction, F.lit("")), F.lit("ward trend")),
        "FLUKE": F.concat(name, F.lit(" shows a short-lived "), blip, F.lit(" rather than a lasting shift")),
        "SEASONAL": F.concat(name, F.lit(" moved in line with its usual annual pattern")),
        "NO_CHANGE": F.concat(name, F.lit(" shows no meaningful change in the recent window")),
        "INCONCLUSIVE": F.concat(F.lit("The data from "), name, F.lit(" does not support a firm call")),
    }
    return F.coalesce(*[F.when(label == k, v) for k, v in by.items()])


def narration(name: Column, label: Column, direction: Column, confidence: Column, rule: Column, reason: Column, evidence: Column, condition: Column, window: Column) -> Column:
    """A paragraph from a verdict's own fields; evidence: the sentence of the first check that agrees, condition: the first of condition_texts, window: a sentence on the periods compared."""
    first = F.concat(opening(name, label, direction), F.lit(": the verdict is "), label, F.lit(", with "), confidence, F.lit(" confidence (rule "), rule, F.lit(")."))
    change = F.concat(F.lit("What would change this: "), F.lower(F.substring(condition, 1, 1)), F.regexp_replace(condition, "^.", ""))
    return paragraph(F.array(first, F.when(reason != "", F.concat(F.lit("Why: "), F.regexp_replace(reason, r"\.$", ""), F.lit("."))), evidence, change, window))
