"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidate spans in each text. Hashes of the candidates' values are
aggregated by distinct repository and owner over the whole corpus, with the
places where these values stand bare. A value that several owners hold is a
widely copied example, unless one owner has most of the repositories that hold
it: such a value, or one of few owners, belongs to an owner, and is live if it
looks random. Every span tells its value's class. A live value is also reported
where it stands bare, without the context that the patterns need (kind
``corpus``): as a run of its characters, as a run's part after its first =, or
as one between = and /.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: kind: pattern, group that holds the value, least length of that value. The
#: bounds of access and hex are in their patterns: their runs are maximal, so
#: that finds the same matches. A failing assign match uses its text up.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Bare runs that can be a known value elsewhere.
BARE = r"[A-Za-z0-9+/_.=-]{15,}[A-Za-z0-9+/_=]"
BARE_LEAST = 16
#: Parts of a bare run between = and /.
PIECE = r"[A-Za-z0-9+_.-]{15,}[A-Za-z0-9+_]"
#: A value with at least so many owners is a widely copied example, unless one owner has this share of its repositories.
EXAMPLE_OWNERS = 3
OWNER_SHARE = 0.8
#: Bits a character that a random value's characters carry at least, by their counts in it.
LEAST_ENTROPY = 2.5
#: Arrays are summed up in parts of so many elements: copying is linear in an array's length.
PART = 256

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last_of(xs: Column, otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(xs, F.lit(-1)), otherwise)


def running(values: Column, op) -> Column:
    """Running results of an associative op over an array of numbers from 0 up (0 changes nothing): in parts, then over the parts' ends."""
    fold = lambda part: F.aggregate(part, F.array().cast("array<int>"), lambda out, x: F.concat(out, F.array(op(last_of(out, F.lit(0)), x).cast("int"))))
    carried = lambda parts: F.aggregate(parts, F.array(F.lit(0)), lambda out, part: F.concat(out, F.array(op(last_of(out, F.lit(0)), last_of(part, F.lit(0))).cast("int"))))
    joined = lambda parts: F.flatten(F.zip_with(parts, F.slice(carried(parts), F.lit(1), F.size(parts)), lambda part, b: F.transform(part, lambda x: op(b, x).cast("int"))))
    cut = lambda xs: F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / PART).cast("int")), lambda i: fold(F.slice(xs, i * PART + 1, F.lit(PART))))
    return let(values, lambda xs: F.when(F.size(xs) <= PART, fold(xs)).otherwise(let(cut(xs), joined)))


def spans_of(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Spans of one kind: leftmost matches, not overlapping; positions in code points, from the text between matches."""
    p = F.lit(pattern)
    values = F.regexp_extract_all(text, p, F.lit(group))
    pair = lambda end, hit: F.struct(end.alias("end"), F.length(hit).alias("size"))
    span = lambda x, value: F.struct((x["end"] - x["size"]).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

    def placed(hits):
        both = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        ends = F.zip_with(running(both, lambda x, y: x + y), hits, pair)
        return F.filter(F.zip_with(ends, values, span), lambda s: F.length(s["value"]) >= least)

    found = let(F.regexp_extract_all(text, p, F.lit(0)), placed)
    return F.when(text.rlike(pattern), found.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """All spans of the patterns, by start, then kind as listed."""
    return F.array_sort(F.concat(*[spans_of(text, p, group, least, rank, kind) for rank, (kind, (p, group, least)) in enumerate(KINDS.items())]))


def entropy(value: Column) -> Column:
    """Bits a character, by the counts of its characters in the value."""
    letters, n = F.split(value, ""), F.length(value)
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.filter(letters, lambda c: c != "")), F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))


def looks_random(value: Column) -> Column:
    """Long enough, with a digit and a letter, and of many different characters."""
    shape = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= BARE_LEAST)
    return F.when(shape, entropy(value) >= LEAST_ENTROPY).otherwise(False)


def scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str | None) -> DataFrame:
    """One pass over the texts: base spans, and bare runs with a digit and a letter, of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.filter(spans_of(text, BARE, 0, BARE_LEAST, len(KINDS), "corpus"), lambda s: looks_random(s["value"]))
    owner = F.col(owner_col).cast("string")
    return docs.select(
        F.col(id_col).alias("__id"),
        F.md5(text).alias("__text"),
        owner.alias("__owner"),
        (F.col(repository_col).cast("string") if repository_col else owner).alias("__repository"),
        base_spans(text).alias("__base"),
        bare.alias("__bare"),
    )


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"[.=-]+$", "")


def value_hash(value: Column) -> Column:
    return F.sha2(trimmed(value), 256)


def bare_places(found: DataFrame) -> DataFrame:
    """A row for each place outside base spans where a bare value may stand: runs, their parts after the first =, and those between = and /."""
    runs = found.where(F.size("__bare") > 0).select("__id", "__text", "__owner", "__repository", "__base", F.explode("__bare").alias("s"))
    run, first = F.col("s.value"), F.instr("s.value", "=")
    part = lambda shift, value: F.struct((F.col("s.start") + shift).alias("start"), F.col("s.rank").alias("rank"), (F.col("s.start") + shift + F.length(value)).alias("end"), F.col("s.kind").alias("kind"), value.alias("value"))
    rest = run.substr(first + 1, F.length(run))
    one = F.array(F.col("s").cast(SPAN), part(first, rest).cast(SPAN))
    pieces = F.transform(spans_of(run, PIECE, 0, BARE_LEAST, len(KINDS), "corpus"), lambda p: part(p["start"], p["value"]).cast(SPAN))
    # A part that differs from the run, or from its rest, in trailing padding only is the same place.
    fresh = F.filter(pieces, lambda p: ~((p["start"] == F.col("s.start")) & (trimmed(p["value"]) == trimmed(run))) & ~((p["start"] == F.col("s.start") + first) & (trimmed(p["value"]) == trimmed(rest))))
    every = F.when(run.rlike("[=/]"), F.concat(F.when(first > 0, one).otherwise(F.slice(one, 1, 1)), fresh)).otherwise(F.slice(one, 1, 1))
    places = runs.select("__id", "__text", "__owner", "__repository", "__base", F.explode(F.filter(every, lambda p: looks_random(p["value"]))).alias("s"))
    places = places.where(~F.exists("__base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"])))
    return places.select("__id", "__text", "__owner", "__repository", "s", value_hash(F.col("s.value")).alias("hash"))


def ownership(found: DataFrame) -> DataFrame:
    """By hash of a candidate value: places (in base spans and bare), repositories, owners, the largest owner's share of the repositories, and class (example, live or weak).

    Counted key by key with partial sums first: a value in a third of all rows is
    a few rows for each task before anything is shuffled. Bare values that no
    base span has are dropped after these sums. A repository is told by its owner
    and its name.
    """
    keys = ("hash", "__owner", "__repository")
    one = found.select("__owner", "__repository", F.explode("__base.value").alias("value"))
    one = one.select("__owner", "__repository", value_hash(F.col("value")).alias("hash"), looks_random(F.col("value")).alias("random"))
    base = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("random").alias("random"))
    bare = bare_places(found).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("random"))
    bare = bare.join(base.select("hash").distinct(), "hash", "left_semi")
    by_repository = base.unionByName(bare).groupBy(*keys).agg(F.sum("n").alias("n"), F.max("random").alias("random"))
    by_owner = by_repository.groupBy("hash", "__owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"), F.max("random").alias("random"))
    by_hash = by_owner.groupBy("hash").agg(F.sum("n").alias("places"), F.sum("r").alias("repositories"), F.count(F.lit(1)).alias("owners"), (F.max("r") / F.sum("r")).alias("share"), F.max("random").alias("random"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) & (F.col("share") < OWNER_SHARE)
    return by_hash.select("hash", "places", "repositories", "owners", "share", F.when(copied, "example").when(F.col("random"), "live").otherwise("weak").alias("class"))


def classed_spans(found: DataFrame, owners: DataFrame) -> DataFrame:
    """By id and text, for rows with a span: all spans with their values' classes (base ones, and bare places of live values outside them; of bare places one in the other, the longer)."""
    base = found.where(F.size("__base") > 0).select("__id", "__text", F.explode("__base").alias("s"))
    base = base.withColumn("hash", value_hash(F.col("s.value"))).join(owners.select("hash", "class"), "hash")
    added = bare_places(found).join(owners.where(F.col("class") == "live").select("hash", "class"), "hash")
    both = base.select("__id", "__text", "s", "class").unionByName(added.select("__id", "__text", "s", "class"))
    every = both.groupBy("__id", "__text").agg(F.collect_set(F.struct("s.start", "s.rank", "s.end", "s.kind", "s.value", "class")).alias("__all"))
    is_bare = lambda s: s["kind"] == "corpus"
    inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    bare = F.filter("__all", is_bare)
    longest = F.filter(bare, lambda s: ~F.exists(bare, lambda o: inside(s, o)))
    return every.select("__id", "__text", F.array_sort(F.concat(F.filter("__all", lambda s: ~is_bare(s)), longest)).alias("__spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


CLASSED = SPAN.replace(">", ",class:string>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of start, rank, end, kind, value; spans with their values' class too) of every row.

    An owner is a source; its repository is another column or, without one, the
    source too. A null text is empty; null owners count as one owner. Repeated
    rows each give a row, with equal spans. A null id is kept. Other columns are
    ignored. A text of any length is scanned whole. An empty table gives no rows.
    """
    found = written(scanned(docs, id_col, text_col, owner_col, repository_col), "secrets")
    spans = classed_spans(found, ownership(found))
    rows = found.select("__id", "__text", "__base").alias("f").join(spans.alias("a"), F.col("f.__id").eqNullSafe(F.col("a.__id")) & (F.col("f.__text") == F.col("a.__text")), "left")
    return rows.select(F.col("f.__id").alias("doc_id"), F.col("f.__text").alias("text_md5"), F.col("f.__base").alias("base"), F.coalesce("a.__spans", F.array().cast(f"array<{CLASSED}>")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or union of overlapping spans, replaced by mark. Spans are in order of their starts."""

    def cut(done):
        # A span that begins in an earlier one has no mark of its own.
        pieces = F.zip_with(F.transform(spans, lambda s: s["start"]), F.slice(done, F.lit(1), F.size(spans)), lambda start, at: F.when(start >= at, F.concat(text.substr(at + 1, start - at), F.lit(mark))))
        return F.concat(F.array_join(pieces, ""), text.substr(F.element_at(done, -1) + 1, F.length(text)))

    ends = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    return F.when(F.size(spans) > 0, let(F.concat(F.array(F.lit(0)), ends), cut)).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """docs with its texts redacted; all rows and other columns stay as they are (a null text stays null)."""
    spans = scan(docs, id_col, text_col, owner_col).where(F.size("spans") > 0).groupBy("doc_id", "text_md5").agg(F.first("spans").alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__key"), F.col("text_md5").alias("__text"), "__spans")
    rows = docs.join(spans, F.col(id_col).eqNullSafe(F.col("__key")) & (F.md5(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__text")), "left")
    clean = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), F.col("__spans")))
    return rows.withColumn(text_col, clean).select(*docs.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources, repositories a source's languages. classes: of the spans, in their order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = scan(docs, repository_col="lang")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    classes = F.array_join(F.transform("spans", lambda s: s["class"]), ",").alias("classes")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), classes)


QUERIES = {"op7_secret_scan": op7_secret_scan}
