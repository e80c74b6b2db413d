"""Mixing sources to target weights by systematic sampling.

A prefix sum of documents' expected copies, shifted by one random offset a
source, emits a copy for every integer it crosses. Documents stand in falling
order of size, so a sample takes large and small ones alike.

A few very large documents could still put a source far off its target,
whichever way the offset falls. So of each source's largest documents, ``FIRST``
at most, each one's expected copies are what is left of the target over what is
left of the size once the copies before it are known: what one was given too much
is taken from those after it. All others share the rate that is left then. There
is one offset a source, and nothing is chosen by its outcome; the price is that
the largest documents' expected copies vary about the source's rate.

Prefix sums come from counts of small groups (source, size class, part by a hash
of the id) and row numbers inside them: a source that holds a third of all rows
is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, table, written

SEED = 7
CAP = 3
WEIGHTS = (1, 2, 3)
#: Largest documents of a source whose rates follow what is left.
FIRST = 32
#: Their class, above all others.
TOP = 1 << 20


KEYS = ["__key", "__class", "__part"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs and what places each row in its source's order; all new names begin with two underscores."""
    source, hashed = F.col(source_col).cast("string"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.withColumns({"__source": source, "__key": F.coalesce(F.concat(F.lit("s"), source), F.lit("null")), "__size": word_count(F.col(text_col)), "__hash": hashed})


def least_sizes(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """(__least_key, __least): the largest size of each source that more than ``first`` documents reach, -1 where all are fewer. Each task sends so many rows of a source at most."""
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.desc("__size")))
    top = rows.select("__key", "__size").withColumn("__place", place).where(F.col("__place") <= first + 1)
    return top.groupBy(F.col("__key").alias("__least_key")).agg(F.coalesce(F.max(F.when(F.col("__place") == first + 1, F.col("__size"))), F.lit(-1)).alias("__least"))


def classed(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Rows with their size class and part: those above __least are a class and a part of their own, at most FIRST of a source."""
    # Whole numbers in classes an eighth to a sixteenth wide, in order.
    size_class = F.expr("shiftright(__size, greatest(length(bin(__size)) - 4, 0)) + 8 * greatest(length(bin(__size)) - 4, 0)")
    top = F.col("__size") > F.col("__least")
    both = rows.join(least, F.col("__key") == F.col("__least_key"))
    return both.withColumns({"__class": F.when(top, TOP).otherwise(size_class), "__part": F.when(top, "").otherwise(F.substring("__hash", 1, 2))}).drop("__least_key", "__least")


def targets(totals: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(__source, __key, source_size): the same and target. One row a source, so the windows are small.

    Sources in code-point order, null last, weigh as weights says in turn. The
    total is shared by weight; a source whose share is above cap times its size
    stops there and the rest is shared anew until none is above. Sources stop in
    order of cap * size / weight, so running sums tell where that ends.
    """
    order = Window.orderBy(F.col("__source").isNull(), "__source")
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    rows = totals.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), nth.cast("int")).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("__source").isNull(), "__source")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns(
        {
            "at": F.row_number().over(by_ratio),
            "left": F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "left_w": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    most, goes_on = cap * F.col("source_size"), cap * F.col("source_size") * F.col("left_w") > F.col("w") * F.col("left")
    shared = F.min(F.when(goes_on, F.struct("at", (F.col("left") / F.col("left_w")).alias("rate")))).over(whole)["rate"]
    return rows.withColumn("shared", shared).select("__source", "__key", "source_size", F.coalesce(F.least(most.cast("double"), F.col("w") * F.col("shared")), most.cast("double")).alias("target"))


def offset(seed: int) -> Column:
    """The seeded offset in [0, 1) of the source in __key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__key"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rate_of(target: Column, size: Column, cap: int) -> Column:
    """What is left of the target over what is left of the size; documents without words go on at the source's own rate."""
    within = lambda t, s: F.least(F.greatest(t / s, F.lit(0.0)), F.lit(float(cap)))
    whole = F.col("source_size").cast("double")
    return F.when(size > 0, within(target, size)).when(whole > 0, within(F.col("target"), whole)).otherwise(F.lit(0.0))


def crossed(u: Column, before: Column, after: Column, cap: int) -> Column:
    """Integers between two prefix sums, shifted by the offset."""
    return F.least(F.floor(u + after) - F.floor(u + before), F.lit(cap)).cast("long")


def first_copies(top: DataFrame, cap: int) -> DataFrame:
    """Of each source (__key, source_size, target, u, sizes: its largest documents' in order): their copies, and the prefix sum (__sum) and rate (__rate) with which the others go on."""
    begin = F.struct(F.col("target").alias("t"), F.col("source_size").cast("double").alias("s"), F.lit(0.0).alias("p"), F.array().cast("array<bigint>").alias("c"))

    def step(a, size):
        after = a["p"] + rate_of(a["t"], a["s"], cap)
        n = crossed(F.col("u"), a["p"], after, cap)
        return F.struct((a["t"] - (n * size).cast("double")).alias("t"), (a["s"] - size.cast("double")).alias("s"), after.alias("p"), F.concat(a["c"], F.array(n)).alias("c"))

    end = top.withColumn("e", F.aggregate("sizes", begin, step))
    return end.select("__key", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("u").alias("__u"), F.col("e.c").alias("__copies"), F.col("e.p").alias("__sum"), rate_of(F.col("e.t"), F.col("e.s"), cap).alias("__rate"))


def numbered(rows: DataFrame, places: DataFrame, id_col: str, cap: int = CAP) -> DataFrame:
    """rows with what places has for their group, and __times: how often the mix takes each."""
    within = Window.partitionBy(*KEYS).orderBy(F.desc("__size"), "__hash", id_col)
    both = rows.withColumn("__at", F.row_number().over(within)).join(places, KEYS)
    at = F.col("__first") + F.col("__at")
    after = crossed(F.col("__u"), F.col("__sum") + F.col("__rate") * (at - 1), F.col("__sum") + F.col("__rate") * at, cap)
    return both.withColumn("__times", F.when(F.col("__class") == TOP, F.try_element_at("__copies", F.col("__at"))).otherwise(after))


def plan(rows: DataFrame, seed: int = SEED, cap: int = CAP, weights=WEIGHTS) -> DataFrame:
    """For each group of classed() rows: how many rows of its source, but for the largest, come before it; its source's size, target, offset and rates."""
    parts = written(rows.groupBy("__source", *KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("size")), "mix_parts")
    goal = targets(parts.groupBy("__source", "__key").agg(F.sum("size").alias("source_size")), weights, cap).drop("__source").withColumn("u", offset(seed))
    largest = rows.where(F.col("__class") == TOP).groupBy("__key").agg(F.reverse(F.array_sort(F.collect_list("__size"))).alias("sizes"))
    top = goal.join(largest, "__key", "left").withColumn("sizes", F.coalesce("sizes", F.array().cast("array<bigint>")))
    running = Window.partitionBy("__key").orderBy(F.desc("__class"), "__part")
    others = F.when(F.col("__class") == TOP, 0).otherwise(F.col("n"))
    first = parts.select(*KEYS, (F.sum(others).over(running) - others).alias("__first"))
    return first.join(first_copies(top, cap), "__key")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, cap: int = CAP, weights=WEIGHTS) -> DataFrame:
    """The columns of docs, each row as many times as the mix takes it.

    A null source is a source of its own, after all others; a null or empty text
    has size 0 and is drawn like others; a source without words has target 0 and
    gives nothing. Repeated rows are documents of their own. A null id hashes as
    the empty text; documents of equal size stand in order of their id's hash. A
    text of any length is counted whole. An empty table gives no rows. Columns named like the
    operator's own never clash: those begin with two underscores. The same rows
    give the same copies, however they are spread.
    """
    rows, _, places = placed(docs, id_col, source_col, text_col, seed, cap, weights)
    times = numbered(rows, places, id_col, cap).where("__times > 0")
    return times.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("__copy")).select(*docs.columns)


def placed(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, cap: int, weights) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of docs with their groups, the same without texts, written, and plan())."""
    rows = sized(docs, id_col, source_col, text_col)
    narrow = written(rows.select(id_col, "__source", "__key", "__size", "__hash"), "mix_sizes")
    least = written(least_sizes(narrow), "mix_least")
    narrow = classed(narrow, least)
    return classed(rows, least), narrow, written(plan(narrow, seed, cap, weights), "mix_places")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, cap: int = CAP, weights=WEIGHTS) -> DataFrame:
    """What mix() does with each row: id, size, source_size, target, copies, taken. Every row is there, also those not taken."""
    _, narrow, places = placed(docs, id_col, source_col, text_col, seed, cap, weights)
    out = numbered(narrow, places, id_col, cap)
    return out.select(id_col, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__times").alias("copies"), (F.col("__times") * F.col("__size")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("copies")


QUERIES = {"op10_mixing": op10_mixing}

ORACLE_SQL = {
    "op10_mixing": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY size DESC) AS nth FROM d),
l AS (SELECT k, coalesce(max(size) FILTER (nth = {FIRST} + 1), -1) AS least FROM o GROUP BY k),
c AS (SELECT d.*, size > least AS top, greatest(length(bin(size)) - 4, 0) AS e, substr(h, 1, 2) AS part FROM d JOIN l USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, top ORDER BY CASE WHEN top THEN 0 ELSE (size >> e) + 8 * e END DESC, CASE WHEN top THEN '' ELSE part END, size DESC, h, doc_id) AS pos FROM c),
s AS (SELECT source, k, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS w FROM s),
b AS (SELECT *, row_number() OVER o AS pos,
        sum(source_size) OVER () - {CAP} * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
        sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
      FROM w WINDOW o AS (ORDER BY source_size / w::DOUBLE, source IS NULL, source)),
g AS (SELECT *, (SELECT arg_min(left_::DOUBLE / left_w::DOUBLE, pos) FROM b WHERE {CAP} * source_size * left_w > w * left_) AS shared FROM b),
t AS (SELECT k, source_size, coalesce(least(({CAP} * source_size)::DOUBLE, w::DOUBLE * shared), ({CAP} * source_size)::DOUBLE) AS target,
        ('0x' || substr(md5('{SEED}:' || k), 1, 13))::BIGINT / {float(1 << 52):.1f} AS u FROM g),
f AS (
  SELECT k, 0::BIGINT AS i, target AS t, source_size::DOUBLE AS s, 0::DOUBLE AS p, 0::BIGINT AS c FROM t
  UNION ALL
  SELECT k, i, t - (c * size)::DOUBLE, s - size::DOUBLE, after, c FROM (
    SELECT *, least(floor(u + after) - floor(u + p), {CAP})::BIGINT AS c FROM (
      SELECT f.k, f.i + 1 AS i, f.t, f.s, f.p, r.size, t.u, f.p + CASE WHEN f.s > 0 THEN least(greatest(f.t / f.s, 0), {CAP}) WHEN t.source_size > 0 THEN least(t.target / t.source_size, {CAP}) ELSE 0 END AS after
      FROM f JOIN r ON r.k = f.k AND r.top AND r.pos = f.i + 1 JOIN t ON t.k = f.k))),
z AS (SELECT f.k, f.p, CASE WHEN f.s > 0 THEN least(greatest(f.t / f.s, 0), {CAP}) WHEN t.source_size > 0 THEN least(t.target / t.source_size, {CAP}) ELSE 0 END AS rate
      FROM (SELECT k, max(i) AS i FROM f GROUP BY k) m JOIN f USING (k, i) JOIN t USING (k))
SELECT r.doc_id, r.size, t.source_size, t.target,
       (CASE WHEN r.top THEN f.c ELSE least(floor(t.u + (z.p + z.rate * r.pos)) - floor(t.u + (z.p + z.rate * (r.pos - 1))), {CAP}) END * r.size)::BIGINT AS taken
FROM r JOIN t ON r.k = t.k JOIN z ON z.k = r.k LEFT JOIN f ON f.k = r.k AND r.top AND f.i = r.pos
"""
}
