"""Near-duplicate documents by SetSketch registers.

1. One pass over the texts gives each its shingle set's digest and SetSketch
   registers. Equal sets are one class from then on, however many copies.
2. Bands of registers put classes into buckets. A bucket's members are paired
   with its first member and with the one before them only.
3. The likeliest similarity of a pair's registers, the set sizes known, drops
   pairs that are far below the threshold; full sets confirm the others.
4. Links make components, by alternating stars.
5. A bucket that then still holds several components is compared inside, in
   blocks of bounded size, across components only, each pair in the first band
   that it shares: first the best of the possible links, as a forest, whose
   pairs are confirmed like others; then what remains apart is confirmed where
   its block stands, texts beside one another, and only links that unite come
   out. So no link of a bucket is lost, and the pairs of a group are never rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, slices, table, written
from tidemark.llm.shingles import SetSketch, Shingler
from tidemark.llm.tokens import shared

BANDS = 32
ROWS = 4
#: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Pairs whose likeliest similarity is below are not confirmed: four standard errors under the threshold.
MAYBE = 0.60
#: About as many members, and shingles in all, has a block that is compared with another.
BLOCK = 1_024
BLOCK_SHINGLES = 4_000_000
#: Members of larger buckets are ordered in parts of about this size.
PART = 4_096


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null where it is empty) and registers of every row."""

    def run(batches):
        sets, sketch = shared(Shingler), shared(SetSketch, BANDS * ROWS)
        for batch in slices(batches):
            found = sets.sets(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found], pa.binary()),
                    pa.array([sketch.registers(s).tobytes() if len(s) else None for s in found], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "registers"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


#: A list of hot buckets is sent to all tasks up to so many rows (16 bytes each); a longer one is joined by key.
HOT_ROWS = 1_000_000


def parts_of(n) -> Column:
    return F.greatest(F.ceil(n / PART), F.lit(1)).cast("int")


def dealt(rows: DataFrame, parts: str = "parts") -> DataFrame:
    """A row of a bucket once for each of the bucket's parts."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))


def buckets(classes: DataFrame) -> DataFrame:
    """(key, part, parts, band, id, lo, prev, n): the members of every bucket that has several, with its first member and the one before.

    First members and sizes are partial aggregates. A large bucket is then dealt
    into parts before its members are moved, so that they never meet in one task
    (prev is in the part).
    """
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    keys = classes.select("id", "registers", band.alias("band"))
    keys = keys.select(F.xxhash64("band", F.expr(f"substring(registers, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("key"), "band", "id")
    several = written(keys.groupBy("key").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", parts_of(F.col("n"))), "several")
    hot = several.where("parts > 1").select("key", F.col("parts").alias("of"))
    hot = F.broadcast(hot) if hot.count() <= HOT_ROWS else hot
    keys = keys.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("of", F.lit(1))).cast("int")).drop("of")
    return keys.join(dealt(several), ["key", "part"]).withColumn("prev", F.lag("id").over(Window.partitionBy("key", "part").orderBy("id")))


PAIR = ("id", "n_shingles", "registers", "text")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sizes allow, whose likeliest similarity is at least MAYBE, and whose full sets reach the threshold."""
    side = lambda x: texts.select(*[F.col(c).alias(x if c == "id" else f"{x}_{c}") for c in PAIR])
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(100 * F.least("a_n_shingles", "b_n_shingles") >= THRESHOLD * F.greatest("a_n_shingles", "b_n_shingles"))

    def run(batches):
        sets, sketch, known = shared(Shingler), shared(SetSketch, BANDS * ROWS), {}

        def shingles(k, text):
            if k not in known:
                if len(known) > 64:
                    known.clear()
                known[k] = sets.sets([text])[0]
            return known[k]

        for whole in batches:
            keep = []
            for at in range(0, len(whole), 2048):
                part = whole.slice(at, 2048)
                x, y = (np.frombuffer(b"".join(part.column(f"{k}_registers").to_pylist()), dtype=np.uint16).reshape(-1, sketch.m) for k in "ab")
                j = sketch.jaccard(x, y, *(part.column(f"{k}_n_shingles").to_numpy().astype(float) for k in "ab"))
                part = part.filter(pa.array(j >= MAYBE))
                for a, b, t, u in zip(*(part.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text")), strict=True):
                    s, r = shingles(a, t), shingles(b, u)
                    common = len(np.intersect1d(s, r, assume_unique=True))
                    if 100 * common >= THRESHOLD * (len(s) + len(r) - common):
                        keep.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in keep], pa.int64()), pa.array([b for _, b in keep], pa.int64())], names=["a", "b"])

    columns = ["a", "b", *[f"{k}_{c}" for k in "ab" for c in PAIR[1:]]]
    return both.select(*columns).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of the links (a, b): the least id that it reaches.

    Alternating stars over links from a larger to a smaller id. The large star
    moves a link's small end to that end's own least neighbour; the small star
    gathers a node's small ends under the least. An id that very many link to
    stands on the side of a join that AQE splits, and its own links are few. Each
    round is a written table; it ends when count and hash sum stay the same.
    """
    before, rounds = None, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    state = None
    while True:
        seen = Observation()
        mark = rounds.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        after = written(mark, "links")
        now = (seen.get["n"], seen.get["h"])
        if state is not None:
            drop_written(state)
        state = after
        if now == before or not now[0]:
            break
        before = now
        least = state.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
        large = state.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a"))).select("a", "b", "m")
        moved = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        rounds = moved.select("l.a", "l.b").where("a <> b").distinct()
    ends = state.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


PLACE = ("key", "kind", "i", "j")


def left_over(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, placed in pairs of blocks, with their registers.

    A bucket's largest component is held against all others (kind 1), and these
    against one another (kind 0); side says which of the two blocks a member is of.
    Buckets of up to three were paired fully before.
    """
    named = members.where("n > 3").select("key", "part", "parts", "band", "id").join(labels, "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id")).join(classes.select("id", "n_shingles", "registers"), "id")
    sizes = named.groupBy("key", "parts", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    sizes = sizes.groupBy("key", "parts").agg(F.max(F.struct("m", "component", "s")).alias("top"), F.sum("m").alias("n"), F.sum("s").alias("all_s")).where("n > top.m")
    sizes = sizes.select("key", "parts", F.col("top.component").alias("most"), F.col("top.m").alias("main"), "n", F.col("top.s").alias("main_s"), (F.col("all_s") - F.col("top.s")).alias("rest_s"))
    named = named.drop("parts").join(dealt(sizes), ["key", "part"])
    of_main = F.col("component") == F.col("most")
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, F.col(s) / BLOCK_SHINGLES)).cast("int")
    named = named.withColumns({"of_rest": blocks(F.col("n") - F.col("main"), "rest_s"), "of_main": blocks(F.col("main"), "main_s"), "spot": F.xxhash64("id", F.lit(1))})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod("spot", F.col(n)).cast("int")
    at = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    main = F.transform(every("of_rest"), lambda k: at(1, k, own("of_main"), F.lit(1)))
    among = F.transform(every("of_rest"), lambda k: at(0, F.least(own("of_rest"), k), F.greatest(own("of_rest"), k), own("of_rest") > k))
    against = F.transform(every("of_main"), lambda k: at(1, own("of_rest"), k, F.lit(0)))
    placed = named.select("key", "band", "id", "component", "n_shingles", "registers", F.explode(F.when(of_main, main).otherwise(F.concat(among, against))).alias("at"))
    placed = placed.select("key", "at.kind", "at.i", "at.j", "at.side", "band", "id", "component", "n_shingles", "registers")
    # Else the pairs of blocks of a bucket would stay together, as the joins by key left them. Their cost is
    # comparisons, not bytes: with a number given, they are not put together by their bytes.
    return placed.repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PLACE)


def possible(part: pd.DataFrame) -> list[tuple[float, int, int]]:
    """(share of equal registers, x, y): rows of a pair of blocks that may be linked, of different components, in the first band that they share."""
    r = np.frombuffer(b"".join(part["registers"]), dtype=np.uint16).reshape(-1, BANDS * ROWS)
    n, c, side = (part[k].to_numpy() for k in ("n_shingles", "component", "side"))
    kind, i, j, band = (int(part[k].iloc[0]) for k in ("kind", "i", "j", "band"))
    found, other = [], np.flatnonzero(side == 1)
    for x in np.flatnonzero(side == 0):
        y = other if kind == 1 or i != j else np.arange(x + 1, len(part))
        y = y[(c[y] != c[x]) & (100 * np.minimum(n[y], n[x]) >= THRESHOLD * np.maximum(n[y], n[x]))]
        equal = r[y] == r[x]
        share = equal.mean(axis=1)
        near = np.flatnonzero(share >= MAYBE)
        first = equal[near].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
        found += [(float(share[k]), int(x), int(y[k])) for k in near[first == band]]
    return found


def forest(part: pd.DataFrame, found: list[tuple[float, int, int]], linked=None) -> list[tuple[int, int]]:
    """Of the possible links, best first, the ids of those that unite components (and are linked)."""
    c, ids, top = part["component"].tolist(), part["id"].tolist(), {}

    def root(v):
        while top.get(v, v) != v:
            top[v] = v = top.get(top[v], top[v])
        return v

    kept = []
    for _, x, y in sorted(found, key=lambda e: (-e[0], ids[e[1]], ids[e[2]])):
        u, v = root(c[x]), root(c[y])
        if u != v and (linked is None or linked(x, y)):
            top[max(u, v)] = min(u, v)
            kept.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
    return kept


def pairs_of(kept: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": [a for a, _ in kept], "b": [b for _, b in kept]}, dtype="int64")


def likely(placed: DataFrame) -> DataFrame:
    """(a, b): the best possible links between components, a forest in each pair of blocks."""
    return placed.groupBy(*PLACE).applyInPandas(lambda part: pairs_of(forest(part, possible(part))), "a long, b long").distinct()


def confirmed(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links by full sets, a forest in each pair of blocks. Texts go only where a member has a possible link."""

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        rows = sorted({k for _, x, y in possible(part) for k in (x, y)})
        return part.iloc[rows][[*PLACE, "side", "band", "id", "component"]]

    def check(part: pd.DataFrame) -> pd.DataFrame:
        sets = shared(Shingler).sets(part["text"].tolist())

        def linked(x, y):
            both = len(sets[x]) + len(sets[y])
            common = both - len(np.unique(np.concatenate((sets[x], sets[y]))))
            return 100 * common >= THRESHOLD * (both - common)

        return pairs_of(forest(part, possible(part), linked))

    involved = placed.groupBy(*PLACE).applyInPandas(meet, "key long, kind int, i int, j int, side int, band int, id long, component long")
    return involved.join(texts, "id").groupBy(*PLACE).applyInPandas(check, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Two documents are linked if 100 * intersection >= 75 * union of their sets of
    distinct five-word shingles (A-Z in lower case; of fewer words, the whole
    sequence is one). A text without words, or null, has an empty set and is
    linked with nothing: its component is itself. component_id is the least
    doc_id that is reached; kept says that the row is that document. Repeated
    rows are linked by their equal texts; all rows of the least doc_id are kept.
    A null doc_id takes the component of its equal texts, or null, and is not
    kept. Other columns are ignored. An empty table gives no rows.
    """
    base = written(sketched(docs, id_col, text_col), "sketches")
    classes = written(
        base.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "classes",
    )
    members = written(buckets(classes), "buckets")
    star = members.select(F.col("id").alias("a"), F.explode(F.array("lo", "prev")).alias("b")).where("b is not null and a <> b").distinct()
    # Only documents of some bucket are ever compared; their texts are moved once.
    wanted = classes.select("id", "n_shingles", "registers").join(members.select("id").distinct(), "id", "left_semi")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id")
    texts = written(texts.select(*PAIR), "texts")
    labels = components(linked(star, texts))
    more = lambda found: components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found))
    fresh = written(linked(written(likely(left_over(members, labels, classes)), "pairs"), texts), "confirmed")
    if not fresh.isEmpty():
        labels = more(fresh)
    fresh = written(confirmed(left_over(members, labels, classes), texts), "confirmed")
    if not fresh.isEmpty():
        labels = more(fresh)
    named = classes.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    rows = base.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_near_dedup": op5_near_dedup}

ORACLE_SQL = {
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END) + 1),
        lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle FROM w),
n AS (SELECT w.doc_id, count(s.shingle)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS least FROM n UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.id)
SELECT n.doc_id, n.n AS n_shingles, min(r.least) AS component_id, n.doc_id = min(r.least) AS kept
FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
"""
}
