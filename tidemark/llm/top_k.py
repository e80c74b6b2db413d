r"""Exact top-k search by inner product, with bounds from segment statistics.

A vector is cut into 1, 4 and 16 segments of equal length (padded with zeros
to a multiple of 16); each has a mean and a deviation. By the inequality of Cauchy and Schwarz, two
vectors' squared distance is at least the sum over segments of their length
times the squared differences of means and of deviations, and each level's bound
is at least the one before. The inner product is half of what the squared norms
leave over the squared distance, so a lower bound of the distance is an upper
bound of the score. Coarse to fine, candidates whose bound is below what a query
has already are left out; survivors' scores are computed whole.

Queries and candidates meet in a grid of cells: a candidate goes to one column of
cells, a query to one row, both by a hash, so a cell's part is the same whatever
a vector is like. A cell holds a part of the candidates in blocks, the longest
vectors first, and streams queries through. The longest vectors of all, a stated
number, are broadcast and give every query a score to start from; so a cell tells
of a query only what may be among its best, and k at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, written

K = 20
EVERY = 20
SCALE = 64
LEVELS = (1, 4, 16)
#: Broadcast vectors, at most this many and this many bytes.
SEEDS, SEED_BYTES = 1_024, 16 << 20
#: Pairs of a query and a candidate that a cell has at most, and at least where there are many cells.
MOST_PAIRS, LEAST_PAIRS = 1 << 34, 1 << 18
#: Vectors in a block of candidates and of queries.
CANDIDATES, QUERIES_AT_ONCE = 2_048, 128
#: Whole numbers up to here are exact in double precision.
EXACT = 1 << 53


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """A written row per usable vector: __row, vec_id, size, norm2, v (its components times scale, rounded down).

    Vectors that are null, or hold a null, NaN or infinite component, and rows
    without an id, are left out. Components beyond whole numbers of 64 bits stand
    at that bound.
    """
    v = F.col(vector_col)
    usable = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    norm2 = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    out = rows.where(usable).select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("vec_id"), whole.alias("v"))
    return written(out.select("__row", "vec_id", F.size("v").alias("size"), norm2(F.col("v")).alias("norm2"), "v"), "vectors")


def statistics(v: np.ndarray, level: int) -> np.ndarray:
    """Means and deviations of each row's segments, both times the root of a segment's length: a row's product with another's is the bound."""
    whole = LEVELS[-1] * max(1, math.ceil(v.shape[1] / LEVELS[-1]))
    n, parts = whole // level, np.zeros((len(v), whole))
    parts[:, : v.shape[1]] = v
    parts = parts.reshape(len(v), level, n)
    return np.concatenate((parts.mean(axis=2), parts.std(axis=2)), axis=1) * math.sqrt(n)


class Block:
    """Candidates of one length with their statistics at each level."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray):
        self.rows, self.ids, self.v = rows, ids, v
        self.real = v.astype(float)
        self.longest = float(np.sqrt((self.real**2).sum(axis=1)).max(initial=0))
        self.levels = [statistics(self.real, n) for n in LEVELS]
        self.top = largest(v)


def largest(v: np.ndarray) -> int:
    return max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))


def scores(a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
    """Exact inner products of rows of whole numbers of size at most top; those beyond 64 bits stand at that bound."""
    if top * top * max(1, a.shape[1]) < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if top * top * max(1, a.shape[1]) < 1 << 63:
        return a @ b.T
    product = a.astype(object) @ b.astype(object).T
    return np.clip(product, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best of each of some queries: rows ordered by score, then id, then row."""

    def __init__(self, n: int, k: int, start: np.ndarray):
        self.k, self.start = k, start
        self.found = [np.empty((0, 3), np.int64)] * n

    def least(self) -> np.ndarray:
        """The score below which nothing can be among each query's best any more."""
        own = [int(f[-1, 0]) if len(f) == self.k else -(1 << 63) for f in self.found]
        return np.maximum(self.start, np.array(own, np.int64))

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(score):
            every = np.concatenate((self.found[q], np.stack((score, ids, rows), axis=1)))
            self.found[q] = every[np.lexsort((every[:, 2], every[:, 1], ~every[:, 0]))[: self.k]]


def searched(blocks: list[Block], rows: np.ndarray, v: np.ndarray, k: int, start: np.ndarray) -> Best:
    """The best candidates of some queries of one length, start: a score below which none is asked for."""
    best, real, top = Best(len(rows), k, start), v.astype(float), largest(v)
    levels, own = [statistics(real, n) for n in LEVELS], np.sqrt((real**2).sum(axis=1))
    for block in blocks:
        least = best.least()
        # Rounding of the bounds is far below this.
        needed = least.astype(float) - 1e-9 * own * block.longest - 1e-6
        at_q, at_c = np.arange(len(rows)), np.arange(len(block.rows))
        for mine, theirs in zip(levels, block.levels, strict=True):
            above = mine[at_q] @ theirs[at_c].T >= needed[at_q, None]
            some_q, some_c = above.any(axis=1), above.any(axis=0)
            keep, at_q, at_c = above[some_q][:, some_c], at_q[some_q], at_c[some_c]
            if not len(at_q):
                break
        if not len(at_q):
            continue
        exact = scores(v[at_q], block.v[at_c], max(top, block.top))
        wanted = keep & (exact >= least[at_q, None]) & (rows[at_q, None] != block.rows[None, at_c])
        for i in np.flatnonzero(wanted.any(axis=1)):
            j = np.flatnonzero(wanted[i])
            if len(j) > 4 * k:  # ties at the k-th score stay
                j = j[exact[i, j] >= np.partition(exact[i, j], len(j) - k)[len(j) - k]]
            best.add(at_q[i], exact[i, j], block.ids[at_c[j]], block.rows[at_c[j]])
    return best


def blocks_of(rows: list, ids: list, v: list, norm2: list, size: int = CANDIDATES) -> list[Block]:
    """Blocks of candidates of one length, the longest vectors first."""
    order = np.argsort(-np.array(norm2), kind="stable")
    row, own, numbers = np.array(rows, np.int64)[order], np.array(ids, np.int64)[order], np.stack(v)[order]
    return [Block(row[at : at + size], own[at : at + size], numbers[at : at + size]) for at in range(0, len(row), size)]


def listed(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of arrays without nulls."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def grid(n_queries: int, n: int, partitions: int) -> tuple[int, int]:
    """(parts of the candidates, parts of the queries): as many cells as bound each one's pairs; the sides share them so that few rows are moved."""
    pairs = n_queries * n
    cells = max(1, math.ceil(pairs / MOST_PAIRS), min(4 * partitions, math.ceil(pairs / LEAST_PAIRS)))
    columns = max(1, min(cells, round(math.sqrt(cells * n / max(1, n_queries)))))
    return columns, max(1, math.ceil(cells / columns))


def top_k(rows: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each row where is_query holds (a condition on the id), its k best others, all if there are fewer.

    Ties go to the smaller id. Only vectors of the same length are compared;
    empty ones score 0 among themselves. Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part. Repeated rows
    are candidates of their own, and each repeated query row has its own result;
    among equal scores and ids the order is of no consequence. Scores beyond 64 bits stand
    at that bound. Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    every = vectors(rows, id_col, vector_col, scale)
    asked = is_query(F.col("vec_id"))
    n, n_queries = every.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    columns, lines = grid(n_queries, n, int(spark.conf.get("spark.sql.shuffle.partitions")))

    longest = every.select("__row", "vec_id", "size", "norm2", "v").orderBy(F.desc("norm2"), "__row").limit(SEEDS).where(F.col("size") <= SEED_BYTES // (8 * SEEDS)).collect()
    seeds: dict = {}
    for r in longest:
        for x, value in zip(seeds.setdefault(r["size"], ([], [], [], [])), (r["__row"], r["vec_id"], np.array(r["v"], np.int64), r["norm2"]), strict=True):
            x.append(value)
    known = spark.sparkContext.broadcast(seeds)
    none = -(1 << 63)

    def start(batches):
        """Each query with the k-th best score among the longest vectors."""
        held = {size: blocks_of(*own) for size, own in known.value.items() if len(own[0]) > k}
        for batch in slices(batches, QUERIES_AT_ONCE):
            row, size, v = batch.column(0).to_numpy(), batch.column(2).to_numpy(), listed(batch.column(4))
            least = np.full(len(row), none)
            for length in held:
                at = np.flatnonzero(size == length)
                if len(at):
                    least[at] = searched(held[length], row[at], np.stack([v[i] for i in at]), k, least[at]).least()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["__row", "vec_id", "size", "norm2", "v", "least"])

    kind = "__row long, vec_id long, size int, norm2 double, v array<long>"
    cast = every.withColumn("vec_id", F.col("vec_id").cast("long")).select("__row", "vec_id", "size", "norm2", "v")
    spread = lambda parts, seed: F.pmod(F.xxhash64("__row", F.lit(seed)), F.lit(parts)).cast("int")
    candidates = cast.withColumns({"least": F.lit(None).cast("long"), "column": spread(columns, 1), "line": F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))})
    queries = cast.where(asked).mapInArrow(start, f"{kind}, least long").withColumns({"line": spread(lines, 2), "column": F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))})
    both = candidates.withColumn("asks", F.lit(0)).unionByName(queries.withColumn("asks", F.lit(1)))
    both = both.withColumn("cell", F.col("line") * columns + F.col("column")).drop("line", "column")
    fields = "query long, query_id long, vec_id long, row long, score long"

    def meet(batches):
        """Cells one after another, a length after another in each, candidates before queries."""
        now, held, waiting, blocks = None, [], [], None

        def answered(waiting):
            rows, ids, v, least = zip(*waiting, strict=True)
            found = searched(blocks, np.array(rows, np.int64), np.stack(v), k, np.array(least, np.int64)).found
            sizes, every = [len(f) for f in found], np.concatenate(found)
            columns = np.repeat(rows, sizes), np.repeat(ids, sizes), every[:, 1].copy(), every[:, 2].copy(), every[:, 0].copy()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in fields.split(", ")])

        for batch in slices(batches):
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            for cell, size, asks, row, own, norm2, v, least in zip(*(column(c).to_pylist() for c in ("cell", "size", "asks", "__row", "vec_id", "norm2")), listed(column("v")), column("least").to_pylist(), strict=True):
                if (cell, size) != now:
                    if waiting:
                        yield answered(waiting)
                    now, held, waiting, blocks = (cell, size), [], [], None
                if not asks:
                    held.append((row, own, v, norm2))
                elif held:
                    if blocks is None:
                        blocks = blocks_of(*zip(*held, strict=True))
                    waiting.append((row, own, v, least))
                    if len(waiting) == QUERIES_AT_ONCE:
                        yield answered(waiting)
                        waiting = []
        if waiting:
            yield answered(waiting)

    dealt = both.repartition("cell").sortWithinPartitions("cell", "size", "asks", "norm2")
    found = dealt.mapInArrow(meet, fields)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % EVERY == 0)


QUERIES = {"op13_top_k": op13_top_k}

ORACLE_SQL = {
    "op13_top_k": f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
}
