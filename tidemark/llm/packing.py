"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are tokenized once; full-length pieces and tails form a histogram of
length classes (at most ``max_len / grid`` of them, whatever the corpus), the
only thing that reaches the driver. A linear program over packing patterns is
solved there: a knapsack by dynamic programming prices new patterns. Rounded
patterns become a small broadcast table that says, for each class, which ranks
go to which sequences; pieces are ranked within their class by two-level
counting, so no class is ever gathered in one task.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, written
from tidemark.llm.tokens import ChunkIds, shared, word_ids

TOKENIZER = "word_bpe_49k.json"
MAX_LEN = 2048
#: Lengths are counted in classes of so many tokens, rounded up.
GRID = 16
#: Each class is ranked in so many parts.
SALTS = 256
END_ID = 1


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, max_len: int, end_id: int) -> DataFrame:
    """Token pieces of at most max_len ids: full ones and one tail for each document."""
    end = struct.pack("<I", end_id)
    size = 4 * max_len

    def run(batches):
        ids = shared(ChunkIds, tokenizer, False, True)
        for batch in slices(batches):
            keys, at, start, data, total = batch.column(0), [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = word_ids(text or "", ids) + end
                for k in range(0, len(got), size):
                    at.append(i)
                    start.append(k // 4)
                    data.append(got[k : k + size])
                    total.append(len(got) // 4)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array(data, pa.binary()), pa.array(total, pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    return cut.withColumn("ids_crc32", F.crc32("ids"))


def best_pattern(value: np.ndarray, width: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of highest value within room."""
    f, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(width, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        f[c] = f[c - 1]
        if k := fits[c]:
            got = f[c - width[:k]] + value[:k]
            if got[j := int(got.argmax())] > f[c] + 1e-12:
                f[c], pick[c] = got[j], j
    made, c = np.zeros(len(width), dtype=np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            made[pick[c]] += 1
            c -= width[pick[c]]
    return f[room], made


def plan_patterns(counts: dict[int, int], room: int, gap: float = 0.001, rounds: int = 3000) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: pieces}, sequences) that hold exactly counts.

    Column generation: the dual prices of the linear program price patterns in
    a knapsack; generation ends when no pattern improves the bound by more
    than gap, or after so many rounds (then the plan is only less tight).
    What rounding down leaves over is packed first-fit in falling order.
    """
    width = np.array(sorted(k for k, n in counts.items() if n), dtype=np.int64)
    if not len(width):
        return []
    need = np.array([counts[int(k)] for k in width], dtype=np.float64)
    n = len(width)
    columns = [np.eye(n, dtype=np.int64)[i] * (room // w) for i, w in enumerate(width)]
    inverse = np.diag(1.0 / np.array([room // w for w in width], dtype=np.float64))
    x = inverse @ need
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        worth, column = best_pattern(price, width, room)
        if worth <= 1 + gap:
            break
        way = inverse @ column
        up = way > 1e-9
        if not up.any():
            break
        steps = np.where(up, x / np.where(up, way, 1), np.inf)
        out = int(steps.argmin())
        step = max(steps[out], 0.0)
        x -= step * way
        x[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[out] = column
        np.maximum(x, 0, out=x)
    plan, left = [], need.astype(np.int64)
    for column, times in zip(columns, np.floor(x + 1e-6).astype(np.int64), strict=True):
        used = column > 0
        times = int(min(times, (left[used] // column[used]).min())) if used.any() else 0
        if times > 0:
            left -= times * column
            plan.append(({int(w): int(k) for w, k in zip(width[used], column[used], strict=True)}, times))
    return plan + first_fit(dict(zip(width.tolist(), left.tolist(), strict=True)), room)


def first_fit(left: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """First-fit in falling order, one pattern for each sequence; rooms are kept by what is free in them."""
    free: dict[int, list[int]] = {}
    bins: list[dict[int, int]] = []
    for w in sorted(left, reverse=True):
        for _ in range(left[w]):
            fit = min((r for r, b in free.items() if r >= w and b), default=None)
            if fit is None:
                bins.append({})
                at, fit = len(bins) - 1, room
            else:
                at = free[fit].pop()
            bins[at][w] = bins[at].get(w, 0) + 1
            free.setdefault(fit - w, []).append(at)
    return [(b, 1) for b in bins]


def placements(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each class and pattern: class, first rank, end rank, pieces a sequence, first sequence."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        for w, per in pattern.items():
            lo = taken.get(w, 0)
            taken[w] = lo + per * times
            rows.append((w, lo, taken[w], per, sequence))
        sequence += times
    return rows


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    max_len: int = MAX_LEN,
    grid: int = GRID,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids (little-endian
    unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and gives the end id alone. Repeated rows are separate
    documents with equal ids. Other columns are ignored. An empty table gives
    no rows. A document of any length is cut into pieces of at most max_len.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, tokenizer, max_len, end_id), "pieces")
    cut = cut.withColumn("__class", F.ceil(F.col("length") / grid).cast("int")).withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    parts = cut.groupBy("__class", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    parts = written(parts, "piece_counts")
    histogram = {r["__class"]: r["n"] for r in parts.groupBy("__class").agg(F.sum("__n").alias("n")).collect()}
    rows = placements(plan_patterns(histogram, max_len // grid))
    # At most (max_len / grid) * SALTS rows, and a few thousand rows of patterns: both small at any input size.
    first = parts.select("__class", "__salt", (F.sum("__n").over(Window.partitionBy("__class").orderBy("__salt")) - F.col("__n")).alias("__first"))
    places = spark.createDataFrame(rows, "__class int, __lo long, __hi long, __per long, __seq long")
    order = Window.partitionBy("__class", "__salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        cut.withColumn("__rank", F.row_number().over(order) - 1)
        .join(F.broadcast(first), ["__class", "__salt"])
        .withColumn("__rank", F.col("__rank") + F.col("__first"))
        .join(F.broadcast(places), "__class")
        .where("__rank >= __lo and __rank < __hi")
        .withColumn("sequence_id", F.col("__seq") + F.floor((F.col("__rank") - F.col("__lo")) / F.col("__per")))
    )
    within = Window.partitionBy("sequence_id").orderBy(F.desc("__class"), "__rank")
    return ranked.withColumn("offset", F.sum("length").over(within) - F.col("length")).select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")


QUERIES = {"op3_packing": op3_packing}
