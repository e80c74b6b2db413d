"""Document fingerprints by Order MinHash.

The k-mers of a text are numbered by occurrence, so a repeated one is several
elements. A hash deals the elements into ``SLOTS`` slots (one-permutation
hashing in place of as many permutations); in each slot the ``TUPLE`` elements
of least hash are selected, put back into text order, and hashed as a tuple.
Two texts agree in a slot only if they share these elements and their order, so
agreement falls with edit distance, not only with the k-mers that differ.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, written
from tidemark.llm.shingles import mixed

K = 8
SLOT_BITS = 6
SLOTS = 1 << SLOT_BITS
TUPLE = 2
#: An entry is four hexadecimal digits; 0000 is a slot without elements.
DIGITS = 4

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def kmer_hashes(cp: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k code points; of the whole where there are fewer."""
    k = min(k, len(cp))
    h, done, power = cp + np.uint64(1), 1, _BASE
    while 2 * done <= k:
        h = h[: len(h) - done] * power + h[done:]
        done, power = 2 * done, power * power
    while done < k:
        h = h[:-1] * _BASE + cp[done : done + len(h) - 1] + np.uint64(1)
        done += 1
    return mixed(h + np.uint64(k))


def elements(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, number of its occurrence), by place in the text."""
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    group, place = packed >> bits, packed & low
    again = np.concatenate(([False], group[1:] == group[:-1]))
    if not again.any():
        return h
    at = np.arange(len(h))
    occurrence = at - np.maximum.accumulate(np.where(again, 0, at))
    out, later = h.copy(), place[again].astype(np.int64)
    out[later] = mixed(h[later] + occurrence[again].astype(np.uint64) * _STEP)
    return out


def fingerprint(text: str, k: int = K) -> str:
    """SLOTS entries of a text. Equal texts have equal ones; the empty text's are all 0000."""
    if not text:
        return "0" * (DIGITS * SLOTS)
    with np.errstate(over="ignore"):
        e = elements(kmer_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), k))
        bits = np.uint64(max(1, int(len(e)).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        order = np.sort((e & ~low) | np.arange(len(e), dtype=np.uint64))
        edge = np.searchsorted(order, np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))
        end = np.append(edge[1:], len(order))
        pick = edge[:, None] + np.arange(TUPLE)
        there = pick < end[:, None]
        place = np.where(there, order[np.minimum(pick, len(order) - 1)] & low, np.uint64(1 << 62)).astype(np.int64)
        place.sort(axis=1)
        got = np.where(place < len(e), e[np.minimum(place, len(e) - 1)], np.uint64(0))
        h = np.zeros(SLOTS, dtype=np.uint64)
        for j in range(TUPLE):
            h = mixed(h * _STEP + got[:, j] + np.uint64(j + 1))
    entry = np.where(there[:, 0], h % np.uint64(0xFFFF) + np.uint64(1), np.uint64(0)).astype(">u2")
    return entry.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of slots that agree, among those that either text fills; two empty texts are alike."""
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=">u2") for s in (a, b))
    filled = (x > 0) | (y > 0)
    return float((x == y)[filled].mean()) if filled.any() else 1.0


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: What a range hands over: its first row's text (end 0), and its last row (end 1), whose next stands in another range.
EDGE = ", end int, part int, text string, mark string"


def batch_of(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def compared(key, own: str, own_mark: str, text: str, mark: str, k: int) -> tuple:
    """The row of a document whose next one has this text and fingerprint."""
    new = edited(own, text)
    new_mark = own_mark if new == own else fingerprint(new, k)
    return key, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own_mark, new_mark, likeness(own_mark, new_mark), likeness(own_mark, mark)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each row's fingerprint, its edited text's, and their likeness, and that to the next document's.

    The next document is the one of the next id (rows with one id stand in order
    of a hash of their texts; null ids come first), after the last the first; a
    single document follows itself. A null text is empty. Repeated rows each give
    a row. A text of any length is fingerprinted whole, one at a time. Other
    columns are ignored. An empty table gives no rows.

    Rows are dealt into ranges of (id, hash), so that many rows of one id, or
    without one, are dealt too. A range compares its own neighbours and hands its
    first and last row over: two rows a range, joined by range number.
    """
    spark = docs.sparkSession
    fields = FIELDS + EDGE
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ranges = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.asc_nulls_first("id"), "hash").sortWithinPartitions(F.asc_nulls_first("id"), "hash")

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for batch in slices(batches):
            out = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                mark = fingerprint(text, k)
                if last is None:
                    out.append((*[None] * 7, 0, part, text, mark))
                else:
                    out.append((*compared(*last, text, mark, k), None, None, None, None))
                last = key, text, mark
            yield batch_of(out, fields)
        if last is not None:
            yield batch_of([(last[0], *[None] * 6, 1, part, *last[1:])], fields)

    done = written(ranges.mapInArrow(run, fields), "fingerprints")
    first, final = done.where("end = 0"), done.where("end = 1")
    # One row a range: its number and the number of the next range that has rows.
    order = Window.orderBy("part")
    follows = first.select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())))
    edges = final.join(follows, "part").join(first.select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("mark").alias("next_mark")), "next")

    def join(batches):
        for batch in slices(batches, 16):
            yield batch_of([compared(*x, k) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)], FIELDS)

    ends = edges.select("doc_id", "text", "mark", "next_text", "next_mark").mapInArrow(join, FIELDS)
    return done.where("end is null").select(*[f.split()[0] for f in FIELDS.split(", ")]).unionByName(ends)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_fingerprints": op6_fingerprints}
