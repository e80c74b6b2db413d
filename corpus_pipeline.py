"""A training corpus from the documents table: five stages, each an operator of tidemark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. The pipeline is not expressible in SQL (its
first and last stages are not), so ORACLE_SQL is None and tests hold it against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, table, written
from tidemark.llm.language_id import UNKNOWN, identified
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.secret_scan import redact

#: A text of at least so many characters that is like no language at all is rejected.
LONG_TEXT = 200
LEAST_SCORE = 0.1
#: Copies of documents that a stage reads until its result is written; the next stage drops them.
PASSING: list[DataFrame] = []


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and long texts that are like no known language.

    Where none was learnt, texts with a letter stay. A column named like one of
    the operator's own (lang_pred, score) stays as it is.
    """
    own = {c: f"__own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = identified(docs.withColumnsRenamed(own))
    unlike = (F.length("text") >= LONG_TEXT) & (F.col("score") < LEAST_SCORE)
    kept = F.when(F.col("lang_pred") == UNKNOWN, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).otherwise(~unlike)
    return found.where(kept).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the least doc_id (a null one comes last).

    Rows are told apart by a number of their own: two texts under one doc_id are
    two rows, and each stays unless it is like another. Texts without words stay.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    PASSING.append(rows)
    found = near_duplicates(rows.select("__row", "text"), "__row").select(F.col("doc_id").alias("__row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"]
    kept = found.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(least.alias("__row")).select("__row")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark. The stage before has been written by now, so what only it read goes."""
    while PASSING:
        drop_written(PASSING.pop())
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return pack(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("secret_scan", secrets), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
