"""Shared pieces: written intermediate tables, table reads, word patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.store import drop_written, scratch_path, written

__all__ = ["WORD", "drop_written", "scratch_path", "slices", "table", "written"]

#: What the contracts call a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 1_024):
    """Arrow batches in parts: a worker holds the texts and results of so many rows at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
