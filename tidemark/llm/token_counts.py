"""Token counts: a map-side two-tier look-up, without a shuffle of pre-tokens.

Tier one is a broadcast hash table from frequent chunks of text (a pre-token or
a few that always stand together) to their token counts; tier two is a cache
per worker, filled by the tokenizer itself. Both only save time: every count is
the library's. The table comes from all documents, by bounded counts in each task.
"""

from __future__ import annotations

import heapq
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, written
from tidemark.llm.tokens import CACHE_CHUNK_BYTES, ByteCounts, byte_chunks, shared

TOKENIZER = "byte_bpe_50k.json"
#: Entries of the broadcast table: at most 65,536 chunks of at most 96 characters, under 10 MB.
FREQUENT = 65_536
#: Entries that a task keeps while it counts, and those that all tasks together send, by entries of the table.
KEPT, SENT = 4, 4


def chunk_counts(docs: DataFrame, text_col: str, tokenizer: str, entries: int) -> DataFrame:
    """(chunk, n) from bounded counts of all documents.

    Each task counts its own documents in a table of bounded size (when it is
    full, the count of the entry at half its size is taken off all, and entries
    at nothing go) and hands its first ones on: so many that all tasks together
    hand on SENT * entries, or 16 each. Executors sum these small tables up, all
    in one job; no chunk of a text is shuffled.
    """
    most = KEPT * entries
    send = max(16, SENT * entries // max(1, docs.rdd.getNumPartitions()))

    def chunks(batches):
        specials, seen = shared(ByteCounts, tokenizer).specials, Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(byte_chunks(text, specials))
            if len(seen) > most:
                off = sorted(seen.values())[len(seen) // 2]
                seen = Counter({c: n - off for c, n in seen.items() if n > off and len(c) <= CACHE_CHUNK_BYTES})
        top = heapq.nlargest(send, ((n, c) for c, n in seen.items() if len(c) <= CACHE_CHUNK_BYTES))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([c for _, c in top], pa.string()), "n": pa.array([n for n, _ in top], pa.int64())})

    return docs.select(F.col(text_col).alias("text")).mapInArrow(chunks, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def frequent_lengths(docs: DataFrame, text_col: str, tokenizer: str, entries: int) -> dict[str, int]:
    """The most frequent chunks of all documents, with their token counts.

    Counts fall into classes an eighth of a power of two wide; the highest classes
    that hold ``entries`` chunks together, or fewer, are the table: the driver
    gets a row for each class (a few hundred) and ``entries`` rows.
    """
    counts = written(chunk_counts(docs, text_col, tokenizer, entries), "chunk_counts")
    height = F.floor(8 * F.log2("n"))
    least, held = None, 0
    for r in counts.groupBy(height.alias("height")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("height")).collect():
        held += r.rows
        if held > entries:
            break
        least = r.height
    top = [] if least is None else counts.where(height >= least).select("chunk").toArrow().column(0).to_pylist()
    return dict(zip(top, shared(ByteCounts, tokenizer).count(top, {}), strict=True))


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    limit: int = 1024,
    frequent: int = FREQUENT,
) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give a
    row; a null id stays null; other columns are ignored; an empty table gives
    no rows. Texts are never cut: one of any length is counted chunk by chunk.
    Ties of chunks' frequencies change no count.
    """
    table_ = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text_col, tokenizer, frequent))

    def run(batches):
        counts, known = shared(ByteCounts, tokenizer), table_.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counts.count(texts, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_token_counts": op4_token_counts}
