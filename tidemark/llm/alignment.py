r"""Cross-tokenizer alignment by an event sweep.

Every token of a text is an event at the byte offset where it ends. The events
of tokenizers A and B are united, dealt by document, sorted by offset inside
partitions and streamed through a state machine that holds what stands behind
the last offset where both end. Between two such offsets lies a group; between
two neighbouring ends of either side lies a link, the one pair of tokens that
cover these bytes.

Events travel in blocks: the ids of at most ``BLOCK`` tokens of one side in
order, with the offset where they begin. An id tells its token's length, so a
block holds its events' offsets too. A text of any length is many blocks, and
the machine's state is a block a side, the open group and the distinct id pairs
of one text.

How often id pairs occur is counted in each task before it is summed up. The
pairs that most documents hold, ``FREQUENT`` at most, are broadcast; what a
document holds besides is joined with the counts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, written
from tidemark.llm.tokens import byte_letters, shared, tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Tokens of an event block.
BLOCK = 16_384
#: Entries of the broadcast table of pair counts: at most 2**20, 17 bytes each.
FREQUENT = 1 << 20
#: Distinct pairs that a task counts before it hands its counts on.
COUNTED = 1 << 22
SPACE = "▁"


class ByteSide:
    """Byte-level BPE by its ranks; special strings inside texts are plain text. Every byte is an id, so its tokens always give the text back."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        t, letters = tokenizer(name, True), byte_letters()
        specials = {a.content for a in t.get_added_tokens_decoder().values()}
        vocab = t.get_vocab(True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in specials else bytes(letters[c] for c in token)
        ranks = {self.bytes[i]: i for token, i in vocab.items() if token not in specials}
        # The rank of a merge is its token's id: the second library gives the same ids, several times as fast.
        self.library = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.library.encode_ordinary(t), "<u2") for t in texts]


class PieceSide:
    """BPE on pieces by their library, which adds the space before a text itself."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin with a space; none of one that they don't give back."""
        out = []
        for text, ids in zip(texts, self.library.encode([t[1:] for t in texts], num_threads=1), strict=True):
            same = b"".join([self.bytes[i] for i in ids]) == text.encode("utf-8", "replace")
            out.append(np.array(ids if same else [], "<u2"))
        return out


def side(name: str):
    return shared(PieceSide if name.endswith(".model") else ByteSide, name)


@lru_cache(maxsize=4)
def lengths(name: str) -> np.ndarray:
    """Bytes of each id's token."""
    return np.array([len(x) for x in side(name).bytes], np.int64)


def tokens(texts: list, a: str, b: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """A's and B's ids of texts, or none of both where one does not give its bytes back."""
    none = np.empty(0, "<u2")
    out, at = [(none, none)] * len(texts), [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in at]
    for i, x, y in zip(at, side(a).ids(spaced), side(b).ids(spaced), strict=True):
        if len(y):
            out[i] = x, y
    return out


EVENTS = "key long, doc_id {id}, at long, side byte, n long, ids binary"


def events(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B, block: int = BLOCK) -> DataFrame:
    """The end events of both sides in blocks: key (a row of docs), doc_id, at (offset where the block begins), side (0 is A), n, ids (compressed). A text without tokens has one empty block."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        sizes = lengths(a), lengths(b)
        for batch in slices(batches, 64):
            row, at, which, n, ids = [], [], [], [], []
            for i, both in enumerate(tokens(batch.column(2).to_pylist(), a, b)):
                for k, own in enumerate(both):
                    begin = 0
                    for lo in range(0, len(own), block):
                        part = own[lo : lo + block]
                        for column, value in zip((row, at, which, n, ids), (i, begin, k, len(part), pa.compress(part.tobytes(), "zstd", asbytes=True)), strict=True):
                            column.append(value)
                        begin += int(sizes[k][part].sum())
                if not len(both[0]):
                    for column, value in zip((row, at, which, n, ids), (i, 0, 0, 0, b""), strict=True):
                        column.append(value)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int64()), pa.array(which, pa.int8()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["key", "doc_id", "at", "side", "n", "ids"])

    return rows.mapInArrow(run, EVENTS.format(id=kind))


class Sweep:
    """The state machine of one text: takes blocks in order of offset and gives out what lies before the last common end."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes = sizes
        self.open = [np.empty(0, "<u2"), np.empty(0, "<u2")]

    def take(self, which: int, ids: np.ndarray):
        """(A ids, B ids, A ends, B ends) of the groups that this block closes, or None. Ends count from the last common end."""
        own = self.open
        own[which] = np.concatenate((own[which], ids)) if len(own[which]) else ids
        if not len(own[0]) or not len(own[1]):
            return None
        ends = [np.cumsum(self.sizes[k][own[k]]) for k in (0, 1)]
        last = [int(e[-1]) for e in ends]
        if last[0] == last[1]:
            n, m = len(own[0]), len(own[1])
        else:
            short, long = (0, 1) if last[0] < last[1] else (1, 0)
            at = np.searchsorted(ends[long], ends[short])
            common = np.flatnonzero(ends[long][at] == ends[short])
            if not len(common):
                return None
            i = int(common[-1])
            j = int(at[i])
            n, m = (i + 1, j + 1) if short == 0 else (j + 1, i + 1)
        out = own[0][:n], own[1][:m], ends[0][:n], ends[1][:m]
        self.open = [own[0][n:], own[1][m:]]
        return out


def linked(ids_a, ids_b, ends_a, ends_b):
    """For closed groups: the A and B place of every link, which A tokens end with a B token, and which B tokens end with an A token."""
    at = np.searchsorted(ends_b, ends_a)
    both_a = ends_b[at] == ends_a
    first = np.zeros(len(at), np.int64)
    first[1:] = at[:-1] + both_a[:-1]
    times = at - first + 1
    place_a = np.repeat(np.arange(len(at)), times)
    again = np.zeros(len(at), np.int64)  # A ends inside a B token so far: there the next link is of the same B token
    np.cumsum(~both_a[:-1], out=again[1:])
    place_b = np.arange(len(place_a)) - np.repeat(again, times)
    both_b = np.zeros(len(ids_b), bool)
    both_b[at[both_a]] = True
    return place_a, place_b, both_a, both_b


def group_of(both: np.ndarray) -> np.ndarray:
    """The number of each token's group."""
    out = np.zeros(len(both), np.int64)
    np.cumsum(both[:-1], out=out[1:])
    return out


@lru_cache(maxsize=1)
def digits() -> np.ndarray:
    """Decimal ids with each separator behind them, in rows of fixed width."""
    return np.array([f"{i}{s}".encode() for s in ",|;" for i in range(1 << 16)])


def group_text(ids_a, ids_b, both_a, both_b) -> bytes:
    """``a1,a2|b1;a3|b2,b3;`` for closed groups."""
    last_b, last_a = np.flatnonzero(both_b), np.flatnonzero(both_a)
    before_b = np.concatenate(([0], last_b + 1))[group_of(both_a)]
    before_a = (last_a + 1)[group_of(both_b)]
    which = np.empty(len(ids_a) + len(ids_b), np.int64)
    which[np.arange(len(ids_a)) + before_b] = ids_a + (both_a.astype(np.int64) << 16)
    which[np.arange(len(ids_b)) + before_a] = ids_b + (both_b.astype(np.int64) << 17)
    return digits()[which].tobytes().translate(None, b"\0")


def swept(blocks, a: str, b: str):
    """Streams sorted blocks through the machine: (doc_id, None) where a text ends, else (doc_id, closed groups)."""
    sizes = lengths(a), lengths(b)
    now, own, machine = None, None, None
    for batch in slices(blocks):
        for key, doc, which, n, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "side", "n", "ids")), strict=True):
            if key != now:
                if machine is not None:
                    yield own, None
                now, own, machine = key, doc, Sweep(sizes)
            if n and (closed := machine.take(which, np.frombuffer(pa.decompress(ids, 2 * n, "zstd", asbytes=True), "<u2"))):
                yield own, closed
    if machine is not None:
        yield own, None


def sorted_events(docs: DataFrame, id_col: str, text_col: str, a: str, b: str, block: int) -> DataFrame:
    return events(docs, id_col, text_col, a, b, block).repartition("key").sortWithinPartitions("key", "at", "side")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B, block: int = BLOCK) -> DataFrame:
    """A row per group: doc_id, start and end (bytes of space+text), a_ids and b_ids.

    Null and empty texts, and texts that a tokenizer does not give back byte by
    byte, have no groups. Repeated rows and rows that share an id each give
    their own; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    fields = f"doc_id {kind.simpleString()}, start long, end long, a_ids array<int>, b_ids array<int>"

    def run(batches):
        names, begin = [x.split()[0] for x in fields.split(", ")], 0
        for doc, closed in swept(batches, a, b):
            if closed is None:
                begin = 0
                continue
            ids_a, ids_b, ends_a, ends_b = closed
            _, _, both_a, both_b = linked(*closed)
            ends = begin + ends_a[both_a]
            starts = np.concatenate(([begin], ends[:-1]))
            begin = int(ends[-1])
            lists = []
            for ids, both in ((ids_a, both_a), (ids_b, both_b)):
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.flatnonzero(both) + 1)), pa.int32()), pa.array(ids.astype(np.int32))))
            own = pa.array([doc] * len(ends), DOC_KINDS.get(kind.simpleString(), pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), *lists], names=names)

    return sorted_events(docs, id_col, text_col, a, b, block).mapInArrow(run, fields)


DOC_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
ALIGNED = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, distinct long"


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, first bytes first, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(numbers) else b""


def _numbers(planes: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(planes, 4 * n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


def pairs_of(n: int, pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct pairs (A id times 2**16 plus B id), rising, and how often it links each."""
    return np.cumsum(_numbers(pairs, n).astype(np.int64)), _numbers(times, n).astype(np.int64)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B, block: int = BLOCK) -> DataFrame:
    """A row per text: numbers of tokens, groups and links, the digest of its groups, and its distinct id pairs."""
    fields = ALIGNED.format(id=docs.schema[id_col].dataType.simpleString())
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = [DOC_KINDS.get(docs.schema[id_col].dataType.simpleString(), pa.int64()), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.int64()]

    def run(batches):
        done: list[tuple] = []
        counts, digest, own = [0, 0, 0, 0], hashlib.sha256(), None
        for doc, closed in swept(batches, a, b):
            if closed is not None:
                ids_a, ids_b, ends_a, ends_b = closed
                place_a, place_b, both_a, both_b = linked(*closed)
                for i, n in enumerate((len(ids_a), len(ids_b), int(both_a.sum()), len(place_a))):
                    counts[i] += n
                if own is not None:
                    digest.update(b";")
                digest.update(group_text(ids_a, ids_b, both_a, both_b)[:-1])
                new = np.unique((ids_a[place_a].astype(np.int64) << 16) | ids_b[place_b], return_counts=True)
                own = new if own is None else _added(own, new)
                continue
            pairs, times = own if own is not None else (np.empty(0, np.int64), np.empty(0, np.int64))
            done.append((doc, *counts, digest.hexdigest() if own is not None else "", _planes(np.diff(pairs, prepend=0)), _planes(times), len(pairs)))
            counts, digest, own = [0, 0, 0, 0], hashlib.sha256(), None
            if len(done) == 1_024:
                yield rows_of(done)
                done = []
        yield rows_of(done)

    def rows_of(done):
        columns = zip(*done, strict=True) if done else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = sorted_events(docs, id_col, text_col, a, b, block).mapInArrow(run, fields)
    return rows.withColumn("key", F.monotonically_increasing_id())


def _added(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two counts by pair."""
    pairs, where = np.unique(np.concatenate((x[0], y[0])), return_inverse=True)
    return pairs, np.bincount(where, np.concatenate((x[1], y[1])).astype(float), len(pairs)).astype(np.int64)


def pair_counts(rows: DataFrame, counted: int = COUNTED) -> DataFrame:
    """(pair, n, best): the number of texts that hold a pair, and whether no pair of its A id has a higher one.

    Tasks count what they read and hand counts on when ``counted`` pairs are distinct, so no row per text and pair is moved.
    """

    def run(batches):
        whole, waiting, size = None, [], 0

        def gathered(whole):
            new = np.unique(np.concatenate(waiting), return_counts=True)
            return new if whole is None else _added(whole, new)

        for batch in slices(batches):
            for n, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n:
                    waiting.append(np.cumsum(_numbers(pairs, n).astype(np.int64)))
                    size += n
            if size >= counted:
                whole, waiting, size = gathered(whole), [], 0
                if len(whole[0]) >= counted:
                    yield pa.RecordBatch.from_arrays([pa.array(whole[0]), pa.array(whole[1])], names=["pair", "n"])
                    whole = None
        if waiting:
            whole = gathered(whole)
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array(whole[0]), pa.array(whole[1])], names=["pair", "n"])

    sums = written(rows.select("distinct", "pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    a_id = F.shiftright("pair", 16)
    most = sums.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
    return written(sums.withColumn("a_id", a_id).join(most, "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair_table")


def frequent_pairs(counts: DataFrame, entries: int) -> DataFrame:
    """The pairs with the highest counts, ``entries`` at most: whole classes of counts between two powers of two."""
    classes = counts.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("c")).collect()
    least, held = 64, 0
    for r in classes:
        held += r.rows
        if held > entries:
            break
        least = r.c
    return counts.where(F.floor(F.log2("n")) >= least)


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose tokens of A or B do not give the bytes of
    space+text, has zeros and an empty digest. A text of any length streams in
    blocks. Ties for an A id's highest count are all best. Repeated rows are
    texts of their own, in results and in counts; a null id stays null; other
    columns are ignored; an empty table gives no rows.
    """
    rows = written(aligned(docs, id_col, text_col, a, b, block), "aligned")
    counts = pair_counts(rows)
    first = frequent_pairs(counts, frequent).toArrow()
    order = np.argsort(pairs := first["pair"].to_numpy())
    known = docs.sparkSession.sparkContext.broadcast((pairs[order], first["n"].to_numpy()[order], first["best"].to_numpy()[order]))

    def run(batches):
        keys, n, best = known.value
        for batch in slices(batches, 4_096):
            n_best, total, rest = [], [], []
            for k, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("distinct", "pairs", "times")), strict=True):
                mine, often = pairs_of(k, pairs, times)
                at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
                hit = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
                at = at[hit]
                total.append(int((n[at] * often[hit]).sum()))
                n_best.append(int(often[hit][best[at]].sum()))
                rest.append([{"pair": p, "times": t} for p, t in zip(mine[~hit].tolist(), often[~hit].tolist(), strict=True)])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in KEPT]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))], names=[*KEPT, "n_best", "count_sum", "rest"])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"key long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"
    found = rows.mapInArrow(run, fields)
    if counts.count() > first.num_rows:
        found = written(found, "scored")
        missed = found.select("key", F.explode("rest").alias("r")).join(counts.withColumnRenamed("pair", "__pair"), F.col("r.pair") == F.col("__pair"))
        sums = missed.groupBy("key").agg(F.sum(F.col("n") * F.col("r.times")).alias("more"), F.sum(F.when(F.col("best"), F.col("r.times")).otherwise(0)).alias("more_best"))
        found = found.join(sums, "key", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


KEPT = ("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_alignment": op11_alignment}
