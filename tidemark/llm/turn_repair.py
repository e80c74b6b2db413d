r"""Conversation structure repair by a rank-compressed dynamic program.

A turn is kept, given another role or deleted, after a run of none to two
inserted turns: nine macro edits, whose codes (``D``, ``ID``, ``IID`` ... ``R``)
are prefix-free. So of two sequences of as many macro edits the one with the
lesser first different code spells the lesser audit string, and a layer of the
program needs no strings: for every state (what the kept roles end with) its
least cost and the rank of its string among the layer's. A turn adds a parent
pointer and a code for each state. Three inserts in a row are never cheapest:
they lead where one does.

A conversation of any length is dealt over tasks: turns stand in ranges, a range
solves its part from each of the four states before it, and the parts' tables
(cost and rank from state to state) are put together in order. Strings are
spelled in the ranges, along the pointers.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, written

BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
USER, ASSISTANT = "user", "assistant"

#: States: nothing yet, a system turn, a user turn (the only one that must go on), an assistant turn.
NOTHING, SYSTEM, ASKED, ANSWERED = STATES = range(4)
#: Where one more turn of a user or assistant leads, and what it says; a system turn only begins.
NEXT = (ASKED, ASKED, ANSWERED, ASKED)
ROLE = (USER, USER, ASSISTANT, USER)
KEPT_AT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: ASKED, SYSTEM: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}}
CODES = sorted("I" * n + e for n in range(3) for e in "DKR")
#: Turns to insert at the end, by state.
TAIL = (0, 2, 1, 0)


@lru_cache(maxsize=50_000)
def advance(kind: str, bad: bool, short: bool, layer: tuple):
    """(layer, pointers) after a turn. A layer has (cost, rank) for each state, or None; a pointer is parent * 9 + code."""
    found: list[list] = [[] for _ in STATES]
    for parent, own in enumerate(layer):
        if own is None:
            continue
        for number, code in enumerate(CODES):
            at, cost = parent, own[0] + INSERT * (len(code) - 1)
            for _ in code[1:]:
                at = NEXT[at]
            if code[-1] == "D":
                found[at].append((cost + DELETE, own[1], number, parent))
            elif bad:
                continue
            elif code[-1] == "R":
                found[NEXT[at]].append((cost + REROLE + CUT_SHORT * short, own[1], number, parent))
            elif (to := KEPT_AT.get(kind, {}).get(at)) is not None:
                found[to].append((cost + KEEP + CUT_SHORT * short, own[1], number, parent))
    best = [min(x) if x else None for x in found]
    ranks = {x[1:3]: i for i, x in enumerate(sorted((x for x in best if x), key=lambda x: x[1:3]))}
    return tuple((x[0], ranks[x[1:3]]) if x else None for x in best), bytes(x[3] * len(CODES) + x[2] if x else 255 for x in best)


def relative(layer: tuple) -> tuple[int, tuple]:
    """The least cost of a layer, and the layer less that."""
    least = min(x[0] for x in layer if x)
    return least, tuple((x[0] - least, x[1]) if x else None for x in layer)


class Part:
    """A conversation's turns in one range, solved from one state or from each."""

    def __init__(self, conv, entries):
        self.conv, self.entries = conv, entries
        self.layers = [tuple((0, 0) if s == e else None for s in STATES) for e in entries]
        self.base = [0] * len(entries)
        self.pointers, self.rows = bytearray(), []

    def add(self, row: int, kind: str, bad: bool, short: bool) -> None:
        self.rows.append(row)
        for i, layer in enumerate(self.layers):
            layer, pointers = advance(kind, bad, short, layer)
            least, self.layers[i] = relative(layer)
            self.base[i] += least
            self.pointers += pointers

    def table(self) -> tuple[list, list]:
        """Costs and ranks from state to state, -1 where there is no way."""
        cost, rank = [-1] * 16, [-1] * 16
        for e, base, layer in zip(self.entries, self.base, self.layers, strict=True):
            for s, x in enumerate(layer):
                if x:
                    cost[4 * e + s], rank[4 * e + s] = base + x[0], x[1]
        return cost, rank


def joined(parts: list) -> list:
    """(entry, exit) of each part on the cheapest way through all, ties to the lesser audit string; parts: (costs, ranks)."""
    layer: dict = {NOTHING: (0, 0)}
    back = []
    for cost, rank in parts:
        found: dict = {}
        for e, (own, order) in layer.items():
            for s in STATES:
                if cost[4 * e + s] >= 0:
                    x = (own + cost[4 * e + s], order, rank[4 * e + s], e)
                    found[s] = min(found.get(s, x), x)
        order = {s: i for i, s in enumerate(sorted(found, key=lambda s: found[s][1:3]))}
        back.append({s: x[3] for s, x in found.items()})
        layer = {s: (x[0], order[s]) for s, x in found.items()}
    at = min(layer, key=lambda s: (layer[s][0] + INSERT * TAIL[s], layer[s][1]))
    ways = []
    for entries in reversed(back):
        ways.append((entries[at], at))
        at = entries[at]
    return ways[::-1]


def path(pointers: bytes, n: int, entries: int, entry: int, at: int) -> bytes:
    """The pointer of each turn in order, on the way from entry to a state."""
    out, e = bytearray(n), entry if entries == 4 else 0
    for i in range(n - 1, -1, -1):
        out[i] = pointers[4 * (i * entries + e) + at]
        at = out[i] // len(CODES)
    return bytes(out)


@lru_cache(maxsize=256)
def spelled(pointer: int) -> tuple:
    """The roles inserted before a turn, its edit and, if it is given one, its new role."""
    at, number = divmod(pointer, len(CODES))
    code, way = CODES[number], []
    for _ in code[1:]:
        way.append(ROLE[at])
        at = NEXT[at]
    return way, code[-1], ROLE[at] if code[-1] == "R" else None


def faulted(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(turns, faults): written rows of __row, conv_id, turn, role, text, who (a hash of role and text); without texts, each one's first fault: blank, duplicate, truncated or null."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = written(rows.withColumn("who", F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text")))), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), F.col("__row").alias("row"))
    first = rows.groupBy(F.col("conv_id").alias("__conv"), F.col("who").alias("__who")).agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    bare = rows.select("__row", "conv_id", "turn", "who", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(*STOPS)).alias("short"))
    both = bare.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("who") == F.col("__who")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.coalesce(place > F.col("__first"), F.lit(False)), "duplicate").when(F.col("short"), "truncated")
    return rows, both.select("__row", "conv_id", "turn", "who", "initial", fault.alias("fault"))


def parts_of(rows: DataFrame) -> DataFrame:
    """A row per conversation and range: its tables, pointers and turns in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, part long, entries int, cost array<long>, rank array<int>, pointers binary, rows array<long>"
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())

    def run(batches):
        part, now, first, done, count = TaskContext.get().partitionId(), None, True, [], 0
        for batch in slices(batches):
            for row, conv, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("__row", "conv_id", "initial", "fault")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now)
                        first = False
                    # Only the first conversation of a range can have begun in another one.
                    now = Part(conv, tuple(STATES) if first else (NOTHING,))
                now.add(row, initial, fault in ("blank", "duplicate"), fault == "truncated")
            count += len(done)
            yield rows_of(done, part)
            done = []
        yield rows_of([now] if now is not None else [], part)

    def rows_of(done, part):
        tables = [p.table() for p in done]
        columns = [
            pa.array([p.conv for p in done], id_type), pa.array([part] * len(done), pa.int64()), pa.array([len(p.entries) for p in done], pa.int32()),
            pa.array([c for c, _ in tables], pa.list_(pa.int64())), pa.array([r for _, r in tables], pa.list_(pa.int32())),
            pa.array([bytes(p.pointers) for p in done], pa.binary()), pa.array([p.rows for p in done], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in fields.split(", ")])

    order = ["conv_id", "turn", "__row"]
    ranges = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return written(ranges.select("__row", "conv_id", "initial", "fault").mapInArrow(run, fields).withColumn("__part", F.monotonically_increasing_id()), "repair_parts")


def ways_of(parts: DataFrame) -> DataFrame:
    """(__part, entry, exit, last): a conversation's parts, a small table each, meet in order of their ranges."""
    fields = "__way long, entry int, exit int, last boolean"

    def run(batches):
        now, held, out = None, [], []

        def close():
            for i, (way, (entry, at)) in enumerate(zip(held, joined([h[1:] for h in held]), strict=True)):
                out.append((way[0], entry, at, i == len(held) - 1))

        for batch in slices(batches):
            for conv, way, cost, rank in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "__part", "cost", "rank")), strict=True):
                if held and conv != now:
                    close()
                    held = []
                now = conv
                held.append((way, cost, rank))
            yield rows_of(out)
            out = []
        if held:
            close()
        yield rows_of(out)

    def rows_of(out):
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=[x.split()[0] for x in fields.split(", ")])

    narrow = parts.select("conv_id", "part", "__part", "cost", "rank").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return narrow.mapInArrow(run, fields)


def edits_of(parts: DataFrame) -> DataFrame:
    """(__edited, part, place, inserted, edit, new_role, appended) of every turn."""
    fields = "__edited long, part long, place long, inserted array<string>, edit string, new_role string, appended array<string>"

    def run(batches):
        for batch in slices(batches, 256):
            out: list[tuple] = []
            for part, entries, pointers, rows, entry, at, last in zip(*(batch.column(c).to_pylist() for c in ("part", "entries", "pointers", "rows", "entry", "exit", "last")), strict=True):
                tail, state = [], at
                for _ in range(TAIL[at] if last else 0):
                    tail.append(ROLE[state])
                    state = NEXT[state]
                for i, (row, pointer) in enumerate(zip(rows, path(pointers, len(rows), entries, entry, at), strict=True)):
                    out.append((row, part, i, *spelled(pointer), tail if i == len(rows) - 1 else []))
                    if len(out) == 4_096:
                        yield rows_of(out)
                        out = []
            yield rows_of(out)

    def rows_of(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string())]
        columns = zip(*out, strict=True) if out else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in fields.split(", ")])

    both = parts.join(ways_of(parts), F.col("__part") == F.col("__way"))
    return both.select("part", "entries", "pointers", "rows", "entry", "exit", "last").mapInArrow(run, fields)


def repaired(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: conv_id, turn, role, text, fault, and its edit.

    part and place order a conversation's turns. fault is the first of blank,
    duplicate and truncated that holds, else null. edit is K, R or D; inserted
    has the roles of the empty turns that go before it, appended of those behind
    a conversation's last turn; new_role is what R gives. Kept roles, by their
    first letters, then are nothing or an optional system turn and pairs of a
    user's and an assistant's.

    Turns stand in order of number, null ones first, repeated rows beside each
    other; different turns with equal numbers stay in the order in which they
    were read. Null roles and texts are empty; a role with another first letter,
    or none, can't be kept; null ids make one conversation. Texts of any length
    are not moved while edits are sought. Other columns are ignored; an empty
    table gives no rows.
    """
    rows, faults = faulted(turns, id_col, turn_col, role_col, text_col)
    faults = written(faults, "faults")
    edits = edits_of(parts_of(faults)).join(faults.select("__row", "fault"), F.col("__edited") == F.col("__row")).drop("__row")
    both = rows.select("__row", "conv_id", "turn", "role", "text").join(edits, F.col("__row") == F.col("__edited"))
    return both.select("conv_id", "part", "place", "turn", "role", "text", "fault", "inserted", "edit", "new_role", "appended")


def report(rows: DataFrame) -> DataFrame:
    """Of each conversation of repaired(): gaps, faults, illegal, cost, audit, repaired_sha256.

    A conversation's turns stream through one task in order, because its digest
    is made in sequence: the task holds counts and the audit string, no turns.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    names = ["conv_id", "turn", "role", "text", "fault", "inserted", "edit", "new_role", "appended"]

    def run(batches):
        now, done = None, []
        for batch in slices(batches):
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Told(conv)
                now.add(*turn)
            yield rows_of(done)
            done = []
        yield rows_of([now.row()] if now is not None else [])

    def rows_of(done):
        kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = zip(*done, strict=True) if done else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in fields.split(", ")])

    return rows.select("part", "place", *names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(run, fields)


class Told:
    """What is told of a conversation while its turns pass."""

    def __init__(self, conv):
        self.conv, self.lines, self.digest, self.audit = conv, 0, hashlib.sha256(), []
        self.first = self.last = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
        self.lines += 1

    def add(self, turn, role, text, fault, inserted, edit, new_role, appended) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if fault:
            self.faults[fault] += 1
        self.cost += INSERT * (len(inserted) + len(appended)) + {"K": KEEP, "R": REROLE, "D": DELETE}[edit] + CUT_SHORT * (fault == "truncated" and edit != "D")
        self.audit.append("I" * len(inserted) + edit + "I" * len(appended))
        for r in inserted:
            self.line(r, "")
        if edit != "D":
            self.line(new_role or role, text)
        for r in appended:
            self.line(r, "")

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.first is not None else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """turns with a fault planted in one of four rows, by a checksum of conversation and turn; nulls of role and text are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how: Column = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), how.alias("how")).where("how <> 0")
    rows = rows.withColumn("text", F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", "".join(STOPS), "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("how") == 4, USER).otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = report(repaired(damaged(turns))).withColumnRenamed("conv_id", "__conv")
    both = turns.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


QUERIES = {"op12_turn_repair": op12_turn_repair}

#: Checksums from their definition; the program itself on whole strings, turn by turn.
ORACLE_SQL = {
    "op12_turn_repair": r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, t,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b
  FROM conversations, crc),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS how FROM k),
d AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, range(2) c(n) WHERE how <> 0 AND n < CASE how WHEN 3 THEN 2 ELSE 1 END),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (
  SELECT *, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
g AS (SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {'c': 0::BIGINT, 'a': '', 'o': ''} AS best FROM g
  UNION ALL
  SELECT conv_id, i, s, min({'c': c, 'a': a, 'o': o}) FROM (
    SELECT p.conv_id, g.i,
           CASE e WHEN 'D' THEN mid WHEN 'K' THEN CASE g.r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE mid WHEN 2 THEN 3 ELSE 2 END END AS s,
           p.best.c + 2 * n + CASE e WHEN 'D' THEN 3 ELSE CASE e WHEN 'R' THEN 2 ELSE 0 END + (g.fault = 'truncated')::INT END AS c,
           p.best.a || repeat('I', n) || e AS a,
           p.best.o || ins || CASE e WHEN 'D' THEN '' WHEN 'K' THEN g.role || ':' || g.text || chr(10) ELSE CASE mid WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || g.text || chr(10) END AS o
    FROM dp p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i + 1,
         (VALUES (0, 0, 0, ''), (1, 0, 1, ''), (2, 0, 2, ''), (3, 0, 3, ''),
                 (0, 1, 2, 'user:' || chr(10)), (1, 1, 2, 'user:' || chr(10)), (2, 1, 3, 'assistant:' || chr(10)), (3, 1, 2, 'user:' || chr(10)),
                 (0, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
                 (2, 2, 2, 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 2, 3, 'user:' || chr(10) || 'assistant:' || chr(10))) m(frm, n, mid, ins),
         (VALUES ('D'), ('K'), ('R')) x(e)
    WHERE m.frm = p.s AND (e = 'D' OR g.fault NOT IN ('blank', 'duplicate'))
      AND (e <> 'K' OR (g.r = 's' AND mid = 0) OR (g.r = 'u' AND mid <> 2) OR (g.r = 'a' AND mid = 2)))
  GROUP BY conv_id, i, s),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
z AS (
  SELECT n.conv_id, min({'c': best.c + CASE s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'a': best.a || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
                         'o': best.o || CASE s WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}) AS b
  FROM n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.i = n.n GROUP BY n.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.b.c, 0)::BIGINT AS cost,
       coalesce(z.b.a, '') AS audit, sha256(CASE WHEN coalesce(z.b.o, '') = '' THEN '' ELSE left(z.b.o, -1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
}
