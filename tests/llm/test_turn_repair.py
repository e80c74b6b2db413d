import hashlib
import itertools
import random
import re
import zlib

from tidemark.llm import turn_repair

TURNS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """Every sequence of edits with up to two inserts between turns, by whole strings."""
    faults, best = faults_of(rows), None
    choices = []
    for (_, role, _), fault in zip(rows, faults):
        choices.append(["D"] if fault in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"])
    runs = ["", "u", "a", "ua", "au"]
    for before in itertools.product(runs, repeat=len(rows) + 1):
        for edits in itertools.product(*choices):
            cost, audit, lines = 0, "", []
            for i in range(len(rows) + 1):
                lines += [("user" if x == "u" else "assistant", "") for x in before[i]]
                audit += "I" * len(before[i])
                cost += 2 * len(before[i])
                if i == len(rows):
                    break
                edit, (_, role, text) = edits[i], rows[i]
                audit += edit[0]
                cost += {"D": 3, "K": 0, "R": 2}[edit[0]] + (faults[i] == "truncated" and edit != "D")
                if edit != "D":
                    lines.append(({"K": role, "Ru": "user", "Ra": "assistant"}[edit], text))
            initials = "".join(r[:1] or "?" for r, _ in lines)
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    initials = [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def some(n, longest, seed=4):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for i in range(r.randint(1, longest)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "unit"])
            rows.append((c if c else None, i + r.randint(0, 1) * 50 if r.random() < 0.9 else None, role, r.choice(["Yes.", "No", "a b?", " ", "", "Yes.", "x!\n", " ", "é"])))
    return rows


def in_order(rows):
    """Turns of each conversation by number; those with equal numbers are not told apart here, so none may be."""
    found = {}
    for c, turn, role, text in rows:
        found.setdefault(c, []).append((turn, role, text))
    return {c: sorted(x, key=lambda t: (t[0] is not None, t[0] or 0)) for c, x in found.items()}


def test_cheapest_edits_against_all(spark):
    rows = [r for r in some(150, 3)]
    seen, kept = set(), []
    for r in rows:
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            kept.append(r)
    frame = spark.createDataFrame(kept, TURNS).selectExpr("*", "'x' as edit", "1 as part", "'y' as fault", "0 as __row")
    got = {r.conv_id: tuple(r[c] for c in NUMBERS) for r in turn_repair.report(turn_repair.repaired(frame)).collect()}
    assert got == {c: brute(x) for c, x in in_order(kept).items()}
    assert len({x[6] for x in got.values()}) > 25


def whole(rows):
    """The program on strings, for conversations of any length."""
    faults, layer = faults_of(rows), {0: (0, "")}
    steps = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
    for (_, role, _), fault in zip(rows, faults):
        new = {}
        for s, (cost, audit) in layer.items():
            at, c, a = s, cost, audit
            for _ in range(3):
                options = [(at, c + 3, a + "D")]
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    options.append((steps[at][0], c + 2 + more, a + "R"))
                    to = 1 if role[:1] == "s" and at == 0 else steps[at][0] if role[:1] == steps[at][1] else None
                    if to:
                        options.append((to, c + more, a + "K"))
                for to, x, y in options:
                    new[to] = min(new.get(to, (x, y)), (x, y))
                at, c, a = steps[at][0], c + 2, a + "I"
        layer = new
    return min((c + (0, 4, 2, 0)[s], a + ("", "II", "I", "")[s]) for s, (c, a) in layer.items())


def test_long_conversations_are_split(spark):
    r = random.Random(9)
    rows = [(7, i, r.choice(["user", "assistant", "user", "assistant", "system", "tool"]), f"{r.choice(['Text', 'other', 'Text'])} {i % 400}{r.choice(['.', '', '!'])}") for i in range(3000)]
    rows += [(8, 0, "user", "Long " * 50_000 + "end."), (8, 1, "assistant", "Yes.")] + [(9, 1, "user", "Same.")] * 500
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        repaired = turn_repair.repaired(spark.createDataFrame(rows, TURNS).repartition(5)).cache()
        assert repaired.where("conv_id = 7").select("part").distinct().count() > 3 and repaired.where("conv_id = 9").select("part").distinct().count() >= 1
        got = {x.conv_id: x for x in turn_repair.report(repaired).collect()}
        repaired.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert (got[7].cost, got[7].audit) == whole(in_order(rows)[7])
    assert (got[8].cost, got[8].audit) == (0, "KK") and (got[9].cost, got[9].duplicate) == (3 * 499 + 2, 499)
    assert got[9].audit == min("K" + "D" * i + "I" + "D" * (499 - i) for i in range(500))


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c}. {t}!") for c in range(60) for t in range(4)] + [(None, None, None, None)]
    got = [tuple(r) for r in turn_repair.damaged(spark.createDataFrame(rows, TURNS)).collect()]
    want = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        want += [(c, t, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert turn_repair.report(turn_repair.repaired(spark.createDataFrame([], TURNS))).collect() == []


def test_query_keeps_conversations_without_turns(spark, tmp_path):
    gone = next(c for c in range(10**4) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x"), (None, 1, "user", "Yes.")], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in turn_repair.op12_turn_repair(spark, str(tmp_path)).collect()}
    assert len(got) == 2 and tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
