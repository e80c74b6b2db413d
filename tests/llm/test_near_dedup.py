import random
import re

import numpy as np

from tests.llm.fixtures import documents, frame, prose
from tidemark.llm import near_dedup as N
from tidemark.llm.shingles import SetSketch, Shingler


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), i == root(i)) for i, s in sets)


def test_sets_and_registers():
    r = random.Random(2)
    words = [f"w{i}" for i in range(50)] + ["É", "é", "Ab", "aB"]
    texts = ["".join(r.choice(words) + r.choice([" ", "\n", "  ", "\x0b", "\x1c "]) for _ in range(r.randint(0, 60))) for _ in range(500)] + [None, ""]
    found = Shingler().sets(texts)
    assert [len(s) for s in found] == [len(shingles(t)) for t in texts]
    for _ in range(500):
        i, j = r.randrange(500), r.randrange(500)
        assert len(np.intersect1d(found[i], found[j])) == len(shingles(texts[i]) & shingles(texts[j]))
    sketch = SetSketch()
    a, b = found[10], found[11]
    assert (np.maximum(sketch.registers(a), sketch.registers(b)) == sketch.registers(np.union1d(a, b))).all()


def test_long_text_is_cut_without_loss(monkeypatch):
    from tidemark.llm import shingles as S

    text = prose(random.Random(4), 4000)
    whole = Shingler().sets([text])[0]
    monkeypatch.setattr(S, "BLOCK", 1000)
    assert (Shingler().sets([text])[0] == whole).all()


def test_against_brute_force(spark):
    rows = documents()
    got = N.near_duplicates(frame(spark, rows, extra=True)).collect()
    assert sorted(map(tuple, got)) == brute([(i, t) for i, t, *_ in rows])
    assert N.near_duplicates(frame(spark, [])).collect() == []


def test_repeats_and_null_ids(spark):
    rows = documents(80)[:40]
    got = N.near_duplicates(frame(spark, [*rows, rows[0], (None, rows[0][1], "en", "s1", 1), (None, None, "en", "s1", 1)])).collect()
    plain = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert sorted(plain.items()) == [(i, c) for i, _, c, _ in brute([(i, t) for i, t, *_ in rows])]
    assert sum(r.doc_id == 0 for r in got) == 2
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles) == [(plain[0], False)]


def test_a_crowded_group_of_near_copies(spark, monkeypatch):
    """Edits of one text at all distances, in blocks far smaller than the buckets."""
    monkeypatch.setattr(N, "BLOCK", 16)
    r = random.Random(9)
    base = prose(r, 150).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {x.id: x.component for x in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    top = {}
    for a, b in links:
        top.setdefault(a, a), top.setdefault(b, b)

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
