import hashlib
import random
from collections import Counter, defaultdict

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.fixtures import DOCS, documents, frame
from tidemark.llm import alignment
from tidemark.llm.tokens import byte_letters

BYTE = Tokenizer.from_file(public_tokenizers.path(alignment.A))
BYTE.encode_special_tokens = True
PIECE = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B))
LETTERS = byte_letters()


def both(text):
    """Each side's ids and token bytes, by the libraries on the whole text."""
    a = BYTE.encode(" " + text, add_special_tokens=False).ids
    b = PIECE.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in BYTE.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if PIECE.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, PIECE.id_to_piece(i)) for i in b)]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    return a, [len(x) for x in bytes_a], b, [len(x) for x in bytes_b]


def spans(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def brute(texts):
    """Links pair by pair, groups offset by offset."""
    rows, held = [], Counter()
    for t in texts:
        found = both(t) if t else None
        if found is None:
            rows.append(([], [], [], []))
            continue
        a, sa, b, sb = found
        pa, pb = spans(sa), spans(sb)
        links = [(i, j) for i, (lo, hi) in enumerate(pa) for j, (x, y) in enumerate(pb) if lo < y and x < hi]
        ends = sorted({h for _, h in pa} & {h for _, h in pb})
        groups, begin = [], 0
        for e in ends:
            groups.append(([a[i] for i, (lo, hi) in enumerate(pa) if begin <= lo < e], [b[j] for j, (lo, hi) in enumerate(pb) if begin <= lo < e]))
            begin = e
        rows.append((a, b, groups, [(a[i], b[j]) for i, j in links]))
        held.update(set(rows[-1][3]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for a, b, groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def awkward():
    r = random.Random(5)
    parts = ["the ", "  ", "a", "é", "中文", "\n", "\t", "<|endoftext|>", "</s>", "<unk>", "▁", "\U0001f600", " x", "ing", "1234", ".", "ﬁ", "́", "　", "\x1d", "   word", "<0x0A>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(120)]
    return [None, "", " ", "   ", "x", "▁", *texts, texts[3], texts[3]]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block,frequent", [(alignment.BLOCK, alignment.FREQUENT), (7, 40), (3, 0)])
def test_against_brute_force(spark, block, frequent):
    rows = [x for x in documents() if len(x[1] or "") < 1500][:40]
    texts = [x[1] for x in rows] + awkward()
    data = [(i if i != 3 else None, t, None, None, None) for i, t in enumerate(texts)]
    got = alignment.alignment(frame(spark, data, extra=True).repartition(3), block=block, frequent=frequent).collect()
    want = {i if i != 3 else None: x for i, x in enumerate(brute(texts))}
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert sum(x[0] > 0 for x in want.values()) > 60 and any(t and want[i if i != 3 else None][0] == 0 for i, t in enumerate(texts))


def test_long_repeated_and_empty(spark):
    long = " ".join(f"word{i % 97} and{'x' * (i % 40)}" for i in range(40_000))
    got = alignment.alignment(frame(spark, [(1, long, None, None, 0), (1, long, None, None, 0), (1, "word1", None, None, 0)])).collect()
    assert len(got) == 3 and got[0].n_a > 2 * alignment.BLOCK or got[1].n_a > 2 * alignment.BLOCK
    big = [r for r in got if r.n_a > 100]
    assert big[0] == big[1] and big[0].n_links == big[0].n_a + big[0].n_b - big[0].n_groups
    assert alignment.alignment(spark.createDataFrame([], DOCS)).collect() == []


def test_groups_are_rows(spark):
    texts = [t for t in awkward() if t]
    got = defaultdict(list)
    for r in alignment.groups(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), block=5).collect():
        got[r.doc_id].append((r.start, r.end, r.a_ids, r.b_ids))
    for i, t in enumerate(texts):
        found, at = both(t), 0
        if found is None:
            assert i not in got
            continue
        for start, end, a, b in sorted(got[i]):
            assert start == at
            at = end
        assert at == len((" " + t).encode()) and [x for g in sorted(got[i]) for x in g[2]] == found[0] and [x for g in sorted(got[i]) for x in g[3]] == found[2]
