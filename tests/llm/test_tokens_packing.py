import random
import zlib

import pytest

from tests.llm.fixtures import documents, frame
from tidemark.llm import packing, token_counts, tokens

ALPHABET = [*" \t\n\r\x0b\x0c\x1c\x85\xa0 　​é'stabcXYZ09!?.,-²中\U0001f600Σς﻿"] + ["  ", "   ", " \n", "<|endoftext|>", "<|startoftext|>", "'ll", " ' re", "Été.", "a" * 120]


@pytest.fixture()
def odd_texts():
    r = random.Random(5)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(4000)]


@pytest.mark.parametrize("entries", [50, 400_000])
def test_caches_give_the_librarys_results(odd_texts, monkeypatch, entries):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", entries)
    byte, word = tokens.tokenizer("byte_bpe_50k.json"), tokens.tokenizer("word_bpe_49k.json")
    counts = tokens.ByteCounts("byte_bpe_50k.json").count(odd_texts, {" the": 1})
    assert counts == [len(e.ids) for e in byte.encode_batch(odd_texts, add_special_tokens=False)]
    ids = tokens.ChunkIds("word_bpe_49k.json", False, True)
    assert [tokens.word_ids(t, ids) for t in odd_texts] == [tokens.packed(e.ids) for e in word.encode_batch(odd_texts, add_special_tokens=False)]


def test_second_library_agrees_on_words():
    t = tokens.tokenizer("word_bpe_49k.json")
    code, plain = tokens.word_coder(t), tokens._PLAIN_WORD
    known = [w for w in (x.removesuffix("</w>") for x in t.get_vocab(False)) if w.isascii() and w.islower() and plain.fullmatch(w)]
    r = random.Random(7)
    words = known + ["".join(r.choice(known) for _ in range(r.randint(2, 3))) for _ in range(60_000)] + ["".join(r.choice("etaoinsçéàü") for _ in range(r.randint(1, 14))) for _ in range(40_000)]
    assert len(known) > 40_000
    for at in range(0, len(words), 4096):
        part = words[at : at + 4096]
        assert [code(w + "\0") for w in part] == [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]


def test_token_counts(spark):
    rows = documents()
    rows.append(rows[5])
    got = token_counts.count_tokens(frame(spark, rows, extra=True)).collect()
    t = tokens.tokenizer("byte_bpe_50k.json")
    want = sorted((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, *_ in rows)
    assert sorted(map(tuple, got)) == want
    assert token_counts.count_tokens(frame(spark, [])).collect() == []


def test_packing_places_every_id_once(spark):
    rows = documents()
    rows += [rows[3], (None, "a b c", "en", "s1", 5)]
    got = packing.pack(frame(spark, rows, extra=True)).collect()
    t = tokens.tokenizer("word_bpe_49k.json")
    want = {}
    for i, x, *_ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            key = (i, k, len(part), zlib.crc32(tokens.packed(part)), len(ids), tokens.packed(part))
            want[key] = want.get(key, 0) + 1
    found = {}
    places = {}
    for r in got:
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids))
        found[key] = found.get(key, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert found == want
    assert sorted(places) == list(range(len(places)))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for p in places.values() for _, n in p)
    assert len(places) <= total / 2048 * 1.03 + 2
    assert packing.pack(frame(spark, [])).collect() == []


def test_column_generation_beats_or_meets_first_fit():
    r = random.Random(3)
    counts = {}
    for _ in range(3000):
        w = min(128, max(1, int(r.lognormvariate(3.5, 0.8))))
        counts[w] = counts.get(w, 0) + 1
    plan = packing.plan_patterns(counts, 128)
    used = {}
    for pattern, times in plan:
        assert sum(w * k for w, k in pattern.items()) <= 128
        for w, k in pattern.items():
            used[w] = used.get(w, 0) + k * times
    assert used == counts
    assert sum(t for _, t in plan) <= sum(t for _, t in packing.first_fit(counts, 128))
    assert sum(t for _, t in plan) <= sum(w * k for w, k in counts.items()) / 128 * 1.01 + 2


def test_counting_is_one_job_whatever_the_partitions(spark):
    """24 partitions are counted at once, and the driver gets at most the table's entries."""
    docs = frame(spark, documents(96)).repartition(24).cache()
    docs.count()
    seen = {}
    for entries in (200, 10**5):
        spark.sparkContext.setJobGroup(f"count-{entries}", "")
        found = token_counts.chunk_counts(docs, "text", token_counts.TOKENIZER, entries).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"count-{entries}")) <= 2
        got = token_counts.frequent_lengths(docs, "text", token_counts.TOKENIZER, entries)
        assert len(got) <= entries and set(got) <= {r.chunk for r in found}
        seen[entries] = got
    spark.sparkContext.setJobGroup("", "")
    t = tokens.tokenizer(token_counts.TOKENIZER)
    assert len(seen[10**5]) > 100 and all(n == len(t.encode(c, add_special_tokens=False).ids) for c, n in list(seen[10**5].items())[:200])
    docs.unpersist()
