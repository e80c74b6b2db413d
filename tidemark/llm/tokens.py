"""Exact tokenizer results through caches of white-space-delimited chunks.

A chunk is a piece of text whose tokens do not depend on what stands around
it, so a text's tokens are those of its chunks in order. The library encodes
each distinct chunk once per worker; texts are then look-ups.

- word_bpe_49k drops white space, so every run without ASCII white space is
  a chunk (a special string has no white space inside and stays in one chunk).
- byte_bpe_50k attaches one space to the word that follows it. ASCII texts and
  texts without unusual white space are cut as ``_BYTE_CHUNK`` does; in others
  only before a space that stands between two printable ASCII characters.
  Special strings are cut out first, as the library does.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of each of a worker's two generations of cached chunks, and the longest chunk it keeps.
CACHE_ENTRIES = 200_000
CACHE_CHUNK_BYTES = 96

_BYTE_CHUNK = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
_PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_SAFE_CUT = re.compile(r"(?<=[!-~])(?= [!-~])")

@lru_cache(maxsize=1)
def tokenizer(name: str, plain_specials: bool = False):
    """The library's tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
    t.encode_special_tokens = plain_specials
    return t


def byte_chunks(text: str, specials: tuple[str, ...]) -> list[str]:
    """Chunks of a text for the byte-level tokenizer."""
    for s in specials:
        if s in text:
            first, *rest = text.split(s)
            out = byte_chunks(first, specials) if first else []
            for part in rest:
                out.append(s)
                out += byte_chunks(part, specials) if part else []
            return out
    if text.isascii():
        if _ODD_ASCII.search(text) is None:
            return _BYTE_CHUNK.findall(text)
    elif _ODD_SPACE.search(text) is None:
        return _BYTE_CHUNK.findall(text)
    return _SAFE_CUT.split(text)


_ODD_ASCII = re.compile("[\x1c-\x1f]")


class Cache:
    """What chunks encode to, in two generations: when the young one is full the old one goes, and what is asked for
    again is young again. So a worker's memory is bounded and frequent chunks stay."""

    def __init__(self, t, value):
        self.t, self.value = t, value
        self.young: dict = {}
        self.old: dict = {}

    def encode(self, many: list) -> None:
        """Encodes chunks by the library and keeps them."""
        for at in range(0, len(many), 4096):
            part = many[at : at + 4096]
            texts = [c.decode("utf-8", "replace") if isinstance(c, bytes) else c for c in part]
            for chunk, e in zip(part, self.t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                self.young[chunk] = self.value(e.ids)

    def missing(self, chunks) -> list:
        """Those of some distinct chunks that are in neither generation."""
        young, old, out = self.young, self.old, []
        for c in chunks:
            if c not in young:
                if (v := old.get(c)) is not None:
                    young[c] = v
                else:
                    out.append(c)
        return out

    def learn(self, chunks: list) -> None:
        self.encode(chunks)

    def look_up(self, chunks: list) -> list:
        """The values of chunks, in order."""
        if len(self.young) > CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        got = list(map(self.young.get, chunks))
        if None not in got:
            return got
        new = self.missing({c for c, v in zip(chunks, got, strict=True) if v is None})
        self.learn([c for c in new if len(c) <= CACHE_CHUNK_BYTES])
        got = list(map(self.young.get, chunks))
        if None in got:
            long = {}
            for c in {c for c, v in zip(chunks, got, strict=True) if v is None}:
                long[c] = self.value(self.t.encode(c.decode("utf-8", "replace") if isinstance(c, bytes) else c, add_special_tokens=False).ids)
            got = [long[c] if v is None else v for c, v in zip(chunks, got, strict=True)]
        return got


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit bytes."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteCounts(Cache):
    """Token counts of byte-level chunks: a broadcast table of frequent ones before this worker's cache."""

    def __init__(self, name: str):
        super().__init__(tokenizer(name), len)
        self.specials = tuple(a.content for a in self.t.get_added_tokens_decoder().values())

    def count(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        out = []
        for text in texts:
            chunks = byte_chunks(text, self.specials)
            got = list(map(frequent.get, chunks))
            if None in got:
                rest = self.look_up([c for c, n in zip(chunks, got, strict=True) if n is None])
                out.append(sum(n for n in got if n is not None) + sum(rest))
            else:
                out.append(sum(got))
        return out


def word_coder(t):
    """The word tokenizer's vocabulary and merges in a second library, for single lower-case words: about five times as
    fast on words that no cache holds. The end of a word, a suffix in the vocabulary, is the byte 0 here; a merge's rank
    is its token's id in both. Tests hold the two libraries' ids against each other."""
    import tiktoken

    specials, ranks = {a.content for a in t.get_added_tokens_decoder().values()}, {}
    letters = byte_letters()
    for token, i in t.get_vocab(True).items():
        if token not in specials:
            word = token.removesuffix("</w>")
            ranks[bytes(letters[c] for c in word) + (b"\0" if word != token else b"")] = i
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones for themselves, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


class ChunkIds(Cache):
    """Packed ids of chunks; words: chunks are those of the word tokenizer, as bytes."""

    def __init__(self, name: str, plain_specials: bool = False, words: bool = False):
        super().__init__(tokenizer(name, plain_specials), packed)
        self.words = words
        self.code = word_coder(self.t) if words else None

    def learn(self, chunks: list) -> None:
        """For the word tokenizer, a plain word and the punctuation after it are encoded, and kept, apart."""
        if not self.words:
            self.encode(chunks)
            return
        plain, rest = {}, []
        for c in chunks:
            if m := _PLAIN_WORD.fullmatch(c.decode("utf-8", "replace")):
                plain[c] = (m[1].lower().encode(), m[2].encode())
            else:
                rest.append(c)
        self.encode(rest + self.missing({p for _, p in plain.values() if p}))
        for w in self.missing({w for w, _ in plain.values()}):
            self.young[w] = packed(self.code(w.decode() + "\0"))
        for c, (w, p) in plain.items():
            self.young[c] = self.young[w] + (self.young[p] if p else b"")

    def join(self, chunks: list) -> bytes:
        """The ids of all chunks, one after another."""
        return b"".join(self.look_up(chunks))


def word_ids(text: str, ids: ChunkIds) -> bytes:
    """The word tokenizer's ids of a whole text."""
    return ids.join(text.encode("utf-8", "surrogatepass").split())


_SHARED: dict = {}
#: Objects that a worker keeps: no operator needs more at once.
KEPT = 2


def shared(kind, *args):
    """One object of a kind per worker process, kept from task to task until KEPT others were asked for."""
    key = (kind, *args)
    found = _SHARED.pop(key, None)
    if found is None:
        while len(_SHARED) >= KEPT:
            del _SHARED[next(iter(_SHARED))]
        found = kind(*args)
    _SHARED[key] = found
    return found
