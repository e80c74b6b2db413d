"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds
(multiplies) its letters' vectors, each permuted (rolled) by its place. A
document bundles (adds) its trigrams' vectors; a language's prototype bundles
those of its training documents. A document's language is the prototype of
highest cosine. Bundling is linear, so each task adds up its own documents and
only one whole vector per language and task is shuffled; the counts are whole
numbers, so their sums do not depend on order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table
from tidemark.llm.tokens import shared

DIMENSIONS = 1_024
SEED = 11
#: Documents and characters that are compared at once, trigrams whose vectors are held at once.
DOCS_AT_ONCE = 256
CHARS_AT_ONCE = 1 << 20
GRAMS_AT_ONCE = 8_192
UNKNOWN = "und"


class Profiles:
    """Letter and trigram vectors of a worker."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.fold = np.full(0x110000, 32, dtype=np.int64)
        for cp in range(0x110000):
            if (c := chr(cp)).isalpha():
                self.fold[cp] = ord(c.lower()[0])

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, cp])).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[cp] = (2 * bits - 1).astype(np.int8)
        return self.letters[cp]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams (21 bits a letter) and their counts; None without a letter. Runs of other characters are one blank."""
        cp = self.fold[np.frombuffer((" " + (text or "") + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        blank = cp == 32
        cp = cp[~(blank & np.concatenate(([False], blank[:-1])))]
        if len(cp) < 3:
            return None
        return np.unique((cp[:-2] << 42) | (cp[1:-1] << 21) | cp[2:], return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """One row per trigram."""
        low = (1 << 21) - 1
        out = None
        for shift, roll in ((42, 2), (21, 1), (0, 0)):
            own, at = np.unique((grams >> shift) & low, return_inverse=True)
            rows = np.stack([np.roll(self.letter(int(c)), roll) for c in own])[at]
            out = rows if out is None else out * rows
        return out.astype(np.float32)

    def bundles(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One row per document: the sum of its trigrams' vectors."""
        every, at = np.unique(np.concatenate([g for g, _ in docs]), return_inverse=True)
        doc = np.repeat(np.arange(len(docs)), [len(g) for g, _ in docs])
        n = np.concatenate([c for _, c in docs])
        out = np.zeros((len(docs), self.dimensions), dtype=np.float64)
        for lo in range(0, len(every), GRAMS_AT_ONCE):
            here = (at >= lo) & (at < lo + GRAMS_AT_ONCE)
            counts = np.zeros((len(docs), min(GRAMS_AT_ONCE, len(every) - lo)), dtype=np.float32)
            counts[doc[here], at[here] - lo] = n[here]
            out += counts @ self.vectors(every[lo : lo + GRAMS_AT_ONCE])
        return out


def groups(texts: list, most: int = DOCS_AT_ONCE, chars: int = CHARS_AT_ONCE):
    """Ranges of texts that are worked on together; a long text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and (i - lo >= most or size + n > chars):
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def held_out(id_col: Column) -> Column:
    """Documents that nothing is learnt from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language. Rows without language or letters teach nothing.

    What comes to the driver is one vector per language, of DIMENSIONS numbers.
    """

    def add(batches):
        p = shared(Profiles)
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in groups(texts):
                by: dict[str, list] = {}
                for i in range(lo, hi):
                    if (g := p.grams(texts[i])) is not None:
                        by.setdefault(langs[i], []).append(g)
                for lang, grams in by.items():
                    g, at = np.unique(np.concatenate([x for x, _ in grams]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([c for _, c in grams])).astype(np.int64)
                    sums[lang] = sums.get(lang, 0) + np.rint(p.bundles([(g, n)])[0]).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(v), pa.string()), "at": pa.array(range(len(v)), pa.int32()), "v": pa.array(v, pa.int64())})

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    summed = known.mapInArrow(add, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sorted(summed, key=lambda r: r.lang):
        out.setdefault(r.lang, np.zeros(DIMENSIONS))[r["at"]] = r.v
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (cosine with the prototype, 0 to 1) in place of any columns of these names.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text when nothing was learnt. Equal cosines go to the first language by name.
    """
    names = sorted(prototypes)
    weights = docs.sparkSession.sparkContext.broadcast(np.stack([prototypes[k] / max(np.linalg.norm(prototypes[k]), 1e-9) for k in names]) if names else None)

    def identify(batches):
        p, w = shared(Profiles), weights.value
        for batch in slices(batches):
            texts = batch.column("__text").to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo, hi in groups(texts) if w is not None else ():
                found = [(i, g) for i in range(lo, hi) if (g := p.grams(texts[i])) is not None]
                if found:
                    v = p.bundles([g for _, g in found])
                    cos = (v @ w.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    for (i, _), k, row in zip(found, cos.argmax(axis=1), cos, strict=True):
                        lang[i], score[i] = names[k], min(1.0, max(0.0, row[k]))
            batch = batch.drop_columns(["__text"])
            yield batch.append_column("lang_pred", pa.array(lang, pa.string())).append_column("score", pa.array(score, pa.float64()))

    rows = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double"
    return rows.withColumn("__text", F.col(text_col)).mapInArrow(identify, fields)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_pred and score, learnt from its own rows that are not held out. Other columns stay as they are."""
    return predict(docs, learn(docs.where(~held_out(F.col(id_col))), text_col, lang_col), text_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), prototypes).drop("text")


QUERIES = {"op9_language_id": op9_language_id}
