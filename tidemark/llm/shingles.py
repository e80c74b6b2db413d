"""Word-shingle sets and SetSketch registers of texts, vectorised over batches.

Words are runs of bytes without ASCII white space, A-Z in lower case. A shingle
is a 64-bit hash of five words; a set is a sorted array of distinct hashes.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bytes hashed at once, a few arrays of 8 bytes for each.
BLOCK = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_C = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of texts; keeps tables of powers."""

    def __init__(self):
        self.up = np.empty(0, dtype=np.uint64)
        self.down = np.empty(0, dtype=np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                one = np.ones(n, dtype=np.uint64)
                self.up, self.down = one.copy(), one.copy()
                self.up[1:], self.down[1:] = np.uint64(_P), np.uint64(_INVERSE)
                np.multiply.accumulate(self.up, out=self.up)
                np.multiply.accumulate(self.down, out=self.down)

    def words(self, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and the places where they begin."""
        b = np.frombuffer(blob, dtype=np.uint8)
        self.powers(len(b) + 1)
        space = np.concatenate(([True], _SPACE[b], [True]))
        change = np.flatnonzero(space[1:] != space[:-1])
        start, end = change[::2], change[1::2]
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_LOWER[b] * self.up[: len(b)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)), start

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The set of every text: of fewer than five words, the whole sequence is one shingle; without words, it is empty."""
        out: list[np.ndarray] = []
        with np.errstate(over="ignore"):
            group, size = [], 0
            for t in texts:
                raw = (t or "").encode("utf-8", "surrogatepass")
                if len(raw) > BLOCK:
                    out += self.grouped(group)
                    group, size = [], 0
                    out.append(self.shingled(np.concatenate([self.words(x)[0] for x in blocks(raw)])))
                    continue
                if size + len(raw) > BLOCK:
                    out += self.grouped(group)
                    group, size = [], 0
                group.append(raw)
                size += len(raw) + 1
            return out + self.grouped(group)

    def grouped(self, raws: list[bytes]) -> list[np.ndarray]:
        if not raws:
            return []
        w, start = self.words(b"\n".join(raws))
        edges = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws]))))
        return [self.shingled(w[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def shingled(self, w: np.ndarray) -> np.ndarray:
        if not len(w):
            return w
        k = min(SHINGLE, len(w))
        h = w[: len(w) - k + 1].copy()
        for j in range(1, k):
            h = h * _C + w[j : len(w) - k + 1 + j]
        return np.unique(mixed(h + np.uint64(k)))


def blocks(raw: bytes):
    """Pieces of about BLOCK bytes, cut at white space."""
    at = 0
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end]
        at = end


class SetSketch:
    """m registers of a set: floor(1 - log_b x), where x is the least of exponential values that a hash gives its elements.

    Registers of a union are the larger ones of both. With b near 1 they agree as
    often as minima do; values fit 16 bits.
    """

    def __init__(self, m: int = 128, b: float = 1.001, a: float = 20.0, q: int = 65_534, seed: int = 3):
        self.m, self.b, self.a, self.q = m, b, a, q
        r = np.random.Generator(np.random.Philox(key=seed))
        self.xor = r.integers(0, 1 << 64, m, dtype=np.uint64)
        self.odd = r.integers(0, 1 << 64, m, dtype=np.uint64) | np.uint64(1)
        self.buffer = np.empty((256, m), dtype=np.uint64)

    def registers(self, s: np.ndarray) -> np.ndarray:
        least = np.full(self.m, np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(s), 256):
                part = s[i : i + 256]
                buffer = self.buffer[: len(part)]
                np.bitwise_xor(part[:, None], self.xor, out=buffer)
                np.multiply(buffer, self.odd, out=buffer)
                np.minimum(least, buffer.min(axis=0), out=least)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64.001) / self.a
        return np.clip(np.floor(1 - np.log(x) / np.log(self.b)), 0, self.q + 1).astype(np.uint16)

    def jaccard(self, x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, steps: int = 201) -> np.ndarray:
        """Likeliest similarity of pairs (rows of registers) of sets of known sizes, from how many registers are above, below and equal."""
        above, below = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
        u = (n_x / (n_x + n_y))[:, None]
        j = np.linspace(0, 1, steps)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)
        p = lambda t: -np.log1p(-np.clip(t, 0, 1) * (self.b - 1) / self.b) / np.log(self.b)
        up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
        log = lambda t: np.log(np.maximum(t, 1e-12))
        fit = above * log(up) + below * log(down) + (self.m - above - below) * log(1 - up - down)
        return j[np.arange(len(j)), fit.argmax(axis=1)]
