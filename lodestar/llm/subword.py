"""Bags of hashed character n-grams, their embeddings and a linear softmax, trained together in numpy.

A word's vectors are those of its character n-grams, word bounds included, so a misspelt word keeps most of them. A bag's
vector is the mean of its n-grams' vectors; the softmax is linear in it. After training an n-gram's vector times the softmax's
weights is one number for each class, so a text is scored by a table look-up and a mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text that are turned into n-grams at once.
CHARACTERS_AT_ONCE = 500_000

_ALNUM: np.ndarray | None = None


def alnum() -> np.ndarray:
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _ALNUM


class Grams:
    """Hashed n-grams of the words (runs of letters and digits) of lower-cased texts."""

    def __init__(self, orders: tuple[int, ...], buckets: int) -> None:
        rng = np.random.default_rng(7)
        self.orders, self.buckets = orders, buckets
        self.odd = {n: (rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)) for n in orders}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """n-gram ids, the word (from 0) of each, and the number of words."""
        codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = alnum()[codes]
        c = np.where(inside, codes, 0)
        word = np.cumsum(inside[1:] & ~inside[:-1])
        word = np.concatenate([[0], word]) - 1
        ids, words = [], []
        for n in self.orders:
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint32)
            ok = inside[1 : m + 1].copy() if n > 2 else inside[:m] | inside[1 : m + 1]
            for k in range(n):
                h += c[k : k + m] * self.odd[n][k]
                if 1 < k < n - 1:
                    ok &= inside[k : k + m]
            at = np.flatnonzero(ok)
            h = h[at]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            ids.append((h % np.uint32(self.buckets)).astype(np.int64))
            words.append(word[at + (~inside[at])])
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        return np.concatenate(ids), np.concatenate(words), int(word[-1]) + 1


def parts(text: str) -> Iterator[str]:
    """A text in parts of about CHARACTERS_AT_ONCE, cut at white space where there is some within the next part."""
    at = 0
    while at < len(text):
        end = at + CHARACTERS_AT_ONCE
        if end < len(text):
            space = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = space if space > at else end
        yield text[at:end]
        at = end


class Words:
    """Distinct words of texts with their n-grams, and texts as arrays of words: what a bounded training sample needs."""

    def __init__(self, grams: Grams, texts: list[str]) -> None:
        number: dict[str, int] = {}
        self.texts = []
        table = alnum()
        for text in texts:
            codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            clean = np.where(table[codes], codes, 32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            self.texts.append(np.array([number.setdefault(w, len(number)) for w in clean.split()], np.int64))
        ids, words, n = grams.of(" ".join(number))
        order = np.argsort(words, kind="stable")
        self.ids = ids[order]
        self.begin = np.searchsorted(words[order], np.arange(n + 1))

    def bag(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of words, and how many each word has."""
        n = self.begin[words + 1] - self.begin[words]
        at = np.repeat(self.begin[words] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
        return self.ids[at], n


class Softmax:
    """Embeddings and weights, trained by stochastic gradient descent with per-coordinate step sizes.

    active: the buckets that are learned; the vectors of others stay 0.
    """

    def __init__(self, buckets: int, dim: int, classes: int, seed: int = 1, active: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(seed)
        self.e = ((rng.random((buckets, dim)) - 0.5) / dim).astype(np.float32)
        self.active = active
        if active is not None:
            self.e[~active] = 0
        self.w = (rng.random((dim, classes)) - 0.5).astype(np.float32)
        self.b = np.zeros(classes, np.float32)
        self.ge, self.gw, self.gb = np.full(buckets, 1e-6, np.float32), np.full(self.w.shape, 1e-6, np.float32), np.full(classes, 1e-6, np.float32)

    def step(self, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray, rate: float, weight: np.ndarray | None = None) -> float:
        """One update on bags (their n-grams one after the other, sizes > 0) with classes y; the mean loss before it."""
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = np.add.reduceat(self.e[ids], begin) / sizes[:, None]
        p = self._softmax(h @ self.w + self.b)
        loss = -np.log(p[np.arange(len(y)), y] + 1e-9).mean()
        p[np.arange(len(y)), y] -= 1
        if weight is not None:
            p *= weight[:, None]
        p /= len(y)
        gw, gb, gh = h.T @ p, p.sum(0), (p @ self.w.T) / sizes[:, None]
        unique, inverse = np.unique(ids, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        ge = np.add.reduceat(np.repeat(gh, sizes, 0)[order], np.searchsorted(inverse[order], np.arange(len(unique))))
        if self.active is not None:
            ge *= self.active[unique][:, None]
        self.ge[unique] += (ge * ge).mean(1)
        self.e[unique] -= (rate / np.sqrt(self.ge[unique]))[:, None] * ge
        self.gw += gw * gw
        self.w -= rate / np.sqrt(self.gw) * gw
        self.gb += gb * gb
        self.b -= rate / np.sqrt(self.gb) * gb
        return float(loss)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(-1, keepdims=True))
        return x / x.sum(-1, keepdims=True)

    def table(self) -> np.ndarray:
        """Each n-gram's share of the class scores."""
        return (self.e @ self.w).astype(np.float32)


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About most of the rows at random by a hash of key, and no more than 1.25 times as many; all of them if they are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * most / n)).limit(most * 5 // 4)
