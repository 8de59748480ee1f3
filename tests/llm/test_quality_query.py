"""The quality query against a model counted in dictionaries, document by document."""

import zlib
from collections import Counter, defaultdict
from statistics import NormalDist, mean, stdev

import numpy as np
import pytest
from conftest import SF

from lodestar.llm import quality as Q


def cuts(counts):
    k = [sum(v == i for v in counts) for i in range(1, 5)]
    y = k[0] / (k[0] + 2 * k[1]) if k[0] else 0
    return [0.0] + [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0), i) if k[i - 1] else 0.5 for i in range(1, 4)]


class Plain:
    """Interpolated modified Kneser-Ney over symbols, Witten-Bell over code points within them."""

    def __init__(self, texts):
        four, self.seen, self.follow = Counter(), Counter(), defaultdict(set)
        for t in texts:
            s, c = self.padded(t)
            four.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
            for i in range(3, len(s)):
                if s[i] >= Q.MANY:
                    for n in range(4):
                        context = (s[i], *c[i - n : i])
                        self.seen[context, c[i]] += 1
                        self.follow[context].add(c[i])
        self.of_context = Counter()
        for (context, _), n in self.seen.items():
            self.of_context[context] += n
        self.counts = {4: four}
        for n in (3, 2, 1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.cut = {n: cuts(list(c.values())) for n, c in self.counts.items()}
        self.total, self.held = defaultdict(Counter), defaultdict(Counter)
        for n, c in self.counts.items():
            for g, v in c.items():
                self.total[n][g[:-1]] += v
                self.held[n][g[:-1]] += self.cut[n][min(v, 3)]
        self.size = np.bincount(Q.symbols())

    @staticmethod
    def padded(text):
        s, c = Q.spelled(text)
        c = [32 if a == 1 else 48 if a == 2 else b for a, b in zip(s.tolist(), c.tolist(), strict=True)]
        return [0] * 3 + s.tolist(), [0] * 3 + c

    def p(self, n, g):
        if not n:
            return 1 / 64
        low, total = self.p(n - 1, g[1:]), self.total[n][g[:-1]]
        if not total:
            return low
        own = self.counts[n][g]
        return (own - self.cut[n][min(own, 3)]) / total + self.held[n][g[:-1]] / total * low

    def perplexity(self, text):
        s, c = self.padded(text)
        if len(s) == 3:
            return None
        total = 0.0
        for i in range(3, len(s)):
            total += np.log(self.p(4, tuple(s[i - 3 : i + 1])))
            if s[i] >= Q.MANY:
                p = 1 / self.size[s[i]]
                for n in range(4):
                    context = (s[i], *c[i - n : i])
                    if self.of_context[context]:
                        kinds = len(self.follow[context])
                        p = (self.seen[context, c[i]] + kinds * p) / (self.of_context[context] + kinds)
                total += np.log(p)
        return float(np.exp(-total / (len(s) - 3)))


def test_query_equals_a_brute_force_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    part = {i: zlib.crc32(str(i).encode()) % Q.HELD for i in docs.doc_id}
    text, lang = dict(zip(docs.doc_id, docs.text, strict=True)), dict(zip(docs.doc_id, docs.lang, strict=True))
    models = [Plain([t for i, t in text.items() if i in good and part[i] != f]) for f in range(Q.HELD)]
    wanted = {i: models[part[i]].perplexity(t) for i, t in text.items()}
    found = {r["doc_id"]: r for r in Q.op1_quality(spark, SF).collect()}
    assert found.keys() == text.keys()
    for i, p in wanted.items():
        assert (found[i]["perplexity"] is None) == (p is None) and (p is None or found[i]["perplexity"] == pytest.approx(p, rel=1e-4)), i
    z = NormalDist().inv_cdf(Q.HIGH)

    def ends(ids):
        p = [wanted[i] for i in ids if wanted[i] is not None]
        log = np.log(p)
        spread = z * stdev(log) if len(p) > 1 else 0.0
        return min(*p, np.exp(mean(log) - spread), 9e9), max(*p, np.exp(mean(log) + spread), 0), max(Q.ECHO_SLACK * max(Q.echo(text[i]) for i in ids if wanted[i] is not None), Q.LEAST_ECHO)

    of = {None: ends(good & text.keys())} | {x: ends([i for i in good if lang.get(i) == x]) for x in {lang[i] for i in good if i in lang} - {None}}
    for i, r in found.items():
        low, high, echo = of.get(lang[i], of[None])
        assert (r["low"], r["high"], r["most_echo"]) == (pytest.approx(low, rel=1e-4), pytest.approx(high, rel=1e-4), pytest.approx(echo))
        near = wanted[i] is not None and min(abs(wanted[i] / low - 1), abs(wanted[i] / high - 1)) < 1e-3
        assert near or r["kept"] == (wanted[i] is not None and low <= wanted[i] <= high and Q.echo(text[i]) <= echo), i
