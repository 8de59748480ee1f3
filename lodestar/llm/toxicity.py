"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Labels are weak: a toxic text is toxic somewhere. Training starts on stretches of texts and goes on in rounds over windows of
WINDOW words: of a toxic text the window that scores highest is taken as toxic, of other texts the highest and random ones as
not toxic. n-grams in fewer than TEXTS texts aren't learned, since in small samples chance alone gives them a label. A text's
score comes from its whole averaged bag and from its highest window, by a logistic curve fitted on texts kept from training: on
one part of FOLDS if it has ENOUGH toxic texts, else on all parts in turn, with a model trained on all texts at the end.

Trained on the driver, on at most SAMPLE labelled texts of each label with up to SAMPLE_CHARACTERS characters; every whole
text is scored on the executors. Labels, languages, sources and doc_ids are no inputs of a score.

Defined results: a null text, an empty one and one without letters or digits score as the lowest features among the texts of
the calibration do. Of rows that share a doc_id one is learned from, a label that comes twice is the larger one, and null labels
and doc_ids teach nothing. Without labels of both kinds the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import crc32_bucket, documents
from lodestar.llm.subword import Grams, Softmax, Words, parts, sampled

ORDERS, BUCKETS, DIM, WINDOW = (3, 4, 5, 6), 1 << 18, 8, 4
SAMPLE, SAMPLE_CHARACTERS = 2500, 30_000
ROUNDS, RATE, THRESHOLD = 6, 0.3, 0.3
#: Texts that an n-gram must be in to be learned, steps of each stage of training at least, and words of a text in its first one.
TEXTS, STEPS, STRETCH = 3, 60, 128
#: Parts for cross-validation, and toxic texts in one part that are enough to calibrate on that part alone.
FOLDS, ENOUGH = 5, 50

_GRAMS = Grams(ORDERS, BUCKETS)


def window_scores(sums: np.ndarray, counts: np.ndarray, bias: float) -> np.ndarray:
    """Score of each window of WINDOW words (of the whole text, if it is shorter) from the words' sums and n-gram counts."""
    if not len(sums):
        return np.zeros(0)
    n = min(WINDOW, len(sums))
    s, c = (np.concatenate([[0], np.cumsum(x, dtype=np.float64)]) for x in (sums, counts))
    return (s[n:] - s[:-n]) / np.maximum(c[n:] - c[:-n], 1) + bias


class Toxicity:
    """A trained model: a number for each n-gram, and the calibration of a text's features: its whole bag's score and its highest window's."""

    def __init__(self, table: np.ndarray, bias: float, curve: np.ndarray, floor: np.ndarray) -> None:
        self.table, self.bias, self.curve, self.floor = table, bias, curve, floor

    def features(self, text: str) -> np.ndarray:
        sums, counts = [], []
        for part in parts(text):
            ids, words, n = _GRAMS.of(part)
            sums.append(np.bincount(words, self.table[ids], n))
            counts.append(np.bincount(words, minlength=n))
        return features(np.concatenate(sums), np.concatenate(counts), self.bias) if sums and sum(map(len, sums)) else self.floor

    def score(self, text: str) -> float:
        return float(probability(self.features(text)[None], self.curve)[0])


def features(sums: np.ndarray, counts: np.ndarray, bias: float) -> np.ndarray:
    return np.array([sums.sum() / max(counts.sum(), 1) + bias, window_scores(sums, counts, bias).max()])


def probability(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -40, 40)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes (not negative) and intercept of a logistic curve by Newton's method with a small penalty on the slopes."""
    use = np.arange(x.shape[1])
    while True:
        scale = x[:, use].std(0) + 1e-6
        f = np.column_stack([x[:, use] / scale, np.ones(len(x))])
        b, penalty = np.zeros(f.shape[1]), np.diag([1e-2] * len(use) + [1e-6])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(f @ b, -30, 30)))
            h = (f * (weight * p * (1 - p))[:, None]).T @ f + penalty
            b -= np.clip(np.linalg.solve(h, f.T @ (weight * (p - y)) + penalty @ b), -2, 2)
        out = np.zeros(x.shape[1] + 1)
        out[use], out[-1] = b[:-1] / scale, b[-1]
        if (b[:-1] >= 0).all():
            return out
        use = use[b[:-1] > 0]


def fit(words: Words, y: np.ndarray, learn: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A number for each n-gram and the bias, from the texts in learn: whole texts first, then rounds over windows."""
    seen = np.zeros(BUCKETS, np.int32)
    for i in learn:
        seen[np.unique(words.bag(np.unique(words.texts[i]))[0])] += 1
    model = Softmax(BUCKETS, DIM, 2, active=seen >= TEXTS)

    def pass_over(whole: list[np.ndarray], labels: np.ndarray, rate: float, steps: int, stretch: int = WINDOW) -> None:
        size, done = 64, 0
        while done < steps:
            order, begin = rng.permutation(len(whole)), rng.random(len(whole))
            bags = [t[(a := int(u * max(1, len(t) - stretch + 1))) : a + stretch] for t, u in zip(whole, begin, strict=True)]
            for at in range(0, len(order), size):
                chosen = order[at : at + size]
                ids, n = words.bag(np.concatenate([bags[i] for i in chosen]))
                bounds = np.cumsum([0, *[len(bags[i]) for i in chosen]])
                sizes = np.add.reduceat(n, bounds[:-1])
                some = sizes > 0
                done += 1
                if some.any():
                    own = labels[chosen][some]
                    even = np.where(own == 1, 0.5 / max(own.mean(), 0.05), 0.5 / max(1 - own.mean(), 0.05))
                    model.step(ids, sizes[some], own, rate, even)

    pass_over([words.texts[i] for i in learn], y[learn], RATE, max(STEPS, 3 * len(learn) // 64), STRETCH)
    for r in range(ROUNDS):
        found, bags, labels = per_text(words, model.table(), model.b), [], []
        for i in learn:
            t, s = words.texts[i], window_scores(*found(i))
            picks = [int(s.argmax())]
            if y[i] == 0:
                picks += rng.integers(0, len(s), 3).tolist()
            bags += [t[k : k + WINDOW] for k in picks]
            labels += [y[i]] * len(picks)
        pass_over(bags, np.array(labels), RATE / (1 + r), max(STEPS, 2 * len(bags) // 64))
    own = model.table()
    return own[:, 1] - own[:, 0], float(model.b[1] - model.b[0])


def per_text(words: Words, table: np.ndarray, b: np.ndarray):
    """From a text's place to its words' sums and counts and the bias."""
    gap = table[:, 1] - table[:, 0] if table.ndim == 2 else table
    per_word = np.add.reduceat(np.append(gap[words.ids], 0), words.begin[:-1]) if len(words.begin) > 1 else np.zeros(0)
    count = np.diff(words.begin)
    per_word, bias = np.where(count > 0, per_word, 0), float(b[1] - b[0]) if np.ndim(b) else float(b)
    return lambda i: (per_word[words.texts[i]], count[words.texts[i]], bias)


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 3) -> Toxicity | None:
    """weight: how many texts of the corpus a text stands for, for the calibration. None if no text with words has one of the labels."""
    rng, words = np.random.default_rng(seed), Words(_GRAMS, texts)
    there = np.array([i for i in range(len(texts)) if len(words.texts[i])], np.int64)
    if len(set(y[there])) < 2:
        return None
    fold = np.full(len(texts), -1)
    for v in (0, 1):  # each label is dealt out evenly
        own = rng.permutation(there[y[there] == v])
        fold[own] = np.arange(len(own)) % FOLDS
    kept = int((y[there] == 1).sum()) // FOLDS
    tried = range(1 if kept >= ENOUGH else FOLDS)
    x, labels, weights, made = [], [], [], None
    for k in tried:
        learn, held = there[fold[there] != k], there[fold[there] == k]
        if len(set(y[learn])) < 2 or not len(held):
            continue
        made = fit(words, y, learn, rng)
        found = per_text(words, *made)
        x += [features(*found(i)) for i in held]
        labels += y[held].tolist()
        weights += weight[held].tolist()
    if len(tried) > 1 or made is None:
        made = fit(words, y, there, rng)
    if len(set(labels)) < 2:
        found = per_text(words, *made)
        x, labels, weights = [features(*found(i)) for i in there], y[there].tolist(), weight[there].tolist()
    x, weights = np.array(x), np.array(weights)
    return Toxicity(*made, calibrate(x, np.array(labels, float), weights / weights.mean()), x.min(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most 1.25 * most rows of each label; the labels are sampled first, so the join is small."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    known = known.where(crc32_bucket("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [sampled(known.where(F.col("toxic") == v), "doc_id", most) for v in (0, 1)]
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= SAMPLE_CHARACTERS)
    one = F.min_by("text", F.xxhash64("text"))  # rows of one doc_id count once
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "toxic").agg(one.alias("text")).collect()  # bounded by most
    rows.sort()
    y = np.array([r["toxic"] for r in rows], np.int64)
    share = [max(1, int((y == v).sum())) for v in (0, 1)]
    return [r["text"] for r in rows], y, np.array([total.get(int(v), 0) / share[v] for v in y], float)


SCORED = "doc_id long, score double"


def toxicity(docs: DataFrame, model: Toxicity | None) -> DataFrame:
    """doc_id and score of each row of docs."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([m.score(t.as_py() or "") for t in batch.column("text")], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(*labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity(docs, model).select("doc_id", (crc32_bucket("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
