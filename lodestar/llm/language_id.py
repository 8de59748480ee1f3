"""Language identification by averaged hashed subword embeddings with a linear softmax and calibrated rejection.

A text's vector is the mean of the vectors of its character n-grams; the softmax over the languages that the labels name is
trained with it by stochastic gradient descent, on random stretches of a few words to whole texts, so that short texts work
too. On texts kept from training a temperature is fitted to the scores, and the rejection bound is the score below which the
share REJECT of those texts falls, at most HIGHEST_BOUND. A text is rejected when its score is below the bound, or when it has no
letter.

The languages are those of all labelled rows outside the fifth that is held out for tests. Trained on the driver on a sample by
language: all rows of a language with at most its quota, which is the largest one with which about SAMPLE rows are taken in
all, and at least LEAST; of a longer text SAMPLE_CHARACTERS characters, from its first letter on. Every language has texts in
training, and with two or more also among those kept from it. Every whole text is predicted on the executors. Languages,
sources and doc_ids are no inputs of a prediction. A language that only held-out rows have can't be learned.

Defined results: a null text and one without a letter are und with score 0 and rejected. Without any label all texts are und.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, crc32_bucket, documents, located, released, stored
from lodestar.llm.subword import Grams, Softmax, Words, parts

ORDERS, BUCKETS, DIM = (2, 3, 4), 1 << 17, 12
#: Rows in all that the quotas of languages aim at, the least quota, and the characters of a text.
SAMPLE, LEAST, SAMPLE_CHARACTERS = 3000, 50, 30_000
STEPS, BATCH, RATE = 900, 48, 0.3
#: The share of texts kept from training that the bound rejects at most, and the highest bound.
REJECT, HIGHEST_BOUND = 0.001, 0.4
UNKNOWN = "und"

_GRAMS = Grams(ORDERS, BUCKETS)


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, bound: float) -> None:
        self.languages, self.table, self.bias, self.temperature, self.bound = languages, table, bias, temperature, bound

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for part in parts(text):
            ids = _GRAMS.of(part)[0]
            counts = np.bincount(ids, minlength=1)
            seen = np.flatnonzero(counts)
            total += counts[seen] @ self.table[seen]
            n += len(ids)
        x = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(x - x.max())
        p /= p.sum()
        return self.languages[int(p.argmax())], float(p.max())


def train(texts: list[str], names: list[str], seed: int = 5) -> LanguageModel:
    languages = sorted(set(names))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(n) for n in names])
    words = Words(_GRAMS, texts)
    there = np.array([i for i, t in enumerate(words.texts) if len(t)], np.int64)
    kept = np.zeros(len(there), bool)
    for k in range(len(languages)):
        own = rng.permutation(np.flatnonzero(y[there] == k))
        kept[own[: max(1, round(len(own) / 5))] if len(own) > 1 else own[:0]] = True
    learn, held = there[~kept], there[kept]
    if not len(learn) or not len(held):
        learn = held = there
    model = Softmax(BUCKETS, DIM, len(languages))
    by_class = [c for c in (learn[y[learn] == k] for k in range(len(languages))) if len(c)]
    for step in range(STEPS if len(learn) else 0):
        chosen = np.array([(c := by_class[rng.integers(len(by_class))])[rng.integers(len(c))] for _ in range(BATCH)])
        bags = []
        for i in chosen:
            t, n = words.texts[i], int(2 ** rng.uniform(0.5, 8))
            at = rng.integers(0, max(1, len(t) - n + 1))
            bags.append(t[at : at + n])
        ids, n = words.bag(np.concatenate(bags))
        sizes = np.add.reduceat(n, np.cumsum([0, *[len(b) for b in bags]])[:-1])
        some = sizes > 0
        if some.any():
            model.step(ids, sizes[some], y[chosen][some], RATE * (1 - step / STEPS))
    out = LanguageModel(languages, model.table(), model.b.astype(float), 1.0, 0.0)
    raw = []
    for i in held:
        ids, _ = words.bag(words.texts[i])
        raw.append((out.table[ids].mean(0) if len(ids) else 0) + out.bias)
    raw = np.array(raw).reshape(len(held), len(languages))

    def scores(temperature: float) -> np.ndarray:
        x = raw / temperature
        p = np.exp(x - x.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    if len(held):
        loss = lambda t: -np.log(scores(t)[np.arange(len(held)), y[held]] + 1e-9).mean()
        out.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        out.bound = float(min(HIGHEST_BOUND, np.quantile(scores(out.temperature).max(1), REJECT)))
    return out


def quota(counts: list[int], most: int, least: int) -> int:
    """The largest number of rows of each language with which about most are taken in all, and at least least."""
    left = most
    for i, n in enumerate(sorted(counts)):
        share = left // (len(counts) - i)
        if n > share:
            return max(share, least)
        left -= n
    return max([least, *counts])


def labelled_sample(docs: DataFrame, most: int = SAMPLE, least: int = LEAST) -> tuple[list[str], list[str]]:
    """Texts and languages of rows of every language: all of them, or about as many as the quota, by a hash of the row."""
    rows = located(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "_row").where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    rows = rows.where(crc32_bucket("doc_id", 5) != 0)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return [], []
    most_each = quota(list(counts.values()), most, least)
    below = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, most_each / n))))])
    drawn = rows.withColumn("_hash", F.pmod(F.xxhash64("doc_id", "_row", "text", F.lit(11)), F.lit(1 << 30))).where(F.col("_hash") < below[F.col("lang")])
    place = F.row_number().over(W.partitionBy("lang").orderBy("_hash"))
    drawn = drawn.withColumn("text", F.substring(F.regexp_replace("text", "^\\P{L}+", ""), 1, SAMPLE_CHARACTERS)).withColumn("_place", place)
    drawn = drawn.where(F.col("_place") <= most_each * 5 // 4).select("doc_id", "text", "lang")
    found = sorted(drawn.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))  # bounded by the quotas
    return [r["text"] for r in found], [r["lang"] for r in found]


PREDICTED = "lang_pred string, score double, rejected boolean"


def language_id(docs: DataFrame, model: LanguageModel, keys: list[str]) -> DataFrame:
    """The columns keys of docs with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col("text").alias("text"))
    schema = ", ".join([f"k{i} {t}" for i, t in enumerate(slim.schema[f"k{i}"].dataType.simpleString() for i in range(len(keys)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            kept = [batch.column(f"k{i}") for i in range(len(keys))]
            cols = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x == UNKNOWN or s < m.bound for x, s in found], pa.bool_())]
            yield pa.record_batch([*kept, *cols], [f"k{i}" for i in range(len(keys))] + ["lang_pred", "score", "rejected"])

    made = slim.mapInArrow(released(run), f"{schema}, {PREDICTED}")
    return made.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is rejected."""
    rows = located(docs)
    gone = stored(language_id(rows, train(*labelled_sample(docs)), ["_file", "_row"]).where("rejected").select("_file", "_row"), "rejected")
    return rows.join(bounded(gone), ["_file", "_row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id(docs, train(*labelled_sample(docs)), ["doc_id"])
    return found.select("doc_id", (crc32_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
