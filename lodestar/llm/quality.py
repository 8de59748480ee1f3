"""Quality by an interpolated modified Kneser-Ney model over characters, trained on trusted text, and by echoes of words.

A character's probability has two factors. The first is that of its symbol in an alphabet of 64 (letters as they are, digits,
white space and rarer signs by class), so an n-gram of symbols is a number of 6 n bits, and everything below the highest order,
4, has at most 64^3 entries whatever the corpus holds. The second, for the two symbols that stand for many code points (other
letters, other signs), is that of the code point within its symbol, given up to three code points before it, by Witten and
Bell's interpolation over hashed n-grams of code points; so text of any script is told apart. Digits and white space are one
symbol each.

1. All trusted texts are counted: 4-grams of symbols by their number, pre-added in each task; shorter ones by how many symbols
   come before them. Three discounts for each order come from the counts of counts. n-grams that end in a code point of the two
   symbols are counted for all orders, and their contexts by number and by how many code points follow.
2. Documents are scored by sharded joins. A block of ROWS rows asks once for each n-gram that it has, dealt out over SHARDS, or
   over SPELLED of code points; each shard of questions meets the same shard of the counts, BLOCKS blocks at a time, and the
   answer goes back to its block, where it meets the block's texts, compressed. Only the lower orders' tables of symbols, of a fixed size, are broadcast.
3. Four characters can't show that a word follows itself. A text's echo is the share of its word pairs that also begin at one of
   the ECHOES words before, so texts that stutter or go round in a short circle have one near 1.
4. Rows fall into HELD parts by doc_id, and there are HELD models, each counted from the trusted texts of all parts but one. Every
   document is scored once, by the model that hasn't seen its part. So trusted texts have the perplexities of texts that the
   model doesn't know, as all others have, and one pair of bounds fits both.
5. A document is kept if its perplexity lies between two quantiles of that of the trusted texts of its language: those counted, or
   those of a log-normal distribution fitted to them where these lie further out, since few texts don't show a quantile of one in a
   thousand. And its echo isn't above the upper one of theirs, widened by ECHO_SLACK since it is one of few texts', or LEAST_ECHO if that is more;
   languages without trusted texts are held to those of all.

Trusted are the rows that the labels give quality 1, all of them. Parts are counted apart, and a model is the sum of all less one
part, so no text is counted twice. Where one part has all trusted texts (a single one, say) the model of all scores it too.

Defined results: a null text, an empty one and one of white space have no perplexity and aren't kept. Every row of the input
gives one row; without trusted text nothing has a perplexity, and what has any text is kept. Words are runs of letters and
digits; a script without spaces has few, so its stutters show in perplexity alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, crc32_bucket, documents, located, released, stored

ORDER, ROWS, SHARDS = 4, 1024, 64
#: Characters of a block's part, and blocks whose questions meet one copy of a shard of the counts.
PART, BLOCKS = 8_000_000, 4096
#: Parts of the rows, each of which is scored by a model that is counted from the trusted rows of the others.
HELD = 4
LOW, HIGH, ECHO_SLACK = 0.001, 0.999, 1.25
CODES, LOWER = 1 << 24, 1 << 18
#: The first symbol that stands for many code points, and shards of n-grams of code points.
MANY, SPELLED = 62, 512
#: Words before a pair of words at which an equal one counts as an echo, and a bound of echoes below which no quantile goes.
ECHOES, LEAST_ECHO = 16, 0.1

_P = np.random.default_rng(99).integers(0, 2**62, 3, np.uint64) * np.uint64(2) + np.uint64(1)

_SYMBOLS: np.ndarray | None = None


def symbols() -> np.ndarray:
    """Symbol of each code point: 0 a text's start, 1 white space, 2 digits, 3 to 28 a to z, then signs and letters by class."""
    global _SYMBOLS
    if _SYMBOLS is None:
        signs, letters = ".,;:!?'\"()-/|*#$%&@<>=_", "äöüßéèêàáóíñç"
        table = np.full(0x110000, 63, np.uint8)
        for c in range(0x110000):
            x = chr(c)
            if x.isspace():
                table[c] = 1
            elif x.isdigit():
                table[c] = 2
            elif x.isalpha():
                table[c] = 62
        for i, x in enumerate("abcdefghijklmnopqrstuvwxyz" + signs[: 33 - len(letters)] + letters):
            table[ord(x)] = 3 + i
        _SYMBOLS = table
    return _SYMBOLS


def spelled(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's symbols and code points in lower case, runs of white space as one, none at its ends."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols()[c]
    space = s == 1
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    s, c = s[keep], c[keep]
    cut = slice(int(len(s) and s[0] == 1), len(s) - int(len(s) > 1 and s[-1] == 1)) if len(s) else slice(0)
    return s[cut], c[cut]


def written(text: str | None) -> np.ndarray:
    return spelled(text)[0]


def hashed(s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of symbols that stand for many code points; hashes of the n-grams that end there and of their contexts, a row for each order."""
    at = np.flatnonzero(s >= MANY)
    c = np.where(s == 1, 32, np.where(s == 2, 48, c)).astype(np.uint64)
    c = np.concatenate([np.zeros(ORDER - 1, np.uint64), c])
    grams, contexts = np.empty((ORDER, len(at)), np.uint64), np.empty((ORDER, len(at)), np.uint64)
    with np.errstate(over="ignore"):
        h = (s[at].astype(np.uint64) + np.uint64(1)) * _P[0]  # the symbol itself is known
        for n in range(ORDER):
            if n:
                h = (h ^ c[at + ORDER - 1 - n]) * _P[0]
                h ^= h >> np.uint64(29)
            for out, x in ((contexts, np.uint64(n)), (grams, (c[at + ORDER - 1] + np.uint64(1)) << np.uint64(3) | np.uint64(n))):
                g = (h ^ x * _P[1]) * _P[2]
                g ^= g >> np.uint64(32)
                out[n] = g * _P[1]
    return at, grams, contexts


def spelling(symbol: np.ndarray, n: np.ndarray, total: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Probability of code points within their symbol, from the counts of n-grams and contexts, a row for each order."""
    p = 1 / np.bincount(symbols(), minlength=64)[symbol]
    for k in range(ORDER):
        p = np.where(total[k] > 0, (n[k] + types[k] * p) / np.maximum(total[k] + types[k], 1), p)
    return p


def echo(text: str | None) -> float:
    """The share of a text's word pairs that are equal to one which begins at most ECHOES words before."""
    number: dict[str, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in re.findall(r"\w+", (text or "").lower())], np.int64)
    pairs = w[:-1] * len(number) + w[1:]
    same = np.zeros(len(pairs), bool)
    for k in range(1, min(ECHOES, len(pairs) - 1) + 1):
        same[k:] |= pairs[k:] == pairs[:-k]
    return float(same.sum() / (len(pairs) + 1))


def codes(s: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each symbol; before the text there are starts."""
    p = np.concatenate([np.zeros(ORDER - 1, np.uint32), s.astype(np.uint32)])
    n = len(s)
    return p[:n] << 18 | p[1 : n + 1] << 12 | p[2 : n + 2] << 6 | p[3 : n + 3]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CODES, np.int32)
    for batch in batches:
        for text in batch.column("text"):
            found, n = np.unique(codes(written(text.as_py())), return_counts=True)
            total[found] += n.astype(np.int32)
    some = np.flatnonzero(total)
    for a in range(0, len(some), 100_000):
        yield pa.record_batch([pa.array(some[a : a + 100_000].astype(np.int32)), pa.array(total[some[a : a + 100_000]].astype(np.int64))], ["gram", "n"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text"):
            s, c = spelled(text.as_py())
            if (s >= MANY).any():
                _, grams, contexts = hashed(s, c)
                some, first, n = np.unique(grams.reshape(-1), return_index=True, return_counts=True)
                yield pa.record_batch([pa.array(some.view(np.int64)), pa.array(contexts.reshape(-1)[first].view(np.int64)), pa.array(n.astype(np.int64))], ["key", "context", "n"])


def discounts(ones: dict[int, int]) -> np.ndarray:
    """What is taken from counts of one, two, and three or more, from how many n-grams have each count up to four."""
    k = [ones.get(i, 0) for i in range(1, 5)]
    y = k[0] / (k[0] + 2 * k[1]) if k[0] else 0.0
    d = [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0.0), float(i)) if k[i - 1] else 0.5 for i in range(1, 4)]
    return np.array([0.0, *d])


def lower_orders(trigrams: np.ndarray) -> np.ndarray:
    """Interpolated probability of each 3-gram, from how many symbols come before it (0: never seen)."""
    p = np.full(1, 1 / 64)
    counts = [trigrams]
    for n in (2, 1):
        counts.insert(0, (counts[0].reshape(64, -1) > 0).sum(0))
    for c in counts:
        size = len(c)
        d = discounts(dict(zip(*np.unique(c[(c > 0) & (c < 5)], return_counts=True), strict=True)))
        cut = np.where(c > 0, d[np.minimum(c, 3)], 0.0)
        by_context = c.reshape(-1, 64).sum(1)
        weight = np.divide(cut.reshape(-1, 64).sum(1), by_context, out=np.ones(size // 64), where=by_context > 0)
        own = np.divide(c - cut, np.repeat(by_context, 64), out=np.zeros(size), where=np.repeat(by_context, 64) > 0)
        p = own + np.repeat(weight, 64) * np.resize(p, size)
    return p


class Model:
    """4-gram counts as a table over the cluster, arrays of fixed size for all that lies below, and a table of the counts of code points."""

    def __init__(self, counts: DataFrame, lower: np.ndarray, total: np.ndarray, weight: np.ndarray, cut: np.ndarray, spellings: DataFrame) -> None:
        self.counts, self.spellings, self.small = counts, spellings, (lower.astype(np.float32), total.astype(np.float64), weight.astype(np.float32), cut)


def counted(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gram and its count without each part (without: array of HELD and, last, the count of all); the same of key and context, for code points. trusted: part, text."""
    by_part = lambda run, kinds: reduce(DataFrame.unionByName, [trusted.where(F.col("part") == f).select("text").mapInArrow(run, kinds).withColumn("part", F.lit(f)) for f in range(HELD)])
    without = F.array(*[F.sum(F.when(F.col("part") != f, F.col("n")).otherwise(0)) for f in range(HELD)], F.sum("n")).alias("without")
    grams = stored(by_part(_count, "gram int, n long").groupBy("gram").agg(without), "grams")
    found = stored(by_part(_spell, "key long, context long, n long").groupBy("key", "context").agg(without), "spellings")
    return grams, found


def train(grams: DataFrame, found: DataFrame, part: int = HELD) -> Model | None:
    """The model of all parts but one, or of all."""
    n = F.col("without")[part].alias("n")
    counts = grams.select("gram", n).where("n > 0")
    ones = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}  # four numbers
    cut = discounts(ones)
    d = F.when(F.col("n") == 1, float(cut[1])).when(F.col("n") == 2, float(cut[2])).otherwise(float(cut[3]))
    preceded, total, held = np.zeros(LOWER, np.int64), np.zeros(LOWER), np.zeros(LOWER)
    for key, own, outs in ((F.col("gram") % LOWER, [F.count("*")], [preceded]), (F.shiftright("gram", 6), [F.sum("n"), F.sum(d)], [total, held])):
        sums = counts.groupBy(key.alias("k")).agg(*[x.alias(f"s{i}") for i, x in enumerate(own)]).toArrow()  # at most 64^3 rows
        for i, out in enumerate(outs):
            out[sums.column("k").to_numpy()] = sums.column(f"s{i}").to_numpy()
    if not preceded.any():
        return None
    some = found.select("key", "context", n).where("n > 0")
    spellings = some.select("key", "n", F.lit(0).cast("long").alias("types")).union(some.groupBy("context").agg(F.sum("n"), F.count("*")))
    return Model(counts, lower_orders(preceded), total, np.divide(held, total, out=np.ones(LOWER), where=total > 0), cut, spellings)


def interpolated(small: tuple, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probability of 4-grams with their counts (0: never seen)."""
    lower, total, weight, cut = small
    context = grams >> 6
    seen = np.divide(n - cut[np.minimum(n, 3)], total[context], out=np.zeros(len(n)), where=n > 0)
    return seen + weight[context] * lower[grams & LOWER - 1]


def shard_of(gram: Column) -> Column:
    return F.shiftright((gram.cast("long") * 2654435761) % (1 << 32), 26).cast("int")


def _packed(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _open(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[int], list[np.ndarray], list[np.ndarray], list[str | None]]]:
    """file, block, part, rows, symbols, code points and texts of runs of rows in one block, as they come; a part has PART characters and one text more at most."""
    now, part, size, rows, held, points, texts = None, 0, 0, [], [], [], []
    for batch in batches:
        for file, block, row, text in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
            if now != (file, block) or size > PART:
                if rows:
                    yield (*now, part, rows, held, points, texts)
                part = part + 1 if now == (file, block) else 0
                now, size, rows, held, points, texts = (file, block), 0, [], [], [], []
            s, c = spelled(text.as_py())
            size += len(s)
            rows.append(row)
            held.append(s)
            points.append(c if (s >= MANY).any() else c[:0])
            texts.append(text.as_py())
    if rows:
        yield (*now, part, rows, held, points, texts)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    there = np.zeros(CODES, bool)
    for file, block, part, _, held, points, _ in _blocks(batches):
        for s in held:
            there[codes(s)] = True
        grams = np.flatnonzero(there).astype(np.uint32)
        there[grams] = False
        shard = (grams.astype(np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32) >> np.uint64(26)).astype(np.int64)
        some = np.unique(shard)
        packed = [_packed(np.diff(grams[shard == s], prepend=np.uint32(0))) for s in some]
        keys = [k for s, c in zip(held, points, strict=True) if len(c) for h in hashed(s, c)[1:] for k in h]
        if keys:
            keys = np.unique(np.concatenate(keys))
            shard = (keys % np.uint64(SPELLED)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            other, begin = np.unique(shard[order], return_index=True)
            packed += [_packed(k) for k in np.split(keys[order], begin[1:])]
            some = np.concatenate([some, other + SHARDS])
        yield pa.record_batch([pa.array([file] * len(some), pa.string()), pa.array([block] * len(some), pa.int64()), pa.array([part] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], ["file", "block", "part", "shard", "grams"])


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, part, rows, held, points, texts in _blocks(batches):
        lengths = np.array([len(s) for s in held], np.int64)
        names = ["rows", "lengths", "echoes", "symbols", "points"]
        packed = [_packed(np.array(rows, np.int64)), _packed(lengths), _packed(np.array([echo(t) for t in texts])), zstandard.compress(np.concatenate(held).tobytes(), 3), _packed(np.concatenate(points))]
        yield pa.record_batch([pa.array([file]), pa.array([block], pa.int64()), pa.array([part], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], ["file", "block", "part", *names])


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """file, row, perplexity, echo of each row of docs (located()) under a model."""
    small = docs.sparkSession.sparkContext.broadcast(model.small)

    def answer(key: tuple, asked: pa.Table, counts: pa.Table) -> pa.Table:
        spell = key[0].as_py() >= SHARDS
        grams, n, types = counts.column("gram").to_numpy().astype(np.int64).view(np.uint64), counts.column("n").to_numpy(), counts.column("types").to_numpy()
        order = np.argsort(grams)
        grams, n, types, out = grams[order], n[order], types[order], []
        for packed in asked.column("grams"):
            if spell:
                g = _open(packed.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(grams, g), max(len(grams) - 1, 0))
                both = np.where(grams[at] == g, np.stack([n[at], types[at]]), 0) if len(grams) else np.zeros((2, len(g)), np.int64)
                out.append(_packed(both.astype(np.int64)))
                continue
            g = np.cumsum(_open(packed.as_py(), np.uint32), dtype=np.uint32)
            at = np.minimum(np.searchsorted(grams, g), max(len(grams) - 1, 0))
            own = np.where(grams[at] == g, n[at], 0) if len(grams) else np.zeros(len(g), np.int64)
            out.append(_packed(np.log(interpolated(small.value, g, own)).astype(np.float32)))
        return pa.table([asked.column("file"), asked.column("block"), asked.column("part"), pa.array([spell] * len(out), pa.bool_()), asked.column("grams"), pa.array(out, pa.binary())], ["file", "block", "part", "spell", "grams", "logs"])

    def score(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        logs = np.zeros(CODES, np.float32)
        keys, counted = [np.zeros(0, np.uint64)], [np.zeros((2, 0), np.int64)]
        for spell, g, v in zip(answers.column("spell").to_pylist(), answers.column("grams"), answers.column("logs"), strict=True):
            if spell:
                keys.append(_open(g.as_py(), np.uint64))
                counted.append(_open(v.as_py(), np.int64).reshape(2, -1))
                continue
            logs[np.cumsum(_open(g.as_py(), np.uint32), dtype=np.uint32)] = _open(v.as_py(), np.float32)
        keys, counted = np.concatenate(keys), np.concatenate(counted, 1)
        order = np.argsort(keys)
        keys, counted = keys[order], counted[:, order]
        rows, out, echoes = [], [], []
        for r, n, e, s, c in zip(*[texts.column(x) for x in ("rows", "lengths", "echoes", "symbols", "points")], strict=True):
            rows += _open(r.as_py(), np.int64).tolist()
            echoes += _open(e.as_py(), np.float64).tolist()
            held, at, points, p = _open(s.as_py(), np.uint8), 0, _open(c.as_py(), np.uint32), 0
            for k in _open(n.as_py(), np.int64).tolist():
                own = held[at : at + k]
                total = logs[codes(own)].sum(dtype=np.float64)
                if (own >= MANY).any():
                    place, grams, contexts = hashed(own, points[p : p + k])
                    seen, types = counted[:, np.searchsorted(keys, contexts)]
                    total += np.log(spelling(own[place], counted[0, np.searchsorted(keys, grams)], seen, types)).sum()
                    p += k
                out.append(float(np.exp(-total / k)) if k else None)
                at += k
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.string()), pa.array(rows, pa.int64()), pa.array(out, pa.float64()), pa.array(echoes, pa.float64())], ["file", "row", "perplexity", "echo"])

    rows = docs.select(F.col("_file").alias("file"), F.floor(F.col("_row") / (ROWS * HELD)).cast("long").alias("block"), F.col("_row").alias("row"), "text")
    # A shard of the counts meets the questions of BLOCKS blocks at a time, so a group stays bounded whatever the corpus holds
    slices = max(1, -(-docs.count() // (ROWS * BLOCKS)))
    asked = rows.mapInArrow(released(_ask), "file string, block long, part int, shard int, grams binary").withColumn("slice", F.pmod(F.xxhash64("file", "block"), F.lit(slices)).cast("int"))
    counts = model.counts.select(F.col("gram").cast("long").alias("gram"), "n", F.lit(0).cast("long").alias("types"), shard_of(F.col("gram")).alias("shard"))
    counts = counts.union(model.spellings.select("key", "n", "types", (F.col("key").bitwiseAND(F.lit(SPELLED - 1)) + SHARDS).cast("int")))
    counts = counts.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))) if slices > 1 else counts.withColumn("slice", F.lit(0))
    answers = asked.groupBy("shard", "slice").cogroup(counts.groupBy("shard", "slice")).applyInArrow(answer, "file string, block long, part int, spell boolean, grams binary, logs binary")
    texts = rows.mapInArrow(released(_send), "file string, block long, part int, rows binary, lengths binary, echoes binary, symbols binary, points binary")
    return texts.groupBy("file", "block", "part").cogroup(answers.groupBy("file", "block", "part")).applyInArrow(score, "file string, row long, perplexity double, echo double")


def quality(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, low, high, echo, most_echo and kept for each row of docs. trusted_ids: distinct doc_ids of trusted text."""
    rows = located(docs).withColumn("_part", crc32_bucket("doc_id", HELD))
    trusted = rows.join(bounded(trusted_ids.select(F.col("doc_id").alias("_trusted"))), rows["doc_id"].cast("long") == F.col("_trusted"), "left_semi")
    grams, found = counted(trusted.select(F.col("_part").alias("part"), "text"))
    whole = train(grams, found)
    slim = rows.select(F.col("_file").alias("file"), F.col("_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).rlike("\\S").alias("any_text"))
    if whole is None:
        return slim.select("doc_id", "lang", *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "low", "high", "echo", "most_echo")], F.col("any_text").alias("kept"))
    each = [perplexities(rows.where(F.col("_part") == f), train(grams, found, f) or whole) for f in range(HELD)]
    scored = stored(slim.join(reduce(DataFrame.unionByName, each), ["file", "row"]), "scored")
    base = scored.join(bounded(trusted_ids), "doc_id", "left_semi").where("perplexity is not null")
    log = F.log("perplexity")
    fitted = lambda q: F.exp(F.avg(log) + NormalDist().inv_cdf(q) * F.coalesce(F.stddev(log), F.lit(0.0)))
    quantile = lambda q: (F.least if q < 0.5 else F.greatest)(F.percentile_approx("perplexity", q, 10_000), fitted(q))
    echoes = F.percentile_approx("echo", HIGH, 10_000)
    every = base.agg(quantile(LOW).alias("all_low"), quantile(HIGH).alias("all_high"), echoes.alias("all_echo"))
    own = base.where("lang is not null").groupBy("lang").agg(quantile(LOW).alias("own_low"), quantile(HIGH).alias("own_high"), echoes.alias("own_echo"))
    judged = scored.join(bounded(own), "lang", "left").join(F.broadcast(every))  # every is one row
    judged = judged.withColumns({"low": F.coalesce("own_low", "all_low"), "high": F.coalesce("own_high", "all_high"), "most_echo": F.greatest(F.coalesce("own_echo", "all_echo") * ECHO_SLACK, F.lit(LEAST_ECHO))})
    kept = F.col("any_text") & F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")) & (F.col("echo") <= F.col("most_echo")), F.lit(True))
    return judged.select("doc_id", "lang", "perplexity", "low", "high", "echo", "most_echo", kept.alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
