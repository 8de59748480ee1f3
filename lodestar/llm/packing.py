"""Best-fit packing of documents into sequences, by patterns fitted with non-negative least squares.

1. On the executors each text becomes pieces of at most SEQUENCE token ids; each piece gets its rank among the pieces of its
   length in its partition. Pieces are stored once, without their ids.
2. The driver sees only how many pieces there are of each length, at most SEQUENCE numbers whatever the corpus holds. It
   enumerates patterns of two and three lengths that fill a sequence, fits how often each is used to the histogram by
   non-negative least squares, rounds down within what there is, and packs the residual best fit, decreasing.
3. A piece's rank among all pieces of its length (its rank in the partition after those of earlier partitions) leads to its
   place in the plan by binary search, so nothing is collected and no group meets in one task.

Ids are those of the library for the whole text, its added tokens included where their strings stand in a text. White space other
than single characters never joins words in this tokenizer and no added token holds any, so a text's ids are those of its parts
between spaces and newlines, one after the other. Texts without added tokens are cut between words, digits and marks too. Each
distinct part of some texts is looked up once, encoded by the library unless it is remembered, and the texts' ids are gathered.

Defined results: a null or empty text is the end id alone; every row of the input is packed, repeated doc_ids too; other
columns may have any name. No rows, no sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.alignment import byte_characters
from lodestar.llm.common import documents, released, stored

SEQUENCE = 2048
END_ID = 0
ROUNDS = 400
#: Distinct parts of texts that a worker remembers, besides as many older ones.
REMEMBERED = 150_000
#: Bytes of text that a worker cuts at once.
TEXT_AT_ONCE = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: Words of Latin letters in which nothing but their case changes when they are normalised. The dotted capital I isn't one: its lower case ends with a mark.
LATIN = re.compile(f"[{''.join(c for c in map(chr, range(0x180)) if c.isalpha() and c != '\u0130')}]+")

#: Bytes in lower case, line ends as spaces; and which are ASCII letters, digits and other printable ASCII characters.
LOWER = np.array([b + 32 if 65 <= b <= 90 else 32 if b == 10 else b for b in range(256)], np.uint8)
LETTER, DIGIT, MARK = (np.array([33 <= b < 127 and kind(chr(b)) for b in range(256)]) for kind in (str.isalpha, str.isdigit, lambda c: not c.isalnum()))
#: Second bytes of letters whose first is C3.
SECOND = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])


def spaced(texts: pa.Array) -> pa.Array:
    """Texts in lower case (A-Z), with a space for each line end and between what the tokenizer cuts apart anyhow, if an ASCII character follows.

    It cuts after letters, around digits, and before letters but for a mark that is an apostrophe. An added token's string is
    found before all that, as it is written, so in texts that may have one only line ends change.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    begin, n = texts.offset, len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[begin : begin + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    data = LOWER[raw]
    letter, digit, mark = LETTER[data], DIGIT[data], MARK[data]
    ends = letter.copy()  # places of letters' last bytes
    ends[1:] |= (data[:-1] == 0xC3) & SECOND[data[1:]]
    cut = ends[:-1] & (digit | mark)[1:]
    cut |= digit[:-1] & (letter | digit | mark)[1:]
    cut |= mark[:-1] & (digit | letter & np.concatenate([[False], data[:-1] != 39]))[1:]
    marked = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
    if marked.any():
        within = np.repeat(marked, np.diff(at))
        data = np.where(within & (raw != 10), raw, data)
        cut &= ~within[1:]
    cut[at[(at > 0) & (at < len(data))] - 1] = False  # between texts
    places = np.flatnonzero(cut) + 1
    data, at = np.insert(data, places, 32), at + np.searchsorted(places, at)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))


class PartEncoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, by a tokenizers file whose tokens never span white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.spelt = str.maketrans({chr(b): c for c, b in byte_characters().items()})

    def _learn(self, parts: list[str]) -> None:
        """Latin words need the library's merges alone; other parts are encoded by it one by one."""
        known, older, words, rest = self.known, self.older, [], []
        for p in parts:
            if p in older:
                known[p] = older[p]
            else:
                (words if LATIN.fullmatch(p) else rest).append(p)
        tokenize, ids, ends = self.tokenizer.model.tokenize, [], []
        for w in words:
            ids += [t.id for t in tokenize(w if w.isascii() and w.islower() else w.lower().encode().decode("latin-1").translate(self.spelt))]
            ends.append(4 * len(ids))
        made = np.array(ids, "<u4").tobytes()
        known |= zip(words, [made[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True)
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[p] = np.array(e.ids, "<u4").tobytes()

    def _ids(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.known.get, parts))
        if gaps := [k for k, x in enumerate(found) if x is None]:
            self._learn([parts[k] for k in gaps])
            for k in gaps:
                found[k] = self.known[parts[k]]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {"": b""}, self.known
        return found

    def encode(self, texts: pa.Array | list[str | None], end: bytes = b"") -> list[bytes]:
        """Each text's ids, and end after them. Parts are split and numbered by Arrow; a text's ids are gathered by its parts' numbers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(spaced(texts), " ")
        parts = split.flatten().dictionary_encode()
        found = [*self._ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), end]
        stops = np.cumsum(pc.list_value_length(split).to_numpy())
        of = np.insert(parts.indices.to_numpy(), stops, len(found) - 1)  # the end after each text's parts
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins, n = (np.cumsum(lengths) - lengths)[of], lengths[of]
        ends = np.cumsum(n)
        at = np.repeat((begins - ends + n).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        ids, cuts = np.frombuffer(b"".join(found), "<u4")[at].tobytes(), (4 * ends[stops + np.arange(len(stops))]).tolist()
        return [ids[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> PartEncoder:
    """A worker's encoder: one for all its tasks, with the parts that it has learned, up to REMEMBERED."""
    return PartEncoder(path)


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a list into runs of about so much size; one that is larger stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def cut(path: str, size: int = SEQUENCE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, ranks = encoder_of(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in groups(sizes, TEXT_AT_ONCE):
                for doc_id, ids in zip(ids_of[a:b], encoder.encode(texts.slice(a, b - a), end), strict=True):
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        piece = ids[at : at + 4 * size]
                        n = len(piece) // 4
                        for column, value in zip(out, (doc_id, k, at // 4, n, zlib.crc32(piece), part, ranks[n]), strict=True):
                            column.append(value)
                        ranks[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All ways to fill size with two or three of the lengths, each way once, as rows a >= b >= c with c 0 for two."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    there[0] = True
    found = []
    for a in lengths[lengths * 3 >= size]:
        b = np.arange((size - a + 1) // 2, min(a, size - a) + 1)
        b = b[(b > 0) & there[b]]
        c = size - a - b
        ok = there[c]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(pattern: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squares of (pieces used - histogram), by accelerated projected gradient."""
    size = len(histogram) - 1
    weight = (np.arange(size + 1) / size) ** 2  # what is left of short pieces fills gaps later
    used = lambda x: sum(np.bincount(pattern[:, i], x, size + 1) for i in range(3))
    norm = 3 * (used(np.ones(len(pattern))) * weight).max()
    x = z = np.zeros(len(pattern))
    t = 1.0
    for _ in range(rounds):
        r = weight * (used(z) - histogram)
        new = np.maximum(0, z - (r[pattern[:, 0]] + r[pattern[:, 1]] + r[pattern[:, 2]]) / norm)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, z, t = new, new + (t - 1) / s * (new - x), s
    return x


def best_fit(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and counts that pack a histogram best fit, decreasing; equal sequences are handled together."""
    size = len(histogram) - 1
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]  # by the room that is left
    for length in np.flatnonzero(histogram)[::-1].tolist():
        left, room = int(histogram[length]), length
        while left and room <= size:
            if not open_[room]:
                room += 1
                continue
            pattern, n = open_[room].popitem()
            k = min(left, n)
            if n > k:
                open_[room][pattern] = n - k
            rest = open_[room - length]
            rest[(*pattern, length)] = rest.get((*pattern, length), 0) + k
            left -= k
            if room - length >= length:
                room = max(length, room - length)
        per = size // length
        for copies, n in ((per, left // per), (left % per, 1)):
            if copies and n:
                rest = open_[size - copies * length]
                rest[(length,) * copies] = rest.get((length,) * copies, 0) + n
    return [x for group in open_ for x in group.items()]


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use every piece of the histogram once."""
    size, left, out = len(histogram) - 1, histogram.astype(np.int64).copy(), []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    ways = patterns(np.flatnonzero(left), size)
    if len(ways):
        x = np.floor(fit(ways, left.astype(float)) + 1e-6).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if x[i] <= 0:
                break
            parts, counts = np.unique(ways[i][ways[i] > 0], return_counts=True)
            if n := int(min(x[i], (left[parts] // counts).min())):
                left[parts] -= n * counts
                out.append((tuple(int(p) for p in ways[i] if p), n))
    return out + best_fit(left)


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as a table by length: from which rank a slot takes pieces, into which sequences, at which offset."""
    rows, first = [], 0
    for pattern, n in made:
        at = 0
        for length in pattern:
            rows.append((length, n, first, at))
            at += length
        first += n
    rows.sort(key=lambda r: r[0])
    length, n, sequence, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return {"begins": np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, "sequence": sequence, "offset": offset}


def place(table: dict[str, np.ndarray], before: np.ndarray):
    """before[n]: pieces shorter than n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = before[batch.column("length").to_numpy()] + batch.column("rank").to_numpy()
            k = np.searchsorted(table["begins"], at, "right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(table["sequence"][k] + at - table["begins"][k]), pa.array(table["offset"][k])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row for each piece of each row of docs: where it begins in its text's ids, and its sequence and offset there."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(cut(path, size)), PIECES), "pieces")
    local = stored(pieces.groupBy("part", "length").count(), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for length, n in local.groupBy("length").agg(F.sum("count")).collect():  # at most size rows
        histogram[length] = n
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = local.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    before = np.concatenate([[0], np.cumsum(histogram)])[: size + 1]
    return ranked.mapInArrow(place(slots(plan(histogram)), before), PLACES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
