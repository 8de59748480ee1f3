"""Cross-tokenizer alignment: minimal groups of two tokenizers' tokens that cover the same bytes, and counts of id pairs.

1. Both tokenizers end a token wherever a text goes from something else than white space to a space: tokenizer A (byte-level
   BPE) cuts there before it merges, and no piece of B (BPE with space marks) has the mark after another character, which is
   checked when the model is loaded. So a text's tokens are those of its parts between such places, and a group never spans one.
   Each distinct part is encoded once, aligned, and remembered.
2. Tokens are the vertices of a bipartite graph, whose edges (links) are the pairs of A and B tokens that overlap in bytes.
   Union-find over it, for many parts at once, gives the connected components: the minimal groups, in the order of the text.
3. Texts are taken in blocks of about BLOCK_BYTES. A block writes one row for each text (its counts, the digest of its groups
   and how often it has each distinct part) and one for itself (its distinct id pairs, how often each is linked, and the pairs
   of its parts). The table is stored once, so a lost executor never mixes two runs' blocks.
4. Pairs are counted over the corpus from the blocks' sums, and each B id's highest count after that: narrow rows, summed before
   each shuffle. A pair has one row in a block, so no key has more rows than there are blocks.
5. The counts go back to their blocks, and each text's sums are those of its parts. No table of pairs is broadcast or collected.

Defined results: texts that are null, empty or not spelt byte by byte by both tokenizers (a space mark in the text, say) have no
tokens: zeros and an empty digest, and they count for nothing. Every row of the input gives one row, repeated and null doc_ids too.
An empty table gives no rows; other columns may have any name. Many, very long or unbroken parts are encoded but not remembered.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import documents, released, stored

#: Bytes of text of a block; distinct parts that a worker remembers, and their longest; parts of a text (or characters of a short one) that are taken at once.
BLOCK_BYTES, REMEMBERED, LONGEST, AT_ONCE = 6_000_000, 200_000, 80, 100_000
#: A pair of ids is one number, A's before B's.
B_BITS = 32
#: Marks that A cuts from a letter before them, and so does B unless one of its pieces has them after a letter.
MARKS = ".,!?;:%&*#"

#: A part: white space, and what follows up to a space that comes after something else. Python counts more characters as white space than the tokenizers do, which only makes parts longer.
PART = re.compile(r"\s*\S*(?:[^\S ]\s*\S*)*")

BLOCKS = "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, parts binary, times binary, keys array<long>, counts array<long>, lengths binary, places binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i and j of the tokens whose byte ranges overlap, in order: a pair for each stretch between neighbouring ends of either."""
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def united(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union-find over n vertices and edges (i, j), all at once: each vertex's root, the smallest vertex of its component."""
    up = np.arange(n)
    while True:
        roots = np.stack([up[i], up[j]])
        low, high = roots.min(0), roots.max(0)
        apart = low != high
        if not apart.any():
            return up
        np.minimum.at(up, high[apart], low[apart])  # a root gets the smallest root that it is joined with
        while (up[up] != up).any():
            up = up[up]


def aligned(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, str, list[int]]]:
    """For each part (they end at ends, where tokens of both end): numbers of A's and B's tokens and of groups, the groups as text, the links' id pairs."""
    i, j = overlaps(a_ends, b_ends)
    root = united(len(a) + len(b), i, len(a) + j)
    # Components begin at an A token, and their tokens follow one another
    starts = np.flatnonzero(root[: len(a)] == np.arange(len(a)))
    a_cut = [*starts.tolist(), len(a)]
    b_cut = [*np.searchsorted(root[len(a) :], starts).tolist(), len(b)]
    xs, ys = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups = [f"{xs[p]}|{ys[r]}" if q - p == 1 == s - r else f"{','.join(xs[p:q])}|{','.join(ys[r:s])}" for p, q, r, s in zip(a_cut, a_cut[1:], b_cut, b_cut[1:], strict=False)]
    keys = (a[i] << B_BITS | b[j]).tolist()
    a_at, b_at = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1
    g_at, l_at = np.searchsorted(starts, a_at), np.searchsorted(i, a_at)
    if (a_ends[a_at - 1] != ends).any() or (b_ends[b_at - 1] != ends).any():
        raise ValueError("a token spans two parts of a text")
    before = (0, 0, 0, 0)
    for now in zip(a_at.tolist(), b_at.tolist(), g_at.tolist(), l_at.tolist(), strict=True):
        yield now[0] - before[0], now[1] - before[1], now[2] - before[2], ";".join(groups[before[2] : now[2]]), keys[before[3] : now[3]]
        before = now


class Aligner:
    """Parts of texts to (numbers of A's and B's tokens and of groups, the groups' text, links' pairs), or None where the bytes differ."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spelt, last = byte_characters(), max(self.a.get_vocab().values())
        self.a_bytes = [b""] * (last + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(spelt[c] for c in token) if all(c in spelt for c in token) else token.encode()
        self.b_bytes, spanned = [], set()
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"the piece {piece!r} has a space mark after another character")
            spanned.update(y for x, y in pairwise(piece) if x.isalpha())
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_length, self.b_length = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.marks = "".join(m for m in MARKS if m not in spanned)
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _several(self, parts: list[str]) -> Iterator[tuple | None]:
        """Parts that end in something else than white space are, one after the other, a text's parts again: the libraries are called once for all."""
        joined = "".join(parts)
        spelt = joined.encode()
        a, b = self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.b.encode(joined[1:])
        if b"".join(map(self.a_bytes.__getitem__, a)) != spelt or b"".join(map(self.b_bytes.__getitem__, b)) != spelt:
            if len(parts) == 1:
                yield None
            else:
                half = len(parts) // 2
                yield from self._several(parts[:half])
                yield from self._several(parts[half:])
            return
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum([len(p) for p in parts] if joined.isascii() else [len(p.encode()) for p in parts])
        yield from aligned(a, self.a_length[a].cumsum(), b, self.b_length[b].cumsum(), ends)

    def _stem(self, part: str) -> str:
        """The part without up to four marks at its end, if they follow a letter: both tokenizers end a token there. Else nothing."""
        if part[-1] not in self.marks or len(part) > LONGEST:
            return ""
        stem = part.rstrip(self.marks)
        return stem if len(part) - len(stem) <= 4 and stem[-1:].isalpha() and stem[-1] < "\u0180" else ""

    def _tail(self, marks: str) -> tuple | None:
        """What marks after a letter have."""
        both, letter = next(self._several([" a" + marks])), next(self._several([" a"]))
        return both and (*[x - y for x, y in zip(both[:3], letter[:3], strict=True)], both[3][len(letter[3]) + 1 :], both[4][len(letter[4]) :])

    def learn(self, parts: list[str]) -> list[tuple | None]:
        """What is known of the parts. Short ones are remembered: those that were asked for since REMEMBERED others were, at least.

        A word with marks at its end is put together from the word and the marks, so only these are encoded and remembered.
        """
        known, older, wanted, apart, alone = self.known, self.older, {}, {}, []
        for p in parts:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                elif stem := self._stem(p):
                    apart[p] = stem, p[len(stem) :]
                    wanted |= dict.fromkeys(apart[p])
                elif len(p) > LONGEST or p[-1].isspace():
                    alone.append(p)
                else:
                    wanted[p] = None
        missing = []
        for p in wanted:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                elif p[0] in self.marks:  # parts begin with white space
                    known[p] = self._tail(p)
                else:
                    missing.append(p)
        for at in range(0, len(missing), 2000):
            known |= zip(missing[at : at + 2000], self._several(missing[at : at + 2000]), strict=True)
        found = {p: next(self._several([p])) for p in alone}
        for p, (stem, tail) in apart.items():
            x, y = known[stem], known[tail]
            found[p] = (x[0] + y[0], x[1] + y[1], x[2] + y[2], f"{x[3]};{y[3]}", x[4] + y[4]) if x and y else None
        out = [known[p] if p in known else found[p] for p in parts]
        if len(known) > REMEMBERED:
            self.known, self.older = {}, known
        return out


@lru_cache(maxsize=1)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """A worker's aligner: one for all its tasks, with the parts that it remembers."""
    return Aligner(a_path, b_path)


def parts_of(text: str) -> Iterator[list[str]]:
    """The parts of a space and a text, about AT_ONCE together; a lone space at the end belongs to the part before."""
    text = " " + text
    if len(text) <= AT_ONCE:
        some = PART.findall(text)[:-1]  # the match at the end is empty
        if len(some) > 1 and some[-1] == " ":
            some[-2:] = [some[-2] + " "]
        yield some
        return
    found, kept = PART.finditer(text), None
    while some := [m[0] for m in islice(found, AT_ONCE)]:
        some = [x for x in some if x]
        if kept is not None:
            some.insert(0, kept)
        if some:
            kept = some.pop()
            if kept == " " and some:
                kept = some.pop() + kept
        if some:
            yield some
    if kept is not None:
        yield [kept]


class Numbers(dict):
    """Distinct parts by number; new has those that came since it was cleared."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.new.append(part)
        return n


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as their width in bytes and themselves, in as few bytes as the largest needs."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind.newbyteorder("<")).tobytes()


def unpacked(stored_: bytes) -> np.ndarray:
    return np.frombuffer(stored_, f"<u{stored_[0]}", offset=1).astype(np.int64)


class Block:
    """Rows of texts, and the distinct parts and pairs that they share."""

    def __init__(self, aligner: Aligner) -> None:
        self.aligner, self.name, self.bytes = aligner, uuid.uuid4().hex, 0
        self.numbers, self.wrong = Numbers(), set()
        self.sizes: list[tuple[int, int, int]] = []
        self.texts: list[str] = []
        self.links: list[list[int]] = []
        self.ids: list[int | None] = []
        self.digests: list[str] = []
        self.used: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def _learn(self) -> None:
        if new := self.numbers.new:
            first = len(self.texts)
            for k, x in enumerate(self.aligner.learn(new), first):
                if x is None:
                    self.wrong.add(k)
                sizes, groups, links = (x[:3], x[3], x[4]) if x else ((0, 0, 0), "", [])
                self.sizes.append(sizes)
                self.texts.append(groups)
                self.links.append(links)
            new.clear()

    def _read(self, text: str) -> Iterator[list[int]]:
        for some in parts_of(text):
            at = list(map(self.numbers.__getitem__, some))
            self._learn()
            yield at

    def add(self, rows: list[tuple[int | None, str | None]]) -> None:
        """Short texts' parts are learned together, those of a long one as they are read."""
        short = [[list(map(self.numbers.__getitem__, some)) for some in parts_of(t)] if t and len(t) < AT_ONCE else None for _, t in rows]
        self._learn()
        for (doc_id, text), numbers in zip(rows, short, strict=True):
            digest, seen = hashlib.sha256(), []
            self.bytes += len(text) + 1 if text else 0
            for at in numbers or (self._read(text) if text else ()):
                if self.wrong and not self.wrong.isdisjoint(at):
                    seen = []
                    break
                digest.update((";" * bool(seen) + ";".join(map(self.texts.__getitem__, at))).encode())
                seen.append(np.array(at, np.int64))
            used, times = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for out, x in ((self.ids, doc_id), (self.digests, digest.hexdigest() if seen else ""), (self.used, used), (self.times, times)):
                out.append(x)

    def batches(self) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in BLOCKS.split(", "))])
        # What each part has, and from it each text
        lengths = np.fromiter(map(len, self.links), np.int64, len(self.links))
        each = np.concatenate([np.array(self.sizes, np.int64).reshape(-1, 3), lengths[:, None]], 1)
        of_row = np.array([(each[u] * n[:, None]).sum(0) for u, n in zip(self.used, self.times, strict=True)], np.int64).reshape(-1, 4)
        keys, places = np.unique(np.fromiter(chain.from_iterable(self.links), np.int64), return_inverse=True)
        # A part of a text that was given up stays known here, and no text has it
        times = np.zeros(len(self.links), np.int64)
        for u, n in zip(self.used, self.times, strict=True):
            times[u] += n
        counts = np.bincount(places, np.repeat(times, lengths), len(keys)).astype(np.int64)
        n = len(self.ids)
        for a in range(0, n, 500):
            b = min(n, a + 500)
            own = [pa.array([self.name] * (b - a)), pa.array(self.ids[a:b], pa.int64()), *[pa.array(x) for x in of_row[a:b].T], pa.array(self.digests[a:b]), pa.array([packed(np.diff(u, prepend=0)) for u in self.used[a:b]], pa.binary()), pa.array([packed(x) for x in self.times[a:b]], pa.binary())]
            yield pa.record_batch([*own, *[pa.nulls(b - a, schema.field(k).type) for k in range(9, 13)]], schema=schema)
        own = [[keys.tolist()], [counts.tolist()], [packed(lengths)], [packed(places)]]
        yield pa.record_batch([pa.array([self.name]), *[pa.nulls(1, schema.field(k).type) for k in range(1, 9)], *[pa.array(x, schema.field(9 + k).type) for k, x in enumerate(own)]], schema=schema)


def blocks(docs: DataFrame, a_path: str, b_path: str, size: int = BLOCK_BYTES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        block = Block(aligner)
        gc.disable()  # else it goes through all that is remembered again and again; nothing here has cycles
        for batch in batches:
            rows, waiting = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows.append((doc_id, text))
                waiting += len(text or "")
                if waiting >= min(size, AT_ONCE):
                    block.add(rows)
                    rows, waiting = [], 0
                    if block.bytes >= size:
                        yield from block.batches()
                        block = Block(aligner)
            block.add(rows)
        if block.ids:
            yield from block.batches()
        gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), BLOCKS)


def pair_counts(made: DataFrame) -> DataFrame:
    """key, count and best (whether no pair with the key's B id has more) of every id pair that is linked anywhere."""
    each = made.where("keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "counts")).alias("k")).where("k.counts > 0")
    counts = stored(each.groupBy(F.col("k.keys").alias("key")).agg(F.sum("k.counts").alias("count")), "pair-counts")
    b = F.col("key").bitwiseAND(2**B_BITS - 1)
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.join(highest, b == F.col("b")).select("key", "count", (F.col("count") == F.col("highest")).alias("best"))


def summed(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The result's rows of one block: its rows, and (at, count, best) of its pairs."""
    own = texts.column("lengths").is_valid().to_numpy().argmax()
    lengths, places = (unpacked(texts.column(k)[int(own)].as_py()) for k in ("lengths", "places"))
    n = int(places.max(initial=-1)) + 1
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = answers.column("at").to_numpy()
    count[at], best[at] = answers.column("count").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False)
    begins = np.cumsum(lengths) - lengths
    of_part = [np.add.reduceat(x[places], begins) if len(begins) else x for x in (count, best)]
    rows = texts.filter(texts.column("parts").is_valid())
    sums = []
    for parts, times in zip(rows.column("parts"), rows.column("times"), strict=True):
        used, n_times = unpacked(parts.as_py()).cumsum(), unpacked(times.as_py())
        sums.append([int((x[used] * n_times).sum()) for x in of_part])
    made = np.array(sums, np.int64).reshape(-1, 2)
    rows = rows.append_column("count_sum", pa.array(made[:, 0])).append_column("n_best", pa.array(made[:, 1]))
    return rows.select([x.split()[0] for x in RESULT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, size: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs, as RESULT says. a_path: a byte-level file of tokenizers; b_path: a model of sentencepiece."""
    made = stored(blocks(docs, a_path, b_path, size), "aligned")
    wanted = made.where("keys IS NOT NULL").select("block", F.posexplode("keys").alias("at", "key"))
    answers = wanted.join(pair_counts(made), "key").select(F.col("block").alias("of"), "at", "count", "best")
    return made.drop("keys", "counts").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(summed, RESULT)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
