"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

A text is cut by the tokenizer's pattern. Distinct pieces that a worker hasn't met are bucketed by length and padded into
matrices of token ids, a row each. In each round every row merges its leftmost pair of minimum rank; the pair's rank comes
from an open-addressing hash table over pairs of ids, kept in numpy arrays, and rows are compacted after the merge. Rows
without a pair that merges leave the matrix. Since a token's id is its rank, the merged pair's rank is the new id.

Pieces of over LONGEST bytes (runs without a break, where rounds over a matrix cost the square of the length) are merged in
the same order over a heap and a linked list, in n log n.

Defined results: a null text counts as empty and has no ids; every row of the input gives one row, whatever its doc_id.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import documents
from lodestar.llm.packing import groups

LONGEST = 512
#: Numbers in a matrix, which bounds a bucket's rows.
CELLS = 1_000_000
#: Distinct pieces that a worker remembers, and bytes of text that it takes at once.
REMEMBERED, TEXT_AT_ONCE = 250_000, 1_000_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """Ranks of pairs of ids by open addressing: keys are probed from a multiplicative hash on until found or free."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = int(len(left) * 2).bit_length() + 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, todo, at = self._key(left, right), np.arange(len(left)), None
        self.probes = 0
        while len(todo):
            at = self._slot(key[todo]) if at is None else (at + 1) & self.keys.size - 1
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = key[todo[put]], rank[todo[put]]
            stay = np.ones(len(todo), bool)
            stay[put] = False
            todo, at, self.probes = todo[stay], at[stay], self.probes + 1

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair doesn't merge or one of the ids is padding (negative)."""
        out = np.full(left.shape, NONE, np.int32)
        flat, real = out.reshape(-1), np.flatnonzero((left >= 0) & (right >= 0))
        key = self._key(left.reshape(-1)[real], right.reshape(-1)[real])
        at = self._slot(key)
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == key
            flat[real[hit]] = self.values[at[hit]]
            go = ~hit & (held >= 0)
            if not go.any():
                break
            real, key, at = real[go], key[go], (at[go] + 1) & self.keys.size - 1
        return out


class ByteBPE:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.token = {int(n): base64.b64decode(t) for t, n in (line.split() for line in f if line.strip())}
        rank = {t: n for n, t in self.token.items()}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(rank[t[:k]], rank[t[k:]], n) for t, n in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        left, right, merged = np.array(pairs, np.int32).T
        self.pairs = PairTable(left, right, merged)
        self.merge = {(a, b): n for a, b, n in pairs}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, bytes] = {}

    def merge_matrix(self, m: np.ndarray) -> list[bytes]:
        """Ids of each row of a matrix of byte ids, padded at its end with -1, as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(m)
        row = np.arange(len(m))
        size = (m >= 0).sum(1)
        ranks = self.pairs.ranks(m[:, :-1], m[:, 1:])
        while len(m):
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(m), np.int64)
            least = ranks[np.arange(len(m)), best] if ranks.shape[1] else np.full(len(m), NONE)
            for i in np.flatnonzero(least == NONE):
                out[row[i]] = m[i, : size[i]].astype("<u4").tobytes()
            if not (go := least != NONE).all():
                m, ranks, row, size, best, least = m[go], ranks[go], row[go], size[go], best[go], least[go]
                if not len(m):
                    break
            # Compact: what is right of the merged pair moves one to the left
            width, at = m.shape[1], np.arange(m.shape[1] - 1)
            m[np.arange(len(m)), best] = least
            m = np.where(at <= best[:, None], m[:, :-1], m[:, 1:])
            if width > 2:
                ranks = np.where(at[:-1] < best[:, None], ranks[:, :-1], ranks[:, 1:])
                for near in (best - 1, best):
                    i = np.flatnonzero((near >= 0) & (near < width - 2))
                    ranks[i, near[i]] = self.pairs.ranks(m[i, near[i]], m[i, near[i] + 1])
            else:
                ranks = ranks[:, :0]
            size = size - 1
            if (most := int(size.max())) < m.shape[1]:
                m, ranks = m[:, :most], ranks[:, : most - 1]
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges, one piece: a heap of (rank, place) finds the leftmost pair of minimum rank."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.merge.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.merge.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := self.merge.get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := self.merge.get((ids[h], r))) is not None:
                heapq.heappush(heap, (s, h))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.array([len(d) for d in data])
        for i in np.flatnonzero(sizes > LONGEST):
            self.known[pieces[i]] = self.merge_long(data[i])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LONGEST]
        begin = 0
        while begin < len(order):
            least = int(sizes[order[begin]])
            width = least if least <= 16 else 1 << (least - 1).bit_length()
            end = min(int(np.searchsorted(sizes[order], width, "right")), begin + max(1, CELLS // width))
            bucket = order[begin:end]
            flat = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in bucket), np.uint8).reshape(len(bucket), width)
            m = np.where(np.arange(width) < sizes[bucket][:, None], self.byte[flat], -1)
            for i, ids in zip(bucket, self.merge_matrix(m), strict=True):
                self.known[pieces[i]] = ids
            begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        if new := set().union(*cut) - self.known.keys():
            self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def bpe_of(path: str) -> ByteBPE:
    """A worker's encoder: one for all its tasks, with the pieces that it has learned, up to REMEMBERED."""
    return ByteBPE(path)


CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def byte_bpe(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Each row's ids (little-endian unsigned 32-bit, null unless keep_ids), their number and digest, and the digest of what they decode to."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path)
        for batch in batches:
            texts = batch.column("text")
            for a, b in groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), TEXT_AT_ONCE):
                ids = bpe.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]), pa.array(ids if keep_ids else [None] * len(ids), pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CODED)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(documents(spark, sf_dir), keep_ids=False).drop("ids")
