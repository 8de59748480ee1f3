"""Near-duplicate documents by 64-bit SimHash fingerprints and covering locality-sensitive hashing.

1. Each text becomes a fingerprint: a bit is 1 if it is set in over half the hashes of the text's shingles of WORDS words,
   repeats included. Rows with equal fingerprints form a class, of which one row goes on, so copies meet in a groupBy alone.
2. Every bit gets a vector of RADIUS + 1 binary digits, no vector being zero, each as often as any other. For each of the
   2^(RADIUS + 1) - 1 non-zero vectors v there is a table, whose mask has the bits whose vectors have an odd product with v.
   Fewer than RADIUS + 1 vectors leave some v with which all have an even product: two fingerprints that differ in RADIUS bits
   or fewer are equal under that table's mask, so every pair within the radius collides in some table.
3. Fingerprints with equal masked bits share a bucket. Buckets of up to LEAF fingerprints are compared exhaustively, as
   matrices; each gives one link for each member that isn't alone. In a larger bucket the masked bits are equal, so the pair
   4. Components of the links name each class, and the classes their rows.

Defined results: a null text, an empty one and one of white space have the fingerprint zero and are linked like any other; a
text of fewer than three words is one shingle. Rows that share a doc_id are one document, whatever their texts; a row without
doc_id has a fingerprint and no component. An empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, documents, released, stored
from lodestar.llm.near_dedup import by_key, components, reached, runs

WORDS, SEED, BITS, RADIUS, FEW = 3, 42, 64, 3, 8
#: Fingerprints of a bucket that are compared exhaustively, and shingles that are hashed at once.
LEAF, AT_ONCE = 2048, 16_384


def fingerprint(text: str | None) -> int:
    """bytes.lower() and split() know ASCII only, as is wanted here."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    width = min(WORDS, len(words))
    begins, ends, digest = begins[: len(words) - width + 1], ends[width - 1 :], xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(begins), AT_ONCE):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(begins[a : a + AT_ONCE].tolist(), ends[a : a + AT_ONCE].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, fp long")


def masks(free: int = 2**BITS - 1, radius: int = RADIUS) -> list[int]:
    """The masks of a covering of the bits that are 1 in free, as signed 64-bit numbers. Bits get the vectors 1, 2, ... in turn."""
    tables, places = 2 ** (radius + 1) - 1, [i for i in range(BITS) if free >> i & 1]
    out = []
    for v in range(1, tables + 1):
        mask = sum(1 << at for k, at in enumerate(places) if (k % tables + 1 & v).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def compare_buckets(radius: int):
    """Rows (node, id, fp) sorted by node and id: a link (id, root) for each id that isn't its cluster's smallest in the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, ["node"]):
            ids, fps = table.column("id").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            spans = np.array(runs(table, ["node"]), np.int64).reshape(-1, 2)
            twos = spans[spans[:, 1] - spans[:, 0] == 2, 0]
            twos = twos[np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= radius]
            out = [np.stack([ids[twos + 1], ids[twos]], 1)]
            for a, b in spans[spans[:, 1] - spans[:, 0] > 2]:
                near = np.stack([np.bitwise_count(fps[a:b] ^ x) <= radius for x in fps[a:b]])
                label = reached(near)
                moved = np.flatnonzero(label != np.arange(b - a))
                out.append(np.stack([ids[a + moved], ids[a + label[moved]]], 1))
            made = np.concatenate(out)
            if len(made):
                yield pa.record_batch([pa.array(made[:, 0]), pa.array(made[:, 1])], ["id", "root"])

    return run


def near_links(reps: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Links (id, root) that join exactly the ids that pairs within the radius join. reps: id and fp, each fp once.

    A bucket's number is a hash, so two buckets may share one: they are compared as one, and a level later are two again.
    fixed has the bits that are equal in a bucket; the coverings of a level differ by it, and there are few.
    """
    rows = reps.select("id", "fp", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("fixed"))
    spark, levels, found = reps.sparkSession, {0}, []
    while True:
        tables = [(fixed, k, m) for fixed in levels for k, m in enumerate(masks(~fixed & 2**BITS - 1, radius))]
        each = rows.join(F.broadcast(spark.createDataFrame(tables, "fixed long, t int, m long")), "fixed")
        placed = each.select("id", "fp", F.xxhash64("node", "t", F.col("fp").bitwiseAND(F.col("m"))).alias("node"), F.col("fixed").bitwiseOR(F.col("m")).alias("fixed"))
        sizes = placed.groupBy("node").count().where("count > 1")
        placed = stored(placed.join(sizes, "node"), "buckets")
        done = (F.col("count") <= leaf) | (F.bit_count("fixed") >= BITS - FEW)
        small = placed.where(done)
        found.append(small.select("node", "id", "fp").repartition("node").sortWithinPartitions("node", "id").mapInArrow(released(compare_buckets(radius)), "id long, root long"))
        rows = placed.where(~done).select("id", "fp", "node", "fixed")
        levels = {r["fixed"] for r in rows.select("fixed").distinct().collect()}  # at most as many as there are masks of a level
        if not levels:
            return stored(reduce(DataFrame.unionByName, found).distinct(), "links")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint, component_id."""
    made = stored(fingerprints(docs), "fingerprints")
    known = made.where(F.col("doc_id").isNotNull())
    reps = stored(known.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    # A doc_id in several classes joins them
    several = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("doc_id")
    own = known.join(several, "doc_id", "left_semi").join(reps, "fp").select(F.col("doc_id").alias("id"), F.col("id").alias("root")).where("id != root")
    final = components(near_links(reps, radius, leaf).unionByName(own))
    named = reps.join(final, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    rows = made.join(bounded(named), "fp", "left")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))
