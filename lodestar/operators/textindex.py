"""An inverted index for text search: term-partitioned postings in blocks of documents, with maxima by which blocks are skipped.

Documents fall into blocks of BLOCK as they are read. For each term and block there is one row: the documents that have the term,
how often, their lengths, and the block's highest frequency and smallest length. Rows lie in folders by a hash of their term, sorted
by it, so a search reads the postings of its own terms. First it reads the terms' maxima without their postings, which bound what a
document of each block can score; then the postings of the most promising blocks; then those of the others that may still reach
the n-th score. What it returns is what BM25 over a full scan returns.

Changes add a segment: new texts become new blocks, and what they replace or remove is noted as (document, segment) that no search
sees, with each term's loss of documents, so scores are those of an index that was built anew. The empty term stands for a
document itself; its postings are the list of documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.traverse import held, scratch

#: Documents of a block, folders of postings, blocks that a search reads before it has a bound, and blocks that a filter names.
BLOCK, BUCKETS, EARLY, NAMED = 1024, 32, 8, 1000
WORD = "[a-z0-9]+"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class TextIndex:
    """Folders of postings and of what changed; key: the documents' key and its type."""

    spark: SparkSession
    folder: str
    key: str
    kind: str
    segments: int = 1

    @property
    def postings(self) -> DataFrame:
        entry = f"array<struct<key:{self.kind},tf:int,len:int>>"
        return self.spark.read.schema(f"term string, block long, segment int, n int, max_tf int, min_len int, docs {entry}, bucket int").parquet(f"{self.folder}/postings")

    @property
    def gone(self) -> DataFrame | None:
        """(key, segment) that are no longer in the index."""
        return self.spark.read.schema(f"key {self.kind}, segment int").parquet(f"{self.folder}/gone") if self.segments > 1 else None

    @property
    def lost(self) -> DataFrame | None:
        """(term, n): documents that a term lost by changes."""
        return self.spark.read.schema("term string, n long").parquet(f"{self.folder}/lost") if self.segments > 1 else None

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of the terms: a filter on folders and on sorted files."""
        if not terms:
            return self.postings.limit(0)
        own = self.spark.range(1).select(F.explode(F.array(*[bucket_of(F.lit(t)) for t in terms])).alias("b")).distinct().collect()  # at most a folder for each word asked for
        return self.postings.where(F.col("bucket").isin([r["b"] for r in own]) & F.col("term").isin(terms))

    def documents(self) -> DataFrame:
        """key, len and segment of each document that is in the index."""
        rows = self.of([""]).select("segment", F.explode("docs").alias("d")).select(F.col("d.key").alias("key"), F.col("d.len").alias("len"), "segment")
        return rows.join(self.gone, ["key", "segment"], "left_anti") if self.gone is not None else rows


def _write(rows: DataFrame, index: TextIndex, key: str, column: str, segment: int) -> None:
    at = F.monotonically_increasing_id()
    words = rows.select(F.col(key).alias("key"), F.lower(column).alias("text"), F.lit(segment).alias("segment"), (F.shiftright(at, 33) * (1 << 23) + F.floor(at.bitwiseAND((1 << 33) - 1) / BLOCK) + segment * (1 << 54)).alias("block"))
    words = words.select("key", "segment", "block", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
    each = words.select("key", "segment", "block", F.when(F.col("w").isNotNull(), F.size("w")).alias("len"), F.explode(F.concat(F.coalesce("w", F.array().cast("array<string>")), F.array(F.lit("")))).alias("term"))
    # One shuffle for both sums: what is dealt by term and block is dealt by document too
    tf = each.repartition("term", "block").groupBy("term", "block", "segment", "key", "len").agg(F.count("*").cast("int").alias("tf"))
    made = tf.groupBy("term", "block", "segment").agg(
        F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"),
        F.array_sort(F.collect_list(F.struct("key", "tf", "len"))).alias("docs"),
    ).withColumn("bucket", bucket_of(F.col("term")))
    made.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(4 * BUCKETS))).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").mode("append").parquet(f"{index.folder}/postings")


def build(rows: DataFrame, key: str, column: str = "text", folder: str | None = None) -> TextIndex:
    """An index over rows (key, column), each key once."""
    spark = rows.sparkSession
    index = TextIndex(spark, folder or scratch(spark, "text"), key, rows.schema[key].dataType.simpleString())
    _write(rows, index, key, column, 0)
    return index


def update(index: TextIndex, changed: DataFrame, column: str = "text", removed: DataFrame | None = None) -> TextIndex:
    """The index with changed rows (key, column; new or in place of what has their key) and without the removed keys. Only blocks with documents that go are read."""
    names = changed.select(F.col(index.key).alias("key"))
    names = held((names.unionByName(removed.select(F.col(index.key).alias("key"))) if removed is not None else names).distinct())
    out = held(index.documents().join(names, "key", "left_semi").select("key", "segment"))
    blocks = index.of([""]).select("block", "segment", F.explode("docs.key").alias("key")).join(out, ["key", "segment"], "left_semi").select("block").distinct()
    lost = index.postings.join(blocks, "block", "left_semi").select("term", "segment", F.explode("docs.key").alias("key")).join(out, ["key", "segment"], "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    held(lost, f"{index.folder}/lost")
    held(out, f"{index.folder}/gone")
    _write(changed, index, index.key, column, index.segments)
    return TextIndex(index.spark, index.folder, index.key, index.kind, index.segments + 1)


def listing(index: TextIndex) -> DataFrame:
    """term, docs and blocks: what the index has, from the blocks' heads alone."""
    rows = index.postings.where("term <> ''").groupBy("term").agg(F.sum("n").alias("docs"), F.count("*").alias("blocks"))
    if index.lost is None:
        return rows
    lost = index.lost.groupBy("term").agg(F.sum("n").alias("lost"))
    return rows.join(lost, "term", "left").withColumn("docs", F.col("docs") - F.coalesce("lost", F.lit(0))).drop("lost").where("docs > 0")


def search(index: TextIndex, query: str, n: int = 10, k1: float = 1.2, b: float = 0.75, report: dict | None = None) -> DataFrame:
    """key and score of the n best documents for the query's words, as retrieval.bm25 gives them. report gets blocks: how many of the terms' blocks were read, of how many."""
    terms = sorted(set(re.findall(WORD, query.lower())))
    own, key = index.of(terms), F.col("key").alias(index.key)
    size = index.documents().agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    heads = own.select("term", "block", "n", "max_tf", "min_len")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    if index.lost is not None:
        df = df.join(index.lost.where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("lost")), "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(F.broadcast(size)).where("df > 0").select("term", idf.alias("idf"), "avg_len").collect()  # a row for each word asked for
    if not weights:
        return index.postings.select(F.explode("docs.key").alias(index.key), F.lit(0.0).alias("score")).limit(0)
    weight = F.broadcast(index.spark.createDataFrame([(r["term"], r["idf"], r["avg_len"]) for r in weights], "term string, idf double, avg_len double"))
    score = lambda tf, length: F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(length) / F.col("avg_len")))
    bounds = held(heads.join(weight, "term").groupBy("block").agg(F.sum(score("max_tf", "min_len")).alias("most"), F.count("*").alias("rows")))

    def scored(blocks: DataFrame) -> DataFrame:
        some = [r["block"] for r in blocks.select("block").limit(NAMED + 1).collect()]
        read = own.where(F.col("block").isin(some)) if len(some) <= NAMED else own.join(blocks.select("block"), "block", "left_semi")
        each = read.select("term", "segment", F.explode("docs").alias("d")).select("term", "segment", "d.*")
        each = each.join(index.gone, ["key", "segment"], "left_anti") if index.gone is not None else each
        return held(each.join(weight, "term").groupBy("key").agg(F.sum(score("tf", "len")).alias("score")))

    early = held(bounds.orderBy(F.desc("most"), "block").limit(EARLY))
    found = scored(early)
    best = [r["score"] for r in found.orderBy(F.desc("score")).limit(n).select("score").collect()]
    floor = best[-1] - 1e-9 if len(best) == n else float("-inf")
    late = bounds.join(early, "block", "left_anti").where(F.col("most") >= floor)
    if report is not None:
        report["blocks"] = (early.agg(F.sum("rows")).first()[0] + (late.agg(F.sum("rows")).first()[0] or 0), bounds.agg(F.sum("rows")).first()[0])
    found = found.unionByName(scored(late))
    return found.select(key, "score").orderBy(F.desc(F.round("score", 9)), index.key).limit(n)


def compact(index: TextIndex) -> TextIndex:
    """The index as one segment again: entries that are gone leave their blocks, blocks keep their numbers."""
    whole = TextIndex(index.spark, scratch(index.spark, "text"), index.key, index.kind)
    each = index.postings.select("term", "block", "segment", "bucket", F.explode("docs").alias("d"))
    if index.gone is not None:
        each = each.withColumn("key", F.col("d.key")).join(index.gone, ["key", "segment"], "left_anti").drop("key")
    made = each.groupBy("term", "block", "bucket").agg(F.lit(0).alias("segment"), F.count("*").cast("int").alias("n"), F.max("d.tf").alias("max_tf"), F.min("d.len").alias("min_len"), F.array_sort(F.collect_list("d")).alias("docs"))
    made.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(4 * BUCKETS))).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{whole.folder}/postings")
    return whole
