"""Exact deduplication as a stateful stream, in DataFrame and SQL functions only.

Every row is reduced to a fingerprint (digest of the normalised text, doc_id, content locator). A stream folds the
fingerprints into keyed state that never expires: RocksDB on the executors' disks, its changes in the shared folder.
For each digest the state keeps the stable identifier and the locator of the row that stays, and how many rows had it. On
hits (digests with more than one row) the texts themselves are fetched and compared byte by byte with the text that stays;
rows whose digest agrees but whose bytes differ are grouped again by their whole text.

Defined results: a null text counts as empty, a null doc_id sorts after all others, and of rows with the same doc_id and
text the one that comes first in its file stays. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, documents, located, scratch, stored

#: Rows of one digest that are compared with a copy of the text that stays, in one task.
ROWS_PER_SALT = 1000

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves megabytes of disk
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else stores stay loaded in the executors after the query has ended
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "32",
}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; only runs that aren't a single space already are touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\t-\\r][ \\t-\\r]*| [ \\t-\\r]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One narrow row for each row of docs, which must be located()."""
    return docs.select(digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_file").alias("file"), F.col("_row").alias("row"))


def ingest(spark: SparkSession, source: str, state: str) -> DataFrame:
    """Fold the fingerprint files in source that the state hasn't seen into it; return the state's groups.

    Called again with the same two folders, it reads new files only and goes on from the state that is there.
    """
    read = spark.read.parquet(source)
    stream = spark.readStream.schema(read.schema).parquet(source)
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "file", "row")
    groups = stream.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    held = spark.read.format("statestore").load(state)
    keep, count = (f"value.`{f.name}`" for f in held.schema["value"].dataType.fields)
    return held.select(F.col("key.digest"), F.col(keep).alias("first"), F.col(count).alias("group_size")).select(
        "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.file").alias("keep_file"), F.col("first.row").alias("keep_row"), "group_size"
    )


def unlike(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of digests in which some row's bytes differ from those that stay, with their texts.

    members: located rows of digests with more than one row, with keep_file, keep_row and group_size. A large group is
    dealt out over salts, each with its own copy of the one text that stays, so that no task holds a whole group.
    """
    texts = docs.select(F.col("_file").alias("file"), F.col("_row").alias("row"), "text").join(bounded(members), ["file", "row"]).withColumn("norm", normalised(F.col("text"))).drop("text")
    salts = F.ceil(F.col("group_size") / ROWS_PER_SALT).cast("int")
    stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    kept = texts.where(stays).select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rest = texts.where(~stays).withColumn("salt", F.pmod(F.xxhash64("file", "row"), salts).cast("int"))
    return rest.join(kept, ["digest", "salt"]).where(F.col("norm") != F.col("kept_norm")).select("digest").distinct()


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For each row of docs (located()): file, row, doc_id, digest, keep_id, keep_file, keep_row, group_size."""
    spark = docs.sparkSession
    source = scratch(spark, "fingerprints")
    fingerprints(docs, digest).write.parquet(source)
    prints = spark.read.parquet(source)
    groups = stored(ingest(spark, source, scratch(spark, "dedup-state")), "dedup-groups")
    found = prints.join(groups, "digest")
    several = stored(prints.join(bounded(groups.where("group_size > 1")), "digest"), "dedup-hits")
    clash = stored(unlike(docs, several), "dedup-clashes")
    if clash.isEmpty():
        return found
    own = docs.select(F.col("_file").alias("file"), F.col("_row").alias("row"), "text").join(several.select("file", "row", "doc_id", "digest").join(clash, "digest"), ["file", "row"]).withColumn("norm", normalised(F.col("text")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "file", "row"))
    whole = own.groupBy("digest", "norm").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    again = own.select("file", "row", "doc_id", "digest", "norm").join(whole, ["digest", "norm"])
    again = again.select("digest", "doc_id", "file", "row", F.col("first.doc_id").alias("keep_id"), F.col("first.file").alias("keep_file"), F.col("first.row").alias("keep_row"), "group_size")
    return found.join(clash, "digest", "left_anti").unionByName(again)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row has already: of equal texts the one with the smallest doc_id stays."""
    rows = located(docs)
    gone = stored(exact_groups(rows).where(~((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row")))).select(F.col("file").alias("_file"), F.col("row").alias("_row")), "dedup-dropped")
    return rows.join(bounded(gone), ["_file", "_row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(located(documents(spark, sf_dir)))
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return groups.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
