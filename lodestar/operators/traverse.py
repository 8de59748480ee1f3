"""Bounded traversal: reach, shortest and simple paths, cycles, chains. Frontiers are DataFrames; only emptiness is looked at."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rounds in which edges that lie on no cycle are taken away.
TRIMS = 8

_fallback: tempfile.TemporaryDirectory | None = None


def scratch(spark: SparkSession, what: str = "step") -> str:
    """A new path in the folder of spark.checkpoint.dir, or in a temporary one where it is unset and all runs on one machine (tests)."""
    global _fallback
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _fallback is None:
            _fallback = tempfile.TemporaryDirectory(prefix="lodestar-")
            atexit.register(_fallback.cleanup)
        folder = "file://" + _fallback.name
    return f"{folder.rstrip('/')}/lodestar/{what}-{uuid.uuid4().hex}"


def held(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written once where lineage must be cut, under path or a new one. A path that is given is added to."""
    path = path or scratch(df.sparkSession)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, starts: DataFrame, depth: int, kind: str | None = None, directed: bool = False, most: int = 20) -> DataFrame:
    """start, id, distance of what each start (id) reaches in 1..depth hops; depth is clamped to most."""
    own = edges.where(F.col("type") == kind) if kind else edges
    hops = own.select("src", "dst")
    hops = held((hops if directed else hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct())
    folder = scratch(edges.sparkSession, "seen")
    seen = held(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance")), folder)
    front = seen
    for d in range(1, min(max(depth, 1), most) + 1):
        step = front.select("start", F.col("id").alias("src")).join(hops, "src").select("start", F.col("dst").alias("id")).distinct()
        front = held(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = held(front, folder)
    return seen.where("distance > 0")


def paths(edges: DataFrame, starts: DataFrame, depth: int, directed: bool = True, ends: DataFrame | None = None) -> DataFrame:
    """All simple paths of 1..depth hops from the starts (id), as start, finish, hops and path; only those to ends (id) if given."""
    hops = edges.select("src", "dst").distinct()
    hops = held(hops if directed else hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("src"), F.array("id").alias("path"))
    found = None
    for d in range(1, depth + 1):
        grown = front.join(hops, "src").where(~F.array_contains("path", F.col("dst")))
        front = held(grown.select("start", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path")))
        step = front.select("start", F.col("src").alias("finish"), F.lit(d).alias("hops"), "path")
        if ends is not None:
            step = step.join(ends.select(F.col("id").alias("finish")), "finish", "left_semi").select("start", "finish", "hops", "path")
        found = step if found is None else found.unionByName(step)
        if front.isEmpty():
            break
    return found


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 3) -> DataFrame:
    """For each pair (start, finish) its shortest undirected path of at most depth hops; of equals the first by its ids.

    A breadth-first search that keeps one parent for each vertex, so the frontier never holds more than the vertices.
    """
    hops = edges.select("src", "dst")
    hops = held(hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    folder = scratch(edges.sparkSession, "seen")
    seen = held(pairs.select("start").distinct().select("start", F.col("start").alias("id"), F.array("start").alias("path"), F.lit(0).alias("hops")), folder)
    front = seen
    for d in range(1, depth + 1):
        step = front.select("start", F.col("id").alias("src"), "path").join(hops, "src").join(seen.select("start", F.col("id").alias("dst")), ["start", "dst"], "left_anti")
        best = step.groupBy("start", F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        front = held(best.select("start", "id", F.concat("path", F.array("id")).alias("path"), F.lit(d).alias("hops")))
        if front.isEmpty():
            break
        seen = held(front, folder)
    return pairs.join(seen.withColumnRenamed("id", "finish"), ["start", "finish"]).where("hops > 0")


def cycles(edges: DataFrame, longest: int = 10) -> DataFrame:
    """Each directed cycle of 2..longest vertices once, from its smallest vertex on: path (closing vertex left out) and hops."""
    hops = held(edges.select("src", "dst").where("src != dst").distinct())
    # What nothing leads to, or what leads nowhere, is on no cycle
    for _ in range(TRIMS):
        less = held(hops.join(hops.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(hops.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if less.count() == hops.count():
            break
        hops = less
    front = hops.select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")).where("last > start")
    found = None
    for n in range(2, longest + 1):
        front = held(front)
        closed = front.join(hops.select(F.col("src").alias("last"), F.col("dst").alias("start")), ["last", "start"], "left_semi").select("path", F.lit(n).alias("hops"))
        found = closed if found is None else found.unionByName(closed)
        if n == longest or front.isEmpty():
            break
        grown = front.join(hops, front["last"] == hops["src"]).where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
        front = grown.select("start", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"))
    return found


def chain(edges: DataFrame, start: str, longest: int = 50) -> DataFrame:
    """start itself at distance 0 and what it leads to along the edges, with the distance."""
    spark = edges.sparkSession
    own = spark.createDataFrame([(start,)], "id string")
    return own.select("id", F.lit(0).alias("distance")).unionByName(reach(edges, own, longest, directed=True, most=longest).select("id", "distance"))


def pathways(edges: DataFrame, ids: DataFrame, depth: int = 3, n: int = 10) -> DataFrame:
    """start, finish, hops and path: the n shortest simple paths between any two of the ids, ties by their vertices."""
    from lodestar.operators.patterns import k_shortest  # it builds on this module

    pairs = ids.select(F.col("id").alias("start")).join(ids.select(F.col("id").alias("finish")), F.col("start") < F.col("finish"))  # a given few
    return k_shortest(edges, pairs, n, depth).orderBy("hops", "path").limit(n)
