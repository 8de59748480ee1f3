"""Path patterns and path searches that a plain frontier doesn't give: types and predicates along a path, the k shortest simple paths, unbounded shortest paths."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.traverse import held, reach, scratch


@dataclass(frozen=True)
class Step:
    """Least to most edges (most None: any number) in one direction (out, in, both), of the types (None: any), each with what where asks of the edge's columns."""

    types: tuple[str, ...] | None = None
    direction: str = "out"
    least: int = 1
    most: int | None = 1
    where: str | None = None


def automaton(steps: list[Step]) -> tuple[list[tuple[int, int, int]], set[int]]:
    """Transitions (from state, to state, step) and accepting states of a pattern: a state for each edge that a step may take, a loop where it may take any number."""
    moves: list[tuple[int, int, int]] = []
    ends, last = {0}, 0  # states in which the steps so far may be over
    for k, s in enumerate(steps):
        if s.least < 0 or (s.most is not None and s.most < max(1, s.least)):
            raise ValueError(f"a step takes {s.least} to {s.most} edges")
        count, done = max(1, s.least if s.most is None else s.most), set(ends) if s.least == 0 else set()
        for j in range(1, count + 1):
            state = last + j
            moves += [(e, state, k) for e in (ends if j == 1 else {state - 1})]
            if j >= s.least:
                done.add(state)
        if s.most is None:
            moves.append((last + count, last + count, k))
        last, ends = last + count, done
    return moves, ends


def match(edges: DataFrame, starts: DataFrame, steps: list[Step], most: int = 50) -> DataFrame:
    """start, id, hops and path: what each start (id) reaches by a path that fits the steps one after the other, of all such paths the shortest, ties by its ids.

    A breadth-first search over pairs of a vertex and a state of the pattern's automaton, each pair once for a start, so repeated types
    and loops of the graph end. The edges are filtered once for each transition, by type and predicate, before any round.
    """
    moves, accept = automaton(steps)

    def along(a: int, b: int, k: int) -> DataFrame:
        s = steps[k]
        own = edges.where(F.col("type").isin(*s.types)) if s.types is not None else edges
        own = own.where(s.where) if s.where else own
        out, back = own.select("src", "dst"), own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        own = {"out": out, "in": back, "both": out.unionByName(back)}[s.direction]
        return own.withColumns({"state": F.lit(a), "next": F.lit(b)})

    hops = held(reduce(DataFrame.unionByName, [along(*m) for m in moves]).distinct())
    folder = scratch(edges.sparkSession, "pattern")
    seen = held(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("state"), F.lit(0).alias("hops"), F.array("id").alias("path")).distinct(), folder)
    front = seen
    for d in range(1, most + 1):
        step = front.select("start", F.col("id").alias("src"), "state", "path").join(hops, ["src", "state"]).select("start", F.col("dst").alias("id"), F.col("next").alias("state"), "path")
        best = step.groupBy("start", "id", "state").agg(F.min("path").alias("path"))
        best = best.join(seen.select("start", "id", "state"), ["start", "id", "state"], "left_anti")
        front = held(best.select("start", "id", "state", F.lit(d).alias("hops"), F.concat("path", F.array("id")).alias("path")))
        if front.isEmpty():
            break
        seen = held(front, folder)
    found = seen.where(F.col("state").isin(*accept))
    return found.groupBy("start", "id").agg(F.min(F.struct("hops", "path")).alias("m")).select("start", "id", "m.hops", "m.path")


def k_shortest(edges: DataFrame, pairs: DataFrame, k: int = 10, depth: int = 5, directed: bool = False) -> DataFrame:
    """start, finish, hops and path: the k shortest simple paths of at most depth edges for each pair (start, finish), ties by their ids.

    Distances to each finish come first, by a breadth-first search from it. Paths of one length after the other follow, for pairs that
    lack some: a beginning goes on only where the distance that is left fits the length. Shortest paths can't meet
    themselves, so of their beginnings at a vertex the k first by ids suffice; of longer ones all that fit are kept.
    """
    hops = edges.select("src", "dst").where("src <> dst")
    hops = held((hops if directed else hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct())
    asked = held(pairs.select("start", "finish").where("start <> finish").distinct())
    back = hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = asked.select(F.col("finish").alias("id")).distinct()
    left = reach(back, ends, depth, directed=True, most=depth).select(F.col("start").alias("finish"), "id", F.col("distance").alias("left"))
    left = held(left.unionByName(ends.select(F.col("id").alias("finish"), "id", F.lit(0).alias("left"))))
    lacking = asked.join(left.withColumnsRenamed({"id": "start", "left": "least"}), ["start", "finish"])
    folder, found = scratch(edges.sparkSession, "paths"), None
    for length in range(1, depth + 1):
        open_ = held(lacking.where(F.col("least") <= length) if found is None else lacking.where(F.col("least") <= length).join(found.groupBy("start", "finish").count().where(F.col("count") >= k), ["start", "finish"], "left_anti"))
        if open_.isEmpty():
            continue
        front = open_.select("start", "finish", "least", F.col("start").alias("src"), F.array("start").alias("path"))
        for h in range(1, length + 1):
            grown = front.join(hops, "src").where(~F.array_contains("path", F.col("dst")) & ((F.col("dst") == F.col("finish")) == (h == length)))
            fits = grown.join(left.withColumnRenamed("id", "dst"), ["finish", "dst"]).where(F.col("left") <= length - h)
            fits = fits.select("start", "finish", "least", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"))
            rank = F.row_number().over(W.partitionBy("start", "finish", "src").orderBy("path"))
            front = held(fits.withColumn("k", rank).where((F.col("k") <= k) | (F.col("least") < length)).drop("k")) if h < length else fits
        rank = F.row_number().over(W.partitionBy("start", "finish").orderBy("path"))
        some = front.withColumn("k", rank).where(F.col("k") <= k).select("start", "finish", F.lit(length).alias("hops"), "path")
        found = held(some, folder)
    if found is None:
        return asked.select("start", "finish", F.lit(0).alias("hops"), F.array("start").alias("path")).limit(0)
    return found.withColumn("k", F.row_number().over(W.partitionBy("start", "finish").orderBy("hops", "path"))).where(F.col("k") <= k).drop("k")


def unbounded_shortest(edges: DataFrame, pairs: DataFrame, most: int = 10_000) -> DataFrame:
    """start, finish, hops and path: a shortest undirected path for each pair (start, finish) that has one, however long.

    Both ends grow by a round at a time until they meet, so each goes half the way and sees the vertices about it alone. Every vertex
    keeps one parent (the smallest id) for each pair and side, not its path; paths are put together once, from the meeting point outwards.
    Pairs that have met leave the frontier; a pair none of whose ends grows any more has no path.
    """
    hops = edges.select("src", "dst").where("src <> dst")
    hops = held(hops.unionByName(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    asked = held(pairs.select("start", "finish").where("start <> finish").distinct())
    keys, folder, done = ["start", "finish"], scratch(edges.sparkSession, "both"), scratch(edges.sparkSession, "met")
    side = lambda c, s: asked.select(*keys, F.lit(s).alias("side"), F.col(c).alias("id"), F.lit(None).cast(asked.schema[c].dataType).alias("parent"), F.lit(0).alias("hops"))
    seen = held(side("start", 0).unionByName(side("finish", 1)), folder)
    front, met = seen, None
    for d in range(1, most + 1):
        step = front.select(*keys, "side", F.col("id").alias("src")).join(hops, "src").groupBy(*keys, "side", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = held(step.join(seen.select(*keys, "side", "id"), [*keys, "side", "id"], "left_anti").select(*keys, "side", "id", "parent", F.lit(d).alias("hops")))
        if new.isEmpty():
            break
        seen = held(new, folder)
        # A vertex that both sides have seen, one of them just now
        other = seen.select(*keys, (1 - F.col("side")).alias("side"), "id", F.col("hops").alias("far"))
        meets = new.join(other, [*keys, "side", "id"]).groupBy(*keys).agg(F.min(F.struct((F.col("hops") + F.col("far")).alias("hops"), "id")).alias("m"))
        found = held(meets.select(*keys, "m.hops", F.col("m.id").alias("middle")), done)
        met, front = found, new.join(found, keys, "left_anti")
    if met is None:
        return asked.select(*keys, F.lit(0).alias("hops"), F.array("start").alias("path")).limit(0)
    path = met.select(*keys, "hops", F.col("middle").alias("a"), F.col("middle").alias("b"), F.array("middle").alias("path"))
    for side_, end, add in ((0, "a", lambda: F.concat(F.array("parent"), "path")), (1, "b", lambda: F.concat("path", F.array("parent")))):
        up = held(seen.where(F.col("side") == side_).join(met.select(*keys), keys, "left_semi").where("parent is not null").select(*keys, F.col("id").alias(end), "parent"))
        finished, going, out = scratch(edges.sparkSession, "whole"), held(path), None
        while not going.isEmpty():
            at = held(going.join(up, [*keys, end], "left"))
            out = held(at.where("parent is null").drop("parent"), finished)
            going = held(at.where("parent is not null").withColumns({"path": add(), end: F.col("parent")}).select(*path.columns))
        path = out
    return path.select(*keys, "hops", "path")
