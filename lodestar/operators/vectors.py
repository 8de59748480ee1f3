"""Vector search by a trained coarse quantiser: cells, residual codes with error bounds, exact top-k and nearest-neighbour joins.

Vectors are unit vectors here, so the nearest by cosine is the nearest by distance, and a cell's centre and radius bound what its
vectors can score. An index holds each vector beside a code of one byte for each component of what its cell's centre leaves, with
the length of the code's error: a score from codes is off by that length at most. A probe reads codes of cells in order of their
bounds, stops when no other cell can reach the k-th score, and reads the few vectors whose code may belong to the result. Results
equal a full scan; the bounds decide only how much is read. A probe that may read a share of the index alone isn't exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from lodestar.functions.columns import cosine_score
from lodestar.operators.retrieval import vector_topk
from lodestar.operators.traverse import held, scratch

#: Vectors on which cells are fitted, the most cells, and rows of a cell that are wished for.
SAMPLE, CELLS, PER_CELL = 50_000, 1024, 1000
#: Vectors of a pack of the nearest-neighbour join, packs of a block of its directory, and what bounds yield to rounding.
PACK, DIRECTORY, ROOM = 8192, 256, 1e-7
#: Distances of two packs that are computed at once.
AT_ONCE = 4_000_000


def unit(rows: list, width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for k, v in enumerate(rows):
        x[k] = v
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)


def sound(vectors: DataFrame, width: int) -> DataFrame:
    """Rows whose embedding has that many components, none null or NaN, and a direction."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")))
    return vectors.where((F.size("embedding") == width) & F.coalesce(fine, F.lit(False)) & F.exists("embedding", lambda c: c != 0))


def width_of(vectors: DataFrame) -> int:
    """The commonest length of the embeddings; 0 where there are none."""
    first = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return first["n"] if first else 0


def fit_cells(vectors: DataFrame, width: int, cells: int | None = None, rounds: int = 10, sample: int = SAMPLE, key: str = "id") -> np.ndarray:
    """Centres by spherical k-means on at most sample vectors, chosen by a hash. Each round assigns the vectors in the tasks and sums them by cell."""
    n = vectors.count()
    cells = min(CELLS, max(1, n // PER_CELL)) if cells is None else cells
    share = min(1.0, 1.25 * sample / max(n, 1))
    near = vectors.where(F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 20)) <= int(share * (1 << 20))).select(key, "embedding")
    some = held(near.orderBy(F.xxhash64(F.col(key), F.lit(5)), key).limit(sample))
    first = some.dropDuplicates(["embedding"]).orderBy(F.xxhash64(F.col(key), F.lit(7)), key).limit(cells).select("embedding").collect()  # at most CELLS vectors
    centres = unit([r[0] for r in first], width)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                x = unit(batch.column("embedding").to_pylist(), width)
                own = (x @ centres.T).argmax(1)
                np.add.at(total, own, x)
                count += np.bincount(own, minlength=len(centres))
            yield pa.record_batch([pa.array(np.repeat(np.arange(len(centres)), width)), pa.array(np.tile(np.arange(width), len(centres))), pa.array(total.reshape(-1)), pa.array(np.repeat(count, width))], ["cell", "at", "total", "n"])

        made = some.select("embedding").mapInArrow(sums, "cell long, at long, total double, n long").groupBy("cell", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # at most CELLS times width numbers
        total = np.zeros_like(centres)
        total[made.column("cell").to_numpy(), made.column("at").to_numpy()] = made.column("total").to_numpy()
        moved = np.where((total**2).sum(1, keepdims=True) > 0, total / np.maximum(np.sqrt((total**2).sum(1, keepdims=True)), 1e-300), centres)
        if np.abs(moved - centres).max(initial=0) < 1e-4:
            return moved
        centres = moved
    return centres


@dataclass
class Index:
    """rows: key, further columns, embedding, cell, scale, error, code, stored by cell. sizes, radii: of each cell."""

    rows: DataFrame
    key: str
    width: int
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that a vector of each cell can have as product with the unit vector q; less than -1 for empty cells."""
        apart = np.arccos(np.clip(self.centres @ q, -1, 1)) - 2 * np.arcsin(np.clip(self.radii / 2, 0, 1))
        return np.where(self.sizes > 0, np.cos(np.clip(apart, 0, np.pi)) + ROOM, -2.0)


def build(vectors: DataFrame, key: str = "id", cells: int | None = None, rounds: int = 10, path: str | None = None) -> Index:
    """An index over vectors (key, embedding and any other columns), stored under path, by cell. Vectors of another length or without direction aren't in it."""
    spark, width = vectors.sparkSession, width_of(vectors)
    own = sound(vectors, width)
    centres = fit_cells(own, width, cells, rounds, key=key)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column("embedding").to_pylist(), width)
            cell = (x @ centres.T).argmax(1)
            left = x - centres[cell]
            scale = np.maximum(np.abs(left).max(1), 1e-12) / 127
            code = np.rint(left / scale[:, None]).astype(np.int8)
            error = np.sqrt(((left - code * scale[:, None]) ** 2).sum(1))
            made = [pa.array(np.sqrt((left**2).sum(1))), pa.array(scale), pa.array(error), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))]
            yield pa.record_batch([*batch.columns, *made], [*batch.schema.names, "_radius", "_scale", "_error", "_code", "_cell"])

    kinds = [StructField(n, t) for n, t in (("_radius", DoubleType()), ("_scale", DoubleType()), ("_error", DoubleType()), ("_code", BinaryType()), ("_cell", IntegerType()))]
    made = own.mapInArrow(encode, StructType([*own.schema.fields, *kinds]))
    path = path or scratch(spark, "vectors")
    made.repartition("_cell", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("_cell").write.partitionBy("_cell").parquet(path)
    schema = StructType([*own.schema.fields, *kinds])
    rows = spark.read.schema(schema).parquet(path)
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in rows.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_radius").alias("radius")).collect():  # at most CELLS rows
        sizes[r["_cell"]], radii[r["_cell"]] = r["n"], r["radius"]
    return Index(rows, key, width, centres, sizes, radii)


def _scores(index: Index, rows: DataFrame, cells: np.ndarray, q: np.ndarray, n: int, by: list[str]) -> DataFrame:
    """Of the cells' codes: key, by, low and high (what the score lies between), without those that n others of their batch and group surely beat."""
    far, width, key = index.centres @ q, index.width, index.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column("_code").to_pylist()), np.int8).reshape(-1, width)
            about = far[batch.column("_cell").to_numpy()] + (code @ q) * batch.column("_scale").to_numpy()
            room = batch.column("_error").to_numpy() + ROOM
            low, high = about - room, about + room
            keep = np.ones(len(low), bool)
            if not by and len(low) > n:
                keep = high >= np.partition(low, -n)[-n]
            at = pa.array(np.flatnonzero(keep))
            yield pa.record_batch([*[batch.column(c).take(at) for c in (key, *by)], pa.array(low[keep]), pa.array(high[keep])], [key, *by, "low", "high"])

    some = rows.where(F.col("_cell").isin([int(c) for c in cells])).select(index.key, *by, "_cell", "_scale", "_error", "_code")
    kinds = [f for f in rows.schema.fields if f.name in (index.key, *by)]
    return some.mapInArrow(run, StructType([*[f for c in (index.key, *by) for f in kinds if f.name == c], StructField("low", DoubleType()), StructField("high", DoubleType())]))


def probe(index: Index, query: list[float], n: int = 10, least: float | None = None, share: float = 1.0, report: dict | None = None) -> DataFrame:
    """key and score of the n nearest, as vector_topk gives them. share: the most of the index whose codes may be read, else until the bound holds.

    report gets cells, codes (share of rows whose codes were read) and vectors (share whose vectors were read).
    """
    if not index.sizes.sum():
        return vector_topk(index.rows, query, index.key, n, least)
    q = unit([query], index.width)[0]
    most = index.bounds(q)
    order = np.argsort(-most, kind="stable")
    order = order[index.sizes[order] > 0]
    ends = np.cumsum(index.sizes[order])
    may = order[(ends - index.sizes[order]) < share * ends[-1]]
    first = may[: max(1, int(np.searchsorted(ends[: len(may)], 4 * n)) + 1)]
    found = held(_scores(index, index.rows, first, q, n, []))
    floor = _kth(found, n)
    rest = np.array([c for c in may[len(first) :] if most[c] >= floor], np.int64)
    if len(rest):
        found = held(found.unionByName(_scores(index, index.rows, rest, q, n, [])))
        floor = _kth(found, n)
    wanted = found.where(F.col("high") >= floor).select(index.key)
    cells = np.concatenate([first, rest])
    if report is not None:
        report |= {"cells": len(cells) / len(order), "codes": float(index.sizes[cells].sum() / ends[-1]), "vectors": wanted.count() / float(ends[-1])}
    rows = index.rows.where(F.col("_cell").isin([int(c) for c in cells])).join(wanted, index.key, "left_semi")
    return vector_topk(rows, query, index.key, n, least)


def _kth(found: DataFrame, n: int) -> float:
    """The n-th highest of the scores' lower ends; below all scores where there are fewer."""
    low = [r["low"] for r in found.orderBy(F.desc("low")).limit(n).select("low").collect()]
    return low[-1] if len(low) == n else -2.0


def federated_topk(index: Index, query: list[float], graph_ids: list, graph: str = "graph_id", n: int = 10, per_graph: int = 10, least: float | None = None) -> DataFrame:
    """graph, key and score of the n nearest over the graphs, at most per_graph of each, by a threshold algorithm.

    Every graph gives its list from the best on. The lists are read to a depth at which the n-th best of all is no worse than what
    any list may still give; only lists that may, go deeper. Bounds of codes decide the order, the vectors the result.
    """
    q = unit([query], index.width)[0]
    every = np.flatnonzero(index.sizes > 0)
    scored = held(_scores(index, index.rows.where(F.col(graph).isin(graph_ids)), every, q, n, [graph]))
    rank = F.row_number().over(W.partitionBy(graph).orderBy(F.desc("low"), index.key))
    depth, deeper, lists = max(1, -(-n // max(1, len(graph_ids)))), list(graph_ids), None
    while True:
        top = held(scored.where(F.col(graph).isin(deeper)).withColumn("k", rank).where(F.col("k") <= min(depth, per_graph)))
        lists = top if lists is None else held(lists.where(~F.col(graph).isin(deeper)).unionByName(top))
        floor = _kth(lists, n)
        last = lists.groupBy(graph).agg(F.count("*").alias("n"), F.min("low").alias("low")).where(F.col("n") >= depth).collect()  # one row for each graph asked for
        deeper = [r[graph] for r in last if r["low"] >= floor and depth < per_graph]
        if not deeper:
            break
        depth *= 2
    # Rows whose score may reach the floor: the n-th best of what the lists surely hold
    wanted = scored.where(F.col("high") >= floor).select(index.key)
    exact = index.rows.join(wanted, index.key, "left_semi").select(graph, index.key, cosine_score(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    exact = exact.where(F.col("score") >= least) if least is not None else exact
    capped = exact.withColumn("k", F.row_number().over(W.partitionBy(graph).orderBy(F.desc("score"), index.key))).where(F.col("k") <= per_graph).drop("k")
    return capped.orderBy(F.desc("score"), index.key).limit(n)


# Nearest neighbours of many vectors


PACKED = "array<struct<id:{0},vec:array<{1}>>>"


def _packs(rows: DataFrame, centres: np.ndarray, width: int, size: int, number: str) -> DataFrame:
    """by, pack, rows, centre, radius: rows (by, id, embedding) in packs of about size, of one by and one cell, or of several where a by has fewer rows than the cells times size."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column("embedding").to_pylist(), width)
            yield pa.record_batch([*batch.columns, pa.array((x @ centres.T).argmax(1).astype(np.int32))], [*batch.schema.names, "cell"])

    placed = held(rows.mapInArrow(assign, StructType([*rows.schema.fields, StructField("cell", IntegerType())])))
    # Packs far below size would each be sent all that is asked: a small by takes its cells together
    packs = placed.groupBy("by").agg(F.ceil(F.count("*") / size).cast("int").alias("packs"))
    placed = placed.join(packs, "by").withColumn("cell", F.col("cell") % F.col("packs")).drop("packs")
    pieces = placed.groupBy("by", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("pieces"))
    numbered = placed.join(pieces, ["by", "cell"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    packs = numbered.groupBy("by", "cell", "piece").agg(F.collect_list(F.struct("id", F.col("embedding").cast(f"array<{number}>").alias("vec"))).alias("rows"))

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre, radius = [], []
            for own in batch.column("rows"):
                x = unit(own.values.field("vec").to_pylist(), width)
                c = x.mean(0)
                centre.append(c.tolist())
                radius.append(float(np.sqrt(((x - c) ** 2).sum(1)).max()))
            yield pa.record_batch([*batch.columns, pa.array(centre, pa.list_(pa.float64())), pa.array(radius)], [*batch.schema.names, "centre", "radius"])

    kinds = StructType([*packs.schema.fields, *StructType.fromDDL("centre array<double>, radius double").fields])
    return held(packs.mapInArrow(shape, kinds).withColumn("pack", F.xxhash64("by", "cell", "piece")).drop("cell", "piece"))


def knn(left: DataFrame, right: DataFrame, k: int, by: list[str] | None = None, same: bool = False, size: int = PACK, rounds: int = 10) -> DataFrame:
    """a, b, score: of each left vector the k nearest right ones with equal by, ties by b. left, right: id, embedding and by. same: both are one set, and a vector isn't its own neighbour.

    Equal to pairing all, without doing it: vectors meet in packs of one cell. A left pack meets the nearest right pack first, which
    gives each vector a k-th distance; other packs follow where a vector's distance to their centre less their radius is smaller. Of
    right vectors that are equal only the k + 1 smallest ids can be neighbours; left vectors that are equal are searched once.
    """
    by = by or []
    width = width_of(right)
    named = lambda df: sound(df.dropna(subset=by) if by else df, width).select(F.struct(*[F.col(c) for c in by], F.lit(0).alias("_")).alias("by"), "id", "embedding")
    others = named(right).withColumn("copy", F.row_number().over(W.partitionBy("by", "embedding").orderBy("id"))).where(F.col("copy") <= k + 1).drop("copy")
    others = held(others)
    own = held(named(left))
    asked = held(own.groupBy("by", "embedding").agg(F.min("id").alias("id")).select("by", "id", "embedding"))
    largest = others.groupBy("by").count().agg(F.max("count")).first()[0] or 0
    centres = fit_cells(others, width, min(CELLS, max(1, -(-largest // size))), rounds)
    number = "float" if all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (left, right)) else "double"
    packs, queries = _packs(others, centres, width, size, number), _packs(asked, centres, width, size, number)
    directory = packs.select("by", "pack", "centre", "radius", F.size("rows").alias("n")).withColumn("part", F.floor((F.row_number().over(W.partitionBy("by", F.pmod("pack", F.lit(64))).orderBy("pack")) - 1) / (DIRECTORY / 64)))
    directory = held(directory.groupBy("by", "part").agg(F.collect_list(F.struct("pack", "centre", "radius", "n")).alias("roots")))
    kind = right.schema["id"].dataType.simpleString()
    wanted = k + 1 if same else k

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = unit([r["vec"] for r in row["rows"]], width)
                    reach = np.array(row["reach"] if row["reach"] is not None else [3.0] * len(x))
                    centres_ = np.array([r["centre"] for r in row["roots"]])
                    distance = np.sqrt(np.maximum(1 + (centres_**2).sum(1) - 2 * (x @ centres_.T), 0))
                    near = distance - np.array([r["radius"] for r in row["roots"]]) <= reach[:, None] + ROOM
                    nearest = int(((np.array(row["centre"]) - centres_) ** 2).sum(1).argmin())
                    for j, r in enumerate(row["roots"]):
                        at = np.flatnonzero(near[:, j]).tolist() if (j == nearest) == first else []
                        if at:
                            yield pa.RecordBatch.from_pylist([{"pack": r["pack"], "asked": [row["rows"][i] for i in at], "reach": reach[at].tolist()}], schema)

        schema = pa.schema([("pack", pa.int64()), ("asked", pa.list_(pa.struct([("id", arrow), ("vec", pa.list_(pa.float32() if number == "float" else pa.float64()))]))), ("reach", pa.list_(pa.float64()))])
        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                y, theirs = unit([r["vec"] for r in row["rows"]], width), [r["id"] for r in row["rows"]]
                step = max(1, AT_ONCE // len(y))
                for at in range(0, len(row["asked"]), step):
                    some = row["asked"][at : at + step]
                    d = np.sqrt(np.maximum(2 - 2 * (unit([r["vec"] for r in some], width) @ y.T), 0))
                    reach = np.array(row["reach"][at : at + step])
                    if d.shape[1] > wanted:
                        reach = np.minimum(reach, np.partition(d, wanted - 1, 1)[:, wanted - 1])
                    i, j = np.nonzero(d <= reach[:, None] + ROOM)
                    yield pa.record_batch([pa.array([some[p]["id"] for p in i.tolist()], arrow), pa.array([theirs[p] for p in j.tolist()], arrow), pa.array(d[i, j])], ["q", "b", "distance"])

    arrow = to_arrow_type(right.schema["id"].dataType)

    def once(first: bool, reach: DataFrame | None) -> DataFrame:
        sent = queries.withColumn("reach", F.lit(None).cast("array<double>")) if reach is None else queries.join(reach, "pack")
        pairs = sent.select("by", "rows", "centre", "reach").join(directory, "by").select("rows", "centre", "reach", "roots")
        routed = pairs.mapInArrow(route(first), f"pack long, asked {PACKED.format(kind, number)}, reach array<double>")
        return held(routed.join(packs.select("pack", "rows"), "pack").select("asked", "rows", "reach").mapInArrow(meet, f"q {kind}, b {kind}, distance double"))

    early = once(True, None)
    kth = early.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("distance"))).where(F.col("k") == wanted).select(F.col("q"), "distance")
    each = queries.select("pack", F.posexplode("rows").alias("at", "r")).select("pack", "at", F.col("r.id").alias("q")).join(kth, "q", "left")
    reach = each.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("distance", F.lit(3.0)).alias("d")))), lambda s: s["d"]).alias("reach"))
    found = early.unionByName(once(False, reach))
    close = F.row_number().over(W.partitionBy("q").orderBy("distance"))
    cut = found.withColumn("k", close).where(F.col("k") == wanted).select("q", F.col("distance").alias("last"))
    near = found.join(cut, "q", "left").where(F.col("last").isNull() | (F.col("distance") <= F.col("last") + 2 * ROOM)).select("q", "b")
    # Exact scores of what is left, from the vectors themselves
    scored = near.join(asked.select(F.col("id").alias("q"), F.col("embedding").alias("va")), "q").join(others.select(F.col("id").alias("b"), F.col("embedding").alias("vb")), "b").select("q", "b", cosine_score(F.col("va"), F.col("vb")).alias("score"))
    reps = own.join(asked.select("by", "embedding", F.col("id").alias("q")), ["by", "embedding"]).select(F.col("id").alias("a"), "q")
    pairs = reps.join(scored, "q").select("a", "b", "score")
    pairs = pairs.where("a <> b") if same else pairs
    return pairs.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("k") <= k).drop("k")
