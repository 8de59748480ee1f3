"""Hard-negative mining over embeddings: for an anchor and each of its best positives, the best rows of other labels whose score
lies in a window below the positive's. Inner products are searched with ball trees, by branch and bound.

1. Components become integers. Of rows with equal label and vector only the COPIES smallest ids can stand in any result (an
   anchor's list has fewer places), so the others leave the index, and anchors with equal label and vector are searched once.
2. Rows are dealt to trees of about TREE rows: by label, by the nearest of a few pivots (a bounded sample, PIVOTS rows), and by a
   hash of the id where a cell is larger. Each tree is built in its own task and stored as one row: nodes with centre, radius and
   range of labels, and the vectors in the order of the leaves.
3. A node with centre c and radius r bounds the inner products with an anchor q both ways: q.c - |q| r and q.c + |q| r. Nodes
   whose bounds lie outside all of the anchor's score windows, strictly beneath its current k-th score in each, or whose labels
   can't match, are pruned; equal scores aren't, since a smaller id may win.
4. Anchors go in blocks against the trees' roots (a directory of one small row for each few hundred trees). A first round visits the
   most promising tree of each block of the directory and gives each anchor a k-th score; the second visits every other tree
   that this bound doesn't prune. Each visit gives at most k rows for a window, which meet in a top-k of each anchor.
5. Two such searches: rows of the anchor's label for its positives, then rows of other labels in the positives' windows.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part, nor do components whose
floor is no long. A vector that is shorter than others has zeros for what it lacks. Several rows of one id count as that with the
smallest label, then vector. An anchor without positives, or without a negative in a window, gives no row there. Scores are
exact while they fit a long. An empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, released, small_batches, stored

POSITIVES, NEGATIVES, ANCHOR, MOVED, LABELS, SCALE, LOW, HIGH = 5, 3, 50, 7, 10, 256, 50, 95
#: The smallest ids of equal rows that may stand in a result: an anchor, its positives.
COPIES = POSITIVES + 1
#: Rows of a tree and of a leaf, groups of labels, pivots, and trees of a block of the directory.
TREE, LEAF, GROUPS, PIVOTS, DIRECTORY = 4096, 64, 16, 64, 512
#: Trees whose anchors make up a block of queries.
TOGETHER = 8

NODES = "struct<start:int,stop:int,left:int,right:int,low:int,high:int,radius:double,centre:array<double>>"
TREES = f"tree long, ids array<long>, labels array<int>, vectors binary, width int, nodes array<{NODES}>"



def rows_of(embeddings: DataFrame, move: bool = True) -> DataFrame:
    """vec_id, label and vec (longs) of the rows that take part, one of each vec_id. move: whether every MOVEDth row's label goes up by one."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * SCALE < 2.0**62))
    some = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))
    label = F.when(F.lit(move) & (F.col("vec_id") % MOVED == 0), (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), x.alias("vec")).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of b: by floats where these are exact, else by integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2.0**52 else a @ b.T


def build(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[dict]]:
    """A ball tree: the rows' order in its leaves, and its nodes in preorder. Labels are told apart first, then halves along the line of two far rows."""
    order, nodes, f = np.argsort(labels, kind="stable"), [], x.astype(np.float64)
    todo = [(0, len(x), -1, "")]
    while todo:
        start, stop, parent, side = todo.pop()
        at = order[start:stop]
        own, lab = f[at], labels[at]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        me = len(nodes)
        nodes.append({"start": start, "stop": stop, "left": -1, "right": -1, "low": int(lab.min()), "high": int(lab.max()), "radius": float(away.max() * (1 + 1e-9)), "centre": centre})
        if side:
            nodes[parent][side] = me
        n = stop - start
        if n <= leaf or (away.max() == 0 and lab.min() == lab.max()):
            continue
        if lab.min() != lab.max():
            borders = np.flatnonzero(lab[1:] != lab[:-1]) + 1
            cut = int(borders[np.abs(borders - n // 2).argmin()])
        else:
            one = own[away.argmax()]
            two = own[((own - one) ** 2).sum(1).argmax()]
            order[start:stop] = at[np.argsort(own @ (two - one), kind="stable")]
            cut = n // 2
        todo += [(start + cut, stop, me, "right"), (start, start + cut, me, "left")]
    return order, nodes


def planted(batches: Iterator[pa.RecordBatch], leaf: int, width: int) -> Iterator[dict]:
    held: list = []

    def grow() -> dict:
        vectors, labels, ids = matrix([r[2] for r in held], width), np.array([r[1] for r in held], np.int64), np.array([r[0] for r in held], np.int64)
        order, nodes = build(vectors, labels, leaf)
        return {"tree": tree, "ids": ids[order].tolist(), "labels": labels[order].tolist(), "vectors": vectors[order].astype("<i8").tobytes(), "width": width, "nodes": [n | {"centre": n["centre"].tolist()} for n in nodes]}

    tree = None
    for batch in batches:
        for t, i, label, vec in zip(*(batch.column(c).to_pylist() for c in ("tree", "vec_id", "label", "vec")), strict=True):
            if t != tree and held:
                yield grow()
                held = []
            tree = t
            held.append((i, label, vec))
    if held:
        yield grow()


def dealt(rows: DataFrame, size: int) -> DataFrame:
    """rows with the number of their tree. Numbers are dense, and trees of neighbouring numbers have the same labels and pivots."""
    spark = rows.sparkSession
    n = rows.count()
    pivots = [r["vec"] for r in rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(max(1, min(PIVOTS, n // (GROUPS * size)))).select("vec").collect()]
    width = max(map(len, pivots), default=0)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = matrix(pivots, width).astype(np.float64)
        half = (p**2).sum(1) / 2
        for batch in batches:
            x = matrix([v[:width] for v in batch.column("vec").to_pylist()], width).astype(np.float64)
            yield pa.record_batch([*batch.columns, pa.array((x @ p.T - half).argmax(1).astype(np.int32))], [*batch.schema.names, "cell"])

    placed = rows.withColumn("group", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))
    if len(pivots) > 1:
        placed = stored(placed.mapInArrow(released(nearest), "vec_id long, label int, vec array<long>, group int, cell int"), "placed")
    else:
        placed = placed.withColumn("cell", F.lit(0))
    counts = sorted((r["group"], r["cell"], r["n"]) for r in placed.groupBy("group", "cell").agg(F.count("*").alias("n")).collect())  # at most GROUPS * PIVOTS
    numbers, first = [], 0
    for group, cell, k in counts:
        numbers.append((group, cell, first, -(-k // size)))
        first += -(-k // size)
    numbered = placed.join(F.broadcast(spark.createDataFrame(numbers, "group int, cell int, first long, pieces long")), ["group", "cell"])
    return numbered.select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces"))).alias("tree"), "vec_id", "label", "vec")


def grown(placed: DataFrame, width: int, leaf: int) -> DataFrame:
    """One row for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())), ("vectors", pa.binary()), ("width", pa.int32()), ("nodes", pa.list_(pa.struct([*[(x, pa.int32()) for x in ("start", "stop", "left", "right", "low", "high")], ("radius", pa.float64()), ("centre", pa.list_(pa.float64()))])))])
        for tree in planted(batches, leaf, width):
            yield pa.RecordBatch.from_pylist([tree], schema)

    return placed.repartition("tree").sortWithinPartitions("tree", "vec_id").mapInArrow(released(run), TREES)


class Best:
    """The k best (score, id) of each query and window so far, scores descending, then ids ascending."""

    def __init__(self, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.floor = np.maximum(floor, low)  # a score that k rows elsewhere reach, or the window's end
        self.scores = np.full((*low.shape, k), np.iinfo(np.int64).min)
        self.ids = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def needs(self, at: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which of the queries have a window that scores between least and most may still enter."""
        return ((most[:, None] >= self.floor[at]) & (least[:, None] <= self.high[at])).any(1)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, right: np.ndarray) -> None:
        """scores of the queries at with rows; right: which of the pairs have labels that match."""
        for w in range(self.low.shape[1]):
            inside = right & (scores >= self.floor[at, w, None]) & (scores <= self.high[at, w, None])
            some = np.flatnonzero(inside.any(1))
            if not len(some):
                continue
            q = at[some]
            s = np.concatenate([self.scores[q, w], np.where(inside[some], scores[some], np.iinfo(np.int64).min)], 1)
            i = np.concatenate([self.ids[q, w], np.where(inside[some], ids[None, :], np.iinfo(np.int64).max)], 1)
            order = np.lexsort((i, ~s), axis=1)[:, : self.k]
            self.scores[q, w], self.ids[q, w] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            full = self.ids[q, w, -1] != np.iinfo(np.int64).max
            self.floor[q, w] = np.where(full, np.maximum(self.floor[q, w], self.scores[q, w, -1]), self.floor[q, w])


def matching(labels: np.ndarray, low: int, high: int, same: bool) -> np.ndarray:
    """Which queries may find a row with the wanted label among labels from low to high."""
    return (labels >= low) & (labels <= high) if same else ~((labels == low) & (labels == high))


def bounds(dots: np.ndarray, norms: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and most that integer inner products may be, with room for the rounding of floats."""
    room = norms * radius
    slack = 0.5 + 1e-9 * (np.abs(dots) + room)
    return dots - room - slack, dots + room + slack


def search(tree: dict, x: np.ndarray, labels: np.ndarray, best: Best, same: bool) -> int:
    """Branch and bound over one tree for all queries x at once; returns how many pairs were scored."""
    nodes, ids, own = tree["nodes"], np.array(tree["ids"], np.int64), np.array(tree["labels"], np.int64)
    vectors = np.frombuffer(tree["vectors"], "<i8").reshape(len(ids), tree["width"])
    centres, f = np.array([n["centre"] for n in nodes]), x.astype(np.float64)
    dots, norms, scored = f @ centres.T, np.sqrt((f**2).sum(1)), 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, at = todo.pop()
        n = nodes[k]
        at = at[matching(labels[at], n["low"], n["high"], same)]
        at = at[best.needs(at, *bounds(dots[at, k], norms[at], n["radius"]))]
        if not len(at):
            continue
        if n["left"] < 0:
            own_ids = slice(n["start"], n["stop"])
            right = (own[None, own_ids] == labels[at, None]) == same
            best.add(at, inner(x[at], vectors[own_ids]), ids[own_ids], right)
            scored += len(at) * (n["stop"] - n["start"])
            continue
        # The half that promises more comes first
        halves = sorted((n["left"], n["right"]), key=lambda h: float((dots[at, h] + norms[at] * nodes[h]["radius"]).mean()))
        todo += [(h, at) for h in halves]
    return scored


QUERIES = "block long, q long, label int, vec array<long>, low array<long>, high array<long>, floor array<long>"
ROUTED = "tree long, q array<long>, label array<int>, vec array<array<long>>, low array<array<long>>, high array<array<long>>, floor array<array<long>>"


def route(same: bool, first: bool, width: int):
    """Rows of a block of queries beside a block of the directory: for each tree that may hold something, its queries.

    first: only each query's most promising tree of the directory's block; else all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.int64()), ("q", pa.list_(pa.int64())), ("label", pa.list_(pa.int32())), *[(c, pa.list_(pa.list_(pa.int64()))) for c in ("vec", "low", "high", "floor")]])
        for batch in batches:
            for row in batch.to_pylist():
                qs, roots = row["queries"], row["roots"]
                x = matrix([r["vec"] for r in qs], width).astype(np.float64)
                low, high, floor = (np.array([r[c] for r in qs], np.int64) for c in ("low", "high", "floor"))
                labels, best = np.array([r["label"] for r in qs], np.int64), Best(low, high, floor, 1)
                dots, norms = x @ np.array([r["centre"] for r in roots]).T, np.sqrt((x**2).sum(1))
                open_, most = np.zeros(dots.shape, bool), np.full(dots.shape, -np.inf)
                for k, r in enumerate(roots):
                    least, most[:, k] = bounds(dots[:, k], norms, r["radius"])
                    open_[:, k] = matching(labels, r["low"], r["high"], same) & best.needs(np.arange(len(qs)), least, most[:, k])
                # The choice of the first round rests on what doesn't change between the rounds
                able = np.stack([matching(labels, r["low"], r["high"], same) for r in roots], 1)
                pick = np.where(able, most, -np.inf).argmax(1)
                picked = np.zeros_like(open_)
                picked[np.arange(len(qs)), pick] = able.any(1)
                open_ &= picked if first else ~picked
                for k, r in enumerate(roots):
                    at = np.flatnonzero(open_[:, k]).tolist()
                    if at:
                        yield pa.RecordBatch.from_pylist([{"tree": r["tree"]} | {c: [qs[i][c] for i in at] for c in ("q", "label", "vec", "low", "high", "floor")}], schema)

    return run


def visit(same: bool, k: int):
    """Rows of a tree beside routed queries: at most k (score, id) for each query and window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = matrix(row["q_vec"], row["width"])
                low, high, floor = (np.array(row[c], np.int64) for c in ("q_low", "q_high", "q_floor"))
                best = Best(low, high, floor, k)
                search(row, x, np.array(row["q_label"], np.int64), best, same)
                q, w, place = np.nonzero(best.ids != np.iinfo(np.int64).max)
                if len(q):
                    yield pa.record_batch([pa.array(np.array(row["q"], np.int64)[q]), pa.array(w.astype(np.int32)), pa.array(best.scores[q, w, place]), pa.array(best.ids[q, w, place])], ["q", "w", "score", "vec_id"])

    return run


FOUND = "q long, w int, score long, vec_id long"


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query and window. Spark cuts each task's rows to k of a key before the shuffle."""
    rank = F.row_number().over(W.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def searched(queries: DataFrame, trees: DataFrame, width: int, same: bool, k: int, windows: int) -> DataFrame:
    """FOUND with rank: the k best rows of each query's windows. queries: QUERIES without floor."""
    roots = trees.select("tree", F.col("nodes")[0].alias("root")).select("tree", "root.low", "root.high", "root.radius", "root.centre")
    directory = stored(roots.withColumn("part", F.floor(F.col("tree") / DIRECTORY)).groupBy("part").agg(F.collect_list(F.struct("tree", "low", "high", "radius", "centre")).alias("roots")), "directory")
    parts = [r["part"] for r in directory.select("part").collect()]  # one number for each DIRECTORY * TREE rows
    trees = trees.select("tree", "ids", "labels", "vectors", "width", "nodes")

    def once(asked: DataFrame, first: bool) -> DataFrame:
        packs = asked.groupBy("block").agg(F.collect_list(F.struct("q", "label", "vec", "low", "high", "floor")).alias("queries"))
        pairs = packs.withColumn("part", F.explode(F.array(*[F.lit(p).cast("long") for p in parts]))).join(bounded(directory), "part")
        routed = pairs.select("queries", "roots").mapInArrow(released(route(same, first, width)), ROUTED)
        routed = routed.select("tree", "q", *[F.col(c).alias(f"q_{c}") for c in ("label", "vec", "low", "high", "floor")])
        return stored(routed.join(trees, "tree").mapInArrow(released(visit(same, k)), FOUND), "found")

    none = F.array_repeat(F.lit(-(2**63)).cast("long"), windows)
    early = once(queries.withColumn("floor", none), True)
    kth = top(early, k).where(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    floor = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda w: F.coalesce(F.try_element_at("kth", w), F.lit(-(2**63)).cast("long")))
    late = once(queries.join(kth, "q", "left").withColumn("floor", floor).drop("kth"), False)
    return stored(top(early.unionByName(late), k), "best")


def mine(rows: DataFrame, anchors: DataFrame, size: int = TREE, leaf: int = LEAF) -> DataFrame:
    """The result for anchors (vec_id), which are among rows (vec_id, label, vec)."""
    small_batches(rows.sparkSession)
    rows = stored(rows, "rows")
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    copies = F.row_number().over(W.partitionBy("label", "vec").orderBy("vec_id"))
    placed = stored(dealt(stored(rows.withColumn("copy", copies).where(F.col("copy") <= COPIES).drop("copy"), "points"), size), "dealt")
    trees = stored(grown(placed, width, leaf), "trees")

    # Anchors with equal label and vector are searched once, under the smallest id of the rows that are equal
    keys = placed.groupBy("label", "vec").agg(F.min(F.struct("vec_id", "tree")).alias("r")).select("label", "vec", F.col("r.vec_id").alias("q"), F.floor(F.col("r.tree") / TOGETHER).alias("block"))
    named = stored(rows.join(bounded(anchors), "vec_id", "left_semi").join(keys, ["label", "vec"]).select(F.col("vec_id").alias("anchor_id"), "q", "block", "label", "vec"), "anchors")
    asked = stored(named.drop("anchor_id").dropDuplicates(["q"]), "asked")
    whole = [F.array(F.lit(x).cast("long")) for x in (-(2**63) + 1, 2**63 - 1)]
    likes = searched(asked.withColumns({"low": whole[0], "high": whole[1]}), trees, width, True, COPIES, 1)
    lists = likes.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), F.col("vec_id").alias("positive_id")))).alias("likes"))
    own = named.select("anchor_id", "q").join(lists, "q").select("anchor_id", "q", F.explode(F.slice(F.filter("likes", lambda x: x["positive_id"] != F.col("anchor_id")), 1, POSITIVES)).alias("p"))
    own = own.select("anchor_id", "q", "p.positive_id", (-F.col("p.below")).alias("positive_score"))

    # The windows of an anchor: one for each score of its positives, in order; LOW * p <= 100 * n <= HIGH * p
    scores = lists.select("q", F.array_sort(F.array_distinct(F.transform("likes", lambda x: -x["below"]))).alias("scores"))
    at = lambda k: F.try_element_at("scores", F.lit(k + 1))
    low = F.array(*[F.coalesce(F.ceil(at(k) * LOW / F.lit(100).cast("decimal(20,0)")).cast("long"), F.lit(2**63 - 1)) for k in range(COPIES)])
    high = F.array(*[F.coalesce(F.floor(at(k) * HIGH / F.lit(100).cast("decimal(20,0)")).cast("long"), F.lit(-(2**63) + 1)) for k in range(COPIES)])
    hard = searched(asked.join(scores.withColumns({"low": low, "high": high}), "q").drop("scores"), trees, width, False, NEGATIVES, COPIES)
    hard = hard.join(scores, "q").select("q", F.element_at("scores", F.col("w") + 1).alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return own.join(hard, ["q", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mine(rows, rows.where(F.col("vec_id") % ANCHOR == 0).select("vec_id"))


OP13_SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % {ANCHOR} = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
neg AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}
"""
