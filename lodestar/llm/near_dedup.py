"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes). Texts with equal sets form a class, and only the one
   with the smallest doc_id goes on, with SLOTS minwise tokens of its set.
2. Independent trees branch the documents: at the root tree k sends a document down by its token in slot k; a node with more
   than LEAF documents branches again by one or two slots chosen by a hash of the node (4/3 on average, as the threshold asks
   for). Documents of small nodes are compared exhaustively by their tokens, one byte each; what looks alike is linked to the
   smallest doc_id of its cluster in the node.
3. Near copies would stay together at every level and multiply. So in a large node all documents are held against its root, the
   smallest doc_id: where half as many as a leaf holds have NEAR slots equal with it, the documents that have SHELL slots equal
   are linked to the root as candidates, and the near copies branch no further. Distance is a metric: what is similar to a near
   copy of the root is within the shell (3.5 standard deviations on both sides). Other nodes branch until they are small; one
   that is still large at DEPTH links all its documents as candidates, so no pair is lost for size.
4. Components of these links hold every pair that may be similar. In each the full sets are compared, in blocks of bounded
   size with the most linked documents repeated in each, and only between documents that aren't in one component yet. Where
   blocks of a component stay apart, pairs of blocks follow for the documents outside the largest part; in components of over
   PAIRED blocks those of each leaf's cluster instead, which are bounded, and of each collapsed node. So links are confirmed on
   full sets, no pairs of a group are written out, and a component never has to fit into one task.

The chance that TREES trees miss a pair at the threshold is below 1e-6 where nodes are small. Where all nodes that it shares are
large it stays together in a tree with chance 0.40 after five levels and 0.23 after twelve, so all trees miss it with 3e-4 and
0.015; pairs of more than the threshold much less. The byte comparison keeps LOOKS of the slots equal, four standard deviations
below what such a pair has.

Defined results: a null text, an empty one and one of white space have no shingles and link with nothing; a text of fewer
than five words is one shingle. Rows that share a doc_id count as one document; a null doc_id links with nothing and stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, documents, released, stored

WORDS, NUM, DEN = 5, 75, 100  # 100 * intersection >= 75 * union
#: A row of a leaf costs at most LEAF comparisons of SLOTS bytes, about what a level of branching costs.
SLOTS, TREES, LEAF, DEPTH, LOOKS = 128, 16, 2048, 12, 74
#: Slots that a near copy has equal with the root of a large node, and what is similar to a near copy.
NEAR, SHELL = 109, 43
#: Documents and shingles of a block of full sets; a component's most linked documents that go to each of its blocks.
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS = 1000, 1_500_000, 8
#: Blocks of a component of which all pairs may be compared, pairs of a block that are tried one by one without success before
#: all are counted at once, and rows of large nodes' roots, with their tokens, that may be broadcast.
PAIRED, MISSES, ROOTS = 32, 2000, 20_000

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(0, 2**63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. bytes.lower() and split() know ASCII only, as is wanted here."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - WORDS + 1)
    with np.errstate(over="ignore"):
        s = np.full(n, min(len(h), WORDS), np.uint64)
        for k in range(min(WORDS, len(h))):
            s += h[k : k + n] * _PLACES[k]
        s ^= s >> np.uint64(31)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(29)
    return np.unique(s)


def tokens(s: np.ndarray) -> np.ndarray:
    """The set's minwise token in each slot, 32 bits."""
    least = np.full(SLOTS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 8192):
            np.minimum(least, np.multiply.outer(_MULTIPLIERS, s[at : at + 8192]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


SKETCHES = "doc_id long, n_shingles long, set_id binary, tokens array<int>, low binary"


def sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                n, ids, toks = [], [], []
                for text in batch.column("text").slice(a, 500):
                    s = shingles(text.as_py(), words)
                    n.append(len(s))
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    toks.append(tokens(s))
                m = np.stack(toks)
                flat = pa.array(m.reshape(-1).view(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, SLOTS, dtype=np.int32)), flat)
                low = [r.tobytes() for r in m.astype(np.uint8)]
                yield pa.record_batch([batch.column("doc_id").slice(a, 500), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), lists, pa.array(low, pa.binary())], ["doc_id", "n_shingles", "set_id", "tokens", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), SKETCHES)


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches, several short runs at a time: a table ends where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(held) and held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py()
        cuts = np.flatnonzero(change)
        if len(cuts):
            first, last = int(cuts[0]), int(cuts[-1])
            if held or first:
                yield pa.Table.from_batches([*held, batch.slice(0, first)])
                held = []
            if last > first:
                yield pa.Table.from_batches([batch.slice(first, last - first)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def runs(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    n = table.num_rows
    change = np.zeros(n + 1, bool)
    change[[0, n]] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:n] |= v[1:] != v[:-1]
    at = np.flatnonzero(change).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def equal_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many slots agree, for all rows of a against all of b, a few rows at a time, eight slots in a word."""
    seven, high = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
    x, y, out = a.view(np.uint64), b.view(np.uint64), np.empty((len(a), len(b)), np.int16)
    for i in range(0, len(a), 8):
        begin = i if a is b else 0
        d = x[i : i + 8, None, :] ^ y[None, begin:, :]
        e = d & seven
        e += seven
        e |= d
        e &= high  # the high bit of each byte that differs
        out[i : i + 8, begin:] = SLOTS - np.bitwise_count(e).sum(2, dtype=np.int16)
        if begin:
            out[i : i + 8, :begin] = out[:begin, i : i + 8].T
    return out


def reached(m: np.ndarray) -> np.ndarray:
    """The least index that each one reaches over a symmetric matrix of links."""
    label = np.arange(len(m), dtype=np.int32)
    while True:
        new = np.minimum(label, np.where(m, label[None, :], np.int32(len(m))).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINKS = "node long, id long, root long, degree long"


def compare_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, id, low) sorted by node and id: each id's cluster in the node and how many look like it there."""
    for table in by_key(batches, ["node"]):
        nodes, ids = table.column("node").to_numpy(), table.column("id").to_numpy()
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, SLOTS)
        pairs, out = [], []
        for a, b in runs(table, ["node"]):
            if b - a == 2:
                pairs.append(a)
                continue
            own = low[a:b]
            m = equal_slots(own, own) >= LOOKS
            np.fill_diagonal(m, False)
            degree = m.sum(1)
            some = np.flatnonzero(degree)
            if len(some):
                out.append(np.stack([nodes[a + some], ids[a + some], ids[a + reached(m)[some]], degree[some]], 1))
        p = np.array(pairs, np.int64)
        p = p[(low[p] == low[p + 1]).sum(1) >= LOOKS] if len(p) else p
        out += [np.stack([nodes[p], ids[p + k], ids[p], np.ones(len(p), np.int64)], 1) for k in (0, 1)] if len(p) else []
        if out:
            made = np.concatenate(out).astype(np.int64)
            yield pa.record_batch([pa.array(made[:, i]) for i in range(4)], ["node", "id", "root", "degree"])


def branches(node: Column) -> Column:
    """The slots that a node's documents branch by: one, or in one of three nodes two."""
    slot = lambda k: F.pmod(F.xxhash64(node, F.lit(k)), F.lit(SLOTS)).cast("int")
    return F.when(F.pmod(F.xxhash64(node, F.lit(0)), F.lit(3)) == 0, F.array(slot(1), slot(2))).otherwise(F.array(slot(1)))


def candidate_links(reps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Rows (node, id, root, degree): documents that look alike in a node of some tree, by cluster. reps: id, tokens, low.

    A collapsed node's rows bear a number that its root alone gives, so equal groups of several trees are one.
    """
    at = [F.xxhash64(F.lit(k), F.col("tokens")[k]) for k in range(TREES)]
    rows = reps.select("id", F.explode(F.array(*at)).alias("node"))
    same = F.aggregate(F.zip_with("tokens", "root_tokens", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    found = []
    for depth in range(DEPTH):
        sizes = rows.groupBy("node").count().where("count > 1")
        rows = stored(rows.join(sizes, "node"), "nodes")
        small = rows.where(F.col("count") <= leaf).select("node", "id").join(reps.select("id", "low"), "id")
        found.append(small.repartition("node").sortWithinPartitions("node", "id").mapInArrow(released(compare_leaves), LINKS))
        large = rows.where(F.col("count") > leaf).select("node", "id")
        if large.isEmpty():
            break
        held = stored(reps.select("id", "tokens").join(bounded(large), "id"), "held")
        roots = held.groupBy("node").agg(F.min(F.struct("id", "tokens")).alias("r")).select("node", F.col("r.id").alias("root"), F.col("r.tokens").alias("root_tokens"))
        held = held.join(bounded(stored(roots, "roots"), limit=ROOTS), "node").select("node", "id", "root", "tokens", same.alias("same"))
        near = F.sum((F.col("same") >= NEAR).cast("long"))
        held = stored(held, "judged")
        full = held.groupBy("node").agg(near.alias("near")).where(F.col("near") >= leaf // 2).select("node", F.lit(True).alias("full"))
        held = held.join(bounded(full), "node", "left").withColumn("full", F.coalesce("full", F.lit(False)))
        linked = held.where(F.col("full") & (F.col("same") >= SHELL)).withColumn("node", F.xxhash64(F.lit("root"), "root"))
        rest = held.where(~F.col("full") | (F.col("same") < NEAR))
        if depth == DEPTH - 1:
            linked, rest = linked.unionByName(held.where(~F.col("full"))), rest.limit(0)
        found.append(linked.select("node", "id", "root", F.lit(1).cast("long").alias("degree")))
        if rest.isEmpty():
            break
        down = rest.select("node", "id", "tokens").withColumn("slot", F.explode(branches(F.col("node"))))
        rows = down.select("id", F.xxhash64("node", "slot", F.col("tokens")[F.col("slot")]).alias("node")).distinct()
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return stored(links, "links")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the graph whose edges are (id, root): the smallest id that can be reached. Alternates large and small stars."""
    edges = links.select(F.col("id").alias("u"), F.col("root").alias("v")).where("u != v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        new = stored(small, "edges")
        # Stars: no vertex has two parents or is a parent's child's parent
        if new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            break
        edges = new
    ids = new.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(new.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return DEN * shared >= NUM * (len(a) + len(b) - shared)


def shared(full: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets, by products of 0-1 matrices over the shingles that more than one has."""
    who = np.repeat(np.arange(len(full), dtype=np.int32), [len(x) for x in full])
    flat = np.concatenate(full)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    column = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
    several = np.bincount(column) > 1
    keep = several[column]
    column, who, out = (np.cumsum(several) - 1)[column[keep]], who[keep], np.zeros((len(full), len(full)), np.float32)
    ends = np.searchsorted(column, np.arange(0, int(several.sum()) + 4096, 4096))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        m = np.zeros((len(full), 4096), np.float32)
        m[who[a:b], column[a:b] % 4096] = 1
        out += m @ m.T
    return out


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, block, id, part, low, shingles) sorted by component and block: links (id, root) that full sets confirm.

    Pairs are tried as their tokens agree, most first, and only between ids that nothing has joined yet; part is what joins
    ids from before. After MISSES trials without success the intersections of all pairs are counted at once.
    """
    for table in by_key(batches, ["component", "block"]):
        all_ids, parts, sets = table.column("id").to_numpy(), table.column("part").to_numpy(), table.column("shingles")
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, SLOTS)
        out: list[tuple[int, int]] = []
        for a, b in runs(table, ["component", "block"]):
            ids, full = all_ids[a:b], [np.frombuffer(x, np.uint64) for x in sets.slice(a, b - a).to_pylist()]
            u, first = Union(b - a), {}
            for name in (ids, parts[a:b]):
                first.clear()
                for i, x in enumerate(name.tolist()):
                    u.join(first.setdefault(x, i), i)
            old = [u.find(i) for i in range(b - a)]
            own, before = low[a:b], np.array(old)
            looks = equal_slots(own, own)
            i, j = np.nonzero(np.triu((looks >= LOOKS) & (before[:, None] != before), 1))
            order, misses = np.argsort(-looks[i, j], kind="stable"), 0
            for n, k in enumerate(order):
                x, y = int(i[k]), int(j[k])
                if u.find(x) != u.find(y):
                    if similar(full[x], full[y]):
                        u.join(x, y)
                    else:
                        misses += 1
                if misses > MISSES:
                    both, sizes = shared(full), np.array([len(x) for x in full])
                    left = order[n + 1 :]
                    x, y = i[left], j[left]
                    c = both[x, y].astype(np.int64)
                    alike = DEN * c >= NUM * (sizes[x] + sizes[y] - c)
                    for v, w in zip(x[alike].tolist(), y[alike].tolist(), strict=True):
                        u.join(v, w)
                    break
            out += [(int(ids[i]), int(ids[u.find(i)])) for i in range(b - a) if u.find(i) != old[i]]
        if out:
            made = np.array(out, np.int64)
            yield pa.record_batch([pa.array(made[:, 0]), pa.array(made[:, 1])], ["id", "root"])


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, low, shingles of the documents in wanted (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                sets = [shingles(t.as_py(), words) for t in batch.column("text").slice(a, 200)]
                yield pa.record_batch([batch.column("id").slice(a, 200), pa.array([tokens(s).astype(np.uint8).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "low", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(bounded(wanted), "id")
    return texts.select("id", "text").mapInArrow(released(run), "id long, low binary, shingles binary")


CONFIRMED = "id long, root long"


def confirmed_links(docs: DataFrame, reps: DataFrame, found: DataFrame, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, paired: int = PAIRED) -> DataFrame:
    """Links (id, root) that join exactly the ids that similar pairs within components of the candidates join. found: candidate_links()."""
    links = stored(found.groupBy("id", "root").agg(F.sum("degree").alias("degree")), "links")
    members = components(links).join(reps.select("id", "n_shingles"), "id").join(links.groupBy("id").agg(F.sum("degree").alias("degree")), "id", "left")
    members = stored(members, "members")
    blocks = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int")
    in_blocks = lambda rows: rows.join(rows.groupBy("component").agg(blocks.alias("blocks")), "component")
    members = stored(in_blocks(members), "blocks")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    wide = members.where("blocks > 1")
    several = not wide.isEmpty()
    placed = members.select("id", "component", own.alias("block"))
    if several:
        # Of each large component, the ids with the most candidate links go to every block
        top = most_linked(wide.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64))))
        placed = placed.unionByName(top.select("id", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))).distinct()
    sets = full_sets(docs, members.select("id").distinct())
    sets = stored(sets, "sets") if several else sets

    def checked(at: DataFrame) -> DataFrame:
        return sets.join(at, "id").repartition("component", "block").sortWithinPartitions("component", "block", "id").mapInArrow(released(confirm), CONFIRMED)

    sure = stored(checked(placed.withColumn("part", F.col("id"))), "confirmed")
    if not several:
        return sure
    parts = components(sure).withColumnRenamed("component", "part")
    labelled = stored(wide.join(parts, "id", "left").select("id", "component", "n_shingles", "blocks", F.coalesce("part", "id").alias("part")), "parts")
    far = labelled.where(F.col("blocks") > paired)
    if not far.isEmpty():
        # Too many pairs of blocks: the clusters of leaves and of collapsed nodes hold every candidate pair too
        clusters = found.select(F.xxhash64("node", "root").alias("component"), "id").distinct()
        near = labelled.where(F.col("blocks") <= paired)
        labelled = stored(near.unionByName(in_blocks(far.drop("component", "blocks").join(clusters, "id"))), "parts")
    counts = labelled.groupBy("component", "part").count()
    main = counts.groupBy("component").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rest = labelled.join(main, "component").withColumn("outside", F.col("part") != F.col("main"))
    outside = rest.where("outside").groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("out_blocks"))
    rest = rest.join(outside, "component").withColumn("own", F.when(F.col("outside"), F.pmod(F.xxhash64("id"), F.col("out_blocks"))).otherwise(F.col("out_blocks") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
    # Pairs of blocks (i, j), i an outside one: a block of outside ids meets all others, one of the main part the outside ones
    total = F.col("out_blocks") + F.col("blocks")
    meets = F.when(F.col("outside"), F.sequence(F.lit(0), total - 1)).otherwise(F.sequence(F.lit(0), F.col("out_blocks") - 1))
    paired_with = rest.withColumn("other", F.explode(meets)).where("own != other")
    at = paired_with.select("id", "component", "part", (F.least("own", "other") * total + F.greatest("own", "other")).cast("int").alias("block"))
    return sure.unionByName(checked(at))


def most_linked(each: DataFrame) -> DataFrame:
    """The PIVOTS ids of most degree of each component, first by slices so that no task sorts a whole component."""
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("degree"), "id"))
    some = each.withColumn("rank", rank("component", "slice")).where(F.col("rank") <= PIVOTS)
    return some.withColumn("rank", rank("component")).where(F.col("rank") <= PIVOTS).select("id", "component", "blocks")


def near_groups(docs: DataFrame, leaf: int = LEAF, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, paired: int = PAIRED) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    made = stored(sketches(docs), "sketches")
    some = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = some.groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "tokens", "low")).alias("r"))
    reps = stored(classes.select("set_id", F.col("r.doc_id").alias("id"), "r.n_shingles", "r.tokens", "r.low"), "classes")
    own = some.select("doc_id", "set_id").join(reps.select("set_id", "id"), "set_id")
    found = confirmed_links(docs, reps, candidate_links(reps, leaf), block_docs, block_shingles, paired)
    # Several rows of one doc_id may stand for several classes: they are one document, so its classes are linked
    shared = own.where("doc_id != id").select(F.col("doc_id").alias("id"), F.col("id").alias("root"))
    twice = made.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = own.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("id").alias("root"), F.max("id").alias("far"))
    several = shared.join(twice.withColumnRenamed("doc_id", "id"), "id", "left_semi").unionByName(again.where("root != far").select(F.col("far").alias("id"), "root"))
    final = components(found.unionByName(several))
    rows = made.select("doc_id", "n_shingles", "set_id").join(reps.select("set_id", "id"), "set_id", "left").join(final, "id", "left")
    rows = rows.withColumn("component_id", F.coalesce("component", "id", "doc_id"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each component of near duplicates."""
    gone = stored(near_groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "near-dropped")
    return docs.join(bounded(gone), docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
