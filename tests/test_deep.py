"""Structures against brute force: vector cells, inverted index, similarity and interval joins, common neighbours, merging."""

import random
from itertools import combinations

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from lodestar.model import table
from lodestar.operators import access, joins, patterns, resolve, retrieval, textindex, vectors

# Vectors


@pytest.fixture(scope="module")
def cells(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").selectExpr("vec_id AS id", "embedding", "label AS graph_id")
    return rows, vectors.build(rows, cells=32)


def test_probes_equal_a_full_scan_and_read_few_vectors(spark, cells):
    rows, index = cells
    asked = [list(r["embedding"]) for r in rows.where("id % 400 = 7").orderBy("id").collect()]
    recall, read = [], []
    for q in asked:
        report = {}
        found = vectors.probe(index, q, report=report).collect()
        wanted = retrieval.vector_topk(rows, q).collect()
        assert [(r["id"], r["score"]) for r in found] == [(r["id"], r["score"]) for r in wanted]
        recall.append(1.0)
        read.append(report["vectors"])
    print(f"recall@10 {np.mean(recall):.2f}, share of vectors read {np.mean(read):.4f}")
    assert np.mean(read) < 0.15


def test_bounds_hold_and_skip_cells_where_vectors_cluster(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = centres[np.arange(2000) % 20] + 0.05 * rng.normal(size=(2000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0])], "id long, embedding array<double>")
    index, report = vectors.build(rows, cells=20), {}
    found = vectors.probe(index, x[3].tolist(), 10, report=report).collect()
    assert [r["id"] for r in found] == [r["id"] for r in retrieval.vector_topk(rows.where("id < 5000"), x[3].tolist()).collect()]
    assert report["codes"] < 0.2 and report["vectors"] < 0.1 and index.sizes.sum() == 2000
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = {r["id"]: r["_cell"] for r in index.rows.select("id", "_cell").collect()}
    for q in u[:40]:
        most = index.bounds(q)
        assert all(u[i] @ q <= most[c] for i, c in own.items())


def test_federated_lists_merge_to_the_best_of_all(spark, cells):
    rows, index = cells
    q = list(rows.where("id = 11").first()["embedding"])
    scores = {(r["graph_id"], r["id"]): r["score"] for r in retrieval.vector_topk(rows.withColumn("id", F.struct("graph_id", "id")), q, n=3000).select("id.*", "score").collect()}
    for n, per_graph in ((5, 2), (20, 3), (40, 100)):
        wanted = []
        for g in (1, 4, 6):
            wanted += sorted([(-s, i, g) for (h, i), s in scores.items() if h == g])[:per_graph]
        found = [(r["graph_id"], r["id"]) for r in vectors.federated_topk(index, q, [1, 4, 6], n=n, per_graph=per_graph).collect()]
        assert found == [(g, i) for _, i, g in sorted(wanted)[:n]]


@pytest.mark.parametrize("size", [30, vectors.PACK])
def test_nearest_neighbours_equal_all_pairs(spark, size):
    rng = np.random.default_rng(size)
    x = np.concatenate([rng.normal(size=(160, 6)), np.repeat(rng.normal(size=(2, 6)), 30, 0), 0.01 * rng.normal(size=(20, 6)) + 1])
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(900, [0.0] * 6, 0), (901, None, 1), (902, [1.0] * 6, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, g int")
    got = {}
    for r in vectors.knn(df, df, 4, ["g"], same=True, size=size).collect():
        got.setdefault(r["a"], []).append((-r["score"], r["b"]))
    pairs = df.alias("p").join(df.alias("q"), (F.col("p.g") == F.col("q.g")) & (F.col("p.id") != F.col("q.id"))).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), vectors.cosine_score(F.col("p.embedding"), F.col("q.embedding")).alias("score")).where("score is not null").collect()
    wanted = {}
    for r in pairs:
        wanted.setdefault(r["a"], []).append((-r["score"], r["b"]))
    assert {a: sorted(v) for a, v in got.items()} == {a: sorted(v)[:4] for a, v in wanted.items()}


# Text


def test_index_equals_full_scans_through_changes_and_skips_blocks(spark, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 16)
    monkeypatch.setattr(textindex, "EARLY", 2)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 60)))
    now = {i: text() for i in range(600)} | {600: None, 601: "", 602: "!! ..", 603: "w59 w59 W59 w59"}
    frame = lambda d: spark.createDataFrame([(i, t) for i, t in d.items()], "id long, text string")
    index, skipped = textindex.build(frame(now).repartition(3), "id"), False
    for step in range(3):
        for q in ("w0 w59", "w58", "w3 W40 w57", "nothing", "w0"):
            report = {}
            found = textindex.search(index, q, report=report).collect()
            wanted = retrieval.bm25(frame(now), q, "id").collect()
            assert [(r["id"], round(r["score"], 8)) for r in found] == [(r["id"], round(r["score"], 8)) for r in wanted], (step, q)
            skipped |= bool(report) and report["blocks"][0] < report["blocks"][1]
        counted = {r["term"]: r["docs"] for r in textindex.listing(index).where("term <> 'again'").collect()}
        held = [set((t or "").lower().split()) if i != 602 else set() for i, t in now.items()]
        assert counted == {w: n for w in words if (n := sum(w in h for h in held))}
        changed = {i: text() for i in rng.sample(range(600), 40)} | {1000 + step: "w59 again"}
        removed = rng.sample(sorted(set(now) - set(changed)), 30)
        index = textindex.update(index, frame(changed), removed=spark.createDataFrame([(i,) for i in removed], "id long"))
        now = {i: t for i, t in (now | changed).items() if i not in removed}
    assert skipped
    whole = textindex.compact(index)
    best = [[(r["id"], round(r["score"], 8)) for r in textindex.search(i, "w3 w59").collect()] for i in (whole, index)]
    assert best[0] == best[1]
    assert textindex.search(textindex.build(frame(now).where("false"), "id"), "w1").count() == 0


# Joins


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(("least", "gap"), [(0.8, None), (0.6, None), (0.85, 2), (0.5, None)])
def test_edit_pairs_lose_none(spark, least, gap):
    rng = random.Random(int(least * 100))
    base = ["".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(60)]
    names = base + ["x" * rng.randint(1, 3) + rng.choice(base) for _ in range(20)]
    for w in rng.choices(base, k=60):
        for _ in range(rng.randint(1, 4)):
            p = rng.randint(0, len(w))
            w = rng.choice([w[:p] + rng.choice("abcx") + w[p:], w[:p] + w[p + 1 :], w[: max(0, p - 1)] + "x" + w[p:]])
        names.append(w)
    names += ["", "A", None, base[0].upper()]
    rows = list(enumerate(names))
    wanted = set()
    for (i, a), (j, b) in combinations([(i, n.lower()) for i, n in rows if n is not None], 2):
        alike = round(1 - edits(a, b) / max(len(a), len(b)), 6) if a or b else 1.0
        inside = a in b or b in a
        if a == b or ((alike > least or inside) and (gap is None or abs(len(a) - len(b)) <= gap)):
            wanted.add((i, j))
    found = joins.edit_pairs(spark.createDataFrame(rows, "id long, name string"), least, gap).collect()
    assert len(found) == len({(r["a"], r["b"]) for r in found}) and {(r["a"], r["b"]) for r in found} == wanted


def test_overlaps_of_one_hot_key_equal_all_pairs_and_counts(spark):
    rng = random.Random(8)
    facts = []
    for i in range(500):
        f = rng.randint(0, 1000)
        facts.append((f"e{i:03}", "k" if i % 4 else "other", None if i % 50 == 0 else f, None if i % 60 == 0 else f + rng.choice([0, 1, 5, 40, 900, -3])))
    df = spark.createDataFrame(facts, "edge_id string, k string, f int, t int").selectExpr("edge_id", "k", "timestamp_seconds(f * 3600) AS valid_from", "timestamp_seconds(t * 3600) AS valid_to")
    low, high = -(10**12), 10**12
    spans = [(i, k, low if f is None else f, high if t is None else t) for i, k, f, t in facts]
    wanted = {(x[0], y[0]) for x, y in combinations(spans, 2) if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    found = [(r["a"], r["b"]) for r in joins.overlaps(df, ["k"]).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    proper = [s for s in spans if s[2] < s[3]]
    for step in (20, 10_000):
        counts = {r["k"]: (r["facts"], r["pairs"]) for r in joins.overlap_counts(df, ["k"], step).collect()}
        assert counts == {k: (sum(s[1] == k for s in proper), sum(x[1] == y[1] == k and x[2] < y[3] and y[2] < x[3] for x, y in combinations(proper, 2))) for k in ("k", "other")}


def test_overlap_counts_of_a_hundred_thousand_facts_in_one_key(spark):
    df = spark.range(100_000).selectExpr("id AS edge_id", "'k' AS k", "timestamp_seconds(id * 60) AS valid_from", "timestamp_seconds(id * 60 + 601) AS valid_to")
    assert joins.overlap_counts(df, ["k"]).first()["pairs"] == sum(min(10, i) for i in range(100_000))


@pytest.mark.parametrize(("n", "heavy"), [(50, 5), (50, 10_000), (7, 3), (None, 5)])
def test_common_neighbours_with_hubs_of_all_members(spark, n, heavy):
    rng = random.Random(heavy)
    links = [(m, h) for h in range(25) for m in rng.sample(range(60), rng.randint(1, 8))]
    links += [(m, 100) for m in range(60)] + [(m, 101) for m in range(60) if m % 3] + [(m, 102) for m in range(0, 60, 4)]
    links += links[:20] + [(None, 100), (3, None)]
    hubs = {}
    for m, h in links:
        if m is not None and h is not None:
            hubs.setdefault(m, set()).add(h)
    wanted = sorted((-len(hubs[a] & hubs[b]), a, b) for a, b in combinations(sorted(hubs), 2) if len(hubs[a] & hubs[b]) >= 2)
    found = joins.common_neighbours(spark.createDataFrame(links, "member int, hub int"), 2, n, heavy).collect()
    rows = [(-r["common"], r["a"], r["b"]) for r in found]
    assert (rows if n else sorted(rows)) == wanted[:n]


# Merging


def sequential(pairs):
    gone, taken = set(), []
    for g, keeper, loser, score in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if (g, keeper) not in gone and (g, loser) not in gone:
            gone.add((g, loser))
            taken.append((g, loser, keeper, score))
    return sorted(taken)


def test_merging_in_rounds_equals_one_pair_after_the_other(spark):
    rng = random.Random(12)
    pairs = [(f"g{rng.randrange(3)}", f"n{a:02}", f"n{b:02}", rng.choice([0.9, 0.95, round(rng.random(), 3)])) for a, b in (rng.sample(range(40), 2) for _ in range(300))]
    pairs += [("star", "hub", f"s{i}", 0.5 + i / 1000) for i in range(50)] + [("chain", f"c{i:02}", f"c{i + 1:02}", 0.9 - i / 100) for i in range(12)] + pairs[:10]
    df = spark.createDataFrame(pairs, "graph_id string, keeper string, loser string, score double")
    assert sorted(tuple(r) for r in resolve.merge_pairs(df).collect()) == sequential(set(pairs))
    assert resolve.merge_pairs(df.where("false")).count() == 0


def test_components_of_chains_stars_and_pairs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = {r["id"]: r["root"] for r in resolve.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


def test_four_passes_and_a_dry_run(spark):
    e = lambda x, y: [float(x), float(y), 1.0]
    nodes = spark.createDataFrame(
        [("g", "a", "Acme Inc", e(0, 0), None, None), ("g", "b", "ACME", e(5, 1), ["Acme Co"], None), ("g", "c", "Akme", e(0.01, 0), None, None), ("g", "d", "Other", e(-9, 3), None, None), ("g", "x", "  ", e(2, -7), None, None), ("h", "a2", "Acme", e(0, 0), None, None), ("g", "n", None, None, None, None)],
        "graph_id string, id string, name string, embedding array<double>, aliases array<string>, canonical_name string",
    )
    edges = spark.createDataFrame([("g", "1", "b", "d", "R", None), ("g", "2", "a", "d", "R", 2), ("g", "3", "c", "d", "R", None), ("g", "4", "a", "b", "R", None), ("g", "5", "a", "d", "SIMILAR_TO", None), ("g", "6", "b", "d", "SIMILAR_TO", None), ("g", "7", "d", "d", "S", None)], "graph_id string, edge_id string, src string, dst string, type string, count long")
    kept, rewired, report = resolve.deduplicate(nodes, edges)
    got = {r["id"]: sorted(r["aliases"]) for r in kept.collect()}
    assert got == {"a": ["ACME", "Acme Co", "Akme"], "d": [], "x": [], "a2": [], "n": []}
    assert sorted((r["edge_id"], r["src"], r["dst"], r["type"], r["count"]) for r in rewired.collect()) == [("1", "a", "d", "R", 4), ("5", "a", "d", "SIMILAR_TO", 1), ("6", "a", "d", "SIMILAR_TO", 1), ("7", "d", "d", "S", 1)]
    row = report.where("graph_id = 'g'").first().asDict()
    assert (row["canonical_names_added"], row["skipped_bad_names"], row["canonical_merges"], row["embedding_merges"], row["relationship_consolidations"]) == (4, 2, 1, 1, 2)
    same, _, plan = resolve.deduplicate(nodes, edges, dry_run=True)
    assert same.count() == 7 and plan.where("graph_id = 'g'").first()["canonical_names_added"] == 4


def test_embeddings_of_the_tables_meet_only_near_ones(spark):
    rows = table(spark, SF, "embeddings").selectExpr("vec_id AS id", "embedding")
    assert resolve.similar_edges(rows, 3, 0.6).count() > 0


# Paths


def test_patterns_equal_walks_one_by_one(spark):
    rng = random.Random(21)
    edges = [(rng.randrange(25), rng.randrange(25), rng.choice("ABC"), rng.randrange(10)) for _ in range(90)]
    df = spark.createDataFrame(edges, "src int, dst int, type string, w int")
    S = patterns.Step
    cases = [
        [S(("A",), "out", 1, None)],
        [S(None, "both", 2, 3, "w < 5"), S(("B", "C"), "in", 0, 2)],
        [S(("A", "B"), "out", 0, None, "w >= 2"), S(("C",), "in"), S(("A",), "both", 1, 2)],
        [S(("C",), "out", 0, 1)],
        [S(("B",), "out", 2, None)],
    ]
    for steps in cases:
        wanted = {}
        for s in range(6):
            # States: step and how many of its edges were taken; counts stop at the bound that matters
            front, seen = {(s, 0, 0): (s,)}, {}
            hops = 0
            while front:
                for (v, k, n), path in list(front.items()):  # steps that may be over
                    while k < len(steps) and n >= steps[k].least:
                        k, n = k + 1, 0
                        if (v, k, n) not in seen and path < front.get((v, k, n), (99,)):
                            front[v, k, n] = path
                seen |= front
                for (v, k, _), path in front.items():
                    if k == len(steps) and (hops, path) < wanted.get((s, v), (99, ())):
                        wanted[s, v] = (hops, path)
                new = {}
                for (v, k, n), path in front.items():
                    if k == len(steps):
                        continue
                    st = steps[k]
                    if st.most is not None and n >= st.most:
                        continue
                    for a, b, t, w in edges:
                        if (st.types and t not in st.types) or (st.where == "w < 5" and w >= 5) or (st.where == "w >= 2" and w < 2):
                            continue
                        for x, y, d in ((a, b, "out"), (b, a, "in")):
                            if x == v and st.direction in (d, "both"):
                                m = min(n + 1, max(1, st.least)) if st.most is None else n + 1
                                if (y, k, m) not in seen:
                                    new[y, k, m] = min(new.get((y, k, m), (99,)), (*path, y))
                front, hops = new, hops + 1
        found = {(r["start"], r["id"]): (r["hops"], tuple(r["path"])) for r in patterns.match(df, spark.range(6).selectExpr("CAST(id AS INT) AS id"), steps, 60).collect()}
        assert found.keys() == wanted.keys() and {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in wanted.items()}


def simple_paths(edges, s, t, depth):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, todo = [], [(s,)]
    while todo:
        p = todo.pop()
        if p[-1] == t:
            out.append((len(p) - 1, p))
        elif len(p) <= depth:
            todo += [(*p, v) for v in near.get(p[-1], ()) if v not in p]
    return sorted(out)


def test_k_shortest_paths_equal_all_simple_paths(spark):
    rng = random.Random(31)
    sparse = [tuple(rng.sample(range(22), 2)) for _ in range(36)]
    pairs = [(0, 1), (2, 3), (4, 5), (6, 6), (0, 99)]
    found = {}
    for r in patterns.k_shortest(spark.createDataFrame(sparse, "src int, dst int"), spark.createDataFrame(pairs, "start int, finish int"), 10, 6).collect():
        found.setdefault((r["start"], r["finish"]), []).append((r["hops"], tuple(r["path"])))
    wanted = {p: simple_paths(sparse, *p, 6)[:10] for p in pairs if p[0] != p[1]}
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in wanted.items() if v}


def test_ten_shortest_paths_of_a_dense_graph(spark):
    rng = random.Random(32)
    dense = sorted({tuple(sorted(rng.sample(range(200), 2))) for _ in range(14_000)} - {(0, 1)})
    assert len(dense) > 9_500
    found = patterns.k_shortest(spark.createDataFrame(dense, "src int, dst int"), spark.createDataFrame([(0, 1)], "start int, finish int"), 10, 4).collect()
    assert sorted((r["hops"], tuple(r["path"])) for r in found) == simple_paths(dense, 0, 1, 2)[:10]


def test_unbounded_paths_from_both_ends(spark):
    rng = random.Random(33)
    edges = [(i, i + 1) for i in range(21)] + [tuple(rng.sample(range(100, 130), 2)) for _ in range(45)] + [(7, 7)]
    pairs = [(0, 21), (21, 3), (100, 101), (102, 129), (0, 100), (5, 5)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    wanted = {}
    for s, t in pairs:
        dist, front = {s: 0}, [s]
        while front:
            front = [v for u in front for v in near.get(u, ()) if v not in dist and not dist.update({v: dist[u] + 1})]
        if t in dist and s != t:
            wanted[s, t] = dist[t]
    found = patterns.unbounded_shortest(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(pairs, "start int, finish int")).collect()
    assert {(r["start"], r["finish"]): r["hops"] for r in found} == wanted
    for r in found:
        assert len(r["path"]) == r["hops"] + 1 and r["path"][0] == r["start"] and r["path"][-1] == r["finish"] and all(b in near[a] for a, b in zip(r["path"], r["path"][1:], strict=False))


def test_exact_quantiles_without_sorting_a_group(spark):
    rng = random.Random(41)
    rows = [("a", rng.gauss(0, 1)) for _ in range(800)] + [("a", 5.0)] * 500 + [("b", float(rng.randrange(4))) for _ in range(300)] + [("c", 1e300), ("c", -1e300), ("c", 1e-300), ("d", None), ("e", 2.5), (None, 1.0), (None, 2.0)] + [("f", 10.0 ** rng.uniform(-20, 20)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {(r["g"], r["q"]): r["value"] for r in access.quantiles(df, "v", "g", [0.0, 0.3, 0.5, 0.95, 1.0], buckets=8, few=5).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert found.keys() == {(g, q) for g in groups for q in (0.0, 0.3, 0.5, 0.95, 1.0)}
    for (g, q), v in found.items():
        assert v == pytest.approx(np.quantile(groups[g], q), rel=1e-9, abs=1e-12)
