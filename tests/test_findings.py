"""What a reviewer found: repeated addresses, texts and tables that grow."""

import duckdb
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from lodestar.functions.similarity import jaro_winkler
from lodestar.operators import access, code, codegraph, community, joins, resolve, retrieval, vectors
from lodestar.plans import deep, more, records, repository, rest  # noqa: F401
from lodestar.plans.queries import QUERIES, SQL


def both(spark, folder, name, **tables):
    """A query's rows over tables (pandas frames) written to folder, and its SQL's."""
    c = duckdb.connect()
    for t, rows_ in tables.items():
        spark.createDataFrame(rows_).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return rows(QUERIES[name](spark, str(folder))), rows(c.sql(SQL[name]).df())


def test_pages_of_one_address_are_told_apart(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i % 3}", None if i % 5 == 0 else f"<p>{i}") for i in range(24)], "page_id long, url string, html string").toPandas()
    found, wanted = both(spark, tmp_path, "file_delta", pages=pages)
    assert len(found) == 24 and found == wanted


def test_files_without_a_path_or_a_hash(spark):
    side = lambda *r: spark.createDataFrame(r, "path string, content_hash string")
    found = code.file_delta(side((None, "x"), ("a", None), ("b", "1"), ("c", None)), side((None, "x"), ("a", None), ("b", None), ("d", None)))
    assert {(r["path"], r["status"]) for r in found.collect()} == {(None, "unchanged"), ("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "removed")}


def test_grants_are_one_for_an_account_and_a_graph(spark, monkeypatch):
    made, whole = [], access.service_accounts
    monkeypatch.setattr(access, "service_accounts", lambda accounts, grants, now: made.append(grants.count()) or whole(accounts, grants, now))
    assert QUERIES["service_accounts"](spark, SF).count() > 0
    assert made[0] <= spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_words_are_split_once_for_all_groups(spark):
    rows_ = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, None)], "id int, text string").select("id", retrieval.word_groups(F.col("text")).alias("g"))
    assert "slice(split(" not in rows_._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["g"] for r in rows_.collect()} == {1: [" ".join(map(str, range(i, min(25, i + 10)))) for i in (0, 10, 20)], 2: [""], 3: None}


def test_names_are_scored_once_for_each_class(spark):
    from pyspark.sql import types as T

    names = [(i, None if i % 11 == 0 else "abcd"[: 1 + i % 3] * 2, i % 2) for i in range(60)]
    scored = spark.sparkContext.accumulator(0)

    @F.udf(T.DoubleType())
    def score(a, b):
        scored.add(1)
        return jaro_winkler(a or "", b or "")

    found = resolve.name_scores(spark.createDataFrame(names, "id int, name string, side int"), ["side"], score).collect()
    wanted = {(i, j): None if a is None or b is None else round(jaro_winkler(a, b), 6) for i, a, s in names for j, b, t in names if s == t and i < j}
    assert len(found) == len(wanted) and {(r["a"], r["b"]): r["similarity"] for r in found} == wanted
    assert scored.value <= 2 * 4 * 4


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_overlaps_of_few_and_of_many_facts(spark, monkeypatch, most):
    import random

    monkeypatch.setattr(joins, "SHARE", 1)
    monkeypatch.setattr(joins, "MANY", most)
    r, facts = random.Random(1), []
    for i in range(150):
        f = r.randrange(0, 400)
        facts.append((i, min(i % 40, 30), None if i % 17 == 0 else f"2020-01-01 00:{f // 60:02}:{f % 60:02}", None if i % 19 == 0 else f"2020-01-01 00:{(g := max(0, f + r.randrange(-3, 60))) // 60:02}:{g % 60:02}"))
    df = spark.createDataFrame(facts, "edge_id int, k int, f string, t string").select("edge_id", "k", F.col("f").cast("timestamp").alias("valid_from"), F.col("t").cast("timestamp").alias("valid_to"))
    wanted = {(a[0], b[0]) for a in facts for b in facts if a[0] < b[0] and a[1] == b[1] and (a[2] or "0001") < (b[3] or "9999") and (b[2] or "0001") < (a[3] or "9999")}
    found = [(x["a"], x["b"]) for x in joins.overlaps(df, ["k"]).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_facts_that_are_alone_are_left_before_pairs_are_looked_for(spark, monkeypatch):
    written, held = [], joins.held
    monkeypatch.setattr(joins, "held", lambda df, *a: written.append(held(df, *a)) or written[-1])
    facts = spark.range(300).select(F.col("id").alias("edge_id"), F.greatest("id", F.lit(2)).alias("k"), F.lit("2020-01-01").cast("timestamp").alias("valid_from"), F.lit("2020-01-02").cast("timestamp").alias("valid_to"))
    assert joins.overlaps(facts, ["k"]).count() == 3
    assert sum(w.count() for w in written) <= 3


def propagated(edges, ids, rounds):
    """Round by round over dictionaries, each vertex for itself."""
    both = {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            both.setdefault(x, {})[y] = both.get(x, {}).get(y, 0) + 1
    label = {i: i for i in ids}
    for _ in range(rounds):
        new = {}
        for v in set(label) | set(both):
            votes = {}
            for u, w in both.get(v, {}).items():
                if u in label:
                    votes[label[u]] = votes.get(label[u], 0) + w
            if v in label:
                votes[label[v]] = votes.get(label[v], 0) + 0.5
            if votes:
                new[v] = min(votes, key=lambda c: (-votes[c], c))
        label = new
    return label


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_labels_equal_rounds_over_all_vertices(spark, monkeypatch, rounds):
    import random

    r = random.Random(rounds)
    core = [(r.randrange(8), r.randrange(8)) for _ in range(14)]
    edges = core + [(100 + i, i % 8) for i in range(30)] + [(100, 0), (107, 7), (50, 51), (60, 60), (61, 60), (70, 71), (71, 72), (80, 81), (80, 81), (90, 99)]
    ids = [v for v in range(130) if v != 99]
    name = lambda v: f"v{v:03}"
    made, held = [], community.held
    monkeypatch.setattr(community, "held", lambda df, *a: made.append(held(df, *a)) or made[-1])
    found = community.label_propagation(spark.createDataFrame([(name(a), name(b)) for a, b in edges], "src string, dst string"), spark.createDataFrame([(name(v),) for v in ids], "id string"), rounds)
    assert sorted((x["id"], x["community"]) for x in found.collect()) == sorted(propagated([(name(a), name(b)) for a, b in edges], [name(v) for v in ids], rounds).items())
    assert made[-1].count() < len(ids) - 25  # leaves take no part in rounds


@pytest.mark.parametrize(("block", "places", "n"), [(2048, 4_000_000, 5), (7, 4_000_000, 5), (7, 20, 5), (7, 20, None), (2048, 4_000_000, None)])
def test_pairs_are_counted_by_blocks(spark, monkeypatch, block, places, n):
    import random
    from itertools import combinations

    for name, value in (("BLOCK", block), ("PLACES", places), ("STEP", 50)):
        monkeypatch.setattr(joins, name, value)
    r = random.Random(3)
    links = {(m, f"h{h}") for h in range(60) for m in r.sample(range(0, 80, 2), r.randrange(1, 12))} | {(m, "all") for m in range(0, 80, 2)}
    hubs = {}
    for m, h in links:
        hubs.setdefault(m, set()).add(h)
    wanted = sorted((-len(hubs[a] & hubs[b]), a, b) for a, b in combinations(sorted(hubs), 2) if len(hubs[a] & hubs[b]) >= 2)
    made, whole = [], joins.light_pairs
    monkeypatch.setattr(joins, "light_pairs", lambda *a: made.append(whole(*a)) or made[-1])
    found = joins.common_neighbours(spark.createDataFrame(sorted(links), "member long, hub string"), 2, n, 20)
    assert sorted((-x["common"], x["a"], x["b"]) for x in found.collect()) == wanted[:n]
    assert n is None or block < 2048 or made[0].count() < 150  # of 780 pairs


@pytest.mark.parametrize("few", [10_000, 0])
def test_code_edges_send_no_side_that_grows(spark, duck, monkeypatch, few):
    monkeypatch.setattr(codegraph, "FEW", few)
    made, sent = [], codegraph._sent
    monkeypatch.setattr(codegraph, "_sent", lambda rows_, small: made.append((rows_, small)) or sent(rows_, small))
    found = QUERIES["code_graph_edges"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= sum(small for _, small in made) and "MapInPandas" not in plan
    assert all(r.count() <= 20 for r, small in made if small)
    assert rows(found) == rows(duck.sql(SQL["code_graph_edges"]).df())


def test_packs_of_vectors_are_as_large_as_asked_for(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "PER_CELL", 20)
    monkeypatch.setattr(vectors, "AT_ONCE", 500)
    made, whole = [], vectors._packs
    monkeypatch.setattr(vectors, "_packs", lambda *a: made.append(whole(*a)) or made[-1])
    x = np.random.default_rng(5).normal(size=(420, 8)).astype(np.float32).astype(float)
    g = [0 if i < 20 else i % 4 + 1 for i in range(420)]
    df = spark.createDataFrame([(i, v.tolist(), g[i]) for i, v in enumerate(x)], "id long, embedding array<float>, g int")
    found = {}
    for r in vectors.knn(df, df, 3, ["g"], same=True, size=50).collect():
        found.setdefault(r["a"], set()).add(r["b"])
    u = x / np.sqrt((x**2).sum(1, keepdims=True))
    s = u @ u.T
    assert found == {i: set(sorted((j for j in range(420) if j != i and g[j] == g[i]), key=lambda j: (-s[i, j], j))[:3]) for i in range(420)}
    sizes = [(r["by"]["g"], r["n"]) for r in made[0].select("by", F.size("rows").alias("n")).collect()]
    assert sum(n for _, n in sizes) == 420 and len([n for b, n in sizes if b == 0]) == 1 and len(sizes) <= 1 + 4 * 4
