import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestar import model
from lodestar.operators import access, code, community, graph, mapping, memory, resolve, retrieval, sinks, temporal, traverse

PATH = [(0, 1), (1, 2), (2, 3), (3, 4), (5, 6), (6, 7), (7, 8), (8, 9), (4, 5)]


@pytest.fixture(scope="module")
def ten(spark):
    edges = spark.createDataFrame([("g", str(a), str(b), "LINK") for a, b in PATH], "graph_id string, src string, dst string, type string")
    nodes = spark.createDataFrame([("g", str(i), f"node {i}", "N") for i in range(10)], "graph_id string, id string, name string, label string")
    return nodes, edges


def test_every_node_is_once_in_each_level_and_finer_levels_have_more(spark, ten):
    found = community.detect(ten[1]).toPandas()
    sizes = []
    for _, level in found.groupby("level"):
        assert sorted(level.member_id) == [str(i) for i in range(10)]
        sizes.append(level.community_id.nunique())
    assert sizes == sorted(sizes)


def test_communities_are_connected_and_cliques_stay_whole(spark):
    ring = [(f"k{g}_{a}", f"k{g}_{b}") for g in range(6) for a in range(5) for b in range(a)] + [(f"k{g}_0", f"k{(g + 1) % 6}_1") for g in range(6)]
    found = community.detect(spark.createDataFrame([("ring", a, b) for a, b in ring], "graph_id string, src string, dst string"), (0.25, 1.0)).toPandas()
    for level, own in found.groupby("level"):
        where = dict(zip(own.member_id, own.community_id, strict=True))
        assert all(len({where[f"k{g}_{i}"] for i in range(5)}) == 1 for g in range(6))
        for c in set(where.values()):
            inside = {v for v in where if where[v] == c}
            seen = front = {min(inside)}
            while front:
                front = {b for e in ring for a, b in (e, e[::-1]) if a in front and b in inside} - seen
                seen = seen | front
            assert seen == inside, (level, c)
    assert found[found.level == 1].community_id.nunique() == 6


def test_label_propagation_covers_all(ten):
    found = community.label_propagation(ten[1], ten[0]).toPandas()
    assert sorted(found.id) == [str(i) for i in range(10)]


def test_hierarchy_takes_the_majority(spark):
    members = spark.createDataFrame([("a", "C1", 0), ("b", "C1", 0), ("c", "C2", 0), ("a", "f", 1), ("b", "f", 1), ("c", "f", 1)], "member_id string, community_id string, level int")
    assert rows(community.hierarchy(members)) == [("f", 1, "C1", 2)]


def test_rollups(spark):
    members = spark.createDataFrame([("a", "C", 0), ("b", "C", 0), ("a", "f1", 1), ("b", "f2", 1)], "member_id string, community_id string, level int")
    names = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "id string, name string")
    found = {r["community_id"]: r["summary"] for r in community.rollup_summaries(members, community.hierarchy(members), names).collect()}
    assert found == {"f1": "Ann", "f2": "Bob", "C": "Ann; Bob"}


def test_pagerank_nears_the_number_of_nodes(ten):
    found = community.pagerank(ten[1], ten[0])
    # Rounds start from the share that each node has by itself, so the sum nears the number of nodes
    assert found.agg(F.sum("rank")).collect()[0][0] == pytest.approx(10 * (1 - 0.85**21))


def test_traversal(spark, ten):
    start = spark.createDataFrame([("0",)], "id string")
    assert traverse.reach(ten[1], start, 3).count() == 3
    assert traverse.reach(ten[1], start, 99).count() == 9
    pairs = spark.createDataFrame([("0", "4"), ("0", "9")], "start string, finish string")
    assert [r["path"] for r in traverse.shortest_paths(ten[1], pairs, 4).collect()] == [["0", "1", "2", "3", "4"]]
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert [r["path"] for r in traverse.cycles(ring).collect()] == [["a", "b", "c"]]
    assert traverse.paths(ring, spark.createDataFrame([("a",)], "id string"), 5).count() == 3
    assert traverse.pathways(ten[1], spark.createDataFrame([("0",), ("2",)], "id string")).collect()[0]["path"] == ["0", "1", "2"]


def test_tenants_do_not_mix(spark):
    nodes = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "graph_id string, id string")
    edges = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2")], "graph_id string, src string, dst string")
    view = model.TenantView(nodes, edges, ["a"])
    assert view.nodes.count() == 1 and view.edges.count() == 1


def test_write_semantics(spark):
    stored = spark.createDataFrame([("g", "1", "A", {"x": "1", "y": "2"})], "graph_id string, id string, label string, props map<string,string>")
    new = spark.createDataFrame([("g", "1", "B", {"x": "9"}), ("g", "2", "B", None)], stored.schema)
    found = {r["id"]: (r["label"], r["props"]) for r in sinks.upsert_nodes(stored, new).collect()}
    assert found == {"1": ("B", {"x": "9", "y": "2"}), "2": ("B", {})}
    records = spark.createDataFrame([("r1", "Ann", ["r2", "z"]), (None, "x", []), ("r2", "Bob", None)], "key string, name string, knows array<string>")
    nodes, edges, skipped = sinks.ingest_records(records, "key", "Person", {"knows": "KNOWS"})
    assert sorted(r["id"] for r in nodes.collect()) == ["r1", "r2", "z"] and edges.count() == 2 and skipped.collect()[0]["n"] == 1
    n, e = sinks.write_graph(spark.createDataFrame([("1", "a"), ("2", " "), ("3", "c")], "id string, name string"), spark.createDataFrame([("1", "3", "R"), ("1", "3", "R"), ("1", "2", "R")], "src string, dst string, type string"), "g", F.lit("2024-01-01").cast("timestamp"))
    assert n.count() == 2 and [(r["src"], r["weight"]) for r in e.collect()] == [("1", 2)]


def test_expiry(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    chunks = spark.createDataFrame([("c1", day(1)), ("c2", None)], "chunk_id string, stale_at timestamp")
    mentions = spark.createDataFrame([("e1", "c1"), ("e2", "c1"), ("e2", "c2")], "id string, chunk_id string")
    entities = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "id string")
    live, left = sinks.expire_chunks(chunks, mentions, entities, F.lit(day(20)), 7)
    assert [r["chunk_id"] for r in live.collect()] == ["c2"] and sorted(r["id"] for r in left.collect()) == ["e2", "e3"]


def test_temporal(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    nodes = spark.createDataFrame([("old", day(1), None), ("new", day(10), None), ("gone", day(1), day(12)), ("dead", day(1), day(3))], "id string, transaction_time timestamp, invalidated_at timestamp")
    edges = spark.createDataFrame([("e1", "old", "new", day(2), None), ("e2", "old", "gone", day(2), None)], "edge_id string, src string, dst string, transaction_time timestamp, invalidated_at timestamp")
    n, e = temporal.rollback(nodes, edges, F.lit(day(5)), F.lit(day(20)))
    assert {r["id"]: r["invalidated_at"] for r in n.collect()} == {"old": None, "new": day(20), "gone": None, "dead": day(3)}
    assert {r["edge_id"]: r["invalidated_at"] for r in e.collect()} == {"e1": day(20), "e2": None}
    facts = spark.createDataFrame([("a", "s", "d", "T", None, day(5)), ("b", "s", "d", "T", day(4), day(5)), ("c", "s", "d", "T", day(5), None)], "edge_id string, src string, dst string, type string, valid_from timestamp, valid_to timestamp")
    assert rows(temporal.contradictions(facts).select("a", "b")) == [("a", "b")]
    with pytest.raises(ValueError, match="unknown"):
        temporal.temporal_filter("NEVER")


def test_memory(spark):
    m = spark.createDataFrame([("g", "m1", "Likes  Tea", 0.5), ("g", "m2", "likes tea", 0.7), ("g", "m3", "other", 0.2)], "graph_id string, memory_id string, content string, importance_score double")
    found = {r["memory_id"]: (r["importance_score"], r["superseded"]) for r in memory.consolidate(m).collect()}
    assert found == {"m2": (1.0, ["m1"]), "m3": (0.2, [])}
    facts = spark.createDataFrame([("m1", "Ann", "lives in", "Rome"), ("m2", "ann", "lives in", "Oslo"), ("m3", "Ann", "likes", "Rome")], "memory_id string, subject string, predicate string, object string")
    assert rows(memory.contradictions(facts).select("a", "b")) == [("m1", "m2")]
    budget = spark.createDataFrame([(1, 5), (2, 50), (3, 1)], "k int, t int")
    assert [r["k"] for r in memory.budgeted(budget, [], [F.col("k")], F.col("t"), 10).collect()] == [1]


def test_resolution(spark):
    pairs = spark.createDataFrame([("g", "a", "b", 0.9), ("g", "b", "c", 0.8), ("g", "a", "c", 0.7)], "graph_id string, keeper string, loser string, score double")
    assert sorted((r["loser"], r["keeper"]) for r in resolve.merge_pairs(pairs).collect()) == [("b", "a"), ("c", "a")]
    scored = spark.createDataFrame([("1", "2", "IBM", "International Business Machines", "Organization", "Organization", 0.97, ["x", "y"], ["x", "y"])], "a string, b string, a_name string, b_name string, a_type string, b_type string, embedding_score double, a_near array<string>, b_near array<string>")
    r = resolve.same_as_scores(scored).collect()[0]
    assert r["score"] == pytest.approx(0.861, abs=1e-3) and r["band"] == "store"
    chunks = spark.createDataFrame([("c1:acme", "Acme", "Org", {"a": "1"}), ("c2:acme", "acme ", "Org", {"a": "1", "b": "2"})], "id string, name string, label string, props map<string,string>")
    assert [(x["id"], x["props"]) for x in resolve.unify_chunk_entities(chunks).collect()] == [("acme", {"a": "1", "b": "2"})]


def test_ontology_modes(spark):
    nodes = spark.createDataFrame([("1", "Person"), ("2", "Persons"), ("3", "Galaxy")], "id string, label string")
    state = lambda **k: {r["id"]: (r["label"], r["ontology_status"]) for r in resolve.enforce_ontology(nodes, ["Person"], **k).collect()}
    assert state() == {"1": ("Person", "ok"), "2": ("Person", "coerced"), "3": ("Galaxy", "mismatch")}
    assert set(state(on_mismatch="drop")) == {"1", "2"} and set(state(mode="STRICT")) == {"1"}
    assert state(mode="WARN")["3"] == ("Galaxy", "violation")


def test_mapping():
    assert mapping.junction_verb("t_employee_leads_project", "employee", "project") == "LEADS"
    assert mapping.junction_verb("employee_project", "employee", "project") is None
    with pytest.raises(ValueError, match="relationship"):
        mapping.valid_type("a b")


def test_access(spark):
    now = F.lit(dt.datetime(2024, 1, 1))
    grants = spark.createDataFrame([("u", "g1", "admin", "s1", True, None), ("u", "g2", "admin", None, True, dt.datetime(2023, 1, 1))], "user_id string, graph_id string, role string, subgraph_id string, is_active boolean, expires_at timestamp")
    assert [(r["graph_id"], r["roles"], r["subgraphs"]) for r in access.access_filter(grants, "u", now).collect()] == [("g1", ["admin"], ["s1"])]
    levels = [spark.createDataFrame([("a", "own")], "agent string, config string"), spark.createDataFrame([("a", "org"), ("b", "org")], "agent string, config string")]
    assert sorted((r["agent"], r["config"]) for r in access.first_configured(levels, "agent").collect()) == [("a", "own"), ("b", "org")]


def test_code_queries(spark):
    e = spark.createDataFrame([("m.a", "m.b", "CALLS"), ("m.b", "m.c", "CALLS"), ("x", "y", "IMPORTS"), ("y", "z", "IMPORTS"), ("z", "x", "IMPORTS"), ("p", "q", "FLOWS_TO"), ("q", "r", "FLOWS_TO")], "src string, dst string, type string")
    s = spark.createDataFrame([("m.a", "function", False), ("m.b", "function", False), ("m.test_x", "function", True), ("m.__init__", "function", False)], "qualified_name string, kind string, is_test boolean")
    assert [r["symbol"] for r in code.callers(e, "m.b").collect()] == ["m.a"] and [r["symbol"] for r in code.callers(e, "m.b", callees=True).collect()] == ["m.c"]
    assert [r["qualified_name"] for r in code.dead_code(s, e).collect()] == ["m.a"]
    assert [r["path"] for r in code.circular_imports(e).collect()] == [["x", "y", "z"]]
    assert code.data_flow(e, "q", "both").count() == 2
    calls = spark.createDataFrame([("m.a", "m.b"), ("m.a", "b"), ("m.a", "nothing")], "caller string, callee string")
    assert sorted((r["callee"], r["qualified_name"]) for r in code.resolve_calls(calls, s).collect()) == [("b", "m.b"), ("m.b", "m.b")]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "x" * 1500), (2, "y" * 1501), (3, ""), (4, "z" * 10)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n"]) for r in retrieval.chunks(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()) == [(1, 1), (2, 2), (4, 1)]
    q = spark.createDataFrame([("What did Acme Corp tell The Board",)], "q string")
    assert q.select(retrieval.entity_candidates(F.col("q")).alias("c")).collect()[0]["c"] == ["Acme Corp", "Board"]


def test_statistics_of_an_empty_graph(spark, ten):
    r = graph.statistics(ten[0].limit(0), ten[1].limit(0)).collect()[0]
    assert (r["node_count"], r["edge_count"], r["density"], r["average_degree"]) == (0, 0, 0.0, 0.0)
