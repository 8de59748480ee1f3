"""The driver's queries over the star schema read as a graph, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar import model
from lodestar.functions import columns as C
from lodestar.functions.similarity import jaro_winkler_udf
from lodestar.model import table
from lodestar.operators import access, code, community, graph, mapping, memory, resolve, retrieval, sinks, temporal, traverse
from lodestar.sources import files
from lodestar.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: What the formulas take as now, and instants within the orders' dates.
NOW = "1999-01-01"
T1, T2 = "1996-01-01", "1997-06-01"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Nodes and edges in SQL, for the queries below.
N = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'Region' AS label FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'Nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'Customer' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'Supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'Part' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order:' || o_orderkey, 'Order' FROM orders)"""
E = """edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'PLACED_BY' FROM orders)"""


@query(f"""WITH {N}, {E}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
SELECT id, name, label, degree FROM d JOIN nodes USING (id) WHERE label = 'Customer' ORDER BY degree DESC, id LIMIT 20""")
def degree_centrality_topn(spark, sf):
    return graph.degree_centrality(model.edges(spark, sf), model.nodes(spark, sf, ["Customer"]), "Customer", 20)


@query(f"""WITH {N}, {E}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id HAVING count(*) > 3)
SELECT id, name, degree FROM d JOIN nodes USING (id) ORDER BY degree DESC, id LIMIT 10""")
def high_degree_having(spark, sf):
    return graph.high_degree(model.edges(spark, sf), model.nodes(spark, sf))


@query("""SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 'SUPPLIES' AS type, count(*) AS weight FROM lineitem GROUP BY ALL""")
def edge_weight_collapse(spark, sf):
    items = table(spark, sf, "lineitem").select(model.key("Supplier", "l_suppkey").alias("src"), model.key("Part", "l_partkey").alias("dst"), F.lit("SUPPLIES").alias("type"))
    return graph.collapse_edges(items)


@query(f"""WITH {N}, {E}
SELECT a.name AS anchor_name, r1.type AS rel1, h1.name AS hop1_name, r2.type AS rel2, h2.name AS hop2_name
FROM nodes a JOIN edges r1 ON r1.src = a.id JOIN nodes h1 ON h1.id = r1.dst
LEFT JOIN edges r2 ON r2.src = h1.id LEFT JOIN nodes h2 ON h2.id = r2.dst
WHERE lower(a.name) LIKE '%customer#00000001%'
ORDER BY anchor_name, rel1, hop1_name, rel2 NULLS FIRST, hop2_name NULLS FIRST LIMIT 20""")
def expand_two_hop(spark, sf):
    return graph.multihop(model.edges(spark, sf), model.nodes(spark, sf), "customer#00000001")


@query(f"""WITH {N}, {E}, u AS (SELECT src, dst, type FROM edges UNION ALL SELECT dst, src, type FROM edges),
one AS (SELECT DISTINCT src, dst, type FROM u WHERE src IN ('nation:1', 'nation:2')),
two AS (SELECT o.*, t.far, n.name AS far_name, row_number() OVER (PARTITION BY o.src, o.dst, o.type ORDER BY t.far) AS k
  FROM one o LEFT JOIN (SELECT DISTINCT src AS dst, dst AS far FROM u) t USING (dst) LEFT JOIN nodes n ON n.id = t.far
  WHERE t.far IS NULL OR t.far <> o.src)
SELECT src, dst, type, coalesce(second_hop, '') AS second_hop FROM one LEFT JOIN (
  SELECT src, dst, type, array_to_string(list_sort(list_distinct(list(far_name))), ',') AS second_hop FROM two WHERE k <= 3 GROUP BY src, dst, type) USING (src, dst, type)
ORDER BY src, dst, type LIMIT 30""")
def undirected_expand_slice(spark, sf):
    anchors = spark.createDataFrame([("nation:1",), ("nation:2",)], "id string")
    return graph.neighbourhood(model.edges(spark, sf), model.nodes(spark, sf), anchors)


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS member, l_partkey AS hub FROM lineitem)
SELECT a.member AS a, b.member AS b, count(*) AS common FROM l a JOIN l b ON a.hub = b.hub AND a.member < b.member
GROUP BY ALL HAVING count(*) >= 2 ORDER BY common DESC, a, b LIMIT 50""")
def shared_neighbours(spark, sf):
    return graph.shared_neighbours(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("hub")))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS member, l_partkey AS hub FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY member) AS k FROM l)
SELECT hub, count(*) AS members, array_to_string(list_sort(list(member) FILTER (k <= 5)), ',') AS sample FROM r GROUP BY hub HAVING count(*) >= 2""")
def shared_hub_context(spark, sf):
    return graph.shared_hubs(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("hub")))


@query(f"""WITH {N}, {E}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
m AS (SELECT 'customer:' || c_custkey AS id, 'nation:' || c_nationkey AS community_id FROM customer),
c AS (SELECT n.id, name, label, coalesce(degree, 0) AS degree, community_id FROM nodes n LEFT JOIN d USING (id) LEFT JOIN m USING (id)
  WHERE label IN ('Customer', 'Nation') AND coalesce(degree, 0) >= 1)
SELECT id, name, label, degree, community_id, (SELECT count(*) FROM c) AS total, (SELECT count(*) FROM c) > 100 AS truncated
FROM c ORDER BY degree DESC, id LIMIT 100""")
def visual_payload(spark, sf):
    members = table(spark, sf, "customer").select(model.key("Customer", "c_custkey").alias("member_id"), model.key("Nation", "c_nationkey").alias("community_id"), F.lit(0).alias("level"))
    return graph.visual_payload(model.nodes(spark, sf, ["Customer", "Nation"]), model.edges(spark, sf), members, least_degree=1, limit=100)


@query(f"""WITH {E} SELECT src, dst, type FROM edges WHERE src LIKE 'customer:%' AND dst IN ('nation:1', 'nation:2', 'nation:3')""")
def induced_subgraph(spark, sf):
    chosen = model.nodes(spark, sf, ["Customer"]).select("id").unionByName(model.nodes(spark, sf, ["Nation"]).where(F.col("id").isin("nation:1", "nation:2", "nation:3")).select("id"))
    return graph.induced_edges(model.edges(spark, sf), chosen).select("src", "dst", "type")


@query(f"""WITH {N}, {E}, n AS (SELECT count(*) AS node_count, count(DISTINCT label) AS label_count FROM nodes), e AS (SELECT count(*) AS edge_count, count(DISTINCT type) AS type_count FROM edges)
SELECT node_count, edge_count, label_count, type_count, edge_count * 2 AS reference_relationship_count,
  round(edge_count::DOUBLE / (node_count * (node_count - 1)), 12) AS density, round(2.0::DOUBLE * edge_count / node_count, 6) AS average_degree FROM n, e""")
def graph_stats(spark, sf):
    return graph.statistics(model.nodes(spark, sf), model.edges(spark, sf))


@query(f"""WITH {N}, {E} SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type""")
def catalogue_counts(spark, sf):
    return graph.catalogue(model.nodes(spark, sf), model.edges(spark, sf))


@query("""SELECT 'Part' AS label, 'p_brand' AS property, 'string' AS value_type, count(*) AS frequency FROM part
UNION ALL SELECT 'Part', 'p_type', 'string', count(*) FROM part UNION ALL SELECT 'Part', 'p_size', 'integer', count(*) FROM part
UNION ALL SELECT 'Order', 'o_orderstatus', 'string', count(*) FROM orders UNION ALL SELECT 'Order', 'o_orderpriority', 'string', count(*) FROM orders""")
def schema_profile(spark, sf):
    return graph.schema_profile(model.nodes(spark, sf, ["Part", "Order"]))


@query("""SELECT 'customer:' || c_custkey AS id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_join_no_orders(spark, sf):
    placed = model.edges(spark, sf, ["PLACED_BY"]).select(F.col("dst").alias("id"))
    return model.nodes(spark, sf, ["Customer"]).join(placed, "id", "left_anti").select("id", "name")


@query("""SELECT 'customer:' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_join_segment(spark, sf):
    placed = model.edges(spark, sf, ["PLACED_BY"]).select(F.col("dst").alias("id"))
    return model.nodes(spark, sf, ["Customer"]).where(F.col("props")["c_mktsegment"] == "BUILDING").join(placed, "id", "left_semi").select("id", "name")


def versioned_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as bitemporal nodes: valid and known from the order's date, for 200 days if they are finished."""
    end = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 200 DAYS"))
    return table(spark, sf, "orders").select(model.key("Order", "o_orderkey").alias("id"), F.col("o_orderdate").alias("valid_from"), end.alias("valid_to"), F.col("o_orderdate").alias("transaction_time"), end.alias("invalidated_at"))


OV = """o AS (SELECT 'order:' || o_orderkey AS id, 'customer:' || o_custkey AS dst, o_orderdate AS f, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 200 DAY END AS t FROM orders)"""


def versioned_edges(spark: SparkSession, sf: str) -> DataFrame:
    own = versioned_orders(spark, sf)
    ends = model.edges(spark, sf, ["PLACED_BY"]).select(F.col("src").alias("id"), "dst")
    return own.join(ends, "id").select(F.concat(F.lit("e:"), "id").alias("edge_id"), F.col("id").alias("src"), "dst", F.lit("PLACED_BY").alias("type"), "valid_from", "valid_to", "transaction_time", "invalidated_at")


@query(f"""WITH {OV} SELECT id FROM o WHERE f <= TIMESTAMP '{T1}' AND (t IS NULL OR t > TIMESTAMP '{T1}') ORDER BY id LIMIT 1000""")
def point_in_time_nodes(spark, sf):
    return temporal.nodes_at(versioned_orders(spark, sf), at(T1)).select("id")


@query("""SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderdate <= TIMESTAMP '1996-03-01' AND l_shipdate > TIMESTAMP '1996-03-01' GROUP BY ALL""")
def point_in_time_edges(spark, sf):
    items = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("valid_from")), "l_orderkey")
    rows = items.select(model.key("Order", "l_orderkey").alias("src"), model.key("Part", "l_partkey").alias("dst"), "valid_from", F.col("l_shipdate").alias("valid_to"))
    return rows.where(temporal.valid_at(at("1996-03-01"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"""WITH {OV} SELECT id FROM o WHERE f <= TIMESTAMP '{T1}' AND (t IS NULL OR t >= TIMESTAMP '{T1}')""")
def temporal_slice_inclusive(spark, sf):
    return versioned_orders(spark, sf).where(temporal.valid_at(at(T1), end_inclusive=True)).select("id")


@query(f"""WITH {OV} SELECT id FROM o WHERE f >= TIMESTAMP '{T2}' OR t >= TIMESTAMP '{T2}'""")
def bitemporal_changes_since(spark, sf):
    return versioned_orders(spark, sf).where(temporal.temporal_filter("CHANGES_SINCE", since=at(T2))).select("id")


@query(f"""WITH {OV} SELECT id FROM o WHERE f <= TIMESTAMP '{T1}' AND (t IS NULL OR t > TIMESTAMP '{T1}')""")
def knowledge_as_of(spark, sf):
    return versioned_orders(spark, sf).where(temporal.temporal_filter("KNOWLEDGE_AS_OF", at=at(T1))).select("id")


@query("""WITH f AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_suppkey AS s, l_partkey AS p, o_orderdate AS a, l_shipdate AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT s AS src, p AS dst, 'SUPPLIES' AS type, x.id AS a, y.id AS b FROM f x JOIN f y USING (s, p) WHERE x.id < y.id AND x.a < y.b AND y.a < x.b""")
def interval_overlap(spark, sf):
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("valid_from"))
    facts = table(spark, sf, "lineitem").join(dates, "l_orderkey").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("SUPPLIES").alias("type"), "valid_from", F.col("l_shipdate").alias("valid_to"))
    return temporal.contradictions(facts)


CH = f"""{OV}, ch AS (
  SELECT 'added' AS change, 'entity' AS kind, id AS key, f AS "at" FROM o WHERE f > TIMESTAMP '{T1}' AND f <= TIMESTAMP '{T2}'
  UNION ALL SELECT 'removed', 'entity', id, t FROM o WHERE t > TIMESTAMP '{T1}' AND t <= TIMESTAMP '{T2}'
  UNION ALL SELECT 'added', 'relationship', 'e:' || id, f FROM o WHERE f > TIMESTAMP '{T1}' AND f <= TIMESTAMP '{T2}'
  UNION ALL SELECT 'removed', 'relationship', 'e:' || id, t FROM o WHERE t > TIMESTAMP '{T1}' AND t <= TIMESTAMP '{T2}')"""


@query(f"""WITH {CH} SELECT kind, change, count(*) AS n FROM ch GROUP BY ALL""")
def version_diff(spark, sf):
    return temporal.version_diff(versioned_orders(spark, sf), versioned_edges(spark, sf), at(T2), at(T1)).groupBy("kind", "change").agg(F.count("*").alias("n"))


@query(f"""WITH {CH} SELECT change, kind, key, epoch_us("at") AS at_us, true AS has_more FROM ch ORDER BY "at", kind, change, key LIMIT 50 OFFSET 20""")
def version_diff_changes(spark, sf):
    diff = temporal.version_diff(versioned_orders(spark, sf), versioned_edges(spark, sf), at(T1), at(T2))
    return temporal.diff_page(diff, 20, 50).select("change", "kind", "key", F.unix_micros("at").alias("at_us"), "has_more")


@query(f"""WITH {OV}, r AS (SELECT id, CASE WHEN f > TIMESTAMP '{T1}' AND t IS NULL THEN TIMESTAMP '{NOW}' WHEN t > TIMESTAMP '{T1}' AND f <= TIMESTAMP '{T1}' THEN NULL ELSE t END AS i FROM o)
SELECT id, epoch_us(i) AS invalidated_us FROM r""")
def rollback_full(spark, sf):
    nodes, _ = temporal.rollback(versioned_orders(spark, sf), versioned_edges(spark, sf), at(T1), at(NOW))
    return nodes.select("id", F.unix_micros("invalidated_at").alias("invalidated_us"))


@query(f"""WITH {OV}, r AS (SELECT id, CASE WHEN f > TIMESTAMP '{T1}' AND t IS NULL THEN TIMESTAMP '{NOW}' WHEN t > TIMESTAMP '{T1}' AND f <= TIMESTAMP '{T1}' THEN NULL ELSE t END AS i FROM o)
SELECT 'e:' || id AS edge_id, i IS NULL AS live FROM r""")
def rollback_edges(spark, sf):
    _, edges = temporal.rollback(versioned_orders(spark, sf), versioned_edges(spark, sf), at(T1), at(NOW))
    return edges.select("edge_id", F.col("invalidated_at").isNull().alias("live"))


@query(f"""WITH {OV} SELECT 'entity' AS kind, id AS key, epoch_us(f) AS at_us, 'start' AS event FROM o WHERE id = 'order:7'
UNION ALL SELECT 'entity', id, epoch_us(t), 'end' FROM o WHERE id = 'order:7' AND t IS NOT NULL UNION ALL SELECT 'relationship', 'e:' || id, epoch_us(f), 'start' FROM o WHERE id = 'order:7'""")
def timeline_entity(spark, sf):
    return temporal.timeline(versioned_orders(spark, sf), versioned_edges(spark, sf), "order:7").select("kind", "key", F.unix_micros("at").alias("at_us"), "event")


@query(f"""WITH {OV} SELECT coalesce((SELECT max(v) FROM (VALUES (1), (4)) x(v)), 0) + 1 AS version_number,
  (SELECT count(*) FROM o WHERE f <= TIMESTAMP '{T1}' AND (t IS NULL OR t > TIMESTAMP '{T1}')) AS entity_count,
  (SELECT count(*) FROM o WHERE f <= TIMESTAMP '{T1}' AND (t IS NULL OR t > TIMESTAMP '{T1}')) AS relationship_count""")
def version_create(spark, sf):
    versions = spark.createDataFrame([("tpch", 1), ("tpch", 4), ("other", 9)], "graph_id string, version_number int")
    return temporal.next_version(versions, "tpch", at(T1), versioned_orders(spark, sf), versioned_edges(spark, sf)).select("version_number", "entity_count", "relationship_count")


@query("""SELECT 'order:' || o_orderkey AS id, epoch_us(o_orderdate) AS at_us FROM orders ORDER BY o_orderdate DESC, id LIMIT 20""")
def temporal_context(spark, sf):
    return temporal.temporal_context(versioned_orders(spark, sf), ["valid_from", "transaction_time"]).select("id", F.unix_micros("at").alias("at_us"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector of smallest id, as a question's."""
    return list(vectors(spark, sf).orderBy("id").limit(1).collect()[0]["embedding"])  # one row


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS id, round((1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2, 6) AS score FROM embeddings, q ORDER BY (1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2 DESC, id LIMIT 10""")
def vector_topk(spark, sf):
    return retrieval.vector_topk(vectors(spark, sf), query_vector(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, (1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2 AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM p)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(s), 4) AS score FROM t WHERE k <= 5 AND s >= 0.6 GROUP BY ALL""")
def similar_to_edges(spark, sf):
    return resolve.similar_edges(vectors(spark, sf), 5, 0.6, ["label"]).select("a", "b", F.round("score", 4).alias("score"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
t AS (SELECT vec_id, label, (1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2 AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 20)
SELECT label, count(*) AS hits, round(max(s), 6) AS best FROM t GROUP BY label HAVING count(*) >= 2""")
def vector_community_context(spark, sf):
    top = retrieval.vector_topk(vectors(spark, sf), query_vector(spark, sf), n=20)
    return top.join(vectors(spark, sf).select("id", "label"), "id").groupBy("label").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best")).where("hits >= 2")


BM = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
n AS (SELECT count(*) AS docs, avg(len(w)) AS avg_len FROM w),
tf AS (SELECT doc_id, len(w) AS len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, (VALUES ('idiot'), ('license'), ('the')) q(term)),
h AS (SELECT * FROM tf WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM h JOIN df USING (term), n GROUP BY doc_id)"""


@query(f"""WITH {BM} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, doc_id LIMIT 10""")
def bm25_topk(spark, sf):
    return retrieval.bm25(table(spark, sf, "documents"), "the license, idiot").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {BM}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
v AS (SELECT vec_id AS doc_id, (1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2 AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 20),
t AS (SELECT doc_id, score AS s FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 20),
vs AS (SELECT doc_id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM v), ts AS (SELECT doc_id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM t),
hy AS (SELECT doc_id, 0.6 * coalesce(vs.s, 0) + 0.4 * coalesce(ts.s, 0) AS score FROM vs FULL JOIN ts USING (doc_id))
SELECT doc_id, round(score, 6) AS score FROM hy ORDER BY round(hy.score, 9) DESC, doc_id LIMIT 10""")
def hybrid_linear(spark, sf):
    v = retrieval.vector_topk(vectors(spark, sf).withColumnRenamed("id", "doc_id"), query_vector(spark, sf), "doc_id", 20)
    t = retrieval.bm25(table(spark, sf, "documents"), "the license, idiot", n=20)
    return retrieval.hybrid(v, t, "doc_id", 0.6).select("doc_id", F.round("score", 6).alias("score"))


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and customers under company names that differ in their endings."""
    ending = lambda k: F.element_at(F.array(*[F.lit(x) for x in (" Inc.", " GmbH", "", " Holdings Ltd", ".com")]), (F.col(k) % 5 + 1).cast("int"))
    s = table(spark, sf, "supplier").select(F.lit("tpch").alias("graph_id"), model.key("Supplier", "s_suppkey").alias("id"), F.concat(F.lit("Firm "), F.floor(F.col("s_suppkey") / 3).cast("string"), ending("s_suppkey")).alias("name"), F.lit("organization").alias("type"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf, "customer").select(F.lit("tpch").alias("graph_id"), model.key("Customer", "c_custkey").alias("id"), F.concat(F.lit("Firm  "), F.floor(F.col("c_custkey") / 3).cast("string"), ending("c_custkey")).alias("name"), F.lit("company").alias("type"), F.col("c_nationkey").alias("nation"))
    return s.unionByName(c)


CO = rf"""co AS (SELECT 'supplier:' || s_suppkey AS id, 'Firm ' || (s_suppkey // 3) || [' Inc.', ' GmbH', '', ' Holdings Ltd', '.com'][s_suppkey % 5 + 1] AS name, 'organization' AS type, s_nationkey AS nation FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'Firm  ' || (c_custkey // 3) || [' Inc.', ' GmbH', '', ' Holdings Ltd', '.com'][c_custkey % 5 + 1], 'company', c_nationkey FROM customer),
ca AS (SELECT id, trim(regexp_replace(trim(regexp_replace(lower(name), '\s+', ' ', 'g')), '{C.SUFFIXES}', '')) AS canonical FROM co)"""


@query(f"""WITH {CO} SELECT canonical, min(id) AS keeper, count(*) AS members FROM ca GROUP BY canonical HAVING count(*) > 1""")
def canonical_name_groups(spark, sf):
    return resolve.canonical_groups(companies(spark, sf)).select("canonical", "keeper", "members")


@query(f"""WITH {CO}, m AS (SELECT id AS loser, min(id) OVER (PARTITION BY canonical) AS keeper FROM ca),
e AS (SELECT coalesce(m.keeper, co.id) AS src, 'nation:' || nation AS dst, 'IN_NATION' AS type FROM co LEFT JOIN m ON m.loser = co.id)
SELECT src, dst, type, count(*) AS count FROM e GROUP BY ALL""")
def merge_canonical_rewire(spark, sf):
    own = companies(spark, sf)
    edges = own.select(F.col("id").alias("src"), F.concat(F.lit("nation:"), F.col("nation").cast("string")).alias("dst"), F.lit("IN_NATION").alias("type"))
    return resolve.rewire(edges, resolve.keeper_map(own))


@query(f"""WITH {CO}, m AS (SELECT co.id, co.name, min(co.id) OVER (PARTITION BY canonical) AS keeper FROM co JOIN ca USING (id))
SELECT k.id, k.name, coalesce(array_to_string(list_sort(list_distinct(list(l.name) FILTER (l.id IS NOT NULL))), ','), '') AS aliases FROM m k LEFT JOIN m l ON l.keeper = k.id AND l.id <> k.id WHERE k.id = k.keeper GROUP BY k.id, k.name""")
def consolidate_aliases(spark, sf):
    own = companies(spark, sf)
    return resolve.consolidate(own, resolve.keeper_map(own)).select("id", "name", F.array_join("aliases", ",").alias("aliases"))


@query("""WITH p AS (SELECT min(p_partkey) AS id, lower(p_name) AS n FROM part GROUP BY p_name)
SELECT x.id AS a, y.id AS b, round(1 - levenshtein(x.n, y.n)::DOUBLE / greatest(length(x.n), length(y.n)), 6) AS similarity FROM p x JOIN p y
ON x.id < y.id AND (round(1 - levenshtein(x.n, y.n)::DOUBLE / greatest(length(x.n), length(y.n)), 6) > 0.6 OR contains(x.n, y.n) OR contains(y.n, x.n))""")
def levenshtein_pairs(spark, sf):
    names = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return resolve.fuzzy_pairs(names, 0.6)


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(jaro_winkler_similarity(lower(a.p_name), lower(b.p_name)), 6) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size % 10 = b.p_size % 10 AND a.p_partkey < b.p_partkey""")
def jaro_winkler_pairs(spark, sf):
    """Names of parts of one brand whose sizes end in one digit."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), "p_brand", (F.col("p_size") % 10).alias("size"))
    return resolve.name_scores(p, ["p_brand", "size"], jaro_winkler_udf)


@query(f"""WITH {CO}, b AS (SELECT co.*, canonical, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '\\b(inc|ltd|corp|llc|co|limited|incorporated|corporation|plc|gmbh|sa|srl|bv|nv|ag)\\b\\.?', '', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm FROM co JOIN ca USING (id)),
p AS (SELECT x.id AS a, y.id AS b, 0.95 * 0.4 + jaro_winkler_similarity(x.norm, y.norm) * 0.3 + CASE WHEN x.type = y.type THEN 1.0 ELSE 0.5 END * 0.2 + CASE WHEN x.nation = y.nation THEN 1.0 ELSE 0.0 END * 0.1 AS score FROM b x JOIN b y USING (canonical) WHERE x.id < y.id)
SELECT a, b, round(score, 6) AS score, CASE WHEN score >= 0.85 THEN 'store' WHEN score >= 0.6 THEN 'ambiguous' ELSE 'discard' END AS band FROM p""")
def sameas_score_bands(spark, sf):
    own = companies(spark, sf).withColumn("canonical", C.canonical_name(F.col("name"))).withColumn("near", F.array(F.col("nation").cast("string")))
    side = lambda s: own.select("canonical", *[F.col(c).alias(s if c == "id" else f"{s}_{c}") for c in ("id", "name", "type", "near")])
    pairs = side("a").join(side("b"), "canonical").where("a < b").withColumn("embedding_score", F.lit(0.95))
    return resolve.same_as_scores(pairs).select("a", "b", F.round("score", 6).alias("score"), "band")


def regional(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as nodes of five tenants, their regions."""
    where = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("graph_id"))
    return table(spark, sf, "customer").join(where, "c_nationkey").select("graph_id", model.key("Customer", "c_custkey").alias("id"), F.concat(F.lit("Client "), F.floor(F.col("c_custkey") / 3).cast("string")).alias("name"), F.col("c_mktsegment").alias("type"))


RG = """rg AS (SELECT 'region-' || n_regionkey AS graph_id, 'customer:' || c_custkey AS id, 'Client ' || (c_custkey // 3) AS name, c_mktsegment AS type FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(f"""WITH {RG}, k AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY id) AS k FROM rg WHERE contains(lower(name), 'client 1') AND graph_id IN ('region-0', 'region-2', 'region-4')) SELECT graph_id, id, name FROM k WHERE k <= 5""")
def federated_search_capped(spark, sf):
    return resolve.federated_search(regional(spark, sf), ["region-0", "region-2", "region-4"], "Client 1", 5).select("graph_id", "id", "name")


@query(f"""WITH {RG} SELECT x.id AS a, y.id AS b, round(0.4 + CASE WHEN lower(x.type) = lower(y.type) THEN 0.3 ELSE 0 END, 6)::DOUBLE AS score FROM rg x JOIN rg y ON x.name = y.name AND x.graph_id < y.graph_id""")
def federation_candidates(spark, sf):
    return resolve.federation_candidates(regional(spark, sf)).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH {RG} SELECT lower(name) AS name, lower(type) AS type, count(*) AS pairs FROM (SELECT x.name, x.type FROM rg x JOIN rg y ON x.name = y.name AND x.type = y.type AND x.graph_id < y.graph_id) GROUP BY ALL""")
def federation_link_counts(spark, sf):
    return resolve.federation_links(regional(spark, sf)).groupBy("name", "type").agg(F.count("*").alias("pairs"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 3 = 1 THEN 'unchanged' ELSE 'updated' END AS status FROM customer""")
def entity_delta(spark, sf):
    now = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit("customer").alias("type"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("props"))
    was = now.where("c_custkey % 3 <> 0").withColumn("props", F.when(F.col("c_custkey") % 3 == 1, F.col("props")).otherwise(F.create_map(F.lit("segment"), F.lit("NONE"))))
    stored = was.select(C.fingerprint(F.col("name"), F.col("type")).alias("fingerprint"), C.property_hash(F.col("props")).alias("prop_hash"))
    return resolve.entity_delta(now, stored).select(F.col("c_custkey").alias("id"), "status")


CK = """ck AS (SELECT doc_id, i AS idx, substr(text, i * 1200 + 1, 1500) AS text FROM (SELECT doc_id, text, unnest(range(greatest(0, ceil((length(text) - 300) / 1200)::INT - 1) + 1)) AS i FROM documents WHERE length(text) > 0))"""


@query(f"""WITH {CK} SELECT doc_id, idx::INT AS index, length(text)::INT AS length, sha256(text) AS content_hash FROM ck""")
def chunk_split(spark, sf):
    return retrieval.with_hash(retrieval.chunks(table(spark, sf, "documents"))).select("doc_id", "index", F.length("text").alias("length"), "content_hash")


@query(f"""WITH {CK}, n AS (SELECT DISTINCT doc_id, sha256(text) AS h FROM ck WHERE doc_id % 2 = 0 OR idx > 0), o AS (SELECT DISTINCT doc_id, sha256(text) AS h FROM ck WHERE doc_id % 2 = 1 OR idx < 2)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM n FULL JOIN o ON n.doc_id = o.doc_id AND n.h = o.h) GROUP BY status""")
def chunk_hash_delta(spark, sf):
    all_ = retrieval.with_hash(retrieval.chunks(table(spark, sf, "documents")))
    new, old = all_.where("doc_id % 2 = 0 or index > 0"), all_.where("doc_id % 2 = 1 or index < 2")
    return resolve.chunk_delta(new, old).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT event_type AS label, count(*) AS violations, min(event_id)::VARCHAR AS example FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY event_type""")
def ontology_violations(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("label"), F.col("event_id").alias("id"))
    return resolve.ontology_violations(rows, ["click", "view", "purchase"]).withColumn("example", F.col("example").cast("string"))


@query("""SELECT CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'views' WHEN 'purchase' THEN 'purchases' ELSE event_type END AS label, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'coerced' ELSE 'mismatch' END AS ontology_status, count(*) AS n FROM events GROUP BY ALL""")
def ontology_coerce(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("label"), F.col("event_id").alias("id"))
    return resolve.enforce_ontology(rows, ["clicks", "views", "purchases"]).groupBy("label", "ontology_status").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {E}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r(id, d) AS (SELECT 'region:1', 0 UNION SELECT u.dst, r.d + 1 FROM r JOIN u ON u.src = r.id WHERE r.d < 3)
SELECT id, min(d) AS distance FROM r WHERE id <> 'region:1' GROUP BY id""")
def khop_reach(spark, sf):
    start = spark.createDataFrame([("region:1",)], "id string")
    return traverse.reach(model.edges(spark, sf), start, 3).select("id", "distance")


@query(f"""WITH RECURSIVE {E}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), p(s, v, d, path) AS (SELECT 'customer:1', 'customer:1', 0, ['customer:1'] UNION ALL SELECT s, u.dst, d + 1, list_append(path, u.dst) FROM p JOIN u ON u.src = p.v WHERE d < 4 AND NOT list_contains(path, u.dst))
SELECT s AS start, v AS finish, min(d) AS hops, arg_min(array_to_string(path, '>'), (d, path)) AS path FROM p WHERE v <> s GROUP BY s, v""")
def shortest_path(spark, sf):
    pairs = model.nodes(spark, sf).where("id <> 'customer:1'").select(F.lit("customer:1").alias("start"), F.col("id").alias("finish"))
    return traverse.shortest_paths(model.edges(spark, sf), pairs, 4).select("start", "finish", "hops", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {E}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), p(v, d, path) AS (SELECT 'region:0', 0, ['region:0'] UNION ALL SELECT u.dst, d + 1, list_append(path, u.dst) FROM p JOIN u ON u.src = p.v WHERE d < 3 AND NOT list_contains(path, u.dst))
SELECT v AS finish, d AS hops, array_to_string(path, '>') AS path FROM p WHERE d > 0 AND v LIKE 'supplier:%'""")
def simple_paths(spark, sf):
    start = spark.createDataFrame([("region:0",)], "id string")
    found = traverse.paths(model.edges(spark, sf), start, 3, directed=False, ends=model.nodes(spark, sf, ["Supplier"]))
    return found.select("finish", "hops", F.array_join("path", ">").alias("path"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey),
p(s, v, d, path) AS (SELECT src, dst, 2, [src, dst] FROM e WHERE dst > src UNION ALL SELECT s, e.dst, d + 1, list_append(path, e.dst) FROM p JOIN e ON e.src = p.v WHERE d < 3 AND e.dst > s AND NOT list_contains(path, e.dst))
SELECT d AS hops, array_to_string(path, '>') AS path FROM p JOIN e ON e.src = p.v AND e.dst = p.s""")
def cycles_bounded(spark, sf):
    """Rings of two or three nations whose suppliers serve the next one's customers."""
    items = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return traverse.cycles(items.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")), 3).select("hops", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {E}, r(id, d) AS (SELECT 'customer:1', 0 UNION ALL SELECT edges.dst, d + 1 FROM r JOIN edges ON edges.src = r.id) SELECT id, d AS distance FROM r""")
def inheritance_chain(spark, sf):
    return traverse.chain(model.edges(spark, sf), "customer:1")


def _pagerank_sql(rounds: int = 20) -> str:
    """The rounds as one common table expression after the other."""
    steps = ["r0 AS MATERIALIZED (SELECT id, 0.15::DOUBLE AS rank FROM ids)"]
    steps += [f"r{i} AS MATERIALIZED (SELECT ids.id, 0.15 + 0.85 * coalesce(got, 0) AS rank FROM ids LEFT JOIN (SELECT l.dst AS id, sum(rank * share) AS got FROM l JOIN r{i - 1} r ON r.id = l.src GROUP BY l.dst) g USING (id))" for i in range(1, rounds + 1)]
    return f"""WITH {N}, {E}, u AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), ids AS (SELECT id FROM nodes),
l AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM u), {", ".join(steps)}
SELECT id, round(rank, 6) AS rank FROM r{rounds} ORDER BY round(r{rounds}.rank, 9) DESC, id LIMIT 10"""


@query(_pagerank_sql())
def pagerank_top(spark, sf):
    return community.pagerank(model.edges(spark, sf), model.nodes(spark, sf)).orderBy(F.desc(F.round("rank", 9)), "id").limit(10).select("id", F.round("rank", 6).alias("rank"))


@query()
def label_propagation(spark, sf):
    return community.label_propagation(model.edges(spark, sf), model.nodes(spark, sf))


@query()
def community_detect(spark, sf):
    return community.detect(model.edges(spark, sf)).groupBy("level", "community_id").agg(F.count("*").alias("size"))


def two_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as members of their region (level 0, coarse) and nation (level 1)."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = table(spark, sf, "customer").join(n, "c_nationkey").withColumn("member_id", model.key("Customer", "c_custkey"))
    return rows.select("member_id", model.key("Region", "n_regionkey").alias("community_id"), F.lit(0).alias("level")).unionByName(rows.select("member_id", model.key("Nation", "c_nationkey").alias("community_id"), F.lit(1).alias("level")))


TL = """tl AS (SELECT 'customer:' || c_custkey AS member_id, 'region:' || n_regionkey AS community_id, 0 AS level FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 1 FROM customer)"""


@query("""SELECT 'nation:' || c_nationkey AS community_id, 1 AS level, 'region:' || n_regionkey AS parent_id, count(*) AS votes FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def community_hierarchy_vote(spark, sf):
    return community.hierarchy(two_levels(spark, sf))


@query(f"""WITH {TL} SELECT level, community_id, count(*) AS entity_count, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY level), 6) AS weight FROM tl GROUP BY level, community_id ORDER BY level, entity_count DESC, community_id LIMIT 10 OFFSET 2""")
def community_list(spark, sf):
    return community.community_list(two_levels(spark, sf), offset=2, limit=10)


@query(f"""WITH {TL} SELECT community_id, count(*) AS hits FROM tl WHERE level = 1 AND member_id IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY community_id HAVING count(*) >= 2 ORDER BY hits DESC, community_id LIMIT 3""")
def community_hits(spark, sf):
    return community.hits(two_levels(spark, sf), model.nodes(spark, sf, ["Customer"]).where(F.col("props")["c_mktsegment"] == "BUILDING"))


@query(f"""WITH {TL}, live AS (SELECT 'customer:' || c_custkey AS id FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier)
SELECT level, count(DISTINCT community_id) AS communities, count(DISTINCT member_id) AS members, round(1 - count(DISTINCT member_id)::DOUBLE / (SELECT count(*) FROM live), 6) AS stale_ratio FROM tl GROUP BY level""")
def community_status(spark, sf):
    return community.community_status(two_levels(spark, sf), model.nodes(spark, sf, ["Customer", "Supplier"]))


@query(f"""WITH {TL}, r AS (SELECT community_id, member_id, c_name AS name, c_mktsegment AS label, row_number() OVER (PARTITION BY community_id ORDER BY member_id) AS k FROM tl JOIN customer ON member_id = 'customer:' || c_custkey WHERE level = 1),
t AS (SELECT community_id, label, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, label) AS k FROM r GROUP BY community_id, label),
s AS (SELECT community_id, count(*) AS entity_count, string_agg(name, ', ' ORDER BY k) FILTER (k <= 5) AS sample FROM r GROUP BY community_id)
SELECT community_id, entity_count, label AS main_label, 'Community of ' || entity_count || ' ' || label || ': ' || sample AS summary FROM s JOIN t USING (community_id) WHERE k = 1""")
def community_describe(spark, sf):
    names = table(spark, sf, "customer").select(model.key("Customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"))
    return community.describe(two_levels(spark, sf).where("level = 1"), names).select("community_id", "entity_count", "main_label", "summary")


def memories(spark: SparkSession, sf: str) -> DataFrame:
    """Events as memories."""
    kind = F.element_at(F.array(F.lit("episodic"), F.lit("semantic"), F.lit("procedural")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select(F.lit("g").alias("graph_id"), F.col("event_id").alias("memory_id"), kind.alias("memory_type"), ((F.col("event_id") % 10) / 10.0).alias("base_importance"), F.col("ts").alias("last_accessed_at"), (F.col("user_id") % 7).alias("access_count"), F.concat_ws(" ", "event_type", (F.col("user_id") % 5).cast("string")).alias("content"))


MM = """mm AS (SELECT event_id AS memory_id, ['episodic', 'semantic', 'procedural'][event_id % 3 + 1] AS memory_type, (event_id % 10) / 10.0::DOUBLE AS base, user_id % 7 AS access_count, event_type || ' ' || (user_id % 5) AS content,
  greatest(0, (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(ts)) / 86400000000.0::DOUBLE) AS days FROM events),
im AS (SELECT *, least(1.0, base * exp(-CASE memory_type WHEN 'episodic' THEN 0.05 WHEN 'semantic' THEN 0.005 ELSE 0.01 END * days) + least(0.3, 0.05 * ln(1 + access_count))) AS importance FROM mm)"""
LATER = "2030-01-01"


@query(f"""WITH {MM} SELECT memory_id, round(importance, 6) AS importance_score, round(exp(-0.02 * days), 6) AS recency FROM im""")
def memory_importance(spark, sf):
    own = memory.with_importance(memories(spark, sf), at(LATER))
    return own.select("memory_id", F.round("importance_score", 6).alias("importance_score"), F.round(C.recency(F.col("last_accessed_at"), at(LATER)), 6).alias("recency"))


@query(f"""WITH {MM} SELECT memory_id, round(0.5 * (memory_id % 100) / 100.0 + 0.3 * importance + 0.2 * exp(-0.02 * days), 6) AS ranking FROM im WHERE content LIKE 'click%' ORDER BY round(0.5 * (memory_id % 100) / 100.0 + 0.3 * importance + 0.2 * exp(-0.02 * days), 6) DESC, memory_id LIMIT 10""")
def memory_search_rank(spark, sf):
    own = memory.with_importance(memories(spark, sf), at(LATER))
    scores = own.where(F.col("content").startswith("click")).select("memory_id", ((F.col("memory_id") % 100) / 100.0).alias("text_score"))
    top = memory.ranked(own, scores, at(LATER), 1_000_000)
    return top.select("memory_id", F.round("ranking", 6).alias("ranking")).orderBy(F.desc("ranking"), "memory_id").limit(10)


@query(f"""WITH {MM}, k AS (SELECT content, memory_id, importance, row_number() OVER (PARTITION BY content ORDER BY round(importance, 9) DESC, memory_id) AS k FROM im)
SELECT min(memory_id) FILTER (k = 1) AS memory_id, round(least(1.0, sum(importance)), 6) AS importance_score, count(*) AS merged FROM k GROUP BY content""")
def memory_consolidate(spark, sf):
    own = memory.with_importance(memories(spark, sf), at(LATER)).withColumn("importance_score", F.round("importance_score", 9))
    return memory.consolidate(own).select("memory_id", F.round("importance_score", 6).alias("importance_score"), "merged")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant') AND NOT (role = 'assistant' AND coalesce(text, '') = '')),
r AS (SELECT *, sum(greatest(1, length(coalesce(text, '')) // 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running FROM o WHERE k <= 6)
SELECT conv_id, turn, running::BIGINT AS running FROM r WHERE running <= 400""")
def history_budget(spark, sf):
    return memory.history(table(spark, sf, "conversations"), 6, 400).select("conv_id", "turn", "running")


@query("""WITH e AS (SELECT event_id, event_type, (floor(length('- ' || props || ' (confidence: ' || '0.50' || ')') * 0.25) + 5)::BIGINT AS tok FROM events),
r AS (SELECT *, sum(tok) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM e) SELECT event_type, event_id, running::BIGINT AS running FROM r WHERE running <= 200""")
def context_budget(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", memory.entry_tokens(F.col("props"), F.lit(0.5)).alias("tok"))
    return memory.budgeted(rows, ["event_type"], [F.col("event_id")], F.col("tok"), 200).select("event_type", "event_id", "running")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 26""")
def keyset_page(spark, sf):
    return access.keyset_page(table(spark, sf, "orders"), "o_orderkey", F.lit(500), 25).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40""")
def offset_page(spark, sf):
    return access.page(table(spark, sf, "orders").where("o_orderstatus = 'F'"), [F.col("o_orderkey")], 40, 20).select("o_orderkey", "o_custkey", "total")


#: Columns that may refer to another table's key, and the key.
REFERS = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
CATALOG = "fk AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, '{o}' AS o WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {o}))" for t, c, o, k in REFERS) + ")"


def star_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.inferred_catalog({t: table(spark, sf, t) for t in STAR})


@query(f"""WITH {CATALOG}, tb AS (SELECT unnest([{", ".join(f"'{t}'" for t in STAR)}]) AS t)
SELECT tb.t AS "table", 'entity_table' AS kind, upper(tb.t[1]) || tb.t[2:] AS label, c AS "column", o AS fk_table, CASE WHEN c IS NOT NULL THEN 'BELONGS_TO' END AS relationship FROM tb LEFT JOIN fk ON fk.t = tb.t""")
def fk_catalog_map(spark, sf):
    """Kinds of tables and types of relationships from the tables' own schemas and values."""
    return mapping.mapping_rules(star_catalog(spark, sf))


@query("""SELECT 'c:nation:' || n_nationkey AS src, 'c:region:' || n_regionkey AS dst, 'BELONGS_TO' AS type FROM nation""")
def fk_edges(spark, sf):
    return mapping.key_edges(table(spark, sf, "nation"), "c", "nation", ["n_nationkey"], "n_regionkey", "region", "BELONGS_TO")


@query("""SELECT 'c:part:' || p_partkey AS id, 'Part' AS label, p_brand AS brand, p_size::VARCHAR AS size FROM part""")
def entity_rows(spark, sf):
    made = mapping.entity_rows(table(spark, sf, "part"), "c", "part", ["p_partkey"], "g", "Part")
    return made.select("id", "label", F.col("props")["p_brand"].alias("brand"), F.col("props")["p_size"].alias("size"))


@query()
def rate_limit_decisions(spark, sf):
    return feeds.rate_limited(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 0.001, 2.0).select("event_id", "user_id", "allowed")


@query("""SELECT user_id, sha256(event_type) AS payload_hash FROM events GROUP BY ALL""")
def event_dedup(spark, sf):
    return feeds.deduplicated(table(spark, sf, "events"), ["user_id"], "event_type").select("user_id", "payload_hash")


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_counts(spark, sf):
    return feeds.tumbling(table(spark, sf, "events"), "ts", "1 day", ["event_type"]).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS s FROM events),
h AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM h GROUP BY user_id, k""")
def session_counts(spark, sf):
    return feeds.sessions(table(spark, sf, "events"), "ts", "6 hours", ["user_id"]).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY event_type""")
def percentile_report(spark, sf):
    return access.percentiles(table(spark, sf, "events"), "value", "event_type")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(sum(value * pow(0.9, n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.1 END), 6) AS ema FROM r GROUP BY event_type""")
def moving_average(spark, sf):
    return access.moving_average(table(spark, sf, "events"), "event_type", "event_id", "value").select("event_type", F.round("ema", 6).alias("ema"))


@query(f"""SELECT DISTINCT user_id, graph_id FROM (
  SELECT 'u' || c_custkey AS user_id, 'g' || c_nationkey AS graph_id FROM customer WHERE c_custkey % 5 < 3 AND c_acctbal > 0 AND (c_custkey % 7 <> 0 OR TIMESTAMP '1998-01-01' > TIMESTAMP '{NOW}')
  UNION ALL SELECT 'u' || s_suppkey, 'g' || s_nationkey FROM supplier)""")
def permission_check(spark, sf):
    """Who may write where: customers by roles that inherit, are active and haven't expired, suppliers as owners."""
    c = table(spark, sf, "customer")
    role = F.element_at(F.array(*[F.lit(x) for x in ("admin", "owner", "editor", "viewer", "guest")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    named = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    grants = c.select(named("u", "c_custkey").alias("user_id"), named("g", "c_nationkey").alias("graph_id"), role.alias("role"), (F.col("c_acctbal") > 0).alias("is_active"), F.when(F.col("c_custkey") % 7 == 0, at("1998-01-01")).alias("expires_at"))
    permissions = spark.createDataFrame([("viewer", "read"), ("editor", "write"), ("owner", "delete")], "role string, permission string")
    parents = spark.createDataFrame([("admin", "owner"), ("owner", "editor"), ("editor", "viewer")], "role string, parent string")
    owners = table(spark, sf, "supplier").select(named("u", "s_suppkey").alias("user_id"), named("g", "s_nationkey").alias("graph_id"))
    return access.permitted(grants, permissions, parents, owners, at(NOW), "write")


@query(r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^([A-Z])', '## \1', 'g'), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls)))::INT AS "at", unnest(ls) AS line FROM d)
SELECT doc_id, "at", 2 AS level, regexp_extract(line, '^(#{1,6})\s+(.+?)\s*$', 2) AS heading FROM l WHERE regexp_matches(line, '^(#{1,6})\s+(.+?)\s*$')""")
def md_sections(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "(?m)^([A-Z])", "## $1").alias("text"))
    return files.markdown_sections(docs).select("doc_id", "at", "level", "heading")


@query("""SELECT graph_id, id, label, seg FROM (SELECT 'tpch' AS graph_id, 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Client' ELSE 'Customer' END AS label, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS seg FROM customer)""")
def upsert_nodes(spark, sf):
    stored = model.nodes(spark, sf, ["Customer"]).select("graph_id", "id", "label", "props")
    new = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.lit("tpch").alias("graph_id"), model.key("Customer", "c_custkey").alias("id"), F.lit("Client").alias("label"), F.create_map(F.lit("c_mktsegment"), F.lit("NEW")).alias("props"))
    return sinks.upsert_nodes(stored, new).select("graph_id", "id", "label", F.col("props")["c_mktsegment"].alias("seg"))


@query(f"""WITH {E} SELECT src, dst, type FROM edges WHERE src NOT IN ('nation:3', 'nation:4') AND dst NOT IN ('nation:3', 'nation:4')""")
def detach_delete(spark, sf):
    gone = spark.createDataFrame([("nation:3",), ("nation:4",)], "id string")
    return sinks.detach_delete(model.nodes(spark, sf, ["Nation"]), model.edges(spark, sf), gone)[1].select("src", "dst", "type")


@query("""SELECT lang, count(*) AS docs, round(100.0 * count(CASE WHEN doc_id % 3 = 0 THEN 1 END) / count(*), 6)::DOUBLE AS coverage FROM documents GROUP BY lang""")
def embedding_coverage(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("label"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("v"))
    return graph.coverage(docs, "v").join(docs.groupBy("label").agg(F.count("*").alias("docs")), "label").select(F.col("label").alias("lang"), "docs", "coverage")


@query("""WITH s AS (SELECT label, (vec_id % 97) / 97.0::DOUBLE AS score, row_number() OVER (PARTITION BY label ORDER BY (vec_id % 97) DESC, vec_id) AS k FROM embeddings) SELECT label, round(avg(score), 6) AS confidence FROM s WHERE k <= 3 GROUP BY label""")
def answer_confidence(spark, sf):
    scores = table(spark, sf, "embeddings").select("label", ((F.col("vec_id") % 97) / 97.0).alias("score"))
    return retrieval.confidence(scores, "label").select("label", F.round("confidence", 6).alias("confidence"))


ASKED = "CASE conv_id % 5 WHEN 0 THEN 'How many of these are there: ' WHEN 1 THEN 'Give an overview. ' WHEN 2 THEN 'How is it related to Acme Corp and ' WHEN 3 THEN 'Match the path between ' ELSE '' END || text"


@query(rf"""WITH q AS (SELECT conv_id, turn, {ASKED} AS text FROM conversations WHERE role = 'user'),
r AS (SELECT *, regexp_extract_all(text, '[A-Z][A-Za-z0-9&.''-]*(?:\s+[A-Z][A-Za-z0-9&.''-]*)*') AS runs FROM q)
SELECT conv_id, turn, CASE WHEN {" OR ".join(f"contains(lower(text), '{w}')" for w in retrieval.GLOBAL)} THEN 'community' WHEN regexp_matches(text, '{retrieval.STRUCTURED}') THEN 'text2query'
  WHEN regexp_matches(text, '{retrieval.ANALYTIC}') THEN 'vector_graph' WHEN regexp_matches(text, '{retrieval.RELATIONAL}') THEN 'hybrid_graph' ELSE 'hybrid' END AS route,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(runs, lambda r: array_to_string(list_filter(string_split_regex(r, '\s+'), lambda w: lower(w) NOT IN ({", ".join(f"'{w}'" for w in retrieval.STOPWORDS)})), ' ')), lambda r: length(r) > 1))), ',') AS candidates FROM r""")
def question_routing(spark, sf):
    """Each user's turn with the retriever it goes to and the names that may be entities."""
    q = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.expr(ASKED).alias("text"))
    return q.select("conv_id", "turn", retrieval.route(F.col("text")).alias("route"), F.array_join(F.array_sort(retrieval.entity_candidates(F.col("text"))), ",").alias("candidates"))


@query("""SELECT role, count(*) AS turns, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM conversations GROUP BY role""")
def token_totals(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(C.token_estimate(F.col("text"))).alias("tokens"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def conversation_export(spark, sf):
    m = table(spark, sf, "conversations")
    doc = access.export_json(m.select("conv_id").distinct(), m, m.limit(0).select("conv_id", "turn", F.col("role").alias("tool")))
    held = doc.select("conv_id", F.from_json("document", "conv_id long, messages array<struct<turn:long,role:string,text:string>>").alias("d"))
    return held.select("conv_id", F.size("d.messages").cast("long").alias("turns"), F.array_join(F.transform("d.messages", lambda x: x.role), ",").alias("roles"))


@query("""SELECT o_orderpriority AS instance_id, count(*) AS executions, sum(round(o_totalprice, 2)::DECIMAL(18,6))::DOUBLE AS credits FROM orders GROUP BY ALL""")
def execution_totals(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("instance_id"), F.round("o_totalprice", 2).alias("credits"))
    return access.execution_totals(runs).withColumn("credits", F.col("credits").cast("double"))


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'memory_only' ELSE 'db_only' END AS presence FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 8) b ON a.k = b.k""")
def registry_presence(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    return access.presence(n.where("k < 15"), n.where("k > 8"), "k")


@query("""SELECT doc_id, any_word FROM (SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'worthless') AS any_word FROM documents) WHERE any_word""")
def any_word_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.any_word_in(F.col("text"), "license worthless").alias("any_word")).where("any_word")


@query(f"""WITH {RG} SELECT type, min(graph_id) AS first_graph, count(DISTINCT graph_id) AS graphs FROM rg WHERE graph_id IN ('region-1', 'region-3') GROUP BY type""")
def tenant_view(spark, sf):
    own = regional(spark, sf)
    view = model.TenantView(own, own, ["region-1", "region-3", "region-1"])
    return view.nodes.groupBy("type").agg(F.min("graph_id").alias("first_graph"), F.count_distinct("graph_id").alias("graphs"))


@query("""SELECT DISTINCT sha256(text) AS sha256 FROM documents""")
def content_blobs(spark, sf):
    return sinks.blobs(table(spark, sf, "documents").select(F.lit("g").alias("graph_id"), F.col("text").alias("content"))).select("sha256")


def code_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers as functions that call each other."""
    return table(spark, sf, "lineitem").select(F.concat(F.lit("m.s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("m.p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("CALLS").alias("type"))


CE = """ce AS (SELECT 'm.s' || l_suppkey AS src, 'm.p' || l_partkey AS dst FROM lineitem)"""


@query(f"""WITH {CE} SELECT DISTINCT src AS symbol FROM ce WHERE dst = 'm.p7' ORDER BY symbol LIMIT 100""")
def code_callers(spark, sf):
    return code.callers(code_edges(spark, sf), "m.p7")


@query(f"""WITH {CE} SELECT DISTINCT src AS qualified_name FROM ce WHERE src NOT IN (SELECT dst FROM ce)""")
def code_dead(spark, sf):
    e = code_edges(spark, sf)
    names = e.select(F.col("src").alias("qualified_name")).unionByName(e.select(F.col("dst").alias("qualified_name"))).distinct()
    return code.dead_code(names.withColumns({"kind": F.lit("function"), "is_test": F.lit(False)}), e).select("qualified_name")
