"""Queries of the operators with structures of their own: vector cells, inverted index, similarity and interval joins, merging, path patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import model
from lodestar.model import table
from lodestar.operators import joins, patterns, resolve, textindex, traverse
from lodestar.operators.patterns import Step
from lodestar.operators.vectors import build, federated_topk
from lodestar.plans.queries import BM, CO, T1, E, companies, query, query_vector, vectors, versioned_edges

# Vectors


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT label AS graph_id, vec_id AS id, (1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2 AS score FROM embeddings, q WHERE label IN (0, 2, 3, 5, 8)),
k AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, id) AS k FROM s)
SELECT graph_id, id, round(score, 6) AS score FROM k WHERE k <= 4 ORDER BY k.score DESC, id LIMIT 12""")
def federated_vector_search(spark, sf):
    """The nearest vectors over the graphs (labels) that may be asked, at most four of each."""
    index = build(vectors(spark, sf).withColumnRenamed("label", "graph_id"))
    found = federated_topk(index, query_vector(spark, sf), [0, 2, 3, 5, 8], n=12, per_graph=4)
    return found.select("graph_id", "id", F.round("score", 6).alias("score"))


# Text


@query(f"""WITH {BM} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, doc_id LIMIT 10""")
def fulltext_topk(spark, sf):
    """bm25_topk from the inverted index."""
    index = textindex.build(table(spark, sf, "documents"), "doc_id")
    return textindex.search(index, "the license, idiot").select("doc_id", F.round("score", 6).alias("score"))


CHANGED = """documents AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'license of ' || text ELSE text END AS text FROM main.documents WHERE doc_id % 9 <> 2
  UNION ALL SELECT doc_id + 1000000, 'The idiot license' FROM main.documents WHERE doc_id % 50 = 0)"""


def changed_index(spark: SparkSession, sf: str) -> textindex.TextIndex:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = textindex.build(docs, "doc_id")
    changed = docs.where("doc_id % 5 = 1 and doc_id % 9 <> 2").select("doc_id", F.concat(F.lit("license of "), "text").alias("text"))
    new = docs.where("doc_id % 50 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("The idiot license").alias("text"))
    return textindex.update(index, changed.unionByName(new), removed=docs.where("doc_id % 9 = 2"))


@query(f"""WITH {CHANGED}, {BM} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, doc_id LIMIT 10""")
def fulltext_after_changes(spark, sf):
    """The same search once documents have changed, gone and come: as if the index were new."""
    return textindex.search(changed_index(spark, sf), "the license, idiot").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {CHANGED} SELECT term, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term""")
def fulltext_listing(spark, sf):
    """The terms of the index and how many documents have each, from the heads of its blocks."""
    return textindex.listing(changed_index(spark, sf)).select("term", "docs")


# Joins


@query("""WITH f AS (SELECT l_returnflag AS mode, l_orderkey || '-' || l_linenumber AS id, epoch_us(o_orderdate) AS a, epoch_us(l_shipdate) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate),
e AS (SELECT mode, a AS t, 1 AS d, 1 AS s FROM f UNION ALL SELECT mode, b, -1, 0 FROM f),
r AS (SELECT mode, s, sum(d) OVER (PARTITION BY mode ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS open FROM e)
SELECT mode, count(*) AS facts, sum(open - 1)::BIGINT AS pairs FROM r WHERE s = 1 GROUP BY mode""")
def overlap_counts(spark, sf):
    """How many pairs of shipments of one mode (its return flag) are under way at once: a third of all facts a key, no pair made."""
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("valid_from"))
    facts = table(spark, sf, "lineitem").join(dates, "l_orderkey").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), F.col("l_returnflag").alias("mode"), "valid_from", F.col("l_shipdate").alias("valid_to"))
    return joins.overlap_counts(facts, ["mode"])


def links_with_hub(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and the parts they supply, and two hubs: one that all suppliers have, one that every third has."""
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("hub"))
    all_ = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("member"))
    return own.unionByName(all_.withColumn("hub", F.lit(-1).cast("long"))).unionByName(all_.where("member % 3 = 0").withColumn("hub", F.lit(-2).cast("long")))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS member, l_partkey AS hub FROM lineitem UNION SELECT s_suppkey, -1 FROM supplier UNION SELECT s_suppkey, -2 FROM supplier WHERE s_suppkey % 3 = 0),
p AS (SELECT a.member AS a, b.member AS b, count(*) AS common FROM l a JOIN l b ON a.hub = b.hub AND a.member < b.member GROUP BY ALL HAVING count(*) >= 2 ORDER BY common DESC, a, b LIMIT 10)
SELECT 'simple_community_tpch_' || (row_number() OVER (ORDER BY common DESC, a, b) - 1) AS community_id, a, b, common, common / 10.0::DOUBLE AS weight FROM p""")
def neighbour_communities(spark, sf):
    """Communities of two from shared neighbours, with a hub that has every member."""
    return joins.neighbour_communities(links_with_hub(spark, sf), "tpch", heavy=50)


# Merging


@query(rf"""WITH {CO}, n AS (SELECT count(*) AS entities_processed, count(*) FILTER (canonical <> '') AS canonical_names_added, count(*) FILTER (canonical = '') AS skipped_bad_names FROM ca),
e AS (SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst FROM lineitem),
r AS (SELECT sum(k - 1)::BIGINT AS relationship_consolidations, sum(k)::BIGINT AS relationships_processed FROM (SELECT count(*) AS k FROM e GROUP BY src, dst))
SELECT 'tpch' AS graph_id, entities_processed, relationships_processed, canonical_names_added, skipped_bad_names, 0::BIGINT AS canonical_merges, relationship_consolidations FROM n, r""")
def dedup_dry_run(spark, sf):
    """What the passes over names and relationships would do; nothing is stored, so nothing merges by names that aren't there yet."""
    own = companies(spark, sf).withColumns({"canonical_name": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<float>"), "aliases": F.lit(None).cast("array<string>")})
    return resolve.deduplicate(own, supplies(spark, sf), ("canonical", "merge_canonical", "relationships"), dry_run=True)[2]


def supplies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.lit("tpch").alias("graph_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), model.key("Supplier", "l_suppkey").alias("src"), model.key("Part", "l_partkey").alias("dst"), F.lit("SUPPLIES").alias("type"), F.lit(None).cast("long").alias("count"))


@query(rf"""WITH {CO}, m AS (SELECT id, min(id) OVER (PARTITION BY canonical) AS keeper FROM ca),
e AS (SELECT coalesce(keeper, 'supplier:' || l_suppkey) AS src, 'part:' || l_partkey AS dst, l_orderkey || '-' || l_linenumber AS edge_id FROM lineitem LEFT JOIN m ON id = 'supplier:' || l_suppkey)
SELECT src, dst, min(edge_id) AS edge_id, count(*) AS count FROM e GROUP BY src, dst""")
def dedup_edges_of_keepers(spark, sf):
    """Edges after names were merged and parallel relationships consolidated."""
    own = companies(spark, sf).withColumns({"canonical_name": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<float>"), "aliases": F.lit(None).cast("array<string>")})
    return resolve.deduplicate(own, supplies(spark, sf), ("canonical", "merge_canonical", "relationships"))[1].select("src", "dst", "edge_id", "count")


# Paths


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", ">"))


@query(f"""WITH RECURSIVE {E}, p(id, hops, path) AS (SELECT 'region:1', 0, 'region:1' UNION ALL SELECT e.src, hops + 1, path || '>' || e.src FROM p JOIN edges e ON e.dst = p.id AND e.type IN ('IN_REGION', 'IN_NATION') WHERE hops < 50)
SELECT 'region:1' AS start, id, min(hops) AS hops, arg_min(path, hops) AS path FROM p WHERE hops > 0 GROUP BY id""")
def pattern_all_types(spark, sf):
    """Paths against the edges' direction, however long, all of whose types are among two."""
    start = spark.createDataFrame([("region:1",)], "id string")
    return shown(patterns.match(model.edges(spark, sf), start, [Step(("IN_REGION", "IN_NATION"), "in", 1, None)]))


@query(f"""WITH {E}, o AS (SELECT src AS id FROM edges WHERE dst = 'customer:1' AND type = 'PLACED_BY'),
n AS (SELECT e.dst AS nation, min(o.id) AS o FROM o JOIN edges p ON p.src = o.id AND p.type = 'PLACED_BY' JOIN edges e ON e.src = p.dst AND e.type = 'IN_NATION' GROUP BY 1)
SELECT 'customer:1' AS start, e.src AS id, 4 AS hops, min('customer:1>' || o || '>customer:1>' || nation || '>' || e.src) AS path FROM n JOIN edges e ON e.dst = nation AND e.type = 'IN_NATION' GROUP BY e.src""")
def pattern_repeated_types(spark, sf):
    """Orders of a customer, back to who placed them, their nation, and all who are in it: types and directions that repeat."""
    start = spark.createDataFrame([("customer:1",)], "id string")
    steps = [Step(("PLACED_BY",), "in"), Step(("PLACED_BY",), "out"), Step(("IN_NATION",), "out"), Step(("IN_NATION",), "in")]
    return shown(patterns.match(model.edges(spark, sf), start, steps))


@query(f"""SELECT 'nation:1' AS start, 'customer:' || c_custkey AS id, 1 AS hops, 'nation:1>customer:' || c_custkey AS path FROM customer WHERE c_nationkey = 1
UNION ALL SELECT 'nation:1', 'order:' || o_orderkey, 2, 'nation:1>customer:' || c_custkey || '>order:' || o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 1 AND o_orderdate < TIMESTAMP '{T1}'
UNION ALL SELECT 'nation:1', 'supplier:' || s_suppkey, 1, 'nation:1>supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 1""")
def pattern_valid_edges(spark, sf):
    """Paths of one or two edges every one of which was there before a day."""
    placed = versioned_edges(spark, sf).select("src", "dst", "type", "valid_from")
    still = model.edges(spark, sf, ["IN_NATION"]).select("src", "dst", "type", F.lit(None).cast("timestamp").alias("valid_from"))
    start = spark.createDataFrame([("nation:1",)], "id string")
    return shown(patterns.match(placed.unionByName(still), start, [Step(None, "in", 1, 2, f"valid_from IS NULL OR valid_from < TIMESTAMP '{T1}'")]))


TR = """tr AS (SELECT DISTINCT 'n' || s_nationkey AS src, 'n' || c_nationkey AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey)"""


def trade(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    return items.select(named("s_nationkey").alias("src"), named("c_nationkey").alias("dst")).where("src <> dst").distinct()


@query(f"""WITH RECURSIVE {TR}, p(start, v, hops, path) AS (SELECT s, s, 0, [s] FROM (VALUES ('n1'), ('n3')) t(s) UNION ALL SELECT start, tr.dst, hops + 1, list_append(path, tr.dst) FROM p JOIN tr ON tr.src = p.v WHERE hops < 3 AND NOT list_contains(path, tr.dst) AND v <> 'n2'),
k AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, path) AS k FROM p WHERE v = 'n2')
SELECT start, v AS finish, hops, array_to_string(path, '>') AS path FROM k WHERE k <= 12""")
def k_shortest_paths(spark, sf):
    """The twelve shortest simple paths between nations that trade, in a graph in which most do."""
    pairs = spark.createDataFrame([("n1", "n2"), ("n3", "n2")], "start string, finish string")
    return shown(patterns.k_shortest(trade(spark, sf), pairs, 12, 3, directed=True))


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS k FROM part), p(start, v, path) AS (SELECT k, k, k::VARCHAR FROM c WHERE k % 20 = 0 UNION ALL SELECT start, v + 1, path || '>' || (v + 1) FROM p JOIN c ON c.k = v + 1 WHERE (v + 1) % 20 <> 0)
SELECT start, v AS finish, 17 AS hops, path FROM p WHERE v % 20 = 17""")
def unbounded_shortest_path(spark, sf):
    """From the first to the last but some of each chain of twenty parts, from both ends at once."""
    k = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    chains = k.join(k.select((F.col("k") - 1).alias("k"), F.col("k").alias("dst")), "k").where("dst % 20 <> 0").select(F.col("k").alias("src"), "dst")
    pairs = k.where("k % 20 = 0").select(F.col("k").alias("start"), (F.col("k") + 17).alias("finish"))
    return shown(patterns.unbounded_shortest(chains, pairs)).select("start", "finish", "hops", "path")


IM = """im AS (SELECT DISTINCT * FROM (SELECT p_partkey AS src, (3 * p_partkey + 1) % n AS dst FROM part, (SELECT count(*) AS n FROM part) UNION ALL SELECT p_partkey, (5 * p_partkey + 2) % n FROM part, (SELECT count(*) AS n FROM part) WHERE p_partkey % 4 = 0) WHERE src <> dst)"""


@query(f"""WITH RECURSIVE {IM}, p(s, v, d, path) AS (SELECT src, dst, 2, [src, dst] FROM im WHERE dst > src UNION ALL SELECT s, im.dst, d + 1, list_append(path, im.dst) FROM p JOIN im ON im.src = p.v WHERE d < 10 AND im.dst > s AND NOT list_contains(path, im.dst))
SELECT d AS hops, array_to_string(path, '>') AS path FROM p JOIN im ON im.src = p.v AND im.dst = p.s""")
def circular_imports(spark, sf):
    """Cycles of two to ten modules, which parts stand for, each importing one or two others."""
    parts = table(spark, sf, "part").select("p_partkey")
    n = parts.agg(F.count("*").alias("n"))
    own = parts.join(F.broadcast(n))  # one row
    to = lambda df, a, b: df.select(F.col("p_partkey").alias("src"), ((a * F.col("p_partkey") + b) % F.col("n")).alias("dst"))
    return traverse.cycles(to(own, 3, 1).unionByName(to(own.where("p_partkey % 4 = 0"), 5, 2)), 10).select("hops", F.array_join("path", ">").alias("path"))
