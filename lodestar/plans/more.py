"""Queries of operators that the other modules don't register: access, records, memory, code, writes, versions, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import model
from lodestar.functions import columns as C
from lodestar.model import table
from lodestar.operators import access, code, graph, mapping, memory, resolve, retrieval, sinks, temporal
from lodestar.operators.vectors import build, probe
from lodestar.plans.queries import CATALOG, CE, E, NOW, OV, SQL, T1, T2, at, code_edges, query, query_vector, star_catalog, vectors, versioned_orders
from lodestar.sources import connectors, files
from lodestar.streaming import feeds


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Writes


@query("""SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'IN_REGION' AS type,
  CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10.0 ELSE 1.0 END AS weight, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS by, 'kept' AS note FROM nation
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || ((n_regionkey + 1) % 5), 'NEAR', 2.0, 'new', NULL FROM nation WHERE n_nationkey % 3 = 0""")
def upsert_edge_properties(spark, sf):
    text = lambda *x: F.create_map(*[F.lit(v) for v in x])
    stored = model.edges(spark, sf, ["IN_REGION"]).withColumns({"weight": F.lit(1.0), "props": text("by", "old", "note", "kept")})
    n = table(spark, sf, "nation")
    graph_id, src = F.lit(model.TENANT).alias("graph_id"), model.key("Nation", "n_nationkey").alias("src")
    again = n.where("n_nationkey % 2 = 0").select(graph_id, src, model.key("Region", "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("type"), (F.col("n_nationkey") * 10.0).alias("weight"), text("by", "new").alias("props"))
    near = n.where("n_nationkey % 3 = 0").select(graph_id, src, F.concat(F.lit("region:"), ((F.col("n_regionkey") + 1) % 5).cast("string")).alias("dst"), F.lit("NEAR").alias("type"), F.lit(2.0).alias("weight"), text("by", "new").alias("props"))
    out = sinks.upsert_edges(stored, again.unionByName(near), model.nodes(spark, sf, ["Nation", "Region"]))
    return out.select("src", "dst", "type", "weight", F.col("props")["by"].alias("by"), F.col("props")["note"].alias("note"))


@query("""SELECT 'missing_id' AS reason, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 HAVING count(*) > 0""")
def ingest_skips(spark, sf):
    rows = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 3 == 1, F.col("c_custkey").cast("string")).when(F.col("c_custkey") % 3 == 2, key("c", "c_custkey")).otherwise(F.when(F.col("c_custkey") % 2 == 0, " ")).alias("key"), "c_name")
    return sinks.ingest_records(rows, "key", "Customer", {})[2]


@query("""SELECT 'order:' || o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '1998-01-01' ELSE TIMESTAMP '1999-01-01' END = TIMESTAMP '1998-01-01' AS was_stale, o_orderpriority = '1-URGENT' OR o_orderstatus = 'O' AS stale FROM orders""")
def soft_delete_rows(spark, sf):
    rows = table(spark, sf, "orders").select(model.key("Order", "o_orderkey").alias("id"), "o_orderpriority", F.when(F.col("o_orderstatus") == "O", at("1998-01-01")).alias("stale_at"))
    out = sinks.soft_delete(rows, F.col("o_orderpriority") == "1-URGENT", "stale_at", at(NOW))
    return out.select("id", F.coalesce(F.col("stale_at") == at("1998-01-01"), F.lit(False)).alias("was_stale"), F.col("stale_at").isNotNull().alias("stale"))


@query("""WITH m AS (SELECT 'c' || l_orderkey AS chunk_id, 'p' || l_partkey AS id FROM lineitem),
live AS (SELECT 'c' || o_orderkey AS chunk_id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01')
SELECT 'p' || p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = 'p' || p_partkey) OR EXISTS (SELECT 1 FROM m JOIN live USING (chunk_id) WHERE m.id = 'p' || p_partkey)""")
def expire_chunks(spark, sf):
    chunks = table(spark, sf, "orders").select(key("c", "o_orderkey").alias("chunk_id"), F.col("o_orderdate").alias("stale_at"))
    mentions = table(spark, sf, "lineitem").select(key("c", "l_orderkey").alias("chunk_id"), key("p", "l_partkey").alias("id"))
    entities = table(spark, sf, "part").select(key("p", "p_partkey").alias("id"))
    return sinks.expire_chunks(chunks, mentions, entities, at("1997-07-01"), 30)[1]


@query("""SELECT 'e' || o_orderkey AS edge_id, CASE WHEN o_orderkey % 2 = 1 THEN 1.0 ELSE (o_orderkey % 50)::DOUBLE END AS weight FROM orders""")
def migrate_edge_properties(spark, sf):
    items = table(spark, sf, "orders").select(key("e", "o_orderkey").alias("edge_id"), "o_orderkey", (F.col("o_orderkey") % 50).cast("double").alias("q"))
    none = F.lit(None).cast("map<string,string>")
    edges = items.select("edge_id", F.when(F.col("o_orderkey") % 2 == 1, 1.0).alias("weight"), none.alias("props"))
    return sinks.migrate_edge_properties(edges, items.select("edge_id", F.col("q").alias("weight"), none.alias("props"))).select("edge_id", "weight")


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'legacy') AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'job' ELSE 'backfill-g' END AS job_id FROM documents""")
def provenance_backfill(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.lit("g").alias("graph_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("content_hash"), F.when(F.col("doc_id") % 3 == 0, "job").alias("job_id"))
    return sinks.provenance_backfill(rows).select("doc_id", "content_hash", "job_id")


@query("""SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'own' END, 'org' || n_regionkey) AS org_id FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def organisation_backfill(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"), F.when(F.col("c_custkey") % 4 == 0, "own").alias("org_id"))
    return sinks.organisation_backfill(rows, table(spark, sf, "nation").select(F.col("n_nationkey").alias("owner"), key("org", "n_regionkey").alias("default_org"))).select("id", "org_id")


@query("""SELECT 'm.p' || p_partkey AS qualified_name, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'changed' ELSE p_brand END AS content_hash,
  CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 1999 ELSE 1998 END AS updated FROM part WHERE NOT (p_size % 3 = 0 AND p_partkey % 5 = 0)""")
def code_graph_write(spark, sf):
    stored = table(spark, sf, "part").select(key("m.p", "p_partkey").alias("qualified_name"), F.lit("function").alias("kind"), key("f", "p_size").alias("path"), F.col("p_brand").alias("content_hash"), at("1998-01-01").alias("updated_at"), "p_size", "p_partkey")
    parsed = stored.where("p_size % 3 = 0 and p_partkey % 5 <> 0").withColumn("content_hash", F.when(F.col("p_partkey") % 2 == 0, "changed").otherwise(F.col("content_hash")))
    empty = stored.where("p_size % 3 = 0").select("path").distinct()  # files that were parsed, whether or not they still have symbols
    own = stored.drop("p_size", "p_partkey")
    out = sinks.write_code_graph(own.join(empty.join(parsed.select("path").distinct(), "path", "left_anti"), "path", "left_anti").select(*own.columns), parsed.drop("p_size", "p_partkey", "updated_at"), at(NOW))
    return out.select("qualified_name", "content_hash", F.year("updated_at").alias("updated"))


@query("""SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size % 2 = 0""")
def stale_code_cleanup(spark, sf):
    nodes = table(spark, sf, "part").select(key("p", "p_partkey").alias("qualified_name"), F.concat(F.lit("f"), (F.col("p_size") % 2).cast("string")).alias("path"))
    nodes = nodes.unionByName(table(spark, sf, "supplier").select(key("s", "s_suppkey").alias("qualified_name"), F.lit("f0").alias("path")))
    edges = table(spark, sf, "lineitem").select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst"))
    return sinks.without_stale_code(nodes, edges, spark.createDataFrame([("f0",)], "path string"))[1].select("src", "dst")


@query("""SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS sha256 FROM documents""")
def result_blobs(spark, sf):
    packed = sinks.packed_results(table(spark, sf, "documents"), "doc_id", "text")
    content = sinks.unpacked_results(packed, "doc_id").where("error is null").select("doc_id", F.sha2("content", 256).alias("sha256"))
    return packed.select("doc_id", "n_bytes").join(content, "doc_id")


# Access and records

ROLES = """g AS (SELECT 'u' || (c_custkey % 50) AS user_id, 'g' || c_nationkey AS graph_id, ['viewer', 'editor', 'owner'][c_custkey % 3 + 1] AS role, 's' || (c_custkey % 7) AS subgraph_id,
  c_custkey % 5 <> 0 AS is_active, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1998-01-01' END AS expires_at FROM customer),
live AS (SELECT * FROM g WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '1999-01-01'))"""


def grants(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as grants of roles in the graphs of their nations."""
    role = F.element_at(F.array(*[F.lit(x) for x in ("viewer", "editor", "owner")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("u"), (F.col("c_custkey") % 50).cast("string")).alias("user_id"), key("g", "c_nationkey").alias("graph_id"), role.alias("role"), F.concat(F.lit("s"), (F.col("c_custkey") % 7).cast("string")).alias("subgraph_id"),
        (F.col("c_custkey") % 5 != 0).alias("is_active"), F.when(F.col("c_custkey") % 4 == 0, at("1998-01-01")).alias("expires_at"),
    )


@query(f"""WITH {ROLES} SELECT graph_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, array_to_string(list_sort(list(DISTINCT subgraph_id)), ',') AS subgraphs FROM live WHERE user_id = 'u7' GROUP BY graph_id""")
def access_filter(spark, sf):
    return access.access_filter(grants(spark, sf), "u7", at(NOW)).select("graph_id", F.array_join("roles", ",").alias("roles"), F.array_join("subgraphs", ",").alias("subgraphs"))


@query(f"""WITH {ROLES} SELECT graph_id, user_id, role FROM live""")
def active_members(spark, sf):
    return access.members(grants(spark, sf), at(NOW))


@query(f"""WITH {ROLES} SELECT user_id, graph_id, role, bool_or(is_active AND user_id <> 'u3') AS active FROM (SELECT user_id, graph_id, role, is_active FROM g UNION ALL SELECT 'u3', 'g1', 'auditor', true) GROUP BY ALL""")
def grant_and_revoke(spark, sf):
    own = grants(spark, sf)
    new = spark.createDataFrame([("u3", "g1", "auditor", None, True, None)], own.schema)
    left = access.revoke(access.grant(own, new), access.grant(own, new).where("user_id = 'u3'"))
    return left.groupBy("user_id", "graph_id", "role").agg(F.bool_or("is_active").alias("active"))


@query(f"""WITH {ROLES} SELECT 'g' || n_nationkey AS graph_id FROM nation WHERE n_regionkey <> 4 AND (n_nationkey % 10 = 7 OR 'g' || n_nationkey IN (SELECT graph_id FROM live WHERE user_id = 'u7'))""")
def user_graphs(spark, sf):
    n = table(spark, sf, "nation")
    graphs = n.select(key("g", "n_nationkey").alias("graph_id"), F.concat(F.lit("u"), (F.col("n_nationkey") % 10).cast("string")).alias("owner"), F.when(F.col("n_regionkey") == 4, "deactivated").alias("status"), F.lit(1).alias("created_at"))
    return access.user_graphs(graphs, grants(spark, sf), "u7", at(NOW)).select("graph_id")


@query(f"""WITH {ROLES}, a AS (SELECT s_suppkey AS agent_id, 'g' || s_nationkey AS home_graph FROM supplier)
SELECT DISTINCT agent_id FROM a WHERE home_graph IN (SELECT graph_id FROM live WHERE user_id = 'u9') OR agent_id % 11 = 0""")
def visible_agents(spark, sf):
    agents = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("agent_id"), key("g", "s_nationkey").alias("home_graph"))
    mine = access.access_filter(grants(spark, sf), "u9", at(NOW)).select("graph_id")
    return access.visible_agents(agents, mine, agents.where("agent_id % 11 = 0").select("agent_id")).select("agent_id")


@query(f"""WITH {ROLES} SELECT 'g' || n_nationkey AS graph_id FROM nation WHERE n_nationkey < 12 AND 'g' || n_nationkey IN (SELECT graph_id FROM live WHERE user_id = 'u1')""")
def granted_among(spark, sf):
    asked = table(spark, sf, "nation").where("n_nationkey < 12").select(key("g", "n_nationkey").alias("graph_id"))
    return access.granted_among(asked, grants(spark, sf).where("user_id = 'u1'"), at(NOW))


@query("""SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#13' AND p_size % 2 = 0 AND lower(p_name) LIKE '%blue%'""")
def capability_match(spark, sf):
    tools = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("capabilities"), F.array(F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")).alias("tags"))
    return access.match_capabilities(tools.withColumn("description", F.lit("")), ["Brand#13"], ["even"], "BLUE").select("id")


@query("""SELECT DISTINCT 'g' || n AS graph_id FROM (SELECT n_nationkey AS n FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey + 5 FROM nation WHERE n_nationkey < 5 AND (n_nationkey + 5) % 3 >= n_nationkey % 2 + 1)""")
def linked_graphs(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey < 5")
    links = n.select(key("g", "n_nationkey").alias("a"), F.concat(F.lit("g"), (F.col("n_nationkey") + 5).cast("string")).alias("b"), F.when(F.col("n_nationkey") % 2 == 1, "owner").otherwise("editor").alias("min_role"))
    rank = F.element_at(F.array(*[F.lit(x) for x in ("viewer", "editor", "owner")]), (F.substring("b", 2, 9).cast("int") % 3 + 1).cast("int"))
    return resolve.linked_graphs(n.select(key("g", "n_nationkey").alias("graph_id")), links, links.select(F.col("b").alias("graph_id"), rank.alias("role")), {"owner": 0, "editor": 1, "viewer": 2})


@query("""SELECT s_suppkey AS account_id, coalesce(len(list(DISTINCT c_nationkey) FILTER (c_custkey % 5 <> 0)), 0)::BIGINT AS graphs FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey WHERE s_suppkey % 3 <> 0 GROUP BY s_suppkey""")
def service_accounts(spark, sf):
    accounts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("account_id"), (F.col("s_suppkey") % 3 != 0).alias("is_active"), "s_nationkey")
    # Customers of one nation stand for one graph: a grant for each account and nation, not for each pair of an account and a customer
    granted = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max(F.coalesce(F.col("c_custkey") % 5 != 0, F.lit(False))).alias("granted"))
    held = accounts.join(granted, F.col("c_nationkey") == F.col("s_nationkey")).select("account_id", key("g", "c_nationkey").alias("graph_id"), F.col("granted").alias("is_active"), F.lit(None).cast("timestamp").alias("expires_at"))
    return access.service_accounts(accounts.drop("s_nationkey"), held, at(NOW)).select("account_id", F.size("graphs").cast("long").alias("graphs"))


@query("""SELECT 'w' || c_custkey AS workflow_id, count(o_orderkey) AS instances, count(*) FILTER (o_orderstatus = 'O') AS running FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def workflow_instances(spark, sf):
    runs = table(spark, sf, "orders").select(key("w", "o_custkey").alias("workflow_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), F.col("o_orderdate").alias("started_at"))
    return access.workflow_instances(runs, table(spark, sf, "customer").select(key("w", "c_custkey").alias("workflow_id"), F.col("c_name").alias("name"))).select("workflow_id", "instances", "running")


@query("""SELECT o_orderkey AS id, replace(translate(base64(encode('{"o":' || (o_orderkey % 1000) || ',"id":"order:' || o_orderkey || '"}')), '+/', '-_'), '=', '') AS cursor, (o_orderkey % 1000)::BIGINT AS "offset", 'order:' || o_orderkey AS last_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 50 ELSE least(100, greatest(1, o_orderkey % 300 - 20)) END::INT AS "limit" FROM orders""")
def cursor_codec(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), access.cursor(F.col("o_orderkey") % 1000, model.key("Order", "o_orderkey")).alias("cursor"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 300 - 20).cast("int").alias("asked"))
    held = rows.withColumn("parts", access.cursor_parts(F.col("cursor")))
    return held.select("id", "cursor", F.col("parts.o").alias("offset"), F.col("parts.id").alias("last_id"), access.clamped(F.col("asked"), 50, 100).alias("limit"))


@query("""SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS grouping_id FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_counts(spark, sf):
    return access.cube_counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), ["status", "priority"])


KEYED = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey")]


@query(f"""WITH {CATALOG}, pk AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c FROM {t} HAVING count(*) = count(DISTINCT {c})" for t, c in KEYED)}),
col AS (SELECT DISTINCT table_name AS t, column_name AS c FROM duckdb_columns() WHERE schema_name = 'main' AND table_name IN ({", ".join(f"'{t}'" for t, _ in KEYED)}))
SELECT t AS "table", c AS "column", (t, c) IN (SELECT (t, c) FROM pk) AS is_pk, (t, c) IN (SELECT (t, c) FROM fk) AS is_fk FROM col""")
def catalog_join(spark, sf):
    """Columns of the tables, joined to the keys and references that their values show."""
    found = star_catalog(spark, sf)
    keys, foreign = found.where("is_pk").select("table", "column"), found.where("is_fk").select("table", "column", "fk_table", F.lit(None).cast("string").alias("fk_column"))
    return connectors.catalog_from(found.select("table", "column", "data_type"), keys, foreign).select("table", "column", "is_pk", "is_fk")


@query("""SELECT 't' || o_custkey AS "table", 'f' || (o_orderkey % 3) AS fk_table, array_to_string(list_sort(list('c' || o_orderkey)), ',') AS columns FROM orders GROUP BY ALL""")
def composite_keys(spark, sf):
    rows = table(spark, sf, "orders").select(key("t", "o_custkey").alias("table"), key("c", "o_orderkey").alias("column"), F.lit(True).alias("is_fk"), F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("fk_table"))
    return mapping.composite_keys(rows)


# Time and versions


@query(f"""WITH {OV} SELECT id FROM o WHERE (t IS NULL OR t > TIMESTAMP '{NOW}') AND f <= TIMESTAMP '{T2}' AND f >= TIMESTAMP '{T1}'""")
def temporal_filter_compiled(spark, sf):
    keep = temporal.compile_filter(current_only=True, at=at(T2), since=at(T1), now=at(NOW))
    return versioned_orders(spark, sf).where(keep).select("id")


@query(f"""WITH {OV} SELECT id, CASE WHEN id LIKE '%7' THEN TIMESTAMP '{T1}' ELSE f END = TIMESTAMP '{T1}' AS moved, CASE WHEN id LIKE '%7' AND id NOT LIKE '%77' THEN TIMESTAMP '{T2}' ELSE t END IS NULL AS open FROM o""")
def temporal_bounds(spark, sf):
    rows = versioned_orders(spark, sf)
    new = rows.where("id like '%7'").select("id", at(T1).alias("new_from"), F.when(~F.col("id").like("%77"), at(T2)).alias("new_to"))
    return temporal.set_bounds(rows, "id", new).select("id", (F.col("valid_from") == at(T1)).alias("moved"), F.col("valid_to").isNull().alias("open"))


@query(f"""SELECT o_orderkey AS id, epoch_us(CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN TIMESTAMP '{T1}' ELSE TIMESTAMP '{NOW}' END) AS t, epoch_us(CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN TIMESTAMP '{T1}' ELSE TIMESTAMP '{NOW}' END) AS i FROM orders""")
def bitemporal_backfill(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("transaction_time"), F.when(F.col("o_orderkey") % 3 == 1, at(T1)).alias("ingestion_time"))
    return temporal.backfill(rows, at(NOW)).select("id", F.unix_micros("transaction_time").alias("t"), F.unix_micros("ingestion_time").alias("i"))


VERSIONS = """v AS (SELECT 'g' || o_custkey AS graph_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS version_number FROM orders)"""


@query(f"""WITH {VERSIONS}, w AS (SELECT * FROM v WHERE NOT (graph_id = 'g7' AND version_number = 2)), p AS (SELECT * FROM w WHERE graph_id = 'g7' ORDER BY version_number DESC LIMIT 3)
SELECT 'page' AS what, version_number FROM p UNION ALL SELECT 'got', version_number FROM w WHERE graph_id = 'g7' AND version_number = 1 UNION ALL SELECT 'gone', version_number FROM w WHERE graph_id = 'g7' AND version_number = 2""")
def version_records(spark, sf):
    from pyspark.sql import Window as W

    orders = table(spark, sf, "orders").withColumn("version_number", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    left = temporal.without_version(orders.select(key("g", "o_custkey").alias("graph_id"), "version_number"), "g7", 2)
    rows = [(temporal.version_page(left, "g7", 0, 3), "page"), (temporal.version_of(left, "g7", 1), "got"), (temporal.version_of(left, "g7", 2), "gone")]
    parts = [df.select(F.lit(name).alias("what"), "version_number") for df, name in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Memory

MEM = """m AS (SELECT o_orderkey AS memory_id, o_orderpriority AS subject, o_orderstatus AS object, o_orderkey % 4 AS access_count FROM orders)"""


def memories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("memory_id"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("object"), (F.col("o_orderkey") % 4).cast("int").alias("access_count"), F.lit(0.5).alias("base_importance"), F.lit("semantic").alias("memory_type"), at(NOW).alias("last_accessed_at"), F.lit(None).cast("timestamp").alias("valid_to"))


@query(f"""WITH {MEM} SELECT memory_id, (access_count + (memory_id % 2 = 0)::INT)::INT AS access_count, round(least(1.0, 0.5 + least(0.3, 0.05 * ln(1 + access_count + (memory_id % 2 = 0)::INT))), 6) AS importance FROM m""")
def memory_access_bump(spark, sf):
    own = memories(spark, sf)
    return memory.bump_access(own, own.where("memory_id % 2 = 0").select("memory_id"), at(NOW)).select("memory_id", F.col("access_count").cast("int").alias("access_count"), F.round("importance_score", 6).alias("importance"))


@query(f"""WITH {MEM}, e AS (SELECT DISTINCT lower(o_orderpriority) AS term FROM orders UNION SELECT 'f') SELECT DISTINCT memory_id, 'e:' || term AS id FROM m JOIN e ON term IN (lower(subject), lower(object))""")
def memory_entity_links(spark, sf):
    names = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name")).distinct().unionByName(spark.createDataFrame([("F",)], "name string"))
    return memory.link_entities(memories(spark, sf), names.select(F.concat(F.lit("e:"), F.lower("name")).alias("id"), "name"))


@query(f"""WITH {MEM} SELECT memory_id, memory_id IN (2, 4) AS ended FROM m WHERE memory_id <> 1""")
def memory_remove(spark, sf):
    kept = memory.remove(memories(spark, sf), ["1"], at(NOW), hard=True)
    return memory.remove(kept, ["2", "4"], at(NOW)).select("memory_id", F.col("valid_to").isNotNull().alias("ended"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderkey % 5 = 0 THEN 0.4 WHEN o_orderstatus = 'P' THEN 0.3 WHEN o_orderkey % 100 / 100.0 >= 0.9 THEN 0.8 ELSE round(o_orderkey % 100 / 100.0 * 0.9, 6) END::DOUBLE AS importance FROM orders""")
def memory_base_importance(spark, sf):
    source = F.when(F.col("o_orderstatus") == "F", "user_feedback").when(F.col("o_orderstatus") == "P", "inference").otherwise("chat")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "episodic").otherwise("semantic")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(C.base_importance(source, kind, F.col("o_orderkey") % 100 / 100.0), 6).alias("importance"))


# Code


@query(f"""WITH {CE} SELECT DISTINCT dst AS qualified_name, CASE WHEN dst LIKE '%1' THEN 'module' ELSE 'external' END AS target FROM ce WHERE src = 'm.s3'""")
def code_file_dependencies(spark, sf):
    edges = code_edges(spark, sf).withColumn("type", F.lit("IMPORTS"))
    symbols = edges.select(F.col("dst").alias("qualified_name")).distinct().where("qualified_name like '%1'").withColumn("kind", F.lit("module"))
    return code.file_dependencies(edges, symbols, "m.s3")


FL = """f AS (SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey * 2 + 1) AS dst FROM nation UNION SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 3) FROM nation)"""


def flows(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    to = lambda c: n.select(key("n", "n_nationkey").alias("src"), F.concat(F.lit("n"), c.cast("string")).alias("dst"))
    return to(F.col("n_nationkey") * 2 + 1).unionByName(to(F.col("n_nationkey") + 3)).withColumn("type", F.lit("FLOWS_TO"))


@query(f"""WITH RECURSIVE {FL}, p AS (SELECT dst, ['n1', dst] AS path, 1 AS hops FROM f WHERE src = 'n1' UNION ALL SELECT f.dst, list_append(path, f.dst), hops + 1 FROM p JOIN f ON f.src = p.dst WHERE hops < 50 AND NOT list_contains(path, f.dst))
SELECT array_to_string(path, '>') AS path, hops FROM p""")
def code_data_flow(spark, sf):
    return code.data_flow(flows(spark, sf), "n1", "forward", 50).select(F.array_join("path", ">").alias("path"), "hops")


@query(f"""WITH RECURSIVE {FL}, p AS (SELECT DISTINCT dst AS id, 1 AS d FROM f WHERE src IN ('n2', 'n5') UNION SELECT f.dst, d + 1 FROM p JOIN f ON f.src = p.id WHERE d < 5)
SELECT DISTINCT id FROM p WHERE id NOT IN ('n2', 'n5') OR id = 'n5'""")
def code_taint_reach(spark, sf):
    names = spark.createDataFrame([("n2", "list_view", []), ("n5", "plain", ["@app.route('/x')"]), ("n9", "plain", [])], "id string, name string, decorators array<string>")
    sources = names.where(code.is_taint_source(F.col("name"), F.col("decorators"))).select("id")
    return code.taint_trace(flows(spark, sf), sources, 5).select("id").distinct()


@query("""WITH s AS (SELECT 'pkg' || (p_partkey % 9) || '.f' || (p_partkey % 40) AS q FROM part), c AS (SELECT DISTINCT 's' || s_suppkey AS caller, CASE WHEN s_suppkey % 2 = 0 THEN 'f' || (s_suppkey % 50) ELSE 'pkg1.f' || (s_suppkey % 50) END AS callee FROM supplier)
SELECT caller, callee, min(q) AS qualified_name FROM c JOIN s ON q = callee OR q LIKE '%.' || callee GROUP BY ALL""")
def code_resolve_calls(spark, sf):
    symbols = table(spark, sf, "part").select(F.concat(F.lit("pkg"), (F.col("p_partkey") % 9).cast("string"), F.lit(".f"), (F.col("p_partkey") % 40).cast("string")).alias("qualified_name")).distinct()
    part = (F.col("s_suppkey") % 50).cast("string")
    calls = table(spark, sf, "supplier").select(key("s", "s_suppkey").alias("caller"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("f"), part)).otherwise(F.concat(F.lit("pkg1.f"), part)).alias("callee")).distinct()
    return code.resolve_calls(calls, symbols)


# Resolution and retrieval


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus <> b.o_orderstatus WHERE (a.o_orderkey + b.o_orderkey) % 2 = 1""")
def same_name_pairs(spark, sf):
    mentions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), key(" N", "o_custkey").alias("name"), F.col("o_orderstatus").alias("chunk_id"))
    linked = resolve.same_name_pairs(mentions).where("(a + b) % 2 = 0")
    return resolve.same_name_pairs(mentions, linked)


@query("""SELECT l_orderkey || '-' || l_linenumber AS edge_id FROM lineitem WHERE l_suppkey % 5 = 1 AND l_linenumber % 2 = 0""")
def orphaned_edges(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), key("o", "l_orderkey").alias("src_fp"), key("L", "l_linenumber").alias("type"), key("p", "l_partkey").alias("dst_fp"), key("c", "l_suppkey").alias("source_chunk_id"), "l_suppkey", "l_linenumber")
    return resolve.orphaned_edges(rows, rows.where("l_linenumber % 2 = 1"), rows.where("l_suppkey % 5 = 1").select("source_chunk_id").distinct()).select("edge_id")


@query("""SELECT lower(p_brand) AS key, count(*) AS mentions, min('e' || p_brand) AS id FROM part GROUP BY 1""")
def unify_chunk_entities(spark, sf):
    rows = table(spark, sf, "part").select(F.concat(F.lit("chunk"), F.col("p_partkey").cast("string"), F.lit(":e"), "p_brand").alias("id"), F.concat(F.lit(" "), F.upper("p_brand")).alias("name"), F.lit("Brand").alias("label"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("props"))
    one = resolve.unify_chunk_entities(rows).select(F.lower(F.trim("name")).alias("key"), "id")
    return one.join(rows.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.count("*").alias("mentions")), "key").select("key", "mentions", "id")


@query("""SELECT doc_id, substr(text, 1, 500) AS excerpt, 0.1235::DOUBLE AS score, sha256('g|' || lower(trim(source)) || '|answer') AS cache_key,
  CASE WHEN length(coalesce(lang, '')) > length(source) THEN lang ELSE source END AS description FROM documents""")
def citations(spark, sf):
    docs = table(spark, sf, "documents")
    c = retrieval.citation(F.col("text"), F.lit(0.12345678))
    return docs.select("doc_id", c["excerpt"].alias("excerpt"), c["score"].alias("score"), retrieval.cache_key(F.lit("g"), F.col("source"), F.lit("answer")).alias("cache_key"), resolve.longer_description(F.col("source"), F.col("lang")).alias("description"))


SA = """e AS (SELECT vec_id AS id, 'v' || (vec_id % 200) AS name, label, embedding::DOUBLE[] AS v, vec_id % 2 AS side FROM embeddings),
x AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.side = 0 AND b.side = 1 AND a.name = CASE WHEN b.id % 3 = 0 THEN 'v' || ((b.id + 1) % 200) ELSE b.name END)"""


@query(f"""WITH {SA} SELECT a, b, 0.99::DOUBLE AS confidence, 'exact' AS path FROM x""")
def same_as_exact(spark, sf):
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("bucket"))
    a = own.where("id % 2 = 0").withColumn("name", F.concat(F.lit("v"), (F.col("id") % 200).cast("string")))
    b = own.where("id % 2 = 1").withColumn("name", F.concat(F.lit("V"), F.when(F.col("id") % 3 == 0, (F.col("id") + 1) % 200).otherwise(F.col("id") % 200).cast("string"), F.lit(" ")))
    typed = lambda df: df.withColumn("type", F.lit("person"))
    return resolve.same_as_links(typed(a), typed(b)).where("path = 'exact'")


@query()
def same_as_job(spark, sf):
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("bucket"), F.lit("person").alias("type"))
    named = lambda n: own.where(f"id % 2 = {n}").withColumn("name", F.concat(F.lit("vector "), (F.col("id") % 97).cast("string")))
    return resolve.same_as_links(named(0), named(1), 0.75).withColumn("confidence", F.round("confidence", 6))


@query(SQL["vector_topk"])
def ann_probe(spark, sf):
    """The nearest vectors from the index's codes: the same as from all vectors, without reading them."""
    index = build(vectors(spark, sf))
    return probe(index, query_vector(spark, sf)).select("id", F.round("score", 6).alias("score"))


TOPV = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
t AS (SELECT vec_id AS id, label, (1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2 AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 20)"""


@query(f"""WITH {TOPV}, a AS (SELECT id, s FROM t ORDER BY s DESC, id LIMIT 2), b AS (SELECT id, s FROM t WHERE id % 2 = 0 ORDER BY s DESC, id LIMIT 3), c AS (SELECT id, s FROM t WHERE id % 2 = 1 ORDER BY s DESC, id LIMIT 2)
SELECT strategy, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM (SELECT 'vector' AS strategy, id, s, 0 AS k FROM a UNION ALL SELECT 'text', id, s, 1 FROM b UNION ALL SELECT 'graph', id, s, 2 FROM c)) WHERE r = 1""")
def capped_sources(spark, sf):
    top = retrieval.vector_topk(vectors(spark, sf), query_vector(spark, sf), n=20)
    found = retrieval.capped_sources([("vector", top, 2), ("text", top.where("id % 2 = 0"), 3), ("graph", top.where("id % 2 = 1"), 2)], "id")
    return found.select("strategy", "id", F.round("score", 6).alias("score"))


def search_inputs(spark: SparkSession, sf: str):
    top = retrieval.vector_topk(vectors(spark, sf), query_vector(spark, sf), n=20).withColumn("id", F.col("id").cast("string"))
    edges = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("src"), F.lit("HAS").alias("type"), key("label", "label").alias("dst"))
    members = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("member_id"), key("c", "label").alias("community_id"))
    return top, top.limit(0), edges, members


@query(f"""WITH {TOPV}, five AS (SELECT * FROM (SELECT id::VARCHAR AS id, label, s FROM t) ORDER BY s DESC, id LIMIT 5)
SELECT 'source' AS kind, id::VARCHAR AS key, round(s, 6) AS score FROM t UNION ALL SELECT 'relation', id || ' HAS label' || label, round(s, 6) FROM five UNION ALL SELECT 'community', 'c' || label, round(max(s), 6) FROM five GROUP BY label""")
def search_comprehensive(spark, sf):
    return retrieval.search("comprehensive", *search_inputs(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""WITH {TOPV}, five AS (SELECT * FROM (SELECT id::VARCHAR AS id, label, s FROM t) ORDER BY s DESC, id LIMIT 5), c AS (SELECT label, max(s) AS s FROM five GROUP BY label)
SELECT 'community' AS kind, 'c' || label AS key, round(s, 6) AS score FROM c UNION ALL SELECT 'relation', vec_id || ' HAS label' || label, round(s, 6) FROM embeddings JOIN c USING (label)""")
def search_drift(spark, sf):
    return retrieval.search("drift", *search_inputs(spark, sf)).withColumn("score", F.round("score", 6))


# Texts, events, communities


@query(r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^([A-F])', '# \1', 'g'), '(?m)^([G-M])', '## \1', 'g'), '(?m)^([N-S])', '### \1', 'g'), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls)))::INT AS "at", unnest(ls) AS line FROM d),
h AS (SELECT doc_id, "at", line, CASE WHEN regexp_matches(line, '^(#{1,6})\s+(.+?)\s*$') THEN length(regexp_extract(line, '^(#{1,6})\s', 1)) END AS level FROM l),
s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY "at") AS sec, max(CASE WHEN level = 1 THEN "at" END) OVER w AS a1, max(CASE WHEN level <= 2 THEN "at" END) OVER w AS a2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT doc_id, sec, trim(string_agg(line, chr(10) ORDER BY "at"), ' ' || chr(10) || chr(9) || chr(13)) AS content FROM s WHERE level IS NULL AND sec > 0 GROUP BY ALL)
SELECT s.doc_id, s."at", s.level::INT AS level, p."at" AS parent_at, length(coalesce(content, ''))::INT AS n_content, md5(coalesce(content, '')) AS content_md5
FROM s LEFT JOIN b USING (doc_id, sec) LEFT JOIN s p ON p.doc_id = s.doc_id AND p."at" = CASE s.level WHEN 2 THEN s.a1 WHEN 3 THEN s.a2 END WHERE s.level IS NOT NULL""")
def md_section_tree(spark, sf):
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "(?m)^([A-F])", "# $1"), "(?m)^([G-M])", "## $1"), "(?m)^([N-S])", "### $1")
    found = files.markdown_sections(table(spark, sf, "documents").select("doc_id", text.alias("text")))
    return found.select("doc_id", "at", "level", "parent_at", F.length("content").alias("n_content"), F.md5("content").alias("content_md5"))


@query("""SELECT doc_id, array_to_string(list_transform(range(0, greatest(1, (len(w) + 9) // 10)), lambda i: array_to_string(w[i * 10 + 1:i * 10 + 10], ' ')), '|') AS groups FROM (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' ') AS w FROM documents)""")
def answer_word_groups(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(retrieval.word_groups(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))), "|").alias("groups"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Issue: ' || c_name || chr(10) || c_mktsegment WHEN 1 THEN 'Push: ' || c_name WHEN 2 THEN 'Pull request: ' || c_name || chr(10) ELSE c_name END AS text FROM customer""")
def event_texts(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("issues", "push", "pull_request", "other")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    body = F.when(kind == "issues", F.to_json(F.struct(F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body")).alias("issue")))).when(kind == "push", F.to_json(F.struct(F.struct(F.col("c_name").alias("message")).alias("head_commit")))).when(kind == "pull_request", F.to_json(F.struct(F.struct(F.col("c_name").alias("title")).alias("pull_request")))).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), feeds.event_text(F.lit("github"), kind, body).alias("text"))


@query("""SELECT o_orderkey AS event_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 < 3 ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def retryable_events(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), (F.col("o_orderkey") % 5).alias("attempts"), F.col("o_orderdate").alias("received_at"))
    return feeds.retryable(rows).select("event_id")


@query("""SELECT 'nation:' || c_nationkey AS community_id, substr(sha256(array_to_string(list_sort(list('customer:' || c_custkey)), '|')), 1, 16) AS member_hash, count(*) AS members FROM customer GROUP BY c_nationkey""")
def community_keys(spark, sf):
    rows = table(spark, sf, "customer").groupBy(model.key("Nation", "c_nationkey").alias("community_id")).agg(F.collect_list(model.key("Customer", "c_custkey")).alias("ids"))
    return rows.select("community_id", C.member_id(F.col("ids")).alias("member_hash"), F.size("ids").cast("long").alias("members"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'Entity' ELSE o_orderstatus END AS label, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ((0.002 * (o_orderkey % 1000) + 0.006 * (o_orderkey % 77)) / 1000)::DECIMAL(10,6)::DOUBLE END AS cost FROM orders""")
def labels_and_costs(spark, sf):
    reserved = F.array(F.lit("__Entity__"), F.lit("__KGBuilder__"))
    labels = F.when(F.col("o_orderkey") % 6 == 0, reserved).otherwise(F.concat(reserved, F.array("o_orderstatus", "o_orderpriority")))
    money = lambda x: F.lit(x).cast("decimal(10,6)")
    price = C.cost(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 1000), F.col("o_orderkey") % 77, money(0.002), money(0.006))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), C.display_label(labels).alias("label"), price.cast("double").alias("cost"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'null' WHEN 1 THEN '"' || o_orderpriority || ' \\"x\\""' WHEN 2 THEN o_orderkey::VARCHAR WHEN 3 THEN 'true' WHEN 4 THEN '-1.5e3' ELSE '"01"' END AS json FROM orders""")
def json_safe_values(spark, sf):
    k = F.col("o_orderkey") % 6
    value = F.when(k == 0, F.when(F.col("o_orderkey") % 4 == 0, "NaN")).when(k == 1, F.concat("o_orderpriority", F.lit(' "x"'))).when(k == 2, F.col("o_orderkey").cast("string")).when(k == 3, " true").when(k == 4, "-1.5e3").otherwise("01")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), C.json_safe(value).alias("json"))


@query(f"""WITH {E}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
SELECT 'neighbours' AS part, count(*)::DOUBLE AS value FROM (SELECT DISTINCT dst FROM u WHERE src IN ('nation:1', 'nation:2'))
UNION ALL SELECT 'influential', max(degree)::DOUBLE FROM d UNION ALL SELECT 'communities', count(DISTINCT c_nationkey)::DOUBLE FROM customer WHERE c_nationkey IN (1, 2)
UNION ALL SELECT 'edges', count(*)::DOUBLE FROM edges""")
def analysis_report(spark, sf):
    edges, nodes = model.edges(spark, sf), model.nodes(spark, sf)
    anchors = spark.createDataFrame([("nation:1",), ("nation:2",)], "id string")
    members = table(spark, sf, "customer").select(model.key("Customer", "c_custkey").alias("member_id"), model.key("Nation", "c_nationkey").alias("community_id"))
    return graph.report(nodes, edges, anchors, members)
