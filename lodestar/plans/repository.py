"""Queries of source text, code graphs, records as JSON, search modes, lineage and communities of several kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.model import table
from lodestar.operators import access, codegraph, community, ingest, registry, retrieval, sinks
from lodestar.plans.more import TOPV, search_inputs
from lodestar.plans.queries import NOW, at, query, query_vector, two_levels, vectors
from lodestar.sources import codehost, files


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Source text

#: A file for each part: Go, TypeScript or Java by its key k; it declares T<k>, a method, and a function help<k>.
GO = """package g
import "pkg%1$d"
// func ghost() { {
type T%2$d struct {
\tT%3$d
}
func (t *T%2$d) Run() int { return help%4$d("}") }
func help%2$d() {}"""
TS = """import { x } from 'pkg%1$d';
/* class Ghost {
*/
export class T%2$d extends T%3$d {
  run(): number { return help%4$d(`}`); }
}
export function help%2$d() {}"""
JAVA = """import pkg%1$d;
import g.f3;
class T%2$d extends T%3$d {
  // }
  int run() { return help%4$d("{"); }
  static void help%2$d() {}
}"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda form: F.format_string(form, k % 7, k, k % 5, k % 4)
    pick = lambda *of: F.when(k % 3 == 0, of[0]).when(k % 3 == 1, of[1]).otherwise(of[2])
    path = F.concat(pick(F.lit("g/f"), F.lit("t/f"), F.lit("j/f")), k.cast("string"), pick(F.lit(".go"), F.lit(".ts"), F.lit(".java")))
    return table(spark, sf, "part").select(path.alias("path"), pick(F.lit("go"), F.lit("typescript"), F.lit("java")).alias("language"), pick(text(GO), text(TS), text(JAVA)).alias("content")).withColumn("content_hash", F.sha2("content", 256))


K = """k AS (SELECT p_partkey AS k, p_partkey % 3 AS l, ['g', 't', 'j'][p_partkey % 3 + 1] AS d, ['go', 'typescript', 'java'][p_partkey % 3 + 1] AS language, ['.go', '.ts', '.java'][p_partkey % 3 + 1] AS ext FROM part),
f AS (SELECT *, d || '/f' || k || ext AS path, d || '.f' || k AS module, d || '.f' || k || '.T' || k AS cls FROM k),
s AS (SELECT k, path, language, module AS qualified_name, 'module' AS kind, 1 AS line, [8, 7, 7][l + 1] AS end_line, NULL AS parent, CASE WHEN l = 2 THEN 'IMPORTS g.f3,' ELSE '' END || 'IMPORTS pkg' || (k % 7) AS edges FROM f
  UNION ALL SELECT k, path, language, cls, 'class', [4, 4, 3][l + 1], [6, 6, 7][l + 1], module, 'INHERITS T' || (k % 5) FROM f
  UNION ALL SELECT k, path, language, cls || CASE WHEN l = 0 THEN '.Run' ELSE '.run' END, 'function', [7, 5, 5][l + 1], [7, 5, 5][l + 1], cls, 'CALLS help' || (k % 4) FROM f
  UNION ALL SELECT k, path, language, CASE WHEN l = 2 THEN cls ELSE module END || '.help' || k, 'function', [8, 7, 6][l + 1], [8, 7, 6][l + 1], CASE WHEN l = 2 THEN cls ELSE module END, '' FROM f)"""


@query(f"""WITH {K} SELECT path, language, qualified_name, kind, line, end_line, parent, edges FROM s""")
def code_symbols_extracted(spark, sf):
    """Modules, classes, methods and functions of files in three languages, with comments and strings that look like code."""
    held = F.array_join(F.transform("edges", lambda e: F.concat_ws(" ", e["type"], e["dst"])), ",")
    return files.extract_symbols(sources(spark, sf)).withColumn("edges", held).drop("decorators")


def repository(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = sources(spark, sf)
    packages = table(spark, sf, "region").select(key("pkg", "r_regionkey").alias("name"), F.lit("1").alias("version"))
    return codegraph.graph(own, files.extract_symbols(own), packages)


@query(f"""WITH {K} SELECT 'file:' || path AS id, 'File' AS label, language, NULL AS line, NULL AS version FROM f
UNION ALL SELECT 'module:' || module, 'CodeModule', language, NULL, NULL FROM f
UNION ALL SELECT DISTINCT 'package:pkg' || p, 'Dependency', NULL, NULL, CASE WHEN p < 5 THEN '1' ELSE '' END FROM (SELECT k % 7 AS p FROM k UNION SELECT r_regionkey FROM region)
UNION ALL SELECT kind || ':' || qualified_name, CASE kind WHEN 'class' THEN 'Class' ELSE 'Function' END, language, line::VARCHAR, NULL FROM s WHERE kind <> 'module'""")
def code_graph_nodes(spark, sf):
    p = F.col("props")
    return repository(spark, sf)[0].select("id", "label", p["language"].alias("language"), p["line"].alias("line"), p["version"].alias("version"))


@query(f"""WITH {K}, m AS (SELECT 'help' || k AS name, qualified_name AS target FROM s WHERE kind = 'function' AND contains(qualified_name, '.help')), c AS (SELECT 'T' || k AS name, cls AS target FROM f)
SELECT kind || ':' || qualified_name AS src, 'DEFINED_IN' AS type, 'file:' || path AS dst FROM s WHERE kind <> 'module'
UNION ALL SELECT 'function:' || s.qualified_name, 'METHOD_OF', 'class:' || s.parent FROM s JOIN f ON f.cls = s.parent WHERE s.kind = 'function'
UNION ALL SELECT 'file:' || path, 'IMPORTS', 'package:pkg' || (k % 7) FROM f UNION ALL SELECT 'file:' || path, 'IMPORTS', 'module:g.f3' FROM f WHERE l = 2
UNION ALL SELECT 'class:' || cls, 'INHERITS', 'class:' || target FROM f JOIN c ON c.name = 'T' || (k % 5)
UNION ALL SELECT 'function:' || qualified_name, 'CALLS', 'function:' || target FROM s JOIN m ON 'CALLS ' || m.name = s.edges""")
def code_graph_edges(spark, sf):
    return repository(spark, sf)[1].select("src", "type", "dst")


@query("""WITH n AS (SELECT p_partkey AS k, 'function:p' || p_partkey AS id, 'f' || p_size AS path, CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '1998-12-01' END AS was FROM part),
m AS (SELECT id, CASE WHEN path IN ('f1', 'f2', 'f3', 'f4', 'f5') THEN CASE WHEN k % 2 = 0 THEN NULL ELSE coalesce(was, TIMESTAMP '1999-01-01') END ELSE was END AS stale_at FROM n)
SELECT id, stale_at IS NOT NULL AS stale FROM m WHERE stale_at IS NULL OR stale_at >= TIMESTAMP '1998-12-25'""")
def code_lifetime(spark, sf):
    """Symbols after a parse of five files that half of their symbols have left, without those that are stale for over a week."""
    rows = table(spark, sf, "part").select("p_partkey", key("function:p", "p_partkey").alias("id"), F.lit("Function").alias("label"), key("f", "p_size").alias("path"))
    stored = rows.select("id", "label", F.create_map(F.lit("path"), F.col("path")).alias("props"), F.when(F.col("p_partkey") % 4 == 0, at("1998-12-01")).alias("stale_at"))
    visited = table(spark, sf, "region").select(F.concat(F.lit("f"), (F.col("r_regionkey") + 1).cast("string")).alias("path"))
    parsed = rows.join(visited, "path", "left_semi").where("p_partkey % 2 = 0").select("id", "label", F.create_map(F.lit("path"), F.col("path")).alias("props"))
    edges = rows.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    live = codegraph.expired(codegraph.merged(stored, parsed, visited, at(NOW)), edges, at(NOW), 7)[0]
    return live.select("id", F.col("stale_at").isNotNull().alias("stale"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS id, round((1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2, 6) AS score FROM embeddings, q WHERE label % 2 = 1 ORDER BY (1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2 DESC, id LIMIT 10""")
def code_semantic_search(spark, sf):
    """Functions nearest to a question; classes have vectors too, but take no part."""
    symbols = vectors(spark, sf).select("id", "embedding", F.when(F.col("label") % 2 == 1, "Function").otherwise("Class").alias("label"))
    return codegraph.semantic_search(symbols, query_vector(spark, sf)).select("id", F.round("score", 6).alias("score"))


# Records as JSON


def customer_records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as JSON texts, four of six kinds with a fault."""
    k = F.col("c_custkey")
    full = F.format_string('{"id": %d, "seg": "%s", "nation": %d, "tags": [%d, "a", "", null], "none": null, "in": {"n": %d}}', k, F.col("c_mktsegment"), F.col("c_nationkey"), F.col("c_nationkey"), F.col("c_nationkey"))
    short = F.format_string('{"id": "c%d", "nation": %d}', k, F.col("c_nationkey"))
    value = F.when(k % 6 == 0, full).when(k % 6 == 1, short).when(k % 6 == 2, '{"id": 1.5}').when(k % 6 == 3, F.format_string("[%d]", k)).when(k % 6 == 4, "{oops").otherwise('{"id": null}')
    return ingest.records(table(spark, sf, "customer").select(value.alias("value")), "Customer", [ingest.Link("nation", "Nation", "LIVES_IN"), ingest.Link("tags", "Tag", "TAGGED")])


CR = """r AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN c_custkey::VARCHAR ELSE 'c' || c_custkey END AS id, c_custkey % 6 AS m, c_mktsegment AS seg, c_nationkey AS n FROM customer WHERE c_custkey % 6 < 2)"""


@query(f"""WITH {CR} SELECT id, 'Customer' AS label, CASE WHEN m = 0 THEN seg END AS seg, n::VARCHAR AS nation, CASE WHEN m = 0 THEN '[' || n || ',"a","",null]' END AS tags, CASE WHEN m = 0 THEN '{{"n":' || n || '}}' END AS inner_value, CASE WHEN m = 0 THEN 4 ELSE 1 END AS n_props, false AS stub FROM r
UNION ALL SELECT DISTINCT n::VARCHAR, 'Nation', NULL, NULL, NULL, NULL, 0, true FROM r UNION ALL SELECT DISTINCT n::VARCHAR, 'Tag', NULL, NULL, NULL, NULL, 0, true FROM r WHERE m = 0 UNION ALL SELECT 'a', 'Tag', NULL, NULL, NULL, NULL, 0, true WHERE EXISTS (SELECT 1 FROM r WHERE m = 0)""")
def ingest_json_nodes(spark, sf):
    p = F.col("props")
    return customer_records(spark, sf)[0].select("id", "label", p["seg"].alias("seg"), p["nation"].alias("nation"), p["tags"].alias("tags"), p["in"].alias("inner_value"), F.size("props").alias("n_props"), "stub")


@query(f"""WITH {CR} SELECT id AS src, 'LIVES_IN' AS type, n::VARCHAR AS dst, 1::BIGINT AS count FROM r UNION ALL SELECT id, 'TAGGED', unnest([n::VARCHAR, 'a']), 1 FROM r WHERE m = 0""")
def ingest_json_edges(spark, sf):
    return customer_records(spark, sf)[1].select("src", "type", "dst", "count")


@query("""SELECT ['missing_or_invalid_id', 'not_a_dict', 'not_json', 'missing_or_invalid_id'][c_custkey % 6 - 1] AS reason, count(*) AS n FROM customer WHERE c_custkey % 6 > 1 GROUP BY reason""")
def ingest_json_faults(spark, sf):
    return customer_records(spark, sf)[2]


# Search modes


FIVE = f"""WITH {TOPV}, five AS (SELECT * FROM (SELECT id::VARCHAR AS id, label, s FROM t) ORDER BY s DESC, id LIMIT 5)"""


@query(f"""WITH {TOPV} SELECT 'source' AS kind, id::VARCHAR AS key, round(s, 6) AS score FROM t""")
def search_fast(spark, sf):
    return retrieval.search("fast", *search_inputs(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""{FIVE} SELECT 'source' AS kind, id::VARCHAR AS key, round(s, 6) AS score FROM t UNION ALL SELECT 'relation', id || ' HAS label' || label, round(s, 6) FROM five""")
def search_balanced(spark, sf):
    """An unknown mode is balanced."""
    return retrieval.search("unknown", *search_inputs(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""WITH {TOPV} SELECT 'source' AS kind, id::VARCHAR AS key, round(s, 6) AS score FROM t""")
def search_legacy(spark, sf):
    """Text search alone; comprehensive falls back to it, since no vector is found."""
    vector, _, edges, members = search_inputs(spark, sf)
    return retrieval.search("comprehensive", vector.limit(0), vector, edges, members).withColumn("score", F.round("score", 6))


ASKS = "CASE conv_id % 3 WHEN 0 THEN 'Compare ' || text WHEN 1 THEN 'What is ' || text ELSE text END"
HAS = lambda words: "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(q, w))) > 0"


@query(f"""WITH a AS (SELECT conv_id, turn, lower({ASKS}) AS q, 0.5 + turn * 3 AS most, (conv_id % 10) / 10.0 AS load, ['depth', 'speed', NULL][turn % 3 + 1] AS pref FROM conversations WHERE role = 'user'),
b AS (SELECT *, {HAS(retrieval.COMPLEX)} AS deep, {HAS(retrieval.SIMPLE)} AS plain FROM a)
SELECT conv_id, turn, CASE WHEN most < 1 THEN 'fast' WHEN plain AND NOT deep AND load < 0.5 THEN 'balanced' WHEN deep AND most > 5 THEN 'comprehensive' WHEN pref = 'depth' THEN 'comprehensive' WHEN pref = 'speed' THEN 'fast' ELSE 'balanced' END AS mode,
  round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.2 * (turn % 2 = 0)::INT + 0.2 * (conv_id % 2 = 0)::INT + 0.1 * (conv_id % 3 = 0)::INT + 0.1 * ((turn % 2 = 0)::INT + (conv_id % 2 = 0)::INT + (conv_id % 3 = 0)::INT + (conv_id % 5 = 0)::INT > 2)::INT), 6) AS confidence FROM b""")
def search_mode_advice(spark, sf):
    """The mode advised for each user's turn, and the confidence of an answer from the parts of context that it has."""
    c, t = F.col("conv_id"), F.col("turn")
    preference = F.when(t % 3 == 0, "depth").when(t % 3 == 1, "speed")
    mode = retrieval.recommend_mode(F.expr(ASKS), 0.5 + t * 3, (c % 10) / 10.0, preference)
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", mode.alias("mode"), retrieval.context_confidence(t % 2 == 0, c % 2 == 0, c % 3 == 0, c % 5 == 0).alias("confidence"))


# Lineage and communities


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS ch, l_partkey AS p FROM lineitem)
SELECT 'p' || p AS id, o_custkey AS doc_id, count(*) AS n_chunks, min('c' || ch) AS first_chunk FROM c JOIN orders ON o_orderkey = ch JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3 GROUP BY p, o_custkey""")
def entity_lineage(spark, sf):
    """Parts as entities, orders as chunks that mention them, customers as documents, those of one nation being gone."""
    mentions = table(spark, sf, "lineitem").select(key("c", "l_orderkey").alias("chunk_id"), key("p", "l_partkey").alias("id"))
    chunks = table(spark, sf, "orders").select(key("c", "o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"))
    return retrieval.lineage(mentions, chunks, table(spark, sf, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("doc_id")))


@query("""SELECT 'nation:' || c_nationkey AS community_id, 'Buyers of ' || c_nationkey AS summary, count(*) AS entity_count FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY c_nationkey ORDER BY entity_count DESC, community_id LIMIT 5""")
def community_top_summaries(spark, sf):
    sizes = two_levels(spark, sf).groupBy("community_id", "level").agg(F.count("*").alias("entity_count"))
    number = F.substring_index("community_id", ":", -1)
    summary = F.when((F.col("level") == 0) | (number.cast("int") % 4 != 0), F.concat(F.lit("Buyers of "), number)).otherwise(F.lit(""))
    return community.top_summaries(sizes.withColumn("summary", summary), 1)


@query("""WITH e AS (SELECT DISTINCT 'nation:' || c_nationkey AS community_id, 'customer:' || c_custkey AS member_id FROM customer), c AS (SELECT 'nation:' || (doc_id % 30) AS community_id, 'chunk:' || doc_id AS member_id FROM documents)
SELECT community_id, 'entity' AS kind, member_id FROM e UNION ALL SELECT community_id, 'chunk', member_id FROM c WHERE community_id NOT IN (SELECT community_id FROM e)""")
def community_members_any_kind(spark, sf):
    """Members of thirty communities, of entities where there are such, else of chunks."""
    entities = two_levels(spark, sf).where("level = 1")
    docs = table(spark, sf, "documents").where("doc_id is not null").select(F.concat(F.lit("nation:"), (F.col("doc_id") % 30).cast("string")).alias("community_id"), key("chunk:", "doc_id").alias("member_id"))
    ids = docs.select("community_id").unionByName(entities.select("community_id"))
    return community.members_of_any_kind([("entity", entities), ("chunk", docs)], ids)


# Connectors


def host_items(spark: SparkSession, sf: str) -> DataFrame:
    """Events as issues, pull requests and commits of a repository each kind of event."""
    e = F.col("event_id")
    user = F.col("user_id").cast("string")
    issue = F.struct(e.alias("number"), F.concat(F.lit("T"), user).alias("title"), F.repeat(F.lit("b"), (e % 600).cast("int")).alias("body"), F.lit("open").alias("state"),
                     F.when(e % 7 > 0, F.struct(user.alias("login"))).alias("user"), F.array(F.struct(F.lit("x").alias("name")), F.struct(F.lit("y").alias("name"))).alias("labels"),
                     F.when(e % 3 == 1, F.struct(F.lit("u").alias("url"))).alias("pull_request"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"))
    commit = F.struct(F.sha1(e.cast("string")).alias("sha"), F.struct(F.repeat(F.lit("m"), (e % 400).cast("int")).alias("message"), F.struct(user.alias("name")).alias("author")).alias("commit"))
    kind = F.when(e % 3 == 2, "commit").otherwise("issue")
    return table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("repo"), kind.alias("kind"), F.when(e % 3 == 2, F.to_json(commit)).otherwise(F.to_json(issue)).alias("item"))


HI = """h AS (SELECT event_id, ts, event_type AS repo, CASE event_id % 3 WHEN 2 THEN 'commit' WHEN 1 THEN 'pull_request' ELSE 'issue' END AS kind,
CASE WHEN event_id % 3 = 2 THEN 'Commit ' || left(sha1(event_id::VARCHAR), 8) || ' in ' || event_type || ' by ' || user_id || ':' || chr(10) || left(repeat('m', (event_id % 400)::INT), 300) || chr(10)
ELSE CASE WHEN event_id % 3 = 1 THEN 'Pull Request #' ELSE 'Issue #' END || event_id || ' in ' || event_type || ': T' || user_id || chr(10) || 'Author: ' || CASE WHEN event_id % 7 > 0 THEN user_id::VARCHAR ELSE 'unknown' END || ' | State: open | Labels: x, y' || chr(10) || left(repeat('b', (event_id % 600)::INT), 500) || chr(10) END AS text,
CASE WHEN event_id % 3 < 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS updated_at FROM events)"""


@query(f"""WITH {HI} SELECT event_id, kind, md5(text) AS text_md5, updated_at FROM h""")
def host_item_texts(spark, sf):
    return codehost.texts(host_items(spark, sf)).select("event_id", "kind", F.md5("text").alias("text_md5"), "updated_at")


@query(f"""WITH {HI}, b AS (SELECT *, (row_number() OVER (PARTITION BY repo ORDER BY ts, event_id) - 1) // 20 AS batch FROM h)
SELECT repo, batch, count(*) AS n, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY ts, event_id)) AS text_md5 FROM b GROUP BY repo, batch""")
def host_item_batches(spark, sf):
    made = codehost.batches(codehost.texts(host_items(spark, sf)), "repo", "ts", "event_id")
    return made.select("repo", "batch", "n", F.md5("text").alias("text_md5"))


@query(f"""WITH {HI}, n AS (SELECT repo, max(updated_at) AS u FROM h GROUP BY repo), o AS (SELECT DISTINCT event_type AS repo, CASE WHEN length(event_type) % 2 = 0 THEN '2999-01-01T00:00:00Z' ELSE '1990-01-01T00:00:00Z' END AS c FROM events UNION ALL SELECT r_name, '1990-01-01T00:00:00Z' FROM region)
SELECT repo, greatest(u, c) AS cursor FROM o FULL JOIN n USING (repo)""")
def host_cursors(spark, sf):
    """The cursor of each repository after a run; one that gave nothing keeps its own."""
    lit = lambda y: F.lit(f"{y}-01-01T00:00:00Z")
    old = table(spark, sf, "events").select(F.col("event_type").alias("repo")).distinct().withColumn("cursor", F.when(F.length("repo") % 2 == 0, lit(2999)).otherwise(lit(1990)))
    old = old.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("repo"), lit(1990).alias("cursor")))
    return codehost.cursors(codehost.texts(host_items(spark, sf)), "repo", old)


def connectors_table(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").where(c % 2 == 0).select(key("c", "c_custkey").alias("connector_id"), key("g", "c_nationkey").alias("graph_id"), F.lit(100).cast("bigint").alias("sample_row_limit"), F.when(c % 10 == 0, "deleted").otherwise("active").alias("status"), at("1998-01-01").alias("updated_at"))


@query("""SELECT 'c' || c_custkey AS connector_id, 'g' || c_nationkey AS graph_id, CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE least(c_custkey * 10, 1000) END AS sample_row_limit, CASE WHEN c_custkey % 2 = 0 THEN 1998 ELSE 1999 END AS updated
FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND c_custkey % 10 <> 0 AND c_custkey % 7 <> 0""")
def connector_registry(spark, sf):
    """What is listed after connectors were registered, some of them again, and others removed."""
    c, stored = F.col("c_custkey"), connectors_table(spark, sf)
    customers = table(spark, sf, "customer")
    incoming = customers.where(c % 3 == 0).select(key("c", "c_custkey").alias("connector_id"), key("g", "c_nationkey").alias("graph_id"), (c * 10).alias("sample_row_limit"))
    made = registry.remove(registry.register(stored, incoming, at(NOW)), customers.where(c % 7 == 0).select(key("c", "c_custkey").alias("connector_id")), at(NOW))
    return registry.listed(made).select("connector_id", "graph_id", "sample_row_limit", F.year("updated_at").alias("updated"))


@query("""WITH r AS (SELECT o_custkey, max((o_orderdate, o_orderstatus, o_orderkey)) AS m FROM orders GROUP BY o_custkey)
SELECT 'c' || c_custkey AS connector_id, m[2] AS last_sync_status, m[3] AS last_sync_row_count, CASE WHEN m[2] = 'F' THEN 'failed' END AS last_sync_error FROM customer LEFT JOIN r ON o_custkey = c_custkey WHERE c_custkey % 2 = 0""")
def connector_sync_status(spark, sf):
    """Orders as results of syncs: the last one of each connector counts."""
    results = table(spark, sf, "orders").select(key("c", "o_custkey").alias("connector_id"), F.col("o_orderdate").alias("occurred_at"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("row_count"), F.when(F.col("o_orderstatus") == "F", "failed").alias("error"))
    return registry.synced(connectors_table(spark, sf), results).select("connector_id", "last_sync_status", "last_sync_row_count", "last_sync_error")


@query("""SELECT connector_id, error_id FROM (SELECT 'n' || c_nationkey AS connector_id, o_orderkey AS error_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F') WHERE k <= 10""")
def connector_errors_kept(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderstatus = 'F'").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return registry.kept_errors(rows.select(key("n", "c_nationkey").alias("connector_id"), F.col("o_orderkey").alias("error_id"), F.col("o_orderdate").alias("occurred_at"))).select("connector_id", "error_id")


# Members, agents, summaries, migrations


@query("""WITH m AS (SELECT o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 10000000 ELSE 0 END AS user_id FROM orders)
SELECT 'member' AS side, count(*) AS n FROM m WHERE user_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'user', count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM m)""")
def members_left_out(spark, sf):
    """Orders as memberships, a fifth of them of users that the users' table hasn't."""
    members = table(spark, sf, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 10000000).otherwise(0)).alias("user_id"), F.col("o_orderkey").alias("graph_id"))
    return access.matched_members(members, table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"))[1]


@query("""SELECT 'a' || s_suppkey AS agent_id, 'n' || s_nationkey AS home_graph, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45) AS n_granted
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2""")
def organisation_agents(spark, sf):
    agents = table(spark, sf, "supplier").select(key("a", "s_suppkey").alias("agent_id"), key("n", "s_nationkey").alias("home_graph"))
    graphs = table(spark, sf, "nation").select(key("n", "n_nationkey").alias("graph_id"), key("o", "n_regionkey").alias("org_id"))
    grants = table(spark, sf, "lineitem").where("l_quantity > 45").select(key("a", "l_suppkey").alias("agent_id"), F.col("l_partkey").alias("graph_id"))
    return access.organisation_agents(agents, graphs, grants, "o2")


@query("""SELECT 'p' || l_partkey AS community_id, count(DISTINCT l_suppkey) AS n_members, CASE WHEN count(DISTINCT l_suppkey) < 2 THEN 'singleton' WHEN l_partkey % 3 = 0 THEN 'existing' ELSE 'missing' END AS work
FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey""")
def community_summary_work(spark, sf):
    """Parts as communities of their suppliers: which summaries are there, which have to be made and which needn't."""
    members = table(spark, sf, "lineitem").where("l_quantity > 40").select(key("p", "l_partkey").alias("community_id"), F.col("l_suppkey").alias("member_id"))
    stored = table(spark, sf, "part").select(key("p", "p_partkey").alias("community_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(" ").alias("summary"))
    return community.summary_work(members, stored)


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'orphaned' WHEN o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 THEN 'transferred' ELSE 'pending' END AS outcome, count(*) AS n FROM orders GROUP BY outcome""")
def migration_outcomes(spark, sf):
    o = F.col("o_orderkey")
    none = F.lit(None).cast("map<string,string>")
    rows = table(spark, sf, "orders").select(key("e", "o_orderkey").alias("edge_id"), "o_orderkey")
    edges = rows.where(o % 7 != 0).select("edge_id", F.when(o % 2 == 1, 1.0).alias("weight"), none.alias("props"))
    old = rows.select("edge_id", F.when((o % 3 != 0), 2.0).alias("weight"), none.alias("props"))
    return sinks.clean_migrated(edges, old)[1]
