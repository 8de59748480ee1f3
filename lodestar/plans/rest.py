"""Queries of readers, guards, communities' texts, buckets and propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import model
from lodestar.model import table
from lodestar.operators import code, community, traverse
from lodestar.operators.traverse import scratch
from lodestar.plans.deep import TR, shown, trade
from lodestar.plans.queries import E, N, SQL, query, two_levels
from lodestar.sources import connectors, files


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Readers


@query("""SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus || ';"' || o_orderpriority || '"' AS note FROM orders""")
def delimited_rows(spark, sf):
    """Orders written with semicolons and quotes, and read back with the delimiter that the file shows."""
    path = scratch(spark, "delimited")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.concat("o_orderstatus", F.lit(';"'), "o_orderpriority", F.lit('"')).alias("note"))
    rows.write.csv(path, sep=";", header=True, quote='"', escape='"')
    return files.read_delimited(spark, path)


@query("""SELECT event_id, event_type FROM events WHERE event_id % 2 = 0""")
def json_line_rows(spark, sf):
    path = f"{scratch(spark, 'json')}.jsonl"
    table(spark, sf, "events").where("event_id % 2 = 0").select(F.to_json(F.struct("event_id", "event_type")).alias("value")).write.text(path)
    return files.read_json(spark, path).select(F.from_json("value", "event_id long, event_type string").alias("e")).select("e.*")


# Guards and code


@query(f"""WITH {N} SELECT label, count(*) AS n FROM nodes WHERE label <> 'Order' GROUP BY label""")
def guarded_statement(spark, sf):
    """A reading statement over a tenant's view alone."""
    view = model.TenantView(model.nodes(spark, sf), model.edges(spark, sf), [model.TENANT])
    return connectors.guarded_sql(spark, "SELECT label, count(*) AS n FROM tenant_nodes WHERE label <> :other GROUP BY label", {"tenant_nodes": view.nodes}, args={"other": "Order"})


@query("""SELECT 'mod' || p_partkey AS qualified_name, CASE WHEN p_partkey % 3 = 0 THEN 'module' ELSE 'external' END AS target FROM part WHERE p_partkey % 7 = 2""")
def dependency_targets(spark, sf):
    """What one file imports, each a module of the repository or a package from outside, by the label of the target."""
    parts = table(spark, sf, "part")
    edges = parts.select(F.concat(F.lit("f"), (F.col("p_partkey") % 7).cast("string")).alias("src"), key("mod", "p_partkey").alias("dst"), F.lit("IMPORTS").alias("type"))
    symbols = parts.where("p_partkey % 3 < 2").select(key("mod", "p_partkey").alias("qualified_name"), F.when(F.col("p_partkey") % 3 == 0, "module").otherwise("function").alias("kind"))
    return code.file_dependencies(edges, symbols, "f2")


NAMED = "['handler_', 'list_view_', 'compute_', 'post_', 'x_'][p_partkey % 5 + 1] || replace(lower(p_brand), '#', '')"
DECORATED = "CASE WHEN p_size % 11 = 0 THEN ['@app.route(''/p'')'] WHEN p_size % 7 = 0 THEN ['@cached', '@router.get(''/p'')'] ELSE ['@cached'] END"


@query(f"""SELECT p_partkey, regexp_matches(n, '{code.TAINT_NAMES}') OR len(list_filter(d, lambda x: regexp_matches(x, '{code.TAINT_DECORATORS}'))) > 0 AS source
FROM (SELECT p_partkey, {NAMED} AS n, {DECORATED} AS d FROM part)""")
def taint_sources(spark, sf):
    """Functions, named by parts, that take what comes from outside."""
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("handler_", "list_view_", "compute_", "post_", "x_")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(prefix, F.regexp_replace(F.lower("p_brand"), "#", ""))
    some = lambda *x: F.array(*[F.lit(v) for v in x])
    decorators = F.when(F.col("p_size") % 11 == 0, some("@app.route('/p')")).when(F.col("p_size") % 7 == 0, some("@cached", "@router.get('/p')")).otherwise(some("@cached"))
    return table(spark, sf, "part").select("p_partkey", code.is_taint_source(name, decorators).alias("source"))


@query(f"""WITH RECURSIVE {TR}, u AS (SELECT src, dst FROM tr UNION SELECT dst, src FROM tr), p(s, v, hops, path) AS (SELECT s, s, 0, [s] FROM (VALUES ('n1'), ('n2'), ('n3')) t(s) UNION ALL SELECT s, u.dst, hops + 1, list_append(path, u.dst) FROM p JOIN u ON u.src = p.v WHERE hops < 2 AND NOT list_contains(path, u.dst))
SELECT s AS start, v AS finish, hops, array_to_string(path, '>') AS path FROM p WHERE s < v AND v IN ('n1', 'n2', 'n3') ORDER BY hops, p.path LIMIT 10""")
def pathways(spark, sf):
    """The ten shortest paths between any two of three nations."""
    return shown(traverse.pathways(trade(spark, sf), spark.createDataFrame([("n1",), ("n2",), ("n3",)], "id string"), 2))


# Communities


ML = """ml AS (SELECT 'customer:' || c_custkey AS member_id, c_name AS name, 'region:' || n_regionkey AS region, 'nation:' || c_nationkey AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@query(f"""WITH {ML}, c AS (SELECT nation AS community_id, count(*) AS entity_count, min(member_id) AS first, 'Buyers of ' || nation || CASE WHEN count(*) % 2 = 0 THEN ' even' ELSE ' odd' END AS summary FROM ml GROUP BY nation)
SELECT community_id, summary, entity_count, array_to_string(list_sort(list(DISTINCT member_id)), ',') AS members FROM (SELECT * FROM c WHERE contains(lower(summary), 'even') OR contains(lower(summary), 'nobody') ORDER BY entity_count DESC, community_id LIMIT 5) c JOIN ml ON nation = community_id GROUP BY ALL""")
def community_search(spark, sf):
    """The largest communities whose summary has a word of the query, with their members."""
    members = two_levels(spark, sf).where("level = 1")
    parity = F.when(F.count("*") % 2 == 0, " even").otherwise(" odd")
    texts = members.groupBy("community_id").agg(F.count("*").alias("entity_count"), F.concat(F.lit("Buyers of "), F.first("community_id"), parity).alias("summary"))
    return community.search(texts, members.select("community_id", "member_id"), "nobody Even")


@query(f"""WITH {ML}, n AS (SELECT nation, region, array_to_string(list_sort(list(name))[1:20], '; ') AS summary FROM ml GROUP BY nation, region)
SELECT nation AS community_id, 1 AS level, summary FROM n UNION ALL SELECT region, 0, array_to_string(list_sort(list(summary))[1:20], '; ') FROM n GROUP BY region""")
def community_summary_rollup(spark, sf):
    """Summaries of nations from their customers, of regions from their nations."""
    members = two_levels(spark, sf)
    names = model.nodes(spark, sf, ["Customer"]).select("id", "name")
    return community.rollup_summaries(members, community.hierarchy(members), names).select("community_id", "level", "summary")


# Propagation and buckets


def _propagation_sql(rounds: int = 10) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, id AS community FROM nodes)"]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT id, arg_min(community, (-w, community)) AS community FROM (SELECT id, community, sum(w) AS w FROM (
  SELECT b.src AS id, r.community, b.w FROM b JOIN r{i - 1} r ON r.id = b.dst UNION ALL SELECT id, community, 0.5 FROM r{i - 1}) GROUP BY id, community) GROUP BY id)""")
    return f"""WITH {N}, {E}, u AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), b AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS w FROM u GROUP BY src, dst), {", ".join(steps)}
SELECT id, community FROM r{rounds}"""


SQL["label_propagation"] = _propagation_sql()

#: Events of a user one after the other: tokens that are left and whether the event was let through.
SQL["rate_limit_decisions"] = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
b(event_id, user_id, i, t, had) AS (SELECT event_id, user_id, i, t, 2.0::DOUBLE FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.user_id, e.i, e.t, CASE WHEN e.t - b.t > 3600 THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, (CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END) + greatest(0.0::DOUBLE, e.t - b.t) * 0.001) END FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)
SELECT event_id, user_id, had >= 1 AS allowed FROM b"""

#: Nodes of two graphs: equal names, else the ten nearest of the same bucket, scored by vector, name and type.
SQL["same_as_job"] = """WITH o AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, 'vector ' || (vec_id % 97) AS name FROM embeddings), l AS (SELECT * FROM o WHERE id % 2 = 0), r AS (SELECT * FROM o WHERE id % 2 = 1),
x AS (SELECT l.id AS a, r.id AS b FROM l JOIN r USING (name)),
n AS (SELECT l.id AS a, r.id AS b, (1 + list_cosine_similarity(l.v, r.v)) / 2 AS v, jaro_winkler_similarity(l.name, r.name) AS name FROM l JOIN r USING (label) WHERE l.id NOT IN (SELECT a FROM x)),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY v DESC, b) AS k FROM n)
SELECT a, b, 0.99::DOUBLE AS confidence, 'exact' AS path FROM x UNION ALL SELECT a, b, round((0.4 * v + 0.3 * name + 0.2) / 0.9, 6), 'vector' FROM k WHERE k <= 10 AND (0.4 * v + 0.3 * name + 0.2) / 0.9 >= 0.75"""
