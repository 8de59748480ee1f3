"""Roles, grants and the record operators around them: members, agents, accounts, connectors, exports, running totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.traverse import held, scratch


def active(now: Column) -> Column:
    return F.coalesce("is_active", F.lit(True)) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def effective_permissions(grants: DataFrame, role_permissions: DataFrame, role_parents: DataFrame, now: Column, hops: int = 5) -> DataFrame:
    """user_id, graph_id, permission from roles (user_id, graph_id, role) and what they inherit (role, parent) within so many hops."""
    front = grants.where(active(now)).select("user_id", "graph_id", "role").distinct()
    seen = front
    for _ in range(hops):
        front = front.join(role_parents.select("role", "parent"), "role").select("user_id", "graph_id", F.col("parent").alias("role")).distinct()
        seen = seen.unionByName(front)
    return seen.distinct().join(role_permissions.select("role", "permission"), "role").select("user_id", "graph_id", "permission").distinct()


def permitted(grants: DataFrame, role_permissions: DataFrame, role_parents: DataFrame, owners: DataFrame, now: Column, permission: str) -> DataFrame:
    """user_id, graph_id of whoever has the permission by role or owns the graph (user_id, graph_id)."""
    by_role = effective_permissions(grants, role_permissions, role_parents, now).where(F.col("permission") == permission).select("user_id", "graph_id")
    return by_role.unionByName(owners.select("user_id", "graph_id")).distinct()


def access_filter(grants: DataFrame, user: str, now: Column) -> DataFrame:
    """graph_id with the roles and subgraphs that a user holds there. grants: user_id, graph_id, role, subgraph_id, is_active, expires_at."""
    own = grants.where((F.col("user_id") == user) & active(now))
    return own.groupBy("graph_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("subgraph_id")).alias("subgraphs"))


def members(grants: DataFrame, now: Column) -> DataFrame:
    return grants.where(active(now)).select("graph_id", "user_id", "role").orderBy("graph_id", "role", "user_id")


def grant(grants: DataFrame, new: DataFrame) -> DataFrame:
    """grants with the new ones; of the same user, graph and role the new one stays."""
    keys = ["user_id", "graph_id", "role"]
    return grants.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*grants.columns))


def revoke(grants: DataFrame, gone: DataFrame) -> DataFrame:
    keys = ["user_id", "graph_id", "role"]
    hit = gone.select(*keys, F.lit(True).alias("_gone")).distinct()
    return grants.join(hit, keys, "left").withColumn("is_active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("is_active"))).drop("_gone")


def user_graphs(graphs: DataFrame, grants: DataFrame, user: str, now: Column) -> DataFrame:
    """Graphs that a user owns or has a role in, those that aren't deactivated, newest first."""
    own = grants.where((F.col("user_id") == user) & active(now)).select("graph_id").distinct().withColumn("granted", F.lit(True))
    live = graphs.where(F.coalesce("status", F.lit("active")) != "deactivated").join(own, "graph_id", "left")
    return live.where((F.col("owner") == user) | F.col("granted")).drop("granted").orderBy(F.desc("created_at"), "graph_id")


def same_organisation(pairs: DataFrame, graphs: DataFrame) -> DataFrame:
    """Pairs (a, b) of graphs of one organisation."""
    org = graphs.select("graph_id", "org_id")
    return pairs.join(org.withColumnsRenamed({"graph_id": "a", "org_id": "o1"}), "a").join(org.withColumnsRenamed({"graph_id": "b", "org_id": "o2"}), "b").where("o1 = o2").select("a", "b")


def with_nested(parents: DataFrame, children: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """parents with their children as a sorted array of structs, empty where there is none."""
    held = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))


def export_json(conversations: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """conv_id and one JSON document of its messages with their tool calls. messages: conv_id, turn, role, text; calls: conv_id, turn, tool."""
    inner = calls.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("tool")).alias("tools"))
    rows = messages.join(inner, ["conv_id", "turn"], "left").withColumn("tools", F.coalesce("tools", F.array().cast("array<string>")))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tools"))).alias("messages"))
    return conversations.join(held, "conv_id").select("conv_id", F.to_json(F.struct("conv_id", "messages")).alias("document"))


def visible_agents(agents: DataFrame, graph_access: DataFrame, agent_grants: DataFrame) -> DataFrame:
    """Agents (agent_id, home_graph) whose home graph is accessible (graph_id) or that are granted themselves (agent_id)."""
    home = agents.join(graph_access.select(F.col("graph_id").alias("home_graph")), "home_graph", "left_semi")
    return home.unionByName(agents.join(agent_grants.select("agent_id"), "agent_id", "left_semi").select(*home.columns)).distinct()


def granted_among(requested: DataFrame, grants: DataFrame, now: Column) -> DataFrame:
    return requested.join(grants.where(active(now)).select("graph_id"), "graph_id", "left_semi")


def first_configured(levels: list[DataFrame], key: str) -> DataFrame:
    """Of configurations (key, config) from the most specific level to the least, the first there is."""
    ranked = reduce(DataFrame.unionByName, [df.select(key, "config", F.lit(i).alias("level")) for i, df in enumerate(levels)])
    return ranked.groupBy(key).agg(F.min_by("config", "level").alias("config"), F.min("level").alias("level"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page in order, with the number of all rows as total."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # total is one row


def keyset_page(rows: DataFrame, key: str, before: Column | None, limit: int) -> DataFrame:
    """Rows below a key, highest first; one row more than the limit tells that there is a next page."""
    own = rows.where(F.col(key) < before) if before is not None else rows
    return own.orderBy(F.desc(key)).limit(limit + 1)


def execution_totals(runs: DataFrame) -> DataFrame:
    """instance_id, executions, credits as decimals."""
    return runs.groupBy("instance_id").agg(F.count("*").alias("executions"), F.sum(F.col("credits").cast("decimal(18,6)")).alias("credits"))


def presence(registry: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """key and where it is: both, memory_only or db_only."""
    a, b = registry.select(key, F.lit(True).alias("m")).distinct(), stored.select(key, F.lit(True).alias("d")).distinct()
    return a.join(b, key, "full").select(key, F.when(F.col("m") & F.col("d"), "both").when(F.col("m"), "memory_only").otherwise("db_only").alias("presence"))


def match_capabilities(tools: DataFrame, wanted: list[str], tags: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Tools that have every capability (array of structs with a name), every tag, and the text in their name or description."""
    found = tools
    for name in wanted:
        found = found.where(F.exists("capabilities", (lambda n: lambda c: c["name"] == n)(name)))
    for tag in tags or []:
        found = found.where(F.array_contains("tags", tag))
    if text:
        found = found.where(F.col("name").ilike(f"%{text}%") | F.col("description").ilike(f"%{text}%"))
    return found


def quantiles(rows: DataFrame, value: str, by: str, at: list[float], buckets: int = 1024, few: int = 1000) -> DataFrame:
    """by, q and value: the exact quantiles, between two neighbouring values in proportion, without sorting a group.

    Each quantile asks for the values at one or two ranks. Every pass counts, for each rank, the values of the range that is left in
    buckets of equal width, and goes on with the bucket that has the rank and the least and greatest value in it; it ends where
    these are equal, or where so few are left that they can be put in order. Counts are summed before the shuffle.
    """
    own = held(rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"))
    ends = own.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    each = ends.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in at]))).withColumn("place", F.col("q") * (F.col("n") - 1))
    ranks = each.select("g", "n", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")).distinct()
    todo, known = held(ranks.withColumn("below", F.lit(0).cast("long"))), scratch(rows.sparkSession, "ranks")
    done = None
    while not todo.isEmpty():
        sure = todo.where("lo = hi").select("g", "rank", F.col("lo").alias("v"))
        small = todo.where((F.col("lo") < F.col("hi")) & (F.col("n") <= few))
        inside = lambda t: t.alias("t").join(own.alias("o"), F.col("t.g").eqNullSafe(F.col("o.g")) & (F.col("o.v") >= F.col("t.lo")) & (F.col("o.v") <= F.col("t.hi"))).select("t.*", F.col("o.v").alias("v"))
        sorted_ = inside(small).groupBy("g", "rank", "below").agg(F.array_sort(F.collect_list("v")).alias("vs")).select("g", "rank", F.col("vs")[(F.col("rank") - F.col("below")).cast("int")].alias("v"))
        done = held(sure.unionByName(sorted_), known)
        rest = inside(todo.where((F.col("lo") < F.col("hi")) & (F.col("n") > few)))
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets))
        counts = rest.withColumn("bucket", bucket).groupBy("g", "rank", "below", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(W.partitionBy("g", "rank").orderBy("bucket"))  # at most buckets rows
        todo = held(counts.withColumn("upto", F.col("below") + upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select("g", "n", "lo", "hi", "rank", (F.col("upto") - F.col("n")).alias("below")))
    if done is None:
        return ends.select(F.col("g").alias(by), F.lit(0.0).alias("q"), F.col("lo").alias("value")).limit(0)
    value_at = lambda name: done.select(F.col("g").alias("h"), F.col("rank").alias("r"), F.col("v").alias(name))
    low = each.join(value_at("low"), F.col("g").eqNullSafe(F.col("h")) & (F.floor("place") == F.col("r"))).drop("h", "r")
    both = low.join(value_at("high"), F.col("g").eqNullSafe(F.col("h")) & (F.ceil("place") == F.col("r")))
    return both.select(F.col("g").alias(by), "q", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("value"))


def percentiles(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Exact mean, median, 95th and 99th percentile and standard deviation."""
    names = {0.5: "p50", 0.95: "p95", 0.99: "p99"}
    sums = rows.groupBy(F.col(by).alias("g")).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("stdev"))
    found = quantiles(rows, value, by, list(names)).groupBy(F.col(by).alias("h")).agg(*[F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 6).alias(n) for q, n in names.items()])
    return sums.join(found, F.col("g").eqNullSafe(F.col("h")), "left").select(F.col("g").alias(by), "n", "mean", *names.values(), "stdev")


def moving_average(rows: DataFrame, by: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """Exponential moving average at the end of each group: each value weighs alpha, what was before 1 - alpha; the first counts whole.

    As a sum over the ranks from the end, so no group is gathered in an array.
    """
    w = W.partitionBy(by)
    own = rows.withColumn("i", F.row_number().over(w.orderBy(order))).withColumn("n", F.count("*").over(w))
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(alpha)
    return own.groupBy(by).agg(F.sum(F.col(value) * weight).alias("ema"))


def cursor(offset: Column, last_id: Column) -> Column:
    """An opaque page cursor: the JSON of offset and last id in URL-safe base64 without padding."""
    raw = F.base64(F.to_json(F.struct(offset.cast("long").alias("o"), last_id.cast("string").alias("id"))).cast("binary"))
    return F.translate(F.regexp_replace(raw, "[=\\s]+", ""), "+/", "-_")


def cursor_parts(text: Column) -> Column:
    """Offset and last id of a cursor as a struct; null for one that is malformed, has no offset or a negative one; a null or empty one is the first page."""
    bare = F.translate(text, "-_", "+/")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    raw = F.try_to_binary(padded, F.lit("base64")).cast("string")
    found = F.from_json(raw, "o long, id string")
    first = F.struct(F.lit(0).cast("long").alias("o"), F.lit(None).cast("string").alias("id"))
    return F.when(text.isNull() | (text == ""), first).when((F.length(text) <= 4096) & (found["o"] >= 0), found)


def clamped(limit: Column, default: int, most: int) -> Column:
    """A page size within 1..most, default where it is null."""
    return F.when(limit.isNull(), default).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), limit)))


def cube_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by every set of the columns, with grouping_id telling which set a row belongs to."""
    return rows.cube(*columns).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("grouping_id"))


def service_accounts(accounts: DataFrame, grants: DataFrame, now: Column) -> DataFrame:
    """Service accounts (account_id, org_id, name) that aren't revoked, with the graphs that they are granted (account_id, graph_id)."""
    held = grants.where(active(now)).groupBy("account_id").agg(F.array_sort(F.collect_set("graph_id")).alias("graphs"))
    live = accounts.where(F.coalesce("is_active", F.lit(True)))
    return live.join(held, "account_id", "left").withColumn("graphs", F.coalesce("graphs", F.array().cast("array<string>")))


def workflow_instances(instances: DataFrame, workflows: DataFrame) -> DataFrame:
    """Each workflow (workflow_id, name) with how many instances it has by status, those without one too, latest first."""
    by = instances.groupBy("workflow_id").agg(F.count("*").alias("instances"), F.count_if(F.col("status") == "running").alias("running"), F.max("started_at").alias("last_started_at"))
    own = workflows.join(by, "workflow_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("instances", "running")})
    return own.orderBy(F.desc_nulls_last("last_started_at"), "workflow_id")


def matched_members(members: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of a graph store (user_id, graph_id, ...) with the columns of the users' table (user_id, ...), and what of either side was left out: side, n.

    A member without a user is skipped and counted as member; users without a graph are counted as user. Null ids match nothing.
    """
    own = users.dropDuplicates(["user_id"])
    found = members.join(own, "user_id")
    lost = members.join(own.select("user_id"), "user_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("member").alias("side"), "n")
    idle = own.join(members.select("user_id"), "user_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("user").alias("side"), "n")
    return found, lost.unionByName(idle)


def organisation_agents(agents: DataFrame, graphs: DataFrame, agent_grants: DataFrame, org: str) -> DataFrame:
    """Agents (agent_id, home_graph) whose home graph is an organisation's (graph_id, org_id), with how many graphs are granted to each (agent_id, graph_id)."""
    own = agents.join(graphs.where(F.col("org_id") == org).select(F.col("graph_id").alias("home_graph")), "home_graph", "left_semi")
    granted = agent_grants.groupBy("agent_id").agg(F.count_distinct("graph_id").alias("n_granted"))
    return own.join(granted, "agent_id", "left").select("agent_id", "home_graph", F.coalesce("n_granted", F.lit(0)).alias("n_granted"))
