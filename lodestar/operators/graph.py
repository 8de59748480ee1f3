"""Expansion, degrees, statistics and profiles of a graph. Every operator is DataFrame -> DataFrame and lazy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.joins import common_neighbours


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, with what else it carries."""
    back = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(back)


def both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst and how many edges join them, within the tenant."""
    return both_ends(edges, nodes).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def expand(edges: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with their target's columns, named dst_..."""
    target = nodes.select(*[F.col(c).alias("dst" if c == "id" else f"dst_{c}") for c in nodes.columns if c != "graph_id"])
    return edges.join(target, "dst", how)


def degrees(edges: DataFrame) -> DataFrame:
    """id and its number of edges, either way. Each edge counts once for each end, so no doubled edge table is made."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def degree_centrality(edges: DataFrame, nodes: DataFrame, label: str | None, n: int) -> DataFrame:
    own = nodes.where(F.col("label") == label) if label else nodes
    return degrees(edges).join(own.select("id", "name", "label"), "id").orderBy(F.desc("degree"), "id").limit(n)


def high_degree(edges: DataFrame, nodes: DataFrame, more_than: int = 3, n: int = 10) -> DataFrame:
    return degrees(edges).where(F.col("degree") > more_than).join(nodes.select("id", "name"), "id").orderBy(F.desc("degree"), "id").limit(n)


def neighbourhood(edges: DataFrame, nodes: DataFrame, anchors: DataFrame, rows: int = 30, second: int = 3) -> DataFrame:
    """Neighbours of the anchors (id), each with the names of its first few other neighbours."""
    both = undirected(edges.select("src", "dst", "type"))
    one = both.join(anchors.select(F.col("id").alias("src")), "src", "left_semi").distinct()
    names = nodes.select(F.col("id").alias("far"), F.col("name").alias("far_name"))
    two = one.select("src", "dst", "type").join(both.select(F.col("src").alias("dst"), F.col("dst").alias("far")).distinct(), "dst", "left").where(F.col("far").isNull() | (F.col("far") != F.col("src")))
    two = two.join(names, "far", "left").withColumn("k", F.row_number().over(W.partitionBy("src", "dst", "type").orderBy("far"))).where(F.col("k") <= second)
    held = two.groupBy("src", "dst", "type").agg(F.array_join(F.array_sort(F.collect_set("far_name")), ",").alias("second_hop"))
    return one.join(held, ["src", "dst", "type"], "left").withColumn("second_hop", F.coalesce("second_hop", F.lit(""))).orderBy("src", "dst", "type").limit(rows)


def multihop(edges: DataFrame, nodes: DataFrame, term: str, when: Column | None = None, rows: int = 20) -> DataFrame:
    """Two directed hops from the nodes whose name has the term, the second hop optional; when is a temporal filter on edges."""
    own = edges.where(when) if when is not None else edges
    names = nodes.select("id", "name")
    hop = lambda a, b, r: own.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("type").alias(r))
    named = lambda df, c, n: df.join(names.select(F.col("id").alias(c), F.col("name").alias(n)), c, "left")
    start = names.where(F.lower("name").contains(term.lower())).select(F.col("id").alias("anchor"), F.col("name").alias("anchor_name"))
    one = named(start.join(hop("anchor", "hop1", "rel1"), "anchor"), "hop1", "hop1_name").where("hop1_name is not null")
    two = named(one.join(hop("hop1", "hop2", "rel2"), "hop1", "left"), "hop2", "hop2_name")
    return two.select("anchor_name", "rel1", "hop1_name", "rel2", "hop2_name").orderBy("anchor_name", "rel1", "hop1_name", F.asc_nulls_first("rel2"), F.asc_nulls_first("hop2_name")).limit(rows)


def shared_neighbours(links: DataFrame, least: int = 2, n: int | None = 50) -> DataFrame:
    """Pairs a < b of members with at least so many hubs in common, the n with most. links: member, hub."""
    return common_neighbours(links, least, n)


def shared_hubs(links: DataFrame, least: int = 2, shown: int = 5) -> DataFrame:
    """Hubs with at least so many members, and the first few of them."""
    w = W.partitionBy("hub").orderBy("member")
    own = links.select("member", "hub").distinct()
    counts = own.groupBy("hub").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    first = own.withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown).groupBy("hub").agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("sample"))
    return counts.join(first, "hub")


def collapse_edges(edges: DataFrame, by: tuple[str, ...] = ("src", "dst", "type")) -> DataFrame:
    """Parallel edges as one with its weight."""
    return edges.groupBy(*by).agg(F.count("*").alias("weight"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, density and average degree. reference_relationship_count counts each edge from both ends."""
    n = nodes.agg(F.count("*").alias("node_count"), F.count_distinct("label").alias("label_count"))
    e = edges.agg(F.count("*").alias("edge_count"), F.count_distinct("type").alias("type_count"))
    both = n.join(e)  # two single rows
    pairs = F.col("node_count") * (F.col("node_count") - 1)
    return both.select(
        "node_count", "edge_count", "label_count", "type_count", (F.col("edge_count") * 2).alias("reference_relationship_count"),
        F.round(F.when(pairs > 0, F.col("edge_count") / pairs).otherwise(F.lit(0.0)), 12).alias("density"),
        F.round(F.when(F.col("node_count") > 0, 2 * F.col("edge_count") / F.col("node_count")).otherwise(F.lit(0.0)), 6).alias("average_degree"),
    )


def catalogue(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How often each label and each edge type occurs."""
    a = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("label"))
    b = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("type"))
    return a.unionByName(b).select("kind", "name", "n")


def schema_profile(nodes: DataFrame) -> DataFrame:
    """label, property, type of its values and frequency. nodes has label and props (map of strings)."""
    from lodestar.functions.columns import type_name

    rows = nodes.select("label", F.explode(F.map_entries("props")).alias("e")).select("label", F.col("e.key").alias("property"), type_name(F.col("e.value")).alias("value_type"))
    return rows.groupBy("label", "property", "value_type").agg(F.count("*").alias("frequency"))


def coverage(nodes: DataFrame, column: str) -> DataFrame:
    """Percentage of rows that have a value in the column, by label."""
    return nodes.groupBy("label").agg(F.round(100 * F.count(column) / F.count("*"), 6).alias("coverage"))


def visual_payload(nodes: DataFrame, edges: DataFrame, members: DataFrame | None = None, label: str | None = None, community: str | None = None, least_degree: int = 0, limit: int = 200) -> DataFrame:
    """Nodes to draw: degree, lowest-level community, total and truncated, most connected first. members: member_id, community_id, level."""
    own = nodes.where(F.col("label") == label) if label else nodes
    held = own.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    if members is not None:
        lowest = members.groupBy(F.col("member_id").alias("id")).agg(F.min_by("community_id", F.struct("level", "community_id")).alias("community_id"))
        held = held.join(lowest, "id", "left")
        if community is not None:
            held = held.join(members.where(F.col("community_id") == community).select(F.col("member_id").alias("id")), "id", "left_semi")
    else:
        held = held.withColumn("community_id", F.lit(None).cast("string"))
    held = held.where(F.col("degree") >= least_degree)
    total = held.agg(F.count("*").alias("total"))
    top = held.orderBy(F.desc("degree"), "id").limit(limit)
    return top.join(F.broadcast(total)).select("id", "name", "label", "degree", "community_id", "total", (F.col("total") > limit).alias("truncated"))  # total is one row


def induced_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    return both_ends(edges, chosen)


def report(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, members: DataFrame) -> DataFrame:
    """Figures of a combined analysis of the anchors (id): part and value. members: member_id, community_id."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    value = lambda df, name, of: df.agg(of.cast("double").alias("value")).select(F.lit(name).alias("part"), "value")
    near = both.join(anchors.select(F.col("id").alias("src")), "src", "left_semi")
    at = anchors.select("id").unionByName(near.select(F.col("dst").alias("id"))).distinct()
    degrees = both.groupBy("src").agg(F.count("*").alias("degree"))
    parts = [value(near, "neighbours", F.count_distinct("dst")), value(degrees, "influential", F.max("degree")), value(members.join(at.select(F.col("id").alias("member_id")), "member_id", "left_semi"), "communities", F.count_distinct("community_id")), value(edges, "edges", F.count("*"))]
    return reduce(DataFrame.unionByName, parts)
