"""Slices in time, versions, differences, rollback and timelines over bitemporal tables. A null bound is open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.joins import overlaps


def valid_at(t: Column, end_inclusive: bool = False) -> Column:
    end = F.col("valid_to") >= t if end_inclusive else F.col("valid_to") > t
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | end)


def known_at(t: Column) -> Column:
    return (F.col("transaction_time").isNull() | (F.col("transaction_time") <= t)) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > t))


def temporal_filter(mode: str, at: Column | None = None, since: Column | None = None) -> Column:
    """POINT_IN_TIME: true in the world at a time. KNOWLEDGE_AS_OF: known then. CHANGES_SINCE: came or went since."""
    if mode == "POINT_IN_TIME":
        event_end = F.col("event_time_end").isNull() | (F.col("event_time_end") >= at)
        return valid_at(at) & (F.col("event_time").isNull() | (F.col("event_time") <= at)) & event_end
    if mode == "KNOWLEDGE_AS_OF":
        return known_at(at)
    if mode == "CHANGES_SINCE":
        return (F.col("transaction_time") >= since) | (F.col("invalidated_at") >= since)
    raise ValueError(f"unknown temporal mode {mode!r}")


def compile_filter(current_only: bool = False, at: Column | None = None, since: Column | None = None, until: Column | None = None, now: Column | None = None) -> Column:
    parts = [F.lit(True)]
    if current_only:
        parts.append(F.col("valid_to").isNull() | (F.col("valid_to") > (now if now is not None else F.current_timestamp())))
    if at is not None:
        parts.append(valid_at(at))
    if since is not None:
        parts.append(F.col("valid_from") >= since)
    if until is not None:
        parts.append(F.col("valid_to").isNull() | (F.col("valid_to") <= until))
    return reduce(lambda a, b: a & b, parts)


def nodes_at(nodes: DataFrame, t: Column, limit: int = 1000) -> DataFrame:
    return nodes.where(valid_at(t)).orderBy("id").limit(limit)


def edges_at(edges: DataFrame, t: Column, limit: int = 2000) -> DataFrame:
    return edges.where(valid_at(t)).orderBy("src", "dst", "type").limit(limit)


def contradictions(facts: DataFrame) -> DataFrame:
    """Pairs of facts (edge_id) with the same ends and type whose intervals overlap."""
    return overlaps(facts, ["src", "dst", "type"])


def backfill(rows: DataFrame, now: Column) -> DataFrame:
    """Missing transaction and ingestion times from each other, else now."""
    return rows.withColumns({"transaction_time": F.coalesce("transaction_time", "ingestion_time", now), "ingestion_time": F.coalesce("ingestion_time", "transaction_time", now)})


def set_bounds(rows: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """rows with valid_from and valid_to from changes (key, new_from, new_to) where those aren't null."""
    return rows.join(changes.select(key, "new_from", "new_to"), key, "left").withColumns({"valid_from": F.coalesce("new_from", "valid_from"), "valid_to": F.coalesce("new_to", "valid_to")}).drop("new_from", "new_to")


def next_version(versions: DataFrame, graph_id: str, captured_at: Column, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the graph's next version number and its counts at the time."""
    last = versions.where(F.col("graph_id") == graph_id).agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("version_number"))
    n = nodes.where(known_at(captured_at)).agg(F.count("*").alias("entity_count"))
    e = edges.where(known_at(captured_at)).agg(F.count("*").alias("relationship_count"))
    return last.join(n).join(e).select(F.lit(graph_id).alias("graph_id"), "version_number", captured_at.alias("captured_at"), "entity_count", "relationship_count")  # three single rows


def version_page(versions: DataFrame, graph_id: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """A graph's versions, newest first."""
    return versions.where(F.col("graph_id") == graph_id).orderBy(F.desc("version_number")).offset(offset).limit(limit)


def version_of(versions: DataFrame, graph_id: str, number: int) -> DataFrame:
    return versions.where((F.col("graph_id") == graph_id) & (F.col("version_number") == number))


def without_version(versions: DataFrame, graph_id: str, number: int) -> DataFrame:
    """versions without one of them; the numbers of the others stay."""
    return versions.where(~((F.col("graph_id") == graph_id) & (F.col("version_number") == number)))


def changes(rows: DataFrame, t1: Column, t2: Column, kind: str, key: str = "id") -> DataFrame:
    """What came or went between two times, whichever is earlier: change, kind, key, at."""
    a, b = F.least(t1, t2), F.greatest(t1, t2)
    came = rows.where((F.col("transaction_time") > a) & (F.col("transaction_time") <= b)).select(F.lit("added").alias("change"), F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col("transaction_time").alias("at"))
    went = rows.where((F.col("invalidated_at") > a) & (F.col("invalidated_at") <= b)).select(F.lit("removed").alias("change"), F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col("invalidated_at").alias("at"))
    return came.unionByName(went)


def version_diff(nodes: DataFrame, edges: DataFrame, t1: Column, t2: Column) -> DataFrame:
    """All changes of nodes (id) and edges (edge_id)."""
    return changes(nodes, t1, t2, "entity").unionByName(changes(edges, t1, t2, "relationship", "edge_id"))


def diff_page(diff: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of changes in order, with has_more."""
    order = [F.col(c) for c in ("at", "kind", "change", "key")]
    page = diff.orderBy(*order).offset(offset).limit(limit + 1)
    more = page.agg((F.count("*") > limit).alias("has_more"))
    return page.orderBy(*order).limit(limit).join(F.broadcast(more))  # more is one row


def rollback(nodes: DataFrame, edges: DataFrame, captured_at: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables as of a time: what came later is invalidated now, what went later is restored, edges of invalid ends go too."""
    later, gone_later = F.col("transaction_time") > captured_at, (F.col("invalidated_at") > captured_at) & (F.coalesce("transaction_time", captured_at) <= captured_at)
    restored = F.when(later & F.col("invalidated_at").isNull(), now).when(gone_later, F.lit(None).cast("timestamp")).otherwise(F.col("invalidated_at"))
    n = nodes.withColumn("invalidated_at", restored)
    dead = n.where("invalidated_at is not null").select("id")
    e = edges.withColumn("invalidated_at", restored)
    for end in ("src", "dst"):
        e = e.join(dead.select(F.col("id").alias(end), F.lit(True).alias(f"dead_{end}")).distinct(), end, "left")
    lost = F.coalesce("dead_src", F.lit(False)) | F.coalesce("dead_dst", F.lit(False))
    return n, e.withColumn("invalidated_at", F.when(lost & F.col("invalidated_at").isNull(), now).otherwise(F.col("invalidated_at"))).drop("dead_src", "dead_dst")


def partial_rollback(nodes: DataFrame, mentions: DataFrame, docs: DataFrame, captured_at: Column, now: Column) -> DataFrame:
    """Invalidates what came later among the entities that the documents (doc_id) mention; mentions: id, doc_id."""
    touched = mentions.join(docs.select("doc_id"), "doc_id", "left_semi").select("id", F.lit(True).alias("touched")).distinct()
    hit = F.coalesce("touched", F.lit(False)) & (F.col("transaction_time") > captured_at) & F.col("invalidated_at").isNull()
    return nodes.join(touched, "id", "left").withColumn("invalidated_at", F.when(hit, now).otherwise(F.col("invalidated_at"))).drop("touched")


def timeline(nodes: DataFrame, edges: DataFrame, entity: str | None = None) -> DataFrame:
    """Starts and ends of entities and relationships in order; events without a time come first."""
    n = nodes.where(F.col("id") == entity) if entity else nodes
    e = edges.where((F.col("src") == entity) | (F.col("dst") == entity)) if entity else edges
    rows = n.select(F.lit("entity").alias("kind"), F.col("id").alias("key"), F.col("valid_from").alias("at"), F.lit("start").alias("event"))
    rows = rows.unionByName(n.where("valid_to is not null").select(F.lit("entity").alias("kind"), F.col("id").alias("key"), F.col("valid_to").alias("at"), F.lit("end").alias("event")))
    rows = rows.unionByName(e.select(F.lit("relationship").alias("kind"), F.col("edge_id").alias("key"), F.col("valid_from").alias("at"), F.lit("start").alias("event")))
    return rows.orderBy(F.asc_nulls_first("at"), "kind", "key", "event")


def temporal_context(nodes: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """The n latest nodes by the first of the columns that has a date."""
    return nodes.withColumn("at", F.coalesce(*columns)).where("at is not null").orderBy(F.desc("at"), "id").limit(n)
