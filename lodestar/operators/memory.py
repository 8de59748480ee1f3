"""Decaying memories: ranking, budgets, duplicates and contradictions. Every formula takes now as an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.columns import RANK_WEIGHTS, content_hash, importance, recency, token_estimate


def with_importance(memories: DataFrame, now: Column) -> DataFrame:
    return memories.withColumn("importance_score", importance(F.col("base_importance"), F.col("memory_type"), F.col("last_accessed_at"), F.col("access_count"), now))


def ranked(memories: DataFrame, text_scores: DataFrame, now: Column, n: int = 10) -> DataFrame:
    """Memories that have a text score (memory_id, text_score), by half the score, three tenths importance and two recency."""
    rank = RANK_WEIGHTS["text"] * F.col("text_score") + RANK_WEIGHTS["importance"] * F.col("importance_score") + RANK_WEIGHTS["recency"] * recency(F.col("last_accessed_at"), now)
    return memories.join(text_scores, "memory_id").withColumn("ranking", rank).orderBy(F.desc("ranking"), "memory_id").limit(n)


def budgeted(rows: DataFrame, by: list[str], order: list[Column], tokens: Column, most: int) -> DataFrame:
    """Rows in order until the first whose tokens would pass the budget; rows after it don't count, however small."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    running = rows.withColumn("running", F.sum(tokens).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return running.where(F.col("running") <= most)  # tokens are positive, so the running sum passes once


def entry_tokens(content: Column, confidence: Column) -> Column:
    """Tokens of a memory's line in a context: a quarter of its characters, five more."""
    line = F.concat(F.lit("- "), content, F.lit(" (confidence: "), F.format_number(confidence, 2), F.lit(")"))
    return (F.floor(F.length(line) * 0.25) + 5).cast("long")


def context_block(chosen: DataFrame, order: list[Column]) -> DataFrame:
    """One text for each kind of memory, its lines in order."""
    w = W.partitionBy("memory_type").orderBy(*order)
    lines = chosen.withColumn("k", F.row_number().over(w))
    return lines.groupBy("memory_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("- "), F.col("content")).alias("line")))), lambda x: x.line), "\n").alias("block"), F.count("*").alias("memories"))


def history(messages: DataFrame, max_turns: int = 20, max_tokens: int = 8000) -> DataFrame:
    """Of each conversation (conv_id, turn, role, text) the latest turns of users and assistants within both budgets; empty answers don't count."""
    own = messages.where(F.col("role").isin("user", "assistant") & ~((F.col("role") == "assistant") & (F.coalesce(F.col("text"), F.lit("")) == "")))
    latest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    own = own.withColumn("k", F.row_number().over(latest)).where(F.col("k") <= max_turns)
    return budgeted(own, ["conv_id"], [F.desc("turn")], token_estimate(F.coalesce("text", F.lit(""))), max_tokens).drop("k")


def consolidate(memories: DataFrame) -> DataFrame:
    """Memories with the same normalised content as one: the most important, of equals the smallest id, with their summed importance, 1 at most, and the ids it supersedes."""
    own = memories.withColumn("content_hash", content_hash(F.col("content")))
    w = W.partitionBy("graph_id", "content_hash").orderBy(F.desc("importance_score"), "memory_id")
    own = own.withColumn("k", F.row_number().over(w))
    return own.groupBy("graph_id", "content_hash").agg(
        F.min_by("memory_id", "k").alias("memory_id"), F.least(F.lit(1.0), F.sum("importance_score")).alias("importance_score"), F.count("*").alias("merged"),
        F.array_sort(F.collect_list(F.when(F.col("k") > 1, F.col("memory_id")))).alias("superseded"),
    )


def contradictions(memories: DataFrame) -> DataFrame:
    """Pairs with the same subject and predicate and different objects."""
    own = memories.select("memory_id", *[F.lower(F.trim(c)).alias(c) for c in ("subject", "predicate", "object")])
    a, b = own.withColumnsRenamed({"memory_id": "a", "object": "o1"}), own.withColumnsRenamed({"memory_id": "b", "object": "o2"})
    return a.join(b, ["subject", "predicate"]).where("a < b and o1 <> o2")


def store(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming memories whose content no stored one has, one of each content."""
    own = incoming.withColumn("content_hash", content_hash(F.col("content"))).dropDuplicates(["graph_id", "content_hash"])
    return own.join(stored.select("graph_id", content_hash(F.col("content")).alias("content_hash")), ["graph_id", "content_hash"], "left_anti")


def bump_access(memories: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """One access more for the hits (memory_id), at now, with their importance anew."""
    own = memories.join(hits.select("memory_id", F.lit(1).alias("hit")).distinct(), "memory_id", "left")
    own = own.withColumns({"access_count": F.col("access_count") + F.coalesce("hit", F.lit(0)), "last_accessed_at": F.when(F.col("hit") == 1, now).otherwise(F.col("last_accessed_at"))})
    return with_importance(own, now).drop("hit")


def link_entities(memories: DataFrame, nodes: DataFrame) -> DataFrame:
    """memory_id and id of the entities whose name is the memory's subject or object."""
    names = nodes.select("id", F.lower("name").alias("term"))
    terms = memories.select("memory_id", F.explode(F.array_distinct(F.array(F.lower("subject"), F.lower("object")))).alias("term"))
    return terms.join(names, "term").select("memory_id", "id").distinct()


def remove(memories: DataFrame, ids: list[str], now: Column, hard: bool = False) -> DataFrame:
    return memories.where(~F.col("memory_id").isin(*ids)) if hard else memories.withColumn("valid_to", F.when(F.col("memory_id").isin(*ids), now).otherwise(F.col("valid_to")))
