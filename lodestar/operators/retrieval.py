"""Retrieval over chunks and vectors: splitting, BM25, exact vector top-k, hybrids, graph context, routing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.columns import cosine_score

#: Patterns that route a question, and words that aren't entities.
ANALYTIC = r"(?i)\b(list all|find all|show all|count|how many|enumerate|which .* are)\b"
RELATIONAL = r"(?i)\b(relationship|connected|related|partner|between|link|associat|collaborat)\b"
STRUCTURED = r"(?i)\b(query|cypher|match|return|where clause|subgraph|path between)\b"
GLOBAL = ["overview", "themes", "theme", "main topics", "across all", "summarize", "summarise", "what are the", "broad", "general", "landscape", "areas", "categories", "domains"]
STOPWORDS = """the a an is are was were be been being have has had do does did will would shall should may might must can could
about what who which when where why how tell me give show find list explain describe in on at to for of and or but not with
from by its their this that these those any all some""".split()


def chunks(docs: DataFrame, size: int = 1500, overlap: int = 300) -> DataFrame:
    """doc_id, index, text of windows of size characters, each beginning size - overlap after the last; a window within the one before is left out."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / step) - 1).cast("int")
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("index"))
    return rows.select("doc_id", "index", F.substring(F.col("text"), F.col("index") * step + 1, F.lit(size)).alias("text"))


def with_hash(rows: DataFrame, column: str = "text") -> DataFrame:
    return rows.withColumn("content_hash", F.sha2(F.col(column), 256))


def terms(rows: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, term, tf."""
    words = F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")
    return rows.select(key, words).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(rows: DataFrame, query: str, key: str = "doc_id", column: str = "text", n: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the n best texts for the query's words. Lengths come from one pass; only the query's words are exploded."""
    wanted = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    words = rows.select(key, F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).withColumn("len", F.size("w"))
    counted = words.select(key, "len", F.filter("w", lambda x: x.isin(*wanted)).alias("w"))
    total = counted.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    tf = counted.select(key, "len", F.explode("w").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    held = tf.join(F.broadcast(df), "term").join(F.broadcast(total))  # df has a row for each word of the query, total is one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return held.groupBy(key).agg(F.sum(score).alias("score")).orderBy(F.desc(F.round("score", 9)), key).limit(n)


def vector_topk(vectors: DataFrame, query: list[float] | Column, key: str = "id", n: int = 10, least: float | None = None) -> DataFrame:
    """key and score of the n nearest vectors, by a full scan: the filter before the score, so no tenant starves another."""
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    found = vectors.select(key, cosine_score(F.col("embedding"), q).alias("score")).where("score is not null")
    found = found.where(F.col("score") >= least) if least is not None else found
    return found.orderBy(F.desc("score"), key).limit(n)


def scaled(scores: DataFrame) -> DataFrame:
    """Scores moved to 0..1 by their range; 1 where all are equal."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return scores.join(F.broadcast(ends)).withColumn("score", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))).drop("lo", "hi")  # ends is one row


def capped_sources(strategies: list[tuple[str, DataFrame, int]], key: str = "chunk_id") -> DataFrame:
    """Sources of several strategies one after the other, each with its own cap, a source that an earlier one has left out: strategy, key, score."""
    parts = []
    for i, (name, found, most) in enumerate(strategies):
        best = found.select(key, "score").orderBy(F.desc("score"), key).limit(most)
        parts.append(best.select(F.lit(name).alias("strategy"), key, "score", F.lit(i).alias("_at")))
    every = reduce(DataFrame.unionByName, parts)
    first = every.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("_at")))
    return first.where("_k = 1").select("strategy", key, "score")


#: The search modes.
MODES = ("fast", "balanced", "comprehensive", "drift", "legacy")


def search(mode: str, vector: DataFrame, text: DataFrame, edges: DataFrame, members: DataFrame, n: int = 5) -> DataFrame:
    """What a search mode gathers: kind (source, relation, community), key, score. vector, text: id and score; edges: src, type, dst; members: member_id, community_id.

    fast takes the nearest vectors; balanced adds the relations of the n best; comprehensive their communities too; drift begins
    with the communities and goes to their members' relations; legacy is text search. An unknown mode is balanced, and where no
    vector is found any mode falls back to legacy.
    """
    mode = mode if mode in MODES else "balanced"
    source = lambda df: df.select(F.lit("source").alias("kind"), F.col("id").alias("key"), "score")
    if mode == "legacy" or vector.isEmpty():
        return source(text)
    best = vector.orderBy(F.desc("score"), "id").limit(n).select("id", "score")
    relation = lambda ids: edges.join(ids.select(F.col("id").alias("src"), "score"), "src").groupBy(F.concat_ws(" ", "src", "type", "dst").alias("key")).agg(F.max("score").alias("score")).select(F.lit("relation").alias("kind"), "key", "score")
    groups = members.join(best.withColumnRenamed("id", "member_id"), "member_id").groupBy(F.col("community_id").alias("key")).agg(F.max("score").alias("score")).select(F.lit("community").alias("kind"), "key", "score")
    if mode == "drift":
        inside = members.join(groups.select(F.col("key").alias("community_id"), "score"), "community_id").select(F.col("member_id").alias("id"), "score")
        return groups.unionByName(relation(inside))
    found = source(vector)
    if mode != "fast":
        found = found.unionByName(relation(best))
    return found.unionByName(groups) if mode == "comprehensive" else found


def hybrid(vector: DataFrame, text: DataFrame, key: str, alpha: float = 0.5, n: int = 10, ranker: str = "linear") -> DataFrame:
    """Both result lists as one: linear weighs their scaled scores, naive takes the better one."""
    v, t = scaled(vector).withColumnRenamed("score", "v"), scaled(text).withColumnRenamed("score", "t")
    v0, t0 = F.coalesce("v", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    score = F.greatest(v0, t0) if ranker == "naive" else alpha * v0 + (1 - alpha) * t0
    return v.join(t, key, "full").select(key, score.alias("score")).orderBy(F.desc(F.round("score", 9)), key).limit(n)


def graph_context(top: DataFrame, mentions: DataFrame, edges: DataFrame, least: float | None = None) -> DataFrame:
    """For each chunk found (chunk_id, score) the entities it mentions and their relations to others. mentions: chunk_id, id."""
    found = top.where(F.col("score") > least) if least is not None else top
    rows = found.join(mentions, "chunk_id", "left").join(edges.select(F.col("src").alias("id"), F.concat_ws(" ", "type", "dst").alias("relation")), "id", "left")
    return rows.groupBy("chunk_id", "score").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("entities"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))


def confidence(scores: DataFrame, by: str) -> DataFrame:
    """Mean of the three best scores within 0..1, one half without any."""
    top = scores.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.desc_nulls_last("score")))).where("k <= 3")
    return top.groupBy(by).agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("score"))), F.lit(0.5)).alias("confidence"))


def route(question: Column) -> Column:
    """Which retriever a question goes to."""
    low = F.lower(question)
    broad = F.lit(False)
    for word in GLOBAL:
        broad = broad | low.contains(word)
    return F.when(broad, "community").when(question.rlike(STRUCTURED), "text2query").when(question.rlike(ANALYTIC), "vector_graph").when(question.rlike(RELATIONAL), "hybrid_graph").otherwise("hybrid")


def entity_candidates(question: Column) -> Column:
    """Runs of capitalised words without stopwords, in order, each once."""
    runs = F.regexp_extract_all(question, F.lit("[A-Z][A-Za-z0-9&.'-]*(?:\\s+[A-Z][A-Za-z0-9&.'-]*)*"), F.lit(0))
    bare = F.transform(runs, lambda r: F.array_join(F.filter(F.split(r, "\\s+"), lambda w: ~F.lower(w).isin(*STOPWORDS)), " "))
    return F.array_distinct(F.filter(bare, lambda r: F.length(r) > 1))


def citation(text: Column, score: Column) -> Column:
    return F.struct(F.substring(text, 1, 500).alias("excerpt"), F.round(score, 4).alias("score"))


def cache_key(graph_id: Column, question: Column, kind: Column) -> Column:
    return F.sha2(F.concat_ws("|", graph_id, F.lower(F.trim(question)), kind), 256)


def word_groups(text: Column, size: int = 10) -> Column:
    """A text in groups of so many words, as an answer is delivered."""
    groups = lambda words: F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))
    # As an element of an array the words are a value that the groups share; as an expression they would be split anew for each group
    return F.element_at(F.transform(F.array(F.split(F.trim(text), "\\s+")), groups), 1)


#: Words that tell how much a question asks for.
COMPLEX = ["analyze", "compare", "relationship", "community", "influence", "pattern", "trend", "comprehensive", "deep dive", "correlation"]
SIMPLE = ["what is", "who is", "when did", "where is", "define"]


def recommend_mode(question: Column, most_seconds: Column, load: Column, preference: Column) -> Column:
    """The search mode for a question: by its words, the seconds that it may take (null: 10), the load (0 to 1, null: 0) and whether depth or
    speed is preferred. A null question has no words."""
    low = F.coalesce(F.lower(question), F.lit(""))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    most, busy = F.coalesce(most_seconds, F.lit(10.0)), F.coalesce(load, F.lit(0.0))
    deep, plain = has(COMPLEX), has(SIMPLE)
    return F.when(most < 1, "fast").when(plain & ~deep & (busy < 0.5), "balanced").when(deep & (most > 5), "comprehensive").when(preference == "depth", "comprehensive").when(preference == "speed", "fast").otherwise("balanced")


def context_confidence(retrieved: Column, analytics: Column, community: Column, temporal: Column) -> Column:
    """0.5 and something for each part of an answer's context that is there (truth values, null: not there), at most 1."""
    there = [F.coalesce(c, F.lit(False)).cast("int") for c in (retrieved, analytics, community, temporal)]
    several = (there[0] + there[1] + there[2] + there[3] > 2).cast("int")
    return F.round(F.least(F.lit(1.0), 0.5 + 0.2 * there[0] + 0.2 * there[1] + 0.1 * there[2] + 0.1 * several), 6)


def lineage(mentions: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Where entities come from: id, doc_id, n_chunks, first_chunk. mentions: chunk_id, id; chunks: chunk_id, doc_id; documents: doc_id.

    Mentions are counted by entity and chunk before they meet the chunks, so an entity that a third of all chunks name isn't shuffled
    with its repeats; a chunk whose document is gone doesn't count.
    """
    once = mentions.where("id is not null").select("chunk_id", "id").distinct()
    held = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", "doc_id").join(documents.select("doc_id"), "doc_id", "left_semi")
    return once.join(held, "chunk_id").groupBy("id", "doc_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))
