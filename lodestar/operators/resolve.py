"""Entity resolution, deduplication, federation, deltas and ontology checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.columns import canonical_name, cosine_score, fingerprint, jaccard, normalise_name, property_hash
from lodestar.functions.similarity import jaro_winkler_udf, sequence_ratio_udf
from lodestar.operators.joins import edit_pairs
from lodestar.operators.traverse import held, scratch
from lodestar.operators.vectors import knn

#: Weights of the four signals, the decision bands, how many pairs a task should make, and pairs of types that count half.
SIGNALS = {"embedding": 0.4, "name": 0.3, "type": 0.2, "context": 0.1}
STORE, AMBIGUOUS = 0.85, 0.60
PAIRS_PER_TASK = 10_000_000
COMPATIBLE = [("organization", "company"), ("person", "individual"), ("location", "place")]


def canonical_groups(nodes: DataFrame) -> DataFrame:
    """graph_id, canonical, keeper (the smallest id) and members of each name that several nodes share once company endings are gone."""
    own = nodes.select("graph_id", "id", canonical_name(F.col("name")).alias("canonical")).where("canonical <> ''")
    return own.groupBy("graph_id", "canonical").agg(F.min("id").alias("keeper"), F.count("*").alias("members")).where("members > 1")


def keeper_map(nodes: DataFrame) -> DataFrame:
    """loser -> keeper for each node that isn't its canonical name's keeper."""
    own = nodes.select("graph_id", "id", canonical_name(F.col("name")).alias("canonical")).where("canonical <> ''")
    keep = own.groupBy("graph_id", "canonical").agg(F.min("id").alias("keeper"))
    return own.join(keep, ["graph_id", "canonical"]).where("id <> keeper").select("graph_id", F.col("id").alias("loser"), "keeper")


def rewire(edges: DataFrame, losers: DataFrame) -> DataFrame:
    """Edges with losers (loser, keeper) replaced by their keepers, parallel ones collapsed into count, loops gone."""
    m = losers.select("loser", "keeper")
    at = edges.join(m.withColumnsRenamed({"loser": "src", "keeper": "src_keeper"}), "src", "left").join(m.withColumnsRenamed({"loser": "dst", "keeper": "dst_keeper"}), "dst", "left")
    at = at.select(F.coalesce("src_keeper", "src").alias("src"), F.coalesce("dst_keeper", "dst").alias("dst"), "type").where("src <> dst")
    return at.groupBy("src", "dst", "type").agg(F.count("*").alias("count"))


def consolidate(nodes: DataFrame, losers: DataFrame) -> DataFrame:
    """Nodes without the losers; keepers gain their losers' names as aliases."""
    names = losers.join(nodes.select(F.col("id").alias("loser"), F.col("name").alias("alias")), "loser").groupBy(F.col("keeper").alias("id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return nodes.join(losers.select(F.col("loser").alias("id")), "id", "left_anti").join(names, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """Greedy merging of scored pairs (graph_id, keeper, loser, score): best first, ties by keeper and loser, none that touches a merged-away id.

    In rounds over all graphs at once. A pair is decided when no better pair that is still open could merge one of its two away, that
    is, has one of them as its loser; all such pairs are taken together, and open pairs worse than the one that merged an id
    away go. The best open pair is always decided, so rounds end; they are as many as the longest chain of losers that keep.
    """
    order = F.struct((-F.col("score")).alias("below"), F.col("keeper").alias("k"), F.col("loser").alias("l"))
    left = held(pairs.select("graph_id", "keeper", "loser", "score").distinct().withColumn("order", order))
    folder, taken = scratch(pairs.sparkSession, "merged"), None
    while not left.isEmpty():
        first = left.groupBy("graph_id", F.col("loser").alias("id")).agg(F.min("order").alias("first"))
        at = lambda c: first.select("graph_id", F.col("id").alias(c), F.col("first").alias(f"{c}_first"))
        sure = left.join(at("loser"), ["graph_id", "loser"]).where("order = loser_first").join(at("keeper"), ["graph_id", "keeper"], "left").where("keeper_first is null or order < keeper_first")
        new = held(sure.select("graph_id", "loser", "keeper", "score", "order"))
        taken = held(new.select("graph_id", "loser", "keeper", "score"), folder)
        gone = lambda c: new.select("graph_id", F.col("loser").alias(c), F.col("order").alias(f"{c}_gone"))
        rest = left.join(gone("loser"), ["graph_id", "loser"], "left").join(gone("keeper"), ["graph_id", "keeper"], "left")
        left = held(rest.where("(loser_gone is null or order < loser_gone) and (keeper_gone is null or order < keeper_gone)").select("graph_id", "keeper", "loser", "score", "order"))
    return taken if taken is not None else left.select("graph_id", "loser", "keeper", "score")


def components(links: DataFrame) -> DataFrame:
    """id and root, the smallest id that can be reached over links (a, b), of each id that any link has. Alternates large and small stars, over whole tables."""
    edges = held(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = held(small)
        # Done when all are stars: nothing has two parents, no parent has one
        if new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            break
        edges = new
    return new.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


#: The passes of deduplication, relationships that aren't consolidated, and what an embedding pass asks for.
PASSES = ("canonical", "merge_canonical", "embedding", "relationships")
STRUCTURAL = ("SIMILAR_TO", "IN_COMMUNITY", "FROM_CHUNK", "PARENT_COMMUNITY", "IN_CHUNK_COMMUNITY", "NEXT_CHUNK", "FROM_DOCUMENT")
NEAR_ENTITIES, NEAR_SCORE = 6, 0.92


def final_keepers(merges: DataFrame) -> DataFrame:
    """loser and keeper, where keepers that were merged away themselves give way to theirs. merges: loser, keeper, each loser once."""
    now = held(merges.select("loser", "keeper"))
    while True:
        onward = now.select(F.col("loser").alias("keeper"), F.col("keeper").alias("next"))
        new = held(now.join(onward, "keeper", "left").select("loser", F.coalesce("next", "keeper").alias("keeper"), F.col("next").isNotNull().alias("moved")))
        now = new.select("loser", "keeper")
        if new.where("moved").isEmpty():
            return now


def deduplicate(nodes: DataFrame, edges: DataFrame, passes: tuple[str, ...] = PASSES, least: float = NEAR_SCORE, dry_run: bool = False, structural: tuple[str, ...] = STRUCTURAL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and a report (graph_id, passes' counts) after the passes, in order; a dry run leaves both as they are and reports what would happen.

    nodes: graph_id, id, name, embedding, aliases and canonical_name (null where it isn't known). edges: graph_id, edge_id, src, dst, type, count.
    canonical names nodes that lack a canonical name; merge_canonical merges nodes of one such name into the smallest id; embedding
    merges pairs among each node's NEAR_ENTITIES nearest vectors with a score of at least least and other canonical names, greedily;
    relationships makes parallel edges one, with their count, but for the structural types. In a dry run a pass sees the table as it
    was, so its merges rest on names that aren't stored yet, and embedding still meets nodes that merge_canonical would have merged.
    """
    start, counts = (nodes, edges), []
    counted = lambda df, name: counts.append(df.groupBy("graph_id").agg(F.count("*").alias(name)))
    if "canonical" in passes:
        named = canonical_name(F.col("name"))
        missing = nodes.where("canonical_name is null").withColumn("made", F.when(named != "", named))
        counted(missing.where("made is not null"), "canonical_names_added")
        counted(missing.where("made is null"), "skipped_bad_names")
        if not dry_run:
            nodes = held(nodes.withColumn("canonical_name", F.coalesce("canonical_name", F.when(named != "", named))))
    if "merge_canonical" in passes:
        keep = nodes.where("canonical_name is not null").groupBy("graph_id", "canonical_name").agg(F.min("id").alias("keeper"))
        losers = held(nodes.join(keep, ["graph_id", "canonical_name"]).where("id <> keeper").select("graph_id", F.col("id").alias("loser"), "keeper"))
        counted(losers, "canonical_merges")
        if not dry_run:
            nodes, edges = merged(nodes, edges, losers)
    if "embedding" in passes:
        own = nodes.where("embedding is not null").select("graph_id", "id", "embedding")
        near = knn(own, own, NEAR_ENTITIES - 1, ["graph_id"], same=True).where((F.col("score") >= least) & (F.col("a") < F.col("b")))
        name = lambda c: nodes.select(F.col("id").alias(c), F.col("canonical_name").alias(f"{c}_name"), *(["graph_id"] if c == "a" else []))
        pairs = near.join(name("a"), "a").join(name("b"), "b").where("a_name is null or b_name is null or a_name <> b_name")
        losers = merge_pairs(pairs.select("graph_id", F.col("a").alias("keeper"), F.col("b").alias("loser"), "score"))
        counted(losers, "embedding_merges")
        if not dry_run:
            nodes, edges = merged(nodes, edges, losers.select("graph_id", "loser", "keeper"))
    if "relationships" in passes:
        several = edges.where(~F.col("type").isin(*structural)).groupBy("graph_id", "src", "dst", "type").agg(F.count("*").alias("n")).where("n > 1")
        counts.append(several.groupBy("graph_id").agg(F.sum(F.col("n") - 1).alias("relationship_consolidations")))
        if not dry_run:
            edges = held(dedup_edges(edges, structural))
    report = nodes.groupBy("graph_id").agg(F.count("*").alias("entities_processed"))
    report = report.join(edges.groupBy("graph_id").agg(F.count("*").alias("relationships_processed")), "graph_id", "full")
    for one in counts:
        report = report.join(one, "graph_id", "left")
    report = report.na.fill(0)
    return (*start, report) if dry_run else (nodes, edges, report)


def merged(nodes: DataFrame, edges: DataFrame, losers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the losers (graph_id, loser, keeper), whose names and aliases their last keeper gains, and edges that end at keepers; loops that this makes go."""
    final = final_keepers(losers)
    names = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>")))
    gained = final.join(nodes.select(F.col("id").alias("loser"), F.explode(names).alias("alias")), "loser").groupBy(F.col("keeper").alias("id")).agg(F.collect_set("alias").alias("gained"))
    kept = nodes.join(final.select(F.col("loser").alias("id")), "id", "left_anti").join(gained, "id", "left")
    aliases = F.array_sort(F.array_remove(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("gained", F.array().cast("array<string>"))), F.coalesce("name", F.lit(""))))
    end = lambda c: final.select(F.col("loser").alias(c), F.col("keeper").alias(f"{c}_keeper"))
    moved = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    was_loop = F.col("src") == F.col("dst")
    moved = moved.withColumns({"src_new": F.coalesce("src_keeper", "src"), "dst_new": F.coalesce("dst_keeper", "dst")}).where(was_loop | (F.col("src_new") != F.col("dst_new")))
    moved = moved.withColumns({"src": F.col("src_new"), "dst": F.col("dst_new")}).select(*edges.columns)
    return held(kept.withColumn("aliases", aliases).select(*nodes.columns)), held(moved)


def dedup_edges(edges: DataFrame, parallel: tuple[str, ...] = ()) -> DataFrame:
    """Of edges with the same ends and type the smallest edge_id stays, with their summed count; types in parallel are left alone."""
    own = edges.withColumn("count", F.coalesce("count", F.lit(1)))
    free = own.where(F.col("type").isin(*parallel)) if parallel else own.limit(0)
    rest = own.where(~F.col("type").isin(*parallel)) if parallel else own
    merged = rest.groupBy("graph_id", "src", "dst", "type").agg(F.min("edge_id").alias("edge_id"), F.sum("count").alias("count"))
    return merged.unionByName(free.select(*merged.columns))


def fuzzy_pairs(nodes: DataFrame, least: float = 0.8, gap: int | None = None) -> DataFrame:
    """Pairs a < b of nodes whose names contain each other or have an edit similarity above least; none is lost."""
    return edit_pairs(nodes, least, gap)


def same_name_pairs(mentions: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Mentions (id, name, chunk_id) of one name in different chunks that aren't linked (a, b) yet."""
    own = mentions.select("id", F.lower(F.trim("name")).alias("name"), "chunk_id")
    pairs = own.withColumnsRenamed({"id": "a", "chunk_id": "c1"}).join(own.withColumnsRenamed({"id": "b", "chunk_id": "c2"}), "name").where("a < b and c1 <> c2").select("a", "b")
    return pairs.join(linked.select("a", "b"), ["a", "b"], "left_anti") if linked is not None else pairs


def type_score(a: Column, b: Column) -> Column:
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    half = reduce(lambda x, y: x | y, [((a == p) & (b == q)) | ((a == q) & (b == p)) for p, q in COMPATIBLE])
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when(half, 0.5).otherwise(0.0)


def same_as_scores(pairs: DataFrame) -> DataFrame:
    """pairs: a, b, a_name, b_name, a_type, b_type, embedding_score, a_near, b_near (names of neighbours): adds score and band."""
    name = jaro_winkler_udf(normalise_name(F.col("a_name")), normalise_name(F.col("b_name")))
    score = F.col("embedding_score") * SIGNALS["embedding"] + name * SIGNALS["name"] + type_score(F.col("a_type"), F.col("b_type")) * SIGNALS["type"] + jaccard(F.col("a_near"), F.col("b_near")) * SIGNALS["context"]
    return pairs.withColumn("score", score).withColumn("band", F.when(F.col("score") >= STORE, "store").when(F.col("score") >= AMBIGUOUS, "ambiguous").otherwise("discard"))


def similar_edges(vectors: DataFrame, k: int, least: float, block: list[str] | None = None) -> DataFrame:
    """SIMILAR_TO pairs a < b among each vector's k nearest others: vectors has id, embedding and the columns of block, within which pairs are made."""
    own = vectors.select("id", "embedding", *(block or []))
    top = knn(own, own, k, block, same=True).where(F.col("score") >= least)
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def same_as_links(nodes: DataFrame, others: DataFrame, least: float = STORE, near: int = 10) -> DataFrame:
    """SAME_AS links between two graphs' nodes (id, name, type, bucket, embedding): a, b, confidence, path.

    Equal names are linked with 0.99. A node without such a partner meets the near nearest vectors of its bucket and is linked
    to those whose score of vector, name and type, without neighbours' weight, is at least least. Names and buckets are equi-joins.
    """
    a = nodes.select(F.col("id").alias("a"), "name", "type", "bucket", "embedding").withColumn("key", F.lower(F.trim("name")))
    b = others.select(F.col("id").alias("b"), F.col("name").alias("b_name"), F.col("type").alias("b_type"), "bucket", F.col("embedding").alias("vb")).withColumn("key", F.lower(F.trim("b_name")))
    exact = a.select("a", "key").join(b.select("b", "key"), "key").select("a", "b", F.lit(0.99).alias("confidence"), F.lit("exact").alias("path"))
    rest = a.join(exact.select("a"), "a", "left_anti").select("a", "name", "type", "bucket", "embedding")
    close = knn(rest.select(F.col("a").alias("id"), "bucket", "embedding"), b.select(F.col("b").alias("id"), "bucket", F.col("vb").alias("embedding")), near, ["bucket"]).withColumnRenamed("score", "v")
    top = close.join(rest.select("a", "name", "type"), "a").join(b.select("b", "b_name", "b_type"), "b")
    name = jaro_winkler_udf(normalise_name(F.col("name")), normalise_name(F.col("b_name")))
    score = (F.col("v") * SIGNALS["embedding"] + name * SIGNALS["name"] + type_score(F.col("type"), F.col("b_type")) * SIGNALS["type"]) / (1 - SIGNALS["context"])
    scored = top.select("a", "b", score.alias("confidence"), F.lit("vector").alias("path"))
    return exact.unionByName(scored.where(F.col("confidence") >= least))


def name_scores(names: DataFrame, by: list[str], score: Callable[[Column, Column], Column]) -> DataFrame:
    """a < b and similarity, to six places, of all rows (id, name, by) with equal by.

    Rows of one name are a class, and two classes are scored once, however many pairs of rows they have. Scored classes then meet their
    rows by the class, so no task has a whole key of by. A null name gives a null similarity; a null in by or id, no pair.
    """
    rows = names.select("id", "name", *by).dropna(subset=["id", *by])
    found = rows.groupBy(*by, "name").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    classes = held(found.withColumn("class", F.monotonically_increasing_id()))
    side = lambda c: classes.select(*by, F.col("name").alias(f"{c}_name"), F.col("class").alias(c), F.col("first").alias(f"{c}_first"), F.col("last").alias(f"{c}_last"))
    both = side("x").join(side("y"), by).where("x_first < y_last")  # else no a of x is before a b of y
    similarity = F.when(F.col("x_name").isNotNull() & F.col("y_name").isNotNull(), F.round(score(F.col("x_name"), F.col("y_name")), 6))
    scored = held(both.select("x", "y", similarity.alias("similarity")))
    same = [rows[c] == classes[c] for c in by] + [rows["name"].eqNullSafe(classes["name"])]
    members = held(rows.join(classes, same).select("id", "class"))
    of = lambda c, at: members.select(F.col("id").alias(c), F.col("class").alias(at))
    # What meets is small beside the pairs that come of it, so its size is no measure for the number of partitions
    pairs = classes.groupBy(*by).agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0.0
    parts = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / PAIRS_PER_TASK) + 1)
    near = scored.repartition(parts, "x").join(of("a", "x"), "x").select("a", "y", "similarity").repartition(parts, "y")
    return near.join(of("b", "y"), "y").where("a < b").select("a", "b", "similarity")


def federated_search(nodes: DataFrame, graph_ids: list[str], term: str, per_graph: int = 50) -> DataFrame:
    """Nodes of the graphs whose name has the term, so many of each graph."""
    own = nodes.where(F.col("graph_id").isin(graph_ids)).where(F.lower("name").contains(term.lower()))
    return own.withColumn("k", F.row_number().over(W.partitionBy("graph_id").orderBy("id"))).where(F.col("k") <= per_graph).drop("k")


def federation_links(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes with the same name and type in different graphs: name, type, a, b with a's graph first."""
    own = nodes.select("graph_id", "id", F.lower(F.trim("name")).alias("name"), F.lower(F.trim("type")).alias("type"))
    a, b = own.withColumnsRenamed({"graph_id": "g1", "id": "a"}), own.withColumnsRenamed({"graph_id": "g2", "id": "b"})
    return a.join(b, ["name", "type"]).where("g1 < g2")


def federation_candidates(nodes: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Nodes of one name in different graphs with 0.4 for the name and 0.3 for an equal type; 0.3 more by their vectors (id, embedding) if given."""
    own = nodes.select("graph_id", "id", F.lower(F.trim("name")).alias("name"), F.lower(F.trim("type")).alias("type"))
    a = own.withColumnsRenamed({"graph_id": "g1", "id": "a", "type": "t1"})
    b = own.withColumnsRenamed({"graph_id": "g2", "id": "b", "type": "t2"})
    pairs = a.join(b, "name").where("g1 < g2").withColumn("score", F.lit(0.4) + F.when(F.col("t1") == F.col("t2"), 0.3).otherwise(0.0))
    if embeddings is not None:
        v = embeddings.select("id", "embedding")
        pairs = pairs.join(v.withColumnsRenamed({"id": "a", "embedding": "va"}), "a", "left").join(v.withColumnsRenamed({"id": "b", "embedding": "vb"}), "b", "left")
        pairs = pairs.withColumn("score", F.col("score") + 0.3 * F.coalesce(cosine_score(F.col("va"), F.col("vb")), F.lit(0.0))).drop("va", "vb")
    return pairs


def strongest_links(links: DataFrame) -> DataFrame:
    """Of links between the same two ids, whichever way, the highest confidence."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence").groupBy("a", "b").agg(F.max("confidence").alias("confidence"))


def linked_graphs(graphs: DataFrame, links: DataFrame, roles: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """The graphs (graph_id) and those linked to them (a, b, min_role), where the caller's role (graph_id, role) ranks high enough (low number)."""
    rank = F.create_map(*[x for r, n in ranks.items() for x in (F.lit(r), F.lit(n))])
    far = links.join(graphs.select(F.col("graph_id").alias("a")), "a", "left_semi").join(roles.select(F.col("graph_id").alias("b"), "role"), "b").where(rank[F.col("role")] <= rank[F.col("min_role")])
    return graphs.select("graph_id").unionByName(far.select(F.col("b").alias("graph_id"))).distinct()


def entity_delta(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming (name, type, props) with fingerprint and status: new, updated or unchanged against stored (fingerprint, prop_hash)."""
    own = incoming.withColumns({"fingerprint": fingerprint(F.col("name"), F.col("type")), "prop_hash": property_hash(F.col("props"))})
    was = stored.select("fingerprint", F.col("prop_hash").alias("was"))
    return own.join(was, "fingerprint", "left").withColumn("status", F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("prop_hash"), "unchanged").otherwise("updated")).drop("was")


def longer_description(current: Column, previous: Column) -> Column:
    return F.when(F.length(previous) > F.length(current), previous).otherwise(current)


def chunk_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """doc_id, content_hash and status (added, removed, unchanged) of chunks in either set."""
    keys = ["doc_id", "content_hash"]
    a, b = new.select(*keys).distinct().withColumn("in_new", F.lit(True)), old.select(*keys).distinct().withColumn("in_old", F.lit(True))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("unchanged").alias("status"))


def changed_documents(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents (doc_id, content_hash) that are new or whose hash differs from the stored one."""
    return new.join(stored.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def orphaned_edges(stored: DataFrame, live: DataFrame, source_chunks: DataFrame) -> DataFrame:
    """Stored edges of the source's chunks (source_chunk_id) whose (src_fp, type, dst_fp, source_chunk_id) the new extraction hasn't."""
    own = stored.join(source_chunks.select("source_chunk_id"), "source_chunk_id", "left_semi")
    return own.join(live.select("src_fp", "type", "dst_fp", "source_chunk_id"), ["src_fp", "type", "dst_fp", "source_chunk_id"], "left_anti")


def unify_chunk_entities(nodes: DataFrame) -> DataFrame:
    """Entities of overlapping chunks (id chunk:name..., name, props): one for each name and label, with the smallest id without its prefix and the richest properties."""
    bare = F.when(F.col("id").contains(":"), F.regexp_extract("id", "^[^:]*:(.*)$", 1)).otherwise(F.col("id"))
    key = F.lower(F.trim("name"))
    return nodes.groupBy(key.alias("key"), "label").agg(F.min(bare).alias("id"), F.min("name").alias("name"), F.max_by("props", F.struct(F.size("props"), F.col("id"))).alias("props")).drop("key")


def ontology_violations(nodes: DataFrame, allowed: list[str]) -> DataFrame:
    """label, rows and example ids of labels that the ontology hasn't."""
    return nodes.where(~F.col("label").isin(*allowed)).groupBy("label").agg(F.count("*").alias("violations"), F.min("id").alias("example"))


def enforce_ontology(nodes: DataFrame, allowed: list[str], mode: str = "COERCE", ratio: float = 0.7, on_mismatch: str = "count") -> DataFrame:
    """nodes with ontology_status: WARN marks, STRICT drops, COERCE renames to the closest allowed label where one is close enough.

    Distances are taken once for each distinct label, not for each node.
    """
    known = F.col("label").isin(*allowed)
    if mode == "WARN":
        return nodes.withColumn("ontology_status", F.when(known, "ok").otherwise("violation"))
    if mode == "STRICT":
        return nodes.where(known).withColumn("ontology_status", F.lit("ok"))
    odd = nodes.where(~known).select("label").distinct().withColumn("to", F.explode(F.array(*[F.lit(a) for a in allowed])))
    near = odd.withColumn("r", sequence_ratio_udf(F.lower("label"), F.lower("to"))).where(F.col("r") >= ratio)
    best = near.groupBy("label").agg(F.max_by("to", F.struct("r", "to")).alias("to"))
    out = nodes.join(best, "label", "left").withColumn("ontology_status", F.when(known, "ok").when(F.col("to").isNotNull(), "coerced").otherwise("mismatch"))
    out = out.withColumn("label", F.coalesce("to", "label")).drop("to")
    return out.where("ontology_status <> 'mismatch'") if on_mismatch == "drop" else out


def strip_properties(nodes: DataFrame, banned: list[str]) -> DataFrame:
    """nodes without the banned keys in props, and how many went."""
    return nodes.withColumn("kept", F.map_filter("props", lambda k, _: ~F.lower(k).isin(*[b.lower() for b in banned]))).withColumn("stripped", F.size("props") - F.size("kept")).withColumn("props", F.col("kept")).drop("kept")


def embedding_text(name: Column, labels: Column, description: Column) -> Column:
    return F.concat_ws(". ", F.concat_ws(" ", name, F.concat(F.lit("("), F.array_join(labels, ", "), F.lit(")"))), F.when(description != "", description))
