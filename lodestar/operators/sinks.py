"""Write semantics as plans: upserts, guarded edges, record ingest, soft and hard deletes, migrations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import both_ends


def upsert_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Nodes (graph_id, id, label, props) of either side: new labels replace old ones, properties are merged, new values first."""
    a = stored.select("graph_id", "id", F.col("label").alias("l0"), F.col("props").alias("p0"))
    b = incoming.dropDuplicates(["graph_id", "id"]).select("graph_id", "id", F.col("label").alias("l1"), F.col("props").alias("p1"))
    empty = F.create_map().cast("map<string,string>")
    p0, p1 = F.coalesce("p0", empty), F.coalesce("p1", empty)
    props = F.map_concat(F.map_filter(p0, lambda k, _: ~F.array_contains(F.map_keys(p1), k)), p1)
    return a.join(b, ["graph_id", "id"], "full").select("graph_id", "id", F.coalesce("l1", "l0").alias("label"), props.alias("props"))


def upsert_edges(stored: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored edges and the incoming ones whose ends exist, each (graph_id, src, type, dst) once. Of columns that both have the
    incoming value counts where it isn't null; properties are merged, new values first."""
    keys = ["graph_id", "src", "type", "dst"]
    values = [c for c in dict.fromkeys([*stored.columns, *incoming.columns]) if c not in keys]
    side = lambda df, name: df.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys])
    both = side(stored, "old").join(side(both_ends(incoming, nodes), "new"), keys, "full")

    def merged(c: str) -> Column:
        there = [F.col(f"{n}_{c}") for n in ("new", "old") if f"{n}_{c}" in both.columns]
        if c != "props" or len(there) < 2:
            return F.coalesce(*there)
        empty = F.create_map().cast(both.schema[f"old_{c}"].dataType)
        new, old = F.coalesce(there[0], empty), F.coalesce(there[1], empty)
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)

    return both.select(*keys, *[merged(c).alias(c) for c in values])


def write_graph(nodes: DataFrame, edges: DataFrame, graph_id: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """What is written of an extraction: named nodes and edges between them, stamped with tenant and time, parallel edges as a weight."""
    n = nodes.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumns({"graph_id": F.lit(graph_id), "transaction_time": now})
    e = both_ends(edges, n).groupBy("src", "dst", "type").agg(F.count("*").alias("weight")).withColumns({"graph_id": F.lit(graph_id), "transaction_time": now})
    return n, e


def ingest_records(records: DataFrame, id_field: str, label: str, relationships: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and skip reasons of structured records. relationships: column with a target id or an array of them -> type.

    A record without an id is skipped; targets that no record has become stub nodes.
    """
    good = F.col(id_field).isNotNull() & (F.trim(F.col(id_field).cast("string")) != "")
    skipped = records.where(~F.coalesce(good, F.lit(False))).select(F.lit("missing_id").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    own = records.where(good)
    props = [c for c in records.columns if c != id_field and c not in relationships]
    value = lambda c: F.to_json(c) if records.schema[c].dataType.simpleString().startswith(("array", "map", "struct")) else F.col(c).cast("string")
    held = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in props]), F.array(*[value(c) for c in props])), lambda _, v: v.isNotNull()) if props else F.create_map().cast("map<string,string>")
    nodes = own.select(F.col(id_field).cast("string").alias("id"), F.lit(label).alias("label"), held.alias("props"))
    edges = None
    for column, kind in relationships.items():
        many = records.schema[column].dataType.simpleString().startswith("array")
        target = F.explode(column) if many else F.col(column)
        part = own.select(F.col(id_field).cast("string").alias("src"), target.alias("dst")).withColumn("dst", F.col("dst").cast("string")).where("dst is not null").withColumn("type", F.lit(kind))
        edges = part if edges is None else edges.unionByName(part)
    if edges is not None:
        stubs = edges.select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
        nodes = nodes.unionByName(stubs.select("id", F.lit("Stub").alias("label"), F.create_map().cast("map<string,string>").alias("props")))
    return nodes, edges, skipped


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes gone (id) and the edges at them."""
    ids = gone.select("id")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def soft_delete(rows: DataFrame, hit: Column, column: str, now: Column) -> DataFrame:
    return rows.withColumn(column, F.when(hit & F.col(column).isNull(), now).otherwise(F.col(column)))


def expire_chunks(chunks: DataFrame, mentions: DataFrame, entities: DataFrame, now: Column, ttl_days: int) -> tuple[DataFrame, DataFrame]:
    """Chunks that aren't stale for longer than the time to live, and entities without those that only such chunks mention."""
    live = chunks.where(F.col("stale_at").isNull() | (F.col("stale_at") >= now - F.expr(f"INTERVAL {int(ttl_days)} DAYS")))
    held = mentions.join(live.select("chunk_id"), "chunk_id", "left_semi").select("id")
    orphans = mentions.select("id").distinct().join(held, "id", "left_anti")
    return live, entities.join(orphans, "id", "left_anti")


def migrate_edge_properties(edges: DataFrame, old: DataFrame) -> DataFrame:
    """edges with weight and props from an older table (edge_id, weight, props) where they have none."""
    return edges.join(old.select("edge_id", F.col("weight").alias("w0"), F.col("props").alias("p0")), "edge_id", "left").withColumns({"weight": F.coalesce("weight", "w0"), "props": F.coalesce("props", "p0")}).drop("w0", "p0")


def clean_migrated(edges: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays of the older table (edge_id, weight, props) once its rows have been carried over, and how many were: outcome, n.

    transferred: the edge has a weight and properties, or the old row had none to give, and the row goes. pending: the edge lacks something
    that the row has. orphaned: no edge has the row's id. Pending and orphaned rows stay.
    """
    now = edges.select("edge_id", F.col("weight").isNotNull().alias("_w"), F.col("props").isNotNull().alias("_p"), F.lit(True).alias("_there")).dropDuplicates(["edge_id"])
    done = (F.col("_w") | F.col("weight").isNull()) & (F.col("_p") | F.col("props").isNull())
    outcome = F.when(F.col("_there").isNull(), "orphaned").when(done, "transferred").otherwise("pending")
    judged = old.join(now, "edge_id", "left").withColumn("outcome", outcome)
    return judged.where("outcome <> 'transferred'").select(*old.columns), judged.groupBy("outcome").agg(F.count("*").alias("n"))


def blobs(rows: DataFrame, column: str = "content") -> DataFrame:
    """Content-addressed: each content of a graph once, with its hash."""
    return rows.select("graph_id", F.sha2(F.col(column), 256).alias("sha256"), column).dropDuplicates(["graph_id", "sha256"])


def provenance_backfill(rows: DataFrame) -> DataFrame:
    """A marker hash and a synthetic job for rows from before either was kept."""
    return rows.withColumns({"content_hash": F.coalesce("content_hash", F.lit("legacy")), "job_id": F.coalesce("job_id", F.concat(F.lit("backfill-"), F.col("graph_id")))})


def organisation_backfill(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """rows with org_id from their owner's default organisation (owner, default_org) where they have none."""
    return rows.join(defaults.select("owner", "default_org"), "owner", "left").withColumn("org_id", F.coalesce("org_id", "default_org")).drop("default_org")


def write_code_graph(stored: DataFrame, symbols: DataFrame, now: Column) -> DataFrame:
    """Code nodes (qualified_name, kind, path, content_hash) after a parse: those of parsed files are replaced, others stay; updated_at tells when."""
    parsed = symbols.select("path").distinct()
    kept = stored.join(parsed, "path", "left_anti")
    same = stored.select("qualified_name", "content_hash", F.col("updated_at").alias("was"))
    fresh = symbols.dropDuplicates(["qualified_name"]).join(same, ["qualified_name", "content_hash"], "left").withColumn("updated_at", F.coalesce("was", now)).drop("was")
    return kept.unionByName(fresh.select(*stored.columns))


def without_stale_code(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Code nodes and edges (src, dst: qualified names) without those of files (path) that aren't there any more."""
    live = nodes.join(files.select("path"), "path", "left_semi")
    names = live.select(F.col("qualified_name").alias("id"))
    return live, both_ends(edges, names)


#: Fixed value: bytes that a result may have once it is unpacked.
MOST_UNPACKED = 64 * 1024 * 1024


def packed_results(rows: DataFrame, key: str, column: str, most: int = MOST_UNPACKED) -> DataFrame:
    """key, packed (zstd), n_bytes and truncated of a text column; of a longer text only the first most bytes are kept, and null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data = [None if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            cols = [pa.array([None if d is None else pack(d[:most]) for d in data], pa.binary()), pa.array([None if d is None else len(d) for d in data], pa.int64()), pa.array([None if d is None else len(d) > most for d in data], pa.bool_())]
            yield pa.record_batch([batch.column(0), *cols], [key, "packed", "n_bytes", "truncated"])

    own = rows.select(key, column)
    return own.mapInArrow(run, f"{key} {own.schema[key].dataType.simpleString()}, packed binary, n_bytes long, truncated boolean")


def unpacked_results(rows: DataFrame, key: str, most: int = MOST_UNPACKED) -> DataFrame:
    """key, content and error of packed results; what would unpack to more than most bytes, or can't be, gives an error and no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            content: list[bytes | None] = []
            errors: list[str | None] = []
            for held in batch.column(1).to_pylist():
                found, error = None, None
                if held is not None:
                    try:
                        with zstandard.ZstdDecompressor().stream_reader(held) as reader:
                            found = reader.read(most + 1)
                    except zstandard.ZstdError as e:
                        error = str(e)
                    if found is not None and len(found) > most:
                        found, error = None, f"more than {most} bytes"
                content.append(found)
                errors.append(error)
            yield pa.record_batch([batch.column(0), pa.array(content, pa.binary()), pa.array(errors, pa.string())], [key, "content", "error"])

    own = rows.select(key, "packed")
    return own.mapInArrow(run, f"{key} {own.schema[key].dataType.simpleString()}, content binary, error string")
