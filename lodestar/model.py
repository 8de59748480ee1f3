"""The property-graph data model: node and edge tables, how the star schema becomes them, and views of one tenant."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = """graph_id string, id string, name string, label string, labels array<string>, type string, embedding array<float>,
valid_from timestamp, valid_to timestamp, transaction_time timestamp, invalidated_at timestamp, event_time timestamp,
ingestion_time timestamp, fingerprint string, prop_hash string, canonical_name string, aliases array<string>, props map<string,string>"""
EDGES = """graph_id string, edge_id string, src string, dst string, type string, weight double, count bigint, score double,
confidence double, valid_from timestamp, valid_to timestamp, event_time timestamp, event_time_end timestamp,
ingestion_time timestamp, transaction_time timestamp, invalidated_at timestamp, source_chunk_id string, props map<string,string>"""

TENANT = "tpch"


@dataclass(frozen=True)
class CommunityKind:
    """A kind of community: what its members are and whether it has levels."""

    name: str
    member_label: str
    hierarchical: bool


KINDS = {k.name: k for k in (CommunityKind("entity", "__Entity__", True), CommunityKind("chunk", "Chunk", False))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its times without a zone read in the session's (which should be UTC)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})


def key(label: str, column: str) -> F.Column:
    """A node's id from its table's key."""
    return F.concat(F.lit(f"{label.lower()}:"), F.col(column).cast("string"))


#: table, label, key column, name column, other columns that become properties
NODE_TABLES = [
    ("region", "Region", "r_regionkey", "r_name", []),
    ("nation", "Nation", "n_nationkey", "n_name", []),
    ("customer", "Customer", "c_custkey", "c_name", ["c_acctbal", "c_mktsegment"]),
    ("supplier", "Supplier", "s_suppkey", "s_name", ["s_acctbal"]),
    ("part", "Part", "p_partkey", "p_name", ["p_brand", "p_type", "p_size"]),
    ("orders", "Order", "o_orderkey", None, ["o_orderstatus", "o_orderpriority"]),
]
#: table, label of the source, its key, label of the target, the foreign key, type of the edge
FK_TABLES = [
    ("nation", "Nation", "n_nationkey", "Region", "n_regionkey", "IN_REGION"),
    ("customer", "Customer", "c_custkey", "Nation", "c_nationkey", "IN_NATION"),
    ("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", "IN_NATION"),
    ("orders", "Order", "o_orderkey", "Customer", "o_custkey", "PLACED_BY"),
]


def nodes(spark: SparkSession, sf_dir: str, labels: list[str] | None = None) -> DataFrame:
    """Nodes (graph_id, id, name, label, type, props) of the star schema, only those of the labels asked for."""
    made = []
    for name, label, k, title, props in NODE_TABLES:
        if labels is None or label in labels:
            pairs = [x for p in props for x in (F.lit(p), F.col(p).cast("string"))]
            held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
            made.append(table(spark, sf_dir, name).select(F.lit(TENANT).alias("graph_id"), key(label, k).alias("id"), (F.col(title) if title else key(label, k)).alias("name"), F.lit(label).alias("label"), F.lit(label.lower()).alias("type"), held.alias("props")))
    return reduce(DataFrame.unionByName, made)


def edges(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> DataFrame:
    """Edges (graph_id, src, dst, type) from the foreign keys, a null key giving none."""
    made = []
    for name, a, k, b, fk, kind in FK_TABLES:
        if types is None or kind in types:
            made.append(table(spark, sf_dir, name).where(F.col(fk).isNotNull()).select(F.lit(TENANT).alias("graph_id"), key(a, k).alias("src"), key(b, fk).alias("dst"), F.lit(kind).alias("type")))
    return reduce(DataFrame.unionByName, made)


class TenantView:
    """Nodes and edges of the graphs that a caller may read. Every operator over a view sees nothing else."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, graph_ids: list[str]) -> None:
        self.graph_ids = list(dict.fromkeys(graph_ids))
        self.nodes = nodes.where(F.col("graph_id").isin(self.graph_ids))
        self.edges = edges.where(F.col("graph_id").isin(self.graph_ids))
