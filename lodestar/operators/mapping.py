"""Relational schemas as graph mappings: kinds of tables, types of relationships, rows as nodes and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that carry bookkeeping, self references by name, and prefixes of junction tables.
AUDIT = ["created_at", "updated_at", "deleted_at", "created_by", "updated_by", "modified_at", "modified_by", "id"]
SELF_REFERENCES = {"parent_id": "HAS_CHILD", "manager_id": "MANAGES", "supervisor_id": "SUPERVISES", "reports_to": "MANAGES", "parent": "HAS_CHILD"}
JUNCTION_PREFIXES = ["t_", "rel_", "jn_", "jt_", "map_", "link_", "xref_", "assoc_"]


def table_kinds(catalog: DataFrame) -> DataFrame:
    """table and kind from a catalogue (table, column, is_pk, is_fk, fk_table): two foreign tables and nothing else make a junction, a key to itself a self reference."""
    fk = F.col("is_fk") & ~F.col("is_pk")
    payload = ~F.col("is_pk") & ~F.col("is_fk") & ~F.lower("column").isin(*AUDIT)
    by = catalog.groupBy("table").agg(F.count_distinct(F.when(fk, F.col("fk_table"))).alias("targets"), F.count_if(payload).alias("payload"), F.count_if(fk & (F.col("fk_table") == F.col("table"))).alias("own"))
    kind = F.when((F.col("targets") == 2) & (F.col("payload") == 0), "junction_table").when(F.col("own") > 0, "self_ref_table").otherwise("entity_table")
    return by.select("table", kind.alias("kind"))


def relationship_type(column: Column, fk_table: Column, table: Column) -> Column:
    """What a foreign key's edge is called."""
    own = F.coalesce(*[F.when(F.lower(column) == k, v) for k, v in SELF_REFERENCES.items()], F.lit("REFERENCES_SELF"))
    return F.when(fk_table == table, own).otherwise(F.lit("BELONGS_TO"))


def junction_verb(table: str, a: str, b: str) -> str | None:
    """A verb from a junction table's name, once prefixes and the two tables' names are gone; None if nothing of three letters is left."""
    name = table.lower()
    for prefix in JUNCTION_PREFIXES:
        name = name.removeprefix(prefix)
    for part in (a.lower(), b.lower()):
        name = name.replace(part, "").strip("_")
    return name.upper() if len(name) >= 3 and name.isalpha() else None


def composite_keys(catalog: DataFrame) -> DataFrame:
    """table, fk_table and the columns that refer to it together."""
    return catalog.where("is_fk and fk_table is not null").groupBy("table", "fk_table").agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns"))


def inferred_catalog(tables: dict[str, DataFrame], ending: str = "key") -> DataFrame:
    """A catalogue (table, column, data_type, is_pk, is_fk, fk_table) of tables that declare no keys, from their schemas and values.

    A column is a key if it is first of its table's columns with the ending, has no nulls and no value twice. It refers to another
    table's key of the same name (prefixes such as o_ aside) if all its values stand there. One pass over each table counts;
    an anti join for each pair of columns that may refer checks the values.
    """
    spark = next(iter(tables.values())).sparkSession
    bare = lambda c: re.sub(r"^[a-z]+_", "", c)
    keys: dict[str, tuple[str, str]] = {}
    for name, df in tables.items():
        first = next((c for c in df.columns if c.endswith(ending)), None)
        if first:
            n = df.agg(F.count("*").alias("n"), F.count(first).alias("some"), F.count_distinct(first).alias("distinct")).first()
            if n["n"] == n["some"] == n["distinct"]:
                keys[bare(first)] = (name, first)
    rows = []
    for name, df in tables.items():
        for f in df.schema.fields:
            owner, column = keys.get(bare(f.name), (None, None))
            own = owner == name and column == f.name
            refers = owner is not None and not own and df.where(F.col(f.name).isNotNull()).join(tables[owner].select(F.col(column).alias("_key")), F.col(f.name) == F.col("_key"), "left_anti").isEmpty()
            rows.append((name, f.name, f.dataType.simpleString(), own, refers, owner if refers else None))
    return spark.createDataFrame(rows, "table string, column string, data_type string, is_pk boolean, is_fk boolean, fk_table string")


def mapping_rules(catalog: DataFrame) -> DataFrame:
    """table, kind, label and, for each foreign key, its type and target."""
    from lodestar.functions.columns import pascal_case

    kinds = table_kinds(catalog).withColumn("label", pascal_case(F.col("table")))
    keys = catalog.where("is_fk and fk_table is not null").select("table", "column", "fk_table", relationship_type(F.col("column"), F.col("fk_table"), F.col("table")).alias("relationship"))
    return kinds.join(keys, "table", "left")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """table, column and change (added, removed, retyped) between two catalogues (table, column, data_type)."""
    a, b = before.select("table", "column", F.col("data_type").alias("was")), after.select("table", "column", F.col("data_type").alias("is"))
    both = a.join(b, ["table", "column"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "retyped")
    return both.withColumn("change", change).where("change is not null").select("table", "column", "change")


def entity_rows(rows: DataFrame, connector: str, table: str, pk: list[str], graph_id: str, label: str) -> DataFrame:
    """A node for each row whose key isn't null: id connector:table:key, the other columns as properties."""
    rest = [c for c in rows.columns if c not in pk]
    props = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(f"`{c}`").cast("string") for c in rest])), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    node_id = F.concat_ws(":", F.lit(connector), F.lit(table), *[F.col(f"`{c}`").cast("string") for c in pk])
    return rows.dropna(subset=pk).select(F.lit(graph_id).alias("graph_id"), node_id.alias("id"), F.lit(label).alias("label"), props.alias("props"))


def key_edges(rows: DataFrame, connector: str, table: str, pk: list[str], fk: str, target: str, kind: str) -> DataFrame:
    """An edge for each row with a key and a foreign key, to the row that it refers to."""
    end = lambda t, *cs: F.concat_ws(":", F.lit(connector), F.lit(t), *[F.col(f"`{c}`").cast("string") for c in cs])
    return rows.dropna(subset=[*pk, fk]).select(end(table, *pk).alias("src"), end(target, fk).alias("dst"), F.lit(kind).alias("type"))


def junction_edges(rows: DataFrame, connector: str, a: tuple[str, str], b: tuple[str, str], kind: str) -> DataFrame:
    """An edge for each row of a junction table; a and b: (column, table that it refers to)."""
    end = lambda x: F.concat_ws(":", F.lit(connector), F.lit(x[1]), F.col(f"`{x[0]}`").cast("string"))
    return rows.dropna(subset=[a[0], b[0]]).select(end(a).alias("src"), end(b).alias("dst"), F.lit(kind).alias("type")).distinct()


def valid_type(name: str) -> str:
    """The name, if it can name a relationship."""
    if not re.fullmatch("[A-Z_][A-Z0-9_]*", name):
        raise ValueError(f"not a relationship type: {name!r}")
    return name
