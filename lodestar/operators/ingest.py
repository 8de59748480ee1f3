"""Ingest of JSON records as nodes and edges: names checked, each record's fault counted, targets as nodes of their own."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """A field whose value, or each value of a list, is the id of a target node."""

    field: str
    label: str
    type: str


def check_names(label: str, links: list[Link]) -> None:
    """ValueError for a label that isn't letters, digits and underscores or a type that isn't capitals, digits and underscores."""
    for name in (label, *[x.label for x in links]):
        if not name.replace("_", "").isalnum():
            raise ValueError(f"not a label: {name!r}")
    for x in links:
        if not re.fullmatch("[A-Z][A-Z0-9_]*", x.type):
            raise ValueError(f"not a type: {x.type!r}")


#: Types of variants that an id may have: text, truth value, whole number.
ID_TYPES = r"^(STRING|BOOLEAN|BIGINT|DECIMAL\(\d+,0\))$"


def _text(v: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _ident(v: Column, kind: Column) -> Column:
    """A text, a whole number as its digits, a truth value as True or False."""
    return F.when(kind == "BOOLEAN", F.initcap(F.to_json(v))).otherwise(_text(v, kind))


def records(rows: DataFrame, label: str, links: list[Link] | None = None, id_field: str = "id", column: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (id, label, props, stub), edges (src, type, dst, count) and faults (reason, n) of records, a JSON text in a column each.

    not_json: no JSON, or null. not_a_dict: JSON, but no object. missing_or_invalid_id: no id, or one that is neither text, whole number
    nor truth value. Such records are left out and counted. Of several records of an id the values of the greatest text win, field by
    field nothing is mixed. Properties are texts: strings as they are, everything else as JSON, null fields left out, id left out.
    Targets are texts or whole numbers, not empty; a target that is no record becomes a node with stub true. An edge counts how often
    it was named. Everything is done on variants in the JVM; the
    parsed value stands behind an explode of one, past which Spark pushes no filter, so a text is parsed once and not for every mention.
    """
    links = links or []
    check_names(label, links)
    if re.search(r"['\\\[\]]", id_field + "".join(x.field for x in links)):
        raise ValueError("field names may not hold quotes, brackets or backslashes")
    field = lambda name: F.try_variant_get("_v", f"$['{name}']", "variant")
    once = lambda v: F.explode(F.array(v))
    typed = rows.select(F.col(column).alias("_text"), once(F.try_parse_json(column)).alias("_v")).withColumn("_t", F.schema_of_variant("_v"))
    typed = typed.withColumn("_i", F.when(F.col("_t").startswith("OBJECT"), field(id_field)))
    typed = typed.select("*", once(F.schema_of_variant("_i")).alias("_it"))
    fault = F.when(F.col("_v").isNull(), "not_json").when(~F.col("_t").startswith("OBJECT"), "not_a_dict").when(~F.coalesce(F.col("_it").rlike(ID_TYPES), F.lit(False)), "missing_or_invalid_id")
    judged = typed.withColumn("_fault", fault)
    faults = judged.where("_fault is not null").groupBy(F.col("_fault").alias("reason")).agg(F.count("*").alias("n"))
    good = judged.where("_fault is null").withColumn("id", _ident(F.col("_i"), F.col("_it")))

    one = good.groupBy("id").agg(F.max("_text").alias("_text")).select("id", once(F.try_parse_json("_text")).alias("_v"))
    there = lambda k, v: (k != "id") & (F.coalesce(F.schema_of_variant(v), F.lit("VOID")) != "VOID")
    fields = F.map_filter(F.try_variant_get("_v", "$", "map<string,variant>"), there)
    nodes = one.select("id", F.lit(label).alias("label"), F.transform_values(fields, lambda _, v: _text(v, F.schema_of_variant(v))).alias("props"), F.lit(False).alias("stub"))

    ends = []
    for x in links:
        v = field(x.field)
        each = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
        part = good.select("id", F.explode(each).alias("_d")).withColumn("_dt", F.schema_of_variant("_d")).where(F.col("_dt").rlike(ID_TYPES))
        ends.append(part.select(F.col("id").alias("src"), F.lit(x.type).alias("type"), _ident(F.col("_d"), F.col("_dt")).alias("dst"), F.lit(x.label).alias("to_label")).where("dst <> ''"))
    if not ends:
        return nodes, rows.sparkSession.createDataFrame([], "src string, type string, dst string, to_label string, count long"), faults
    edges = reduce(DataFrame.unionByName, ends).groupBy("src", "type", "dst", "to_label").agg(F.count("*").alias("count"))
    targets = edges.select(F.col("dst").alias("id"), F.col("to_label").alias("label")).distinct()
    stubs = targets.join(nodes.select("id", "label"), ["id", "label"], "left_anti")
    return nodes.unionByName(stubs.select("id", "label", F.create_map().cast("map<string,string>").alias("props"), F.lit(True).alias("stub"))), edges, faults
