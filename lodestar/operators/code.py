"""Queries over a code graph: callers, dead code, cycles, inheritance, dependencies, data flow, symbols, deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators import traverse

#: What marks a function as an entry point for outside data.
TAINT_NAMES, TAINT_DECORATORS = r"(?i)(view|handler|endpoint|route|request)", r"(?i)(app\.route|router\.|api_view)"


def callers(edges: DataFrame, name: str, callees: bool = False, limit: int = 100) -> DataFrame:
    """Functions that call name, or that it calls."""
    near, far = ("src", "dst") if callees else ("dst", "src")
    return edges.where((F.col("type") == "CALLS") & (F.col(near) == name)).select(F.col(far).alias("symbol")).distinct().orderBy("symbol").limit(limit)


def dead_code(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions (qualified_name, kind, is_test) that nothing calls, without tests, main and dunder names."""
    short = F.element_at(F.split("qualified_name", "\\."), -1)
    free = symbols.where((F.col("kind") == "function") & ~F.coalesce("is_test", F.lit(False))).withColumn("short", short)
    free = free.where(~F.col("short").startswith("__") & ~F.col("short").startswith("test_") & (F.col("short") != "main"))
    return free.join(edges.where("type = 'CALLS'").select(F.col("dst").alias("qualified_name")), "qualified_name", "left_anti").drop("short")


def circular_imports(edges: DataFrame, longest: int = 10) -> DataFrame:
    return traverse.cycles(edges.where("type = 'IMPORTS'"), longest).orderBy("hops", "path")


def inheritance(edges: DataFrame, name: str) -> DataFrame:
    return traverse.chain(edges.where("type = 'INHERITS'"), name)


def file_dependencies(edges: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """What a file imports: modules of the repository or packages from outside."""
    own = edges.where((F.col("type") == "IMPORTS") & (F.col("src") == path)).select(F.col("dst").alias("qualified_name")).distinct()
    kind = F.when(F.col("kind") == "module", "module").otherwise("external")
    return own.join(symbols.select("qualified_name", "kind"), "qualified_name", "left").select("qualified_name", kind.alias("target")).orderBy("qualified_name")


def data_flow(edges: DataFrame, name: str, direction: str = "forward", depth: int = 10) -> DataFrame:
    """Paths along FLOWS_TO from a symbol, to it, or both; depth within 1..50."""
    flows, depth = edges.where("type = 'FLOWS_TO'").select("src", "dst"), min(max(depth, 1), 50)
    start = edges.sparkSession.createDataFrame([(name,)], "id string")
    ahead = traverse.paths(flows, start, depth).withColumn("direction", F.lit("forward"))
    back = traverse.paths(flows.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth).withColumn("direction", F.lit("backward"))
    return {"forward": ahead, "backward": back, "both": ahead.unionByName(back)}[direction]


def taint_trace(edges: DataFrame, sources: DataFrame, depth: int = 10) -> DataFrame:
    return traverse.reach(edges, sources, depth, kind="FLOWS_TO", directed=True, most=50)


def is_taint_source(name: Column, decorators: Column) -> Column:
    return name.rlike(TAINT_NAMES) | F.exists(decorators, lambda d: d.rlike(TAINT_DECORATORS))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (caller, callee text) with the symbol that is meant: the exact name, else the first that ends with .callee.

    The second join is on the last part of the name, so it is an equi-join too.
    """
    last = lambda c: F.element_at(F.split(c, "\\."), -1)
    names = symbols.select("qualified_name").distinct()
    exact = calls.join(names, calls["callee"] == names["qualified_name"]).select("caller", "callee", "qualified_name")
    rest = calls.join(names, calls["callee"] == names["qualified_name"], "left_anti").withColumn("last", last("callee"))
    near = rest.join(names.withColumn("last", last("qualified_name")), "last").where(F.col("qualified_name").endswith(F.concat(F.lit("."), F.col("callee"))))
    first = near.withColumn("k", F.row_number().over(W.partitionBy("caller", "callee").orderBy("qualified_name"))).where("k = 1").select("caller", "callee", "qualified_name")
    return exact.unionByName(first)


def symbols_page(symbols: DataFrame, kind: str | None = None, language: str | None = None, text: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Symbols by filters, all of them conditions on every row, with the total."""
    from lodestar.operators.access import page

    own = symbols
    for column, value in (("kind", kind), ("language", language)):
        own = own.where(F.col(column) == value) if value else own
    if text:
        own = own.where(F.lower("qualified_name").contains(text.lower()))
    return page(own, [F.col("qualified_name")], offset, limit)


def file_delta(files: DataFrame, stored: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """by and status (new, changed, unchanged, removed) by the hashes of files (by, content_hash). by tells the files of a side apart: paths,
    or other columns too where several files have one path. A null path is one too, and a file with a null hash is there."""
    side = lambda df, mark, value: df.select(*[F.col(c).alias(f"{mark}{c}") for c in by], F.col("content_hash").alias(value), F.lit(True).alias(f"has_{value}"))
    a, b = side(files, "a_", "now"), side(stored, "b_", "was")
    same = reduce(Column.__and__, [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in by])
    status = F.when(F.col("has_was").isNull(), "new").when(F.col("has_now").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("was")), "unchanged").otherwise("changed")
    key = lambda c: F.when(F.col("has_now").isNull(), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c)
    return a.join(b, same, "full").select(*[key(c) for c in by], status.alias("status"))
