"""A parsed repository as a graph: nodes by label, edges between symbols, files and packages, and what a new parse leaves stale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.graph import both_ends
from lodestar.operators.traverse import held as kept

#: The labels of a code graph.
LABELS = {"class": "Class", "function": "Function"}
FILE, MODULE, PACKAGE = "File", "CodeModule", "Dependency"
#: Rows up to which a counted side is sent to all tasks.
FEW = 10_000


def _sent(rows: DataFrame, few: bool) -> DataFrame:
    """The side of a join to be sent to all tasks if its rows were counted and are few, else never: from files' sizes Spark takes millions of names for little."""
    return F.broadcast(rows) if few else rows.hint("merge")


def _last(name: str) -> Column:
    return F.element_at(F.split(name, "\\."), -1)


def resolved(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """uses (src, name, place) with dst: the symbol (qualified_name) of that whole name, else the first whose name ends with .name.

    Suffixes meet by their last part, and each distinct name is resolved once however often it is used: a name that a third of all
    uses have is one row in the search. Names that nothing has are left out.
    """
    known = symbols.select("qualified_name").distinct()
    names = kept(uses.select("name").distinct())
    few = names.count() <= FEW
    exact = known.join(_sent(names, few), names["name"] == known["qualified_name"]).select("name", F.col("qualified_name").alias("dst"))
    exact = kept(exact)
    rest = names.join(_sent(exact, few), "name", "left_anti").withColumn("last", _last("name"))
    near = known.withColumn("last", _last("qualified_name")).join(_sent(rest, few), "last").where(F.endswith("qualified_name", F.concat(F.lit("."), "name")))
    found = exact.unionByName(near.groupBy("name").agg(F.min("qualified_name").alias("dst")))
    return uses.join(_sent(found, few), "name")


def graph(files: DataFrame, symbols: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, props) and edges (src, type, dst, props) of a parse.

    files: path, language, content_hash. symbols: the rows of files.extract_symbols. dependencies: name, version. Symbols are
    CodeModule (modules that import something), Class and Function; DEFINED_IN leads to the file with the lines, METHOD_OF from a
    function to the class that it stands in, IMPORTS from a file to a module of the repository or else to a package, INHERITS (with the
    place among the bases) and CALLS to the symbols that are meant, the latter with their number of names that led there. An import
    that no manifest lists makes a package of its own. Repeated rows count once; a null name or path gives no node.
    """
    text = lambda **of: F.map_filter(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    once = symbols.where("path is not null and qualified_name is not null")
    once = once.withColumn("_k", F.row_number().over(W.partitionBy("qualified_name", "kind").orderBy("path", "line"))).where("_k = 1").drop("_k")
    once = kept(once)  # files are parsed once
    named = once.where(F.col("kind").isin(*LABELS))
    uses = once.select("path", "kind", F.col("qualified_name").alias("src"), F.posexplode("edges").alias("place", "e")).select("path", "kind", "src", "place", F.col("e.type").alias("type"), F.col("e.dst").alias("name")).where("name is not null and name <> ''")

    modules = once.where("kind = 'module'")
    imports = uses.where("type = 'IMPORTS'").select("path", "name").distinct()
    # Each imported name is looked up once, however many files import it
    asked = kept(imports.select("name").distinct())
    few = asked.count() <= FEW
    own_names = kept(modules.select(F.col("qualified_name").alias("name")).join(_sent(asked, few), "name", "left_semi"))
    internal = imports.join(_sent(own_names, few), "name", "left_semi")
    external = imports.join(_sent(own_names, few), "name", "left_anti")
    importing = modules.where(F.exists("edges", lambda e: e["type"] == "IMPORTS")).select("qualified_name", "language").unionByName(
        modules.join(_sent(own_names.withColumnRenamed("name", "qualified_name"), few), "qualified_name", "left_semi").select("qualified_name", "language")).distinct()

    listed = dependencies.where("name is not null").groupBy("name").agg(F.max("version").alias("version"))
    packages = listed.join(external.select("name").distinct().withColumn("used", F.lit(True)), "name", "full").select("name", F.coalesce("version", F.lit("")).alias("version"))
    node = lambda rows, ident, label, props: rows.select(ident.alias("id"), label.alias("label"), props.alias("props"))
    held = files.where("path is not null").groupBy("path").agg(F.max("language").alias("language"), F.max("content_hash").alias("content_hash"))
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("kind")]
    nodes = [
        node(held, F.concat(F.lit("file:"), "path"), F.lit(FILE), text(language=F.col("language"), content_hash=F.col("content_hash"))),
        node(importing, F.concat(F.lit("module:"), "qualified_name"), F.lit(MODULE), text(language=F.col("language"))),
        node(packages, F.concat(F.lit("package:"), "name"), F.lit(PACKAGE), text(version=F.col("version"))),
        node(named, F.concat(F.col("kind"), F.lit(":"), "qualified_name"), label, text(language=F.col("language"), line=F.col("line"), end_line=F.col("end_line"), path=F.col("path"))),
    ]
    edge = lambda rows, src, kind, dst, props: rows.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"), props.alias("props"))
    own = F.concat(F.col("kind"), F.lit(":"), "qualified_name")
    at = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column))
    inside = named.where("kind = 'function'").join(named.where("kind = 'class'").select(F.col("qualified_name").alias("parent")).distinct().hint("merge"), "parent", "left_semi")
    bases = resolved(uses.where("type = 'INHERITS' and kind = 'class'"), named.where("kind = 'class'")).groupBy("src", "dst").agg(F.min("place").alias("place"))
    calls = resolved(uses.where("type = 'CALLS' and kind = 'function'"), named.where("kind = 'function'")).groupBy("src", "dst").agg(F.count_distinct("name").alias("n"))
    none = F.create_map().cast("map<string,string>")
    edges = [
        edge(named.join(held.select("path").hint("merge"), "path", "left_semi"), own, "DEFINED_IN", at("file", "path"), text(line=F.col("line"), end_line=F.col("end_line"))),
        edge(inside, own, "METHOD_OF", at("class", "parent"), none),
        edge(internal, at("file", "path"), "IMPORTS", at("module", "name"), none),
        edge(external, at("file", "path"), "IMPORTS", at("package", "name"), none),
        edge(bases, at("class", "src"), "INHERITS", at("class", "dst"), text(place=F.col("place"))),
        edge(calls, at("function", "src"), "CALLS", at("function", "dst"), text(names=F.col("n"))),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def merged(stored: DataFrame, parsed: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Stored code nodes (id, label, props, stale_at) after a parse of files (path, with content or gone).

    Parsed nodes are current and their properties win. Symbols of those files that the parse didn't find get stale_at, which one that is
    stale already keeps; symbols of other files, modules and packages stay as they are.
    """
    empty = F.create_map().cast("map<string,string>")
    new = parsed.dropDuplicates(["id"]).select("id", F.col("label").alias("l1"), F.coalesce("props", empty).alias("p1"), F.lit(True).alias("_found"))
    both = stored.select("id", F.col("label").alias("l0"), F.coalesce("props", empty).alias("p0"), "stale_at").join(new, "id", "full")
    visited = files.select(F.col("path").alias("_path"), F.lit(True).alias("_visited")).where("_path is not null").distinct()
    both = both.withColumn("_path", F.col("p0")["path"]).join(visited, "_path", "left")
    p0, p1 = F.coalesce("p0", empty), F.coalesce("p1", empty)
    props = F.map_concat(F.map_filter(p0, lambda k, _: ~F.array_contains(F.map_keys(p1), k)), p1)
    stale = F.when(F.col("_found"), F.lit(None)).when(F.coalesce("_visited", F.lit(False)) & F.coalesce("l0", F.lit("")).isin(*LABELS.values()), F.coalesce("stale_at", now)).otherwise(F.col("stale_at"))
    return both.select("id", F.coalesce("l1", "l0").alias("label"), props.alias("props"), stale.cast("timestamp").alias("stale_at"))


def expired(nodes: DataFrame, edges: DataFrame, now: Column, ttl_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Both tables without the classes and functions (id, label, stale_at) that are stale for longer than the time to live, and the edges at them."""
    gone = F.col("label").isin(*LABELS.values()) & (F.col("stale_at") < now - F.expr(f"INTERVAL {int(ttl_days)} DAYS"))
    live = nodes.where(~F.coalesce(gone, F.lit(False)))
    return live, both_ends(edges, live)


def semantic_search(symbols: DataFrame, query: list[float] | Column, n: int = 10) -> DataFrame:
    """Functions (id, label, embedding) nearest to a query's vector: id, score. Other labels and symbols without a vector take no part."""
    from lodestar.operators.retrieval import vector_topk

    return vector_topk(symbols.where((F.col("label") == "Function") & F.col("embedding").isNotNull()), query, "id", n)
