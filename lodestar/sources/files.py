"""File sources: delimited text, JSON, Markdown, source code, manifests. Files are read by Spark, so any store it knows will do."""

from __future__ import annotations

import ast
import csv
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.columns import type_name
from lodestar.sources import declarations

DATES = ["^\\d{4}-\\d{2}-\\d{2}$", "^\\d{1,2}/\\d{1,2}/\\d{4}$", "^\\d{1,2}-\\d{1,2}-\\d{4}$", "^\\d{4}/\\d{1,2}/\\d{1,2}$"]
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".java": "java"}
#: Folders that aren't walked, besides those whose names begin with a dot.
SKIPPED = ["node_modules", "__pycache__", "venv", ".venv"]


def delimiter(spark: SparkSession, path: str) -> str:
    """Of a delimited file, by its ending or its first lines; a comma where they don't tell."""
    if path.lower().endswith(".tsv"):
        return "\t"
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())[:4096]  # twenty lines
    try:
        return csv.Sniffer().sniff(head, delimiters=",\t;|").delimiter
    except csv.Error:
        return ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return spark.read.csv(path, header=True, sep=delimiter(spark, path), inferSchema=False, quote='"', escape='"', multiLine=True)


def delimited_schema(rows: DataFrame, sample: int = 100) -> DataFrame:
    """column and type (bool, int, float, date, str) from the first rows. Bool goes first, so a column of 0 and 1 is bool."""
    few = rows.limit(sample)
    long = few.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias("v")) for i, c in enumerate(rows.columns)])).alias("e")).select("e.*")
    every = lambda ok: F.coalesce(F.bool_and(F.when(F.col("v") != "", ok)), F.lit(False))
    isdate = F.lit(False)
    for p in DATES:
        isdate = isdate | F.col("v").rlike(p)
    kind = F.when(every(F.lower("v").isin("true", "false", "yes", "no", "1", "0")), "bool").when(every(F.col("v").rlike("^[+-]?\\d+$")), "int").when(every(F.expr("try_cast(v as double)").isNotNull()), "float").when(every(isdate), "date").otherwise("str")
    return long.groupBy("at", "column").agg(kind.alias("type")).orderBy("at").select("column", "type")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One column, value: a JSON text for each line of JSON Lines, each item of an array, or the object that a file is."""
    lines = spark.read.text(path)
    if path.lower().endswith((".jsonl", ".ndjson")):
        return lines.where(F.trim("value") != "")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<variant>").alias("a"), "value")
    many = whole.where(F.ltrim("value").startswith("["))
    one = whole.where(~F.ltrim("value").startswith("["))
    return many.select(F.explode("a").alias("v")).select(F.to_json("v").alias("value")).unionByName(one.select("value"))


def json_schema(value: Any) -> Any:
    """The shape of a JSON value: names of types, objects by key, arrays by what their first ten items share; first seen wins."""
    if isinstance(value, dict):
        return {k: json_schema(v) for k, v in value.items()}
    if isinstance(value, list):
        items = [json_schema(v) for v in value[:10]]
        if not items:
            return {"type": "array", "items": "unknown"}
        if all(isinstance(i, dict) for i in items):
            merged: dict[str, Any] = {}
            for i in items:
                merged = i | merged
            return {"type": "array", "items": merged}
        return {"type": "array", "items": items[0] if len({json.dumps(i) for i in items}) == 1 else "mixed"}
    return {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string"}[type(value)]


def json_profile(rows: DataFrame, column: str) -> DataFrame:
    """property, type and frequency of the top-level fields of JSON texts, in the JVM."""
    pairs = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("property", "v"))
    return pairs.groupBy("property", type_name(F.col("v")).alias("value_type")).agg(F.count("*").alias("frequency"))


def markdown_sections(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Sections of Markdown texts: key, at (line), level, heading, parent, its line and content. The parent is the last heading of a smaller level."""
    lines = docs.select(key, F.posexplode(F.split(column, "\n")).alias("at", "line"))
    level = F.length(F.regexp_extract("line", "^(#{1,6})\\s+(.+?)\\s*$", 1))
    lines = lines.withColumn("level", F.when(level > 0, level)).withColumn("heading", F.when(level > 0, F.regexp_extract("line", "^(#{1,6})\\s+(.+?)\\s*$", 2)))
    order = W.partitionBy(key).orderBy("at")
    lines = lines.withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(order))
    body = lines.where("level is null and section > 0").groupBy(key, "section").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line), "\n"), F.lit(" \n\t\r")).alias("content"))
    heads = lines.where("level is not null")
    for n in range(1, 6):
        # The last heading of level n counts if no heading above n came after it
        last = F.last(F.when(F.col("level") <= n, F.struct("level", "heading", "at")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
        heads = heads.withColumn(f"l{n}", last)
    parent = lambda what: F.coalesce(*[F.when((F.col("level") == n + 1), F.col(f"l{n}.{what}")) for n in range(1, 6)])
    heads = heads.withColumns({"parent": parent("heading"), "parent_at": parent("at")})
    return heads.join(body, [key, "section"], "left").select(key, "at", "level", "heading", "parent", "parent_at", F.coalesce("content", F.lit("")).alias("content"))


def code_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """path, language, content_hash and content of the source files under a folder, without the folders of tools and dependencies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ending = F.regexp_extract("path", "(\\.[A-Za-z]+)$", 1)
    language = F.coalesce(*[F.when(ending == e, v) for e, v in LANGUAGES.items()])
    keep = language.isNotNull()
    below = F.expr(f"substring_index(path, '{root.rstrip('/').rsplit('/', 1)[-1]}/', -1)")  # what lies above the root doesn't count
    keep = keep & ~F.concat(F.lit("/"), below).rlike("/\\.[^/]+/")
    for name in SKIPPED:
        keep = keep & ~F.concat(F.lit("/"), below).contains(f"/{name}/")
    for glob in exclude or []:
        keep = keep & ~F.col("path").rlike(re.escape(glob).replace("\\*", ".*").replace("\\?", ".") + "$")
    return files.where(keep).select("path", language.alias("language"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"))


def manifest(path: str, text: str) -> list[tuple[str, str]]:
    """Names and versions of a dependency manifest."""
    if path.endswith("package.json"):
        found = json.loads(text)
        return sorted((found.get("dependencies", {}) | found.get("devDependencies", {})).items())
    if path.endswith("go.mod"):
        return sorted(re.findall(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v[\w.+-]+)", text, re.MULTILINE))
    if path.endswith("pom.xml"):
        return sorted(re.findall(r"<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>", text))
    return sorted((m[1], m[2] or "") for m in re.finditer(r"^([A-Za-z0-9_.-]+)\s*(?:\[[^\]]*\])?\s*([=<>!~][^#\s;]*)?", text, re.MULTILINE))


SYMBOLS = "path string, language string, qualified_name string, kind string, line int, end_line int, parent string, decorators array<string>, edges array<struct<type:string,dst:string>>"

def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else _dotted(node.func) if isinstance(node, ast.Call) else ""


def python_symbols(path: str, text: str) -> list[tuple]:
    """Modules, classes and functions of a Python file with what they import, inherit, call and let flow."""
    module = re.sub(r"\.py$", "", path).strip("/").replace("/", ".")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [(path, "python", module, "module", 1, text.count("\n") + 1, None, [], [])]
    imports = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [("IMPORTS", a.name) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports.append(("IMPORTS", n.module or ""))
    out = [(path, "python", module, "module", 1, text.count("\n") + 1, None, [], sorted(set(imports)))]

    def visit(body: list[ast.stmt], owner: str) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                out.append((path, "python", f"{owner}.{n.name}", "class", n.lineno, n.end_lineno, owner, [_dotted(d) for d in n.decorator_list], [("INHERITS", _dotted(b)) for b in n.bases]))
                visit(n.body, f"{owner}.{n.name}")
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                name = f"{owner}.{n.name}"
                calls = sorted({("CALLS", _dotted(c.func)) for c in ast.walk(n) if isinstance(c, ast.Call) and _dotted(c.func)})
                out.append((path, "python", name, "function", n.lineno, n.end_lineno, owner, [_dotted(d) for d in n.decorator_list], calls + flows(n)))
                visit(n.body, name)

    visit(tree.body, module)
    return out


def flows(function: ast.AST) -> list[tuple[str, str]]:
    """Data flow inside a function as FLOWS_TO edges named from>to: into assigned names, into the return value, into arguments of calls."""
    found = set()
    names = lambda n: {x.id for x in ast.walk(n) if isinstance(x, ast.Name)}
    for n in ast.walk(function):
        if isinstance(n, ast.Assign):
            found |= {(a, b) for t in n.targets for b in names(t) for a in names(n.value)}
        elif isinstance(n, ast.AugAssign | ast.AnnAssign) and n.value is not None:
            found |= {(a, b) for b in names(n.target) for a in names(n.value)}
        elif isinstance(n, ast.Return) and n.value is not None:
            found |= {(a, "return") for a in names(n.value)}
        elif isinstance(n, ast.Call) and _dotted(n.func):
            found |= {(a, f"{_dotted(n.func)}()") for x in [*n.args, *[k.value for k in n.keywords]] for a in names(x)}
    return sorted(("FLOWS_TO", f"{a}>{b}") for a, b in found if a != b)


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of source files (path, language, content); each file is parsed in the task that has it. A null content is an empty file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [r for p, lang, t in zip(df.path, df.language, df.content.fillna(""), strict=True) for r in (python_symbols(p, t) if lang == "python" else declarations.symbols(p, lang, t))]
            made = pd.DataFrame(rows, columns=["path", "language", "qualified_name", "kind", "line", "end_line", "parent", "decorators", "edges"])
            made["edges"] = [[{"type": a, "dst": b} for a, b in e] for e in made.edges]
            yield made

    return files.select("path", "language", "content").mapInPandas(run, SYMBOLS)


def to_documents(rows: DataFrame, source: str) -> DataFrame:
    """A text for each row: name: value lines of the columns that have a value."""
    lines = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in rows.columns]
    return rows.select(F.concat_ws("\n", *lines).alias("text"), F.lit(source).alias("source"))


def read_documents(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Texts of a path by kind (csv, json, markdown, text), told from its ending if not given; binary kinds need a parser that is given as a function of bytes."""
    kind = kind or {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "md": "markdown"}.get(path.rsplit(".", 1)[-1].lower(), "text")
    if kind == "csv":
        return to_documents(read_delimited(spark, path), path)
    if kind == "json":
        return read_json(spark, path).select(F.col("value").alias("text"), F.lit(path).alias("source"))
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.lit(path).alias("source"))


def read_binary(spark: SparkSession, path: str, parser) -> DataFrame:
    """path and text of binary files (PDF, DOCX, images) by a parser: bytes -> text. Parsers run in the tasks; none is built in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"path": df.path, "text": [parser(bytes(c)) for c in df.content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")
