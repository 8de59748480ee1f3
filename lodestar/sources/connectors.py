"""Connectors: databases by JDBC, paged REST feeds as a Python data source, a registry, guarded SQL."""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Statements that change something, which the query tool refuses.
WRITES = r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|replace|grant|revoke|call|set|refresh|load|cache|uncache)\b"


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A table of a database; with a numeric key and its bounds in so many parts at once. The driver's jar must be there."""
    if key and bounds:
        return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def catalog_from(columns: DataFrame, keys: DataFrame, foreign: DataFrame) -> DataFrame:
    """A catalogue from a database's own tables: columns (table, column, data_type), keys (table, column), foreign (table, column, fk_table, fk_column)."""
    pk = keys.select("table", "column", F.lit(True).alias("is_pk")).distinct()
    out = columns.join(pk, ["table", "column"], "left").join(foreign, ["table", "column"], "left")
    return out.withColumns({"is_pk": F.coalesce("is_pk", F.lit(False)), "is_fk": F.col("fk_table").isNotNull()})


def document_foreign_keys(fields: DataFrame) -> DataFrame:
    """Foreign keys of a document store guessed from names: field user_id refers to user. fields: table, column."""
    target = F.regexp_extract("column", "^(.+)_id$", 1)
    return fields.where((F.col("column") != "_id") & (target != "")).select("table", "column", target.alias("fk_table"))


def items(page: object, path: str) -> list:
    """The list at a dotted path of a page."""
    for part in [p for p in path.split(".") if p]:
        page = page.get(part, []) if isinstance(page, dict) else []
    return page if isinstance(page, list) else [page]


def pages(fetch: Callable[[dict], tuple[object, dict]], style: str, size: int, path: str, cursor: str | None = None) -> Iterator[list]:
    """Items page by page from fetch(parameters) -> (body, headers). style: cursor, offset, page or link."""
    at, number = 0, 1
    while True:
        params = {"cursor": {"cursor": cursor, "limit": size}, "offset": {"offset": at, "limit": size}, "page": {"page": number, "per_page": size}, "link": {"url": cursor}}[style]
        body, headers = fetch(params)
        found = items(body, path)
        if found:
            yield found
        if style == "cursor":
            cursor = body.get("next_cursor") if isinstance(body, dict) else None
        elif style == "link":
            m = re.search(r'<([^>]+)>;\s*rel="next"', headers.get("link", ""))
            cursor = m[1] if m else None
        at, number = at + len(found), number + 1
        if not found or (style in ("cursor", "link") and not cursor) or (style in ("offset", "page") and len(found) < size):
            return


class RestSource(DataSource):
    """format("lodestar_rest"): option url, or fetcher, the import path module:function of a fetch function that workers have; style, size and path as in pages()."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_rest"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema):
        return _RestReader(dict(self.options))

    def simpleStreamReader(self, schema):  # noqa: N802
        return _RestStream(dict(self.options))


def http_get(url: str, params: dict) -> tuple[object, dict]:
    """A page of a feed as JSON, and its headers in lower case. A url among the parameters, as a link header gives it, replaces the feed's."""
    own = {k: v for k, v in params.items() if v is not None and k != "url"}
    at = params.get("url") or url + ("&" if "?" in url else "?") * bool(own) + urlencode(own)
    with urlopen(at, timeout=60) as r:
        return json.load(r), {k.lower(): v for k, v in r.headers.items()}


def paced(fetch: Callable[[dict], tuple[object, dict]], rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """fetch with at most rate calls a second, one after the other; a rate of 0 sets no limit."""
    last = [float("-inf")]

    def call(params: dict) -> tuple[object, dict]:
        wait = last[0] + 1 / rate - clock() if rate > 0 else 0
        if wait > 0:
            sleep(wait)
        last[0] = clock()
        return fetch(params)

    return call


def _fetcher(options: dict) -> Callable:
    """The fetch function of the options, with option rate: requests a second."""
    if "fetcher" not in options:
        fetch = partial(http_get, options["url"])
    else:
        module, _, name = options["fetcher"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
    return paced(fetch, float(options.get("rate", 0)))


class _RestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        o = self.options
        for found in pages(_fetcher(o), o.get("style", "cursor"), int(o.get("size", 100)), o.get("path", "")):
            for x in found:
                yield (json.dumps(x),)


class _RestStream(SimpleDataSourceStreamReader):
    """The offset is the greatest value of the option watermark (a field such as updated_at) that was read."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self):  # noqa: N802
        return {"since": self.options.get("since", "")}

    def _after(self, since: str) -> list:
        o = self.options
        field = o.get("watermark", "updated_at")
        return [x for found in pages(_fetcher(o), o.get("style", "cursor"), int(o.get("size", 100)), o.get("path", "")) for x in found if str(x.get(field, "")) > since]

    def read(self, start):
        found = self._after(start["since"])
        last = max([start["since"], *[str(x.get(self.options.get("watermark", "updated_at"), "")) for x in found]])
        return iter([(json.dumps(x),) for x in found]), {"since": last}

    def readBetweenOffsets(self, start, end):  # noqa: N802
        field = self.options.get("watermark", "updated_at")
        return iter([(json.dumps(x),) for x in self._after(start["since"]) if str(x.get(field, "")) <= end["since"]])


#: Sources by name, as a function of (spark, options).
REGISTRY: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "jdbc": lambda spark, o: read_jdbc(spark, o["url"], o["table"], o.get("properties", {})),
    "rest": lambda spark, o: (spark.dataSource.register(RestSource), spark.read.format("lodestar_rest").options(**o).load())[1],
    "parquet": lambda spark, o: spark.read.parquet(o["path"]),
}


def source(spark: SparkSession, kind: str, options: dict) -> DataFrame:
    if kind not in REGISTRY:
        raise ValueError(f"no connector of kind {kind!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind](spark, options)


def guarded_sql(spark: SparkSession, query: str, views: dict[str, DataFrame], limit: int = 100, args: dict | None = None) -> DataFrame:
    """The rows of a reading query over tenant views, 100 at most. Refuses what writes and every table that isn't a view."""
    if re.search(WRITES, re.sub(r"'[^']*'", "''", query)) or ";" in query.strip().rstrip(";"):
        raise ValueError("only one reading query is allowed")
    names = {re.sub(r"`", "", n).lower() for n in re.findall(r"(?i)\b(?:from|join)\s+([`\w.]+)", query)}
    ctes = {n.lower() for n in re.findall(r"(?i)(?:\bwith|,)\s+(\w+)\s+as\s*\(", query)}
    if not names or (unknown := names - {v.lower() for v in views} - ctes):
        raise ValueError(f"tables that aren't views of this tenant: {', '.join(sorted(unknown)) if names else 'none named'}")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query.rstrip().rstrip(";"), args=args).limit(min(max(limit, 1), 100))


def flatten_properties(rows: DataFrame, column: str = "properties") -> DataFrame:
    """Pages of a workspace service: their typed properties, a JSON map, as name -> text."""
    held = F.from_json(column, "map<string,string>")
    text = lambda v: F.coalesce(F.get_json_object(v, "$.title[0].plain_text"), F.get_json_object(v, "$.rich_text[0].plain_text"), F.get_json_object(v, "$.select.name"), F.get_json_object(v, "$.date.start"), F.get_json_object(v, "$.number"), F.get_json_object(v, "$.checkbox"), F.get_json_object(v, "$.url"))
    return rows.withColumn(column, F.transform_values(held, lambda _, v: text(v)))
