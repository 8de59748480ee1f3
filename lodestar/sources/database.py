"""Relational and document databases as Spark sources: catalogues by introspection, key ranges read at once, filters and columns pushed down, samples.

Any module with the DB-API will do. SQLite describes itself by pragmas, servers by their information schema; the driver must be
installed where the tasks run. A table is read in ranges of its numeric key, each by a task of its own with one cursor, in batches,
so no task holds a table; a table without such a key is one range. Filters that the database can apply go into its statement as
parameters, and only the columns that the reader was asked for are fetched.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, LongType, MapType, NullType, StringType, StructField, StructType, TimestampType

from lodestar.sources.connectors import REGISTRY, catalog_from, document_foreign_keys

#: Rows that a cursor gives at once.
FETCH = 2000


@dataclass(frozen=True)
class Database:
    """How to reach a database: a DB-API module, its arguments, and a schema for servers that have several."""

    module: str
    arguments: dict[str, Any]
    schema: str = "public"

    def connect(self):
        return importlib.import_module(self.module).connect(**self.arguments)

    @property
    def lite(self) -> bool:
        return self.module == "sqlite3"

    @property
    def mark(self) -> str:
        return {"qmark": "?", "format": "%s", "pyformat": "%s"}[importlib.import_module(self.module).paramstyle]

    def quoted(self, name: str) -> str:
        mark = "`" if "mysql" in self.module.lower() else '"'
        return mark + name.replace(mark, mark * 2) + mark

    def rows(self, statement: str, parameters: tuple = ()) -> list[tuple]:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(statement, parameters)
            return list(cursor.fetchall())
        finally:
            connection.close()


def introspect(spark: SparkSession, db: Database) -> DataFrame:
    """A catalogue (table, column, data_type, is_pk, is_fk, fk_table, fk_column) from what the database says of itself. Only names and types are read."""
    if db.lite:
        tables = [r[0] for r in db.rows("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        columns, keys, foreign = [], [], []
        for t in tables:
            for _, name, kind, _, _, pk in db.rows("SELECT * FROM pragma_table_info(?)", (t,)):
                columns.append((t, name, kind.lower()))
                if pk:
                    keys.append((t, name))
            foreign += [(t, r[3], r[2], r[4] or next((c for u, c in keys if u == r[2]), None)) for r in db.rows("SELECT * FROM pragma_foreign_key_list(?)", (t,))]
    else:
        m = db.mark
        columns = db.rows(f"SELECT table_name, column_name, data_type FROM information_schema.columns WHERE table_schema = {m} ORDER BY table_name, ordinal_position", (db.schema,))
        used = "SELECT k.table_name, k.column_name FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name"
        keys = db.rows(f"{used} WHERE c.constraint_type = 'PRIMARY KEY' AND c.table_schema = {m}", (db.schema,))
        foreign = db.rows(
            "SELECT k.table_name, k.column_name, p.table_name, p.column_name FROM information_schema.referential_constraints r "
            "JOIN information_schema.key_column_usage k ON k.constraint_name = r.constraint_name AND k.constraint_schema = r.constraint_schema "
            "JOIN information_schema.key_column_usage p ON p.constraint_name = r.unique_constraint_name AND p.constraint_schema = r.unique_constraint_schema AND p.ordinal_position = k.position_in_unique_constraint "
            f"WHERE r.constraint_schema = {m}",
            (db.schema,),
        )
    made = lambda rows, names: spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` string" for n in names))
    return catalog_from(made(columns, ["table", "column", "data_type"]), made(keys, ["table", "column"]), made(foreign, ["table", "column", "fk_table", "fk_column"]))


def spark_type(kind: str) -> DataType:
    """A database's type by its name, as SQLite judges affinity and servers name theirs."""
    k = kind.lower()
    if "bool" in k:
        return BooleanType()
    if "int" in k or "serial" in k:
        return LongType()
    if "timestamp" in k or "datetime" in k:
        return TimestampType()
    if k.startswith("date"):
        return DateType()
    if "numeric" in k or "decimal" in k:
        return DecimalType(38, 10)
    if "real" in k or "floa" in k or "doub" in k:
        return DoubleType()
    return BinaryType() if "blob" in k or "bytea" in k else StringType()


@dataclass
class KeyRange(InputPartition):
    """Keys from low on, below high; None: no end. nulls: rows whose key is null as well."""

    low: int | None = None
    high: int | None = None
    nulls: bool = False


class TableReader(DataSourceReader):
    SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, db: Database, table: str, schema: StructType, key: str | None, parts: int) -> None:
        self.db, self.table, self.schema, self.key, self.parts = db, table, schema, key, parts
        self.where: list[str] = []
        self.parameters: list[Any] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what the database judges as Spark does: comparisons of numbers and equality of texts; the rest goes back."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            kind = self.schema[name].dataType if name in self.schema.names else None
            column = self.db.quoted(name) if kind is not None else ""
            plain = isinstance(kind, LongType | DoubleType) or (isinstance(kind, StringType) and isinstance(f, EqualTo | In))
            if type(f) in self.SIGNS and plain and not isinstance(f.value, bool):
                self.where.append(f"{column} {self.SIGNS[type(f)]} {self.db.mark}")
                self.parameters.append(f.value)
            elif isinstance(f, In) and plain and f.value:
                self.where.append(f"{column} IN ({', '.join([self.db.mark] * len(f.value))})")
                self.parameters += f.value
            elif isinstance(f, IsNull | IsNotNull) and kind is not None:
                self.where.append(f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL")
            else:
                yield f

    def partitions(self) -> list[KeyRange]:
        if self.key is None:
            return [KeyRange()]
        key = self.db.quoted(self.key)
        low, high = self.db.rows(f"SELECT min({key}), max({key}) FROM {self.db.quoted(self.table)}")[0]
        if low is None or self.parts < 2:
            return [KeyRange(nulls=True)]
        step = max(1, -(-(high - low + 1) // self.parts))
        begins = list(range(low, high + 1, step))
        return [KeyRange(a if k else None, a + step if k < len(begins) - 1 else None, k == 0) for k, a in enumerate(begins)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        where, parameters = list(self.where), list(self.parameters)
        if self.key is not None:
            key, ends = self.db.quoted(self.key), []
            for sign, end in ((">=", partition.low), ("<", partition.high)):
                if end is not None:
                    ends.append(f"{key} {sign} {self.db.mark}")
                    parameters.append(end)
            if ends:
                where.append(f"({' AND '.join(ends)}{f' OR {key} IS NULL' if partition.nulls else ''})")
        statement = f"SELECT {', '.join(map(self.db.quoted, self.schema.names))} FROM {self.db.quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        connection = self.db.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(statement, tuple(parameters))
            while rows := cursor.fetchmany(FETCH):
                yield from (tuple(self._value(v, f.dataType) for v, f in zip(r, self.schema.fields, strict=True)) for r in rows)
        finally:
            connection.close()

    @staticmethod
    def _value(v: Any, kind: DataType) -> Any:
        """What a database without strict types gives, as the column's type, or null where it is no such thing."""
        from datetime import date, datetime
        from decimal import Decimal

        if v is None:
            return None
        try:
            if isinstance(kind, StringType):
                return v if isinstance(v, str) else str(v)
            if isinstance(kind, BooleanType):
                return bool(v)
            if isinstance(kind, LongType):
                return int(v)
            if isinstance(kind, DoubleType):
                return float(v)
            if isinstance(kind, DecimalType):
                return Decimal(str(v))
            if isinstance(kind, TimestampType):
                return v if isinstance(v, datetime) else datetime.fromisoformat(v)
            if isinstance(kind, DateType):
                return v if isinstance(v, date) else date.fromisoformat(v[:10])
            return bytes(v)
        except (ValueError, ArithmeticError, TypeError):
            return None


class DatabaseSource(DataSource):
    """Options: module, arguments (JSON), schema, table, columns (comma-joined; all without), key, parts."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_database"

    def _db(self) -> Database:
        return Database(self.options["module"], json.loads(self.options["arguments"]), self.options.get("schema", "public"))

    def schema(self) -> StructType:
        db, table = self._db(), self.options["table"]
        if db.lite:
            found = [(r[1], r[2]) for r in db.rows("SELECT * FROM pragma_table_info(?)", (table,))]
        else:
            found = db.rows(f"SELECT column_name, data_type FROM information_schema.columns WHERE table_schema = {db.mark} AND table_name = {db.mark} ORDER BY ordinal_position", (db.schema, table))
        if not found:
            raise ValueError(f"no table {table!r}")
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or [c for c, _ in found]
        kinds = dict(found)
        return StructType([StructField(c, spark_type(kinds[c])) for c in wanted])

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(self._db(), self.options["table"], schema, self.options.get("key"), int(self.options.get("parts", 8)))


def read_table(spark: SparkSession, db: Database, table: str, columns: list[str] | None = None, key: str | None = None, parts: int = 8) -> DataFrame:
    """A table of a database. key: a numeric column whose range is cut in parts, each read by a task. columns: those to fetch."""
    spark.dataSource.register(DatabaseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"module": db.module, "arguments": json.dumps(db.arguments), "schema": db.schema, "table": table, "parts": str(parts), "columns": ",".join(columns or [])}
    return spark.read.format("lodestar_database").options(**options, **({"key": key} if key else {})).load()


def sample_rows(spark: SparkSession, db: Database, table: str, n: int = 5) -> list[dict]:
    """Some first rows, as a preview: a limit is the feature."""
    reader = read_table(spark, db, table)
    rows = db.rows(f"SELECT {', '.join(map(db.quoted, reader.columns))} FROM {db.quoted(table)} LIMIT {int(n)}")
    return [dict(zip(reader.columns, r, strict=True)) for r in rows]


def entity_tables(spark: SparkSession, db: Database, parts: int = 8) -> dict[str, DataFrame]:
    """Every table of the database by name, read in ranges of its primary key where that is one whole number."""
    catalog = introspect(spark, db).collect()  # names and types
    out = {}
    for t in dict.fromkeys(r["table"] for r in catalog):
        keys = [r for r in catalog if r["table"] == t and r["is_pk"]]
        key = keys[0]["column"] if len(keys) == 1 and isinstance(spark_type(keys[0]["data_type"]), LongType) else None
        out[t] = read_table(spark, db, t, key=key, parts=parts)
    return out


REGISTRY["database"] = lambda spark, o: read_table(spark, Database(o["module"], o["arguments"], o.get("schema", "public")), o["table"], o.get("columns"), o.get("key"), int(o.get("parts", 8)))


# Document stores


def document_catalog(rows: DataFrame, table: str, column: str = "value", sample: int | None = None) -> DataFrame:
    """table, column (a dotted path), data_type, share, is_pk, is_fk, fk_table of JSON documents: what the documents, or a sample by hash, have in common.

    Types are merged over the sample (a whole number and a fraction are a fraction, what doesn't fit is text); share is how many
    have the field, null values not counted. _id is the key; a field that ends in _id refers to what comes before.
    """
    some = rows.select(column)
    if sample is not None:
        n = rows.count()
        some = some.where(F.pmod(F.xxhash64(column), F.lit(1 << 20)) < int(min(1.0, sample / max(1, n)) * (1 << 20)))
    parsed = some.select(F.try_parse_json(column).alias("v")).where("v is not null")
    text = parsed.agg(F.schema_of_variant_agg("v").alias("s")).first()["s"]  # one line
    fields: list[tuple[str, str, bool]] = []

    def walk(kind: DataType, path: str) -> None:
        for f in kind.fields:
            at = f"{path}.{f.name}" if path else f.name
            if isinstance(f.dataType, StructType):
                walk(f.dataType, at)
            else:
                fields.append((at, _document_type(f.dataType), bool(path)))

    kind = _variant_schema(text)
    if not isinstance(kind, StructType):
        return rows.sparkSession.createDataFrame([], "table string, column string, data_type string, share double, is_pk boolean, is_fk boolean, fk_table string")
    walk(kind, "")
    there = lambda p: F.count(F.try_variant_get("v", "$" + "".join(f"['{x}']" for x in p.split(".")), "string"))
    counts = parsed.agg(F.count("*").alias("n"), *[there(p).alias(f"c{i}") for i, (p, _, _) in enumerate(fields)]).first()
    made = [(table, p, t, counts[f"c{i}"] / max(1, counts["n"])) for i, (p, t, _) in enumerate(fields)]
    out = rows.sparkSession.createDataFrame(made, "table string, column string, data_type string, share double").withColumn("is_pk", F.col("column") == "_id")
    foreign = document_foreign_keys(out.where("not contains(column, '.')"))
    return out.join(foreign, ["table", "column"], "left").withColumn("is_fk", F.col("fk_table").isNotNull()).select("table", "column", "data_type", "share", "is_pk", "is_fk", "fk_table")


def _variant_schema(text: str) -> DataType:
    return DataType.fromDDL(text.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))


def _document_type(kind: DataType) -> str:
    if isinstance(kind, ArrayType | MapType):
        return "array" if isinstance(kind, ArrayType) else "object"
    if isinstance(kind, NullType):
        return "null"
    return {"bigint": "integer", "double": "number", "boolean": "boolean", "string": "string"}.get(kind.simpleString(), "number" if kind.simpleString().startswith("decimal") else kind.simpleString())
