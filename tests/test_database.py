"""Databases as sources, over SQLite files: catalogues, ranges, pushed filters, untyped values, documents."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestar.operators import mapping
from lodestar.sources import connectors, database


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "a.db")
    c = sqlite3.connect(path)
    c.executescript("""
      CREATE TABLE team (id INTEGER PRIMARY KEY, name TEXT);
      CREATE TABLE person (id INTEGER PRIMARY KEY, name TEXT, pay REAL, since DATE, team_id INTEGER REFERENCES team(id), manager_id INTEGER REFERENCES person(id), photo BLOB);
      CREATE TABLE team_tag (team_id INTEGER REFERENCES team(id), tag_id INTEGER REFERENCES tag(id), created_at TEXT, PRIMARY KEY (team_id, tag_id));
      CREATE TABLE tag (id INTEGER PRIMARY KEY, "the label" TEXT);
      CREATE TABLE empty (id INTEGER PRIMARY KEY);""")
    c.executemany("INSERT INTO team VALUES (?, ?)", [(i, f"t{i}") for i in range(3)])
    c.executemany("INSERT INTO person VALUES (?, ?, ?, ?, ?, ?, ?)", [(i * 7 - 50, f"p{i}" if i % 9 else None, i * 1.5 if i != 4 else "much", "2024-01-02" if i % 2 else None, i % 3, None, b"\x00\x01") for i in range(500)])
    c.executemany("INSERT INTO tag VALUES (?, ?)", [(1, 'a "b"'), (2, "it's")])
    c.commit()
    c.close()
    return database.Database("sqlite3", {"database": path})


def test_catalogue_gives_the_mapping(spark, db):
    found = database.introspect(spark, db)
    rows = {(r["table"], r["column"]): (r["data_type"], r["is_pk"], r["fk_table"], r["fk_column"]) for r in found.collect()}
    assert rows["person", "id"] == ("integer", True, None, None) and rows["person", "team_id"] == ("integer", False, "team", "id")
    assert rows["team_tag", "tag_id"] == ("integer", True, "tag", "id") and len(rows) == 15
    kinds = {r["table"]: r["kind"] for r in mapping.table_kinds(found.where("table <> 'team_tag' or not is_pk").unionByName(found.where("table = 'team_tag' and is_pk").withColumn("is_pk", F.lit(False)))).collect()}
    assert kinds == {"team": "entity_table", "person": "self_ref_table", "team_tag": "junction_table", "tag": "entity_table", "empty": "entity_table"}


@pytest.mark.parametrize(("key", "parts"), [("id", 4), (None, 4), ("id", 1), ("id", 40)])
def test_ranges_give_each_row_once(spark, db, key, parts):
    found = database.read_table(spark, db, "person", key=key, parts=parts)
    assert dict(found.dtypes) == {"id": "bigint", "name": "string", "pay": "double", "since": "date", "team_id": "bigint", "manager_id": "bigint", "photo": "binary"}
    ids = sorted(r["id"] for r in found.select("id").collect())
    assert ids == [i * 7 - 50 for i in range(500)]
    assert found.rdd.getNumPartitions() == (parts if key else 1)
    assert found.where("id = -22").first()["pay"] is None, "text in a column of numbers"


def test_filters_and_columns_go_into_the_statement(spark, db):
    found = database.read_table(spark, db, "person", ["id", "name", "team_id"], "id", 3)
    some = found.where("team_id = 1 and id >= 100 and name in ('p31', 'p40', 'p41') and name like 'p4%'")
    assert [r["name"] for r in some.collect()] == ["p40"]
    reader = database.TableReader(db, "person", found.schema, "id", 3)
    back = list(reader.pushFilters([database.EqualTo(("team_id",), 1), database.In(("name",), ("p1",)), database.GreaterThan(("name",), "a"), database.IsNull(("name",)), database.EqualTo(("x", "y"), 1)]))
    assert [type(b) for b in back] == [database.GreaterThan, database.EqualTo] and reader.where == ['"team_id" = ?', '"name" IN (?)', '"name" IS NULL']
    assert [r["the label"] for r in database.read_table(spark, db, "tag").where("id = 2").collect()] == ["it's"]


def test_samples_tables_and_the_registry(spark, db):
    assert database.sample_rows(spark, db, "team", 2) == [{"id": 0, "name": "t0"}, {"id": 1, "name": "t1"}]
    tables = database.entity_tables(spark, db)
    assert {t: df.count() for t, df in tables.items()} == {"team": 3, "person": 500, "team_tag": 0, "tag": 2, "empty": 0}
    nodes = mapping.entity_rows(tables["team"], "c", "team", ["id"], "g", "Team")
    assert sorted(r["id"] for r in nodes.collect()) == ["c:team:0", "c:team:1", "c:team:2"]
    assert connectors.source(spark, "database", {"module": "sqlite3", "arguments": db.arguments, "table": "team"}).count() == 3
    with pytest.raises(Exception, match="no table"):
        database.read_table(spark, db, "nowhere").count()


def test_documents_of_a_store_give_a_catalogue(spark):
    docs = ['{"_id": 1, "user_id": 5, "price": 1, "tags": ["a"], "at": {"city": "x", "zip": 3}}', '{"_id": 2, "price": 2.5, "at": {"city": null}}', '{"_id": 3, "user_id": "u", "price": null}', "broken", None]
    found = {r["column"]: (r["data_type"], round(r["share"], 2), r["is_pk"], r["fk_table"]) for r in database.document_catalog(spark.createDataFrame([(d,) for d in docs], "value string"), "orders").collect()}
    assert found["_id"] == ("integer", 1.0, True, None) and found["price"][:2] == ("number", 0.67) and found["tags"][0] == "array"
    assert found["user_id"][1:] == (0.67, False, "user") and found["at.city"][:2] == ("string", 0.33) and found["at.zip"] == ("integer", 0.33, False, None)
    assert database.document_catalog(spark.createDataFrame([], "value string"), "none").count() == 0
