import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestar.sources import connectors, files
from lodestar.streaming import feeds


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("flag;n;x;d;s\ntrue;1;1.5;2024-01-02;a\nno;2;3;2024-02-03;\n")
    found = files.read_delimited(spark, str(p))
    assert found.columns == ["flag", "n", "x", "d", "s"]
    assert [(r["column"], r["type"]) for r in files.delimited_schema(found).collect()] == [("flag", "bool"), ("n", "int"), ("x", "float"), ("d", "date"), ("s", "str")]
    zero = spark.createDataFrame([("0",), ("1",)], "v string")
    assert files.delimited_schema(zero).collect()[0]["type"] == "bool"


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2.5, "b": "x"}]')
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n{"a": null}\n')
    assert files.read_json(spark, str(tmp_path / "a.json")).count() == 2
    assert files.read_json(spark, str(tmp_path / "b.jsonl")).count() == 2
    assert files.json_schema(json.loads('{"a": [{"x": 1}, {"x": "s", "y": true}], "b": [1, "a"], "c": null}')) == {"a": {"type": "array", "items": {"x": "integer", "y": "boolean"}}, "b": {"type": "array", "items": "mixed"}, "c": "null"}


def test_markdown(spark):
    text = "# A\nintro\n## B\none\ntwo\n### C\n## D\n# E\n### F"
    got = files.markdown_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("at").collect()
    assert [(r["heading"], r["level"], r["parent"]) for r in got] == [("A", 1, None), ("B", 2, "A"), ("C", 3, "B"), ("D", 2, "A"), ("E", 1, None), ("F", 3, "E")]
    assert got[1]["content"] == "one\ntwo"


CODE = '''import os
from pkg.mod import thing

class A(Base):
    @app.route("/x")
    def handle_request(self, req):
        data = req.body
        return clean(data)
'''


def test_symbols(spark):
    f = spark.createDataFrame([("src/a.py", "python", CODE), ("b.go", "go", "package b\nfunc Run(x int) int {\n}\ntype T struct {\n}\n"), ("bad.py", "python", "def (")], "path string, language string, content string")
    got = {r["qualified_name"]: r for r in files.extract_symbols(f).collect()}
    assert {(e["type"], e["dst"]) for e in got["src.a"]["edges"]} == {("IMPORTS", "os"), ("IMPORTS", "pkg.mod")}
    assert [(e["type"], e["dst"]) for e in got["src.a.A"]["edges"]] == [("INHERITS", "Base")]
    edges = {(e["type"], e["dst"]) for e in got["src.a.A.handle_request"]["edges"]}
    assert {("CALLS", "clean"), ("FLOWS_TO", "req>data"), ("FLOWS_TO", "data>return"), ("FLOWS_TO", "data>clean()")} <= edges
    assert got["src.a.A.handle_request"]["decorators"] == ["app.route"]
    assert got["b.Run"]["kind"] == "function" and got["b.T"]["kind"] == "class" and got["bad"]["kind"] == "module"


def test_manifests():
    assert files.manifest("requirements.txt", "a==1.0\n# c\nb[x]>=2\n") == [("a", "==1.0"), ("b", ">=2")]
    assert files.manifest("package.json", '{"dependencies": {"x": "^1"}, "devDependencies": {"y": "2"}}') == [("x", "^1"), ("y", "2")]


@pytest.mark.parametrize("style", ["cursor", "offset", "page"])
def test_pages(style):
    data = list(range(7))

    def fetch(p):
        at = int(p.get("cursor") or 0) if style == "cursor" else p["offset"] if style == "offset" else (p["page"] - 1) * 3
        return {"d": {"items": data[at : at + 3]}, "next_cursor": str(at + 3) if at + 3 < 7 else None}, {}

    assert [x for page in connectors.pages(fetch, style, 3, "d.items") for x in page] == data


class Feed(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        body = json.dumps({"items": [{"id": 1, "updated_at": "2024-01-01"}, {"id": 2, "updated_at": "2024-01-02"}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_rest_source_as_table_and_stream(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    o = {"url": f"http://127.0.0.1:{server.server_port}/items", "path": "items", "style": "cursor"}
    assert connectors.source(spark, "rest", o).count() == 2
    got = []
    q = feeds.run_incremental(spark.readStream.format("lodestar_rest").options(**o).load(), str(tmp_path / "c"), lambda df, n: got.extend(r["item"] for r in df.collect()))
    q.awaitTermination()
    assert len(got) == 2
    with pytest.raises(ValueError, match="no connector"):
        connectors.source(spark, "fax", {})


def test_guarded_sql(spark):
    views = {"nodes": spark.range(500).toDF("id")}
    assert connectors.guarded_sql(spark, "SELECT id FROM nodes WHERE id < :n", views, 1000, {"n": 300}).count() == 100
    for bad in ("DROP TABLE nodes", "SELECT * FROM secrets", "SELECT 1; SELECT 2", "SELECT * FROM nodes JOIN other USING (id)"):
        with pytest.raises(ValueError, match="."):
            connectors.guarded_sql(spark, bad, views)


def test_rate_limits(spark):
    events = spark.createDataFrame([(i, "u", t) for i, t in enumerate([0, 0, 0, 1, 2, 2, 4000])], "event_id long, user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = feeds.rate_limited(events, "user", "ts", 1.0, 2.0).orderBy("event_id").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True, True, False, True]


def test_rate_limited_stream(spark, tmp_path):
    spark.createDataFrame([("u", float(t)) for t in (0, 0, 0, 5)], "key string, t double").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("key string, t double").parquet(str(tmp_path / "in"))
        # State with a time to live asks for batches without data too, so the query is stopped by hand
        q = feeds.rate_limited_stream(stream, 1.0, 2.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        end = time.time() + 90
        while time.time() < end and not q.exception() and spark.table("limited").count() < 4:
            time.sleep(1)
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(r["allowed"] for r in spark.table("limited").collect()) == [False, True, True, True]


def test_event_streams_are_deduplicated(spark, tmp_path):
    spark.createDataFrame([("c", "x"), ("c", "x"), ("d", "x")], "connector_id string, payload string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("connector_id string, payload string").parquet(str(tmp_path / "in"))
    q = feeds.deduplicated(stream, ["connector_id"], "payload").writeStream.format("memory").queryName("unique_events").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("unique_events").count() == 2


def test_due_and_texts(spark):
    c = spark.createDataFrame([(1, None, None), (2, None, 0), (3, None, 9000), (4, False, None)], "id int, is_active boolean, s long").withColumn("last_synced_at", F.timestamp_seconds("s"))
    assert sorted(r["id"] for r in feeds.due(c, F.timestamp_seconds(F.lit(10000))).collect()) == [1, 2]
    e = spark.createDataFrame([("github", "issues", '{"issue": {"title": "T", "body": "B"}}'), ("x", "y", "raw")], "source string, kind string, payload string")
    assert rows(e.select(feeds.event_text(F.col("source"), F.col("kind"), F.col("payload")).alias("t"))) == [("Issue: T\nB",), ("raw",)]
