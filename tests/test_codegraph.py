"""Code graphs and ingest of records, by hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.operators import codegraph, ingest
from lodestar.sources import files

SRC = [
    ("app/base.py", "python", "class Base:\n    def run(self):\n        helper()\n\ndef helper():\n    pass\n"),
    ("app/main.py", "python", "import os\nimport app.base\nclass Main(Base):\n    def run(self):\n        base.helper()\n        unknown()\n"),
    ("web/a.ts", "typescript", 'import { x } from "react";\nclass View extends Main { show() { helper(); } }\n'),
]


def test_graph_of_a_repository(spark):
    f = spark.createDataFrame([(*r, "h") for r in SRC] + [(*SRC[0], "h")], "path string, language string, content string, content_hash string")
    deps = spark.createDataFrame([("react", "^1"), ("left", "2"), (None, "3")], "name string, version string")
    nodes, edges = codegraph.graph(f, files.extract_symbols(f), deps)
    got = {r["id"]: r for r in nodes.collect()}
    assert len(got) == nodes.count()
    assert {i for i, r in got.items() if r["label"] == "Class"} == {"class:app.base.Base", "class:app.main.Main", "class:web.a.View"}
    assert {i for i, r in got.items() if r["label"] == "Dependency"} == {"package:react", "package:left", "package:os"}
    assert {i for i, r in got.items() if r["label"] == "CodeModule"} == {"module:app.main", "module:app.base", "module:web.a"}
    assert got["package:react"]["props"] == {"version": "^1"} and got["package:os"]["props"] == {"version": ""}
    e = {(r["src"], r["type"], r["dst"]): r["props"] for r in edges.collect()}
    assert len(e) == edges.count()
    assert {k for k in e if k[1] == "INHERITS"} == {("class:app.main.Main", "INHERITS", "class:app.base.Base"), ("class:web.a.View", "INHERITS", "class:app.main.Main")}
    assert {k for k in e if k[1] == "CALLS"} == {("function:app.base.Base.run", "CALLS", "function:app.base.helper"), ("function:app.main.Main.run", "CALLS", "function:app.base.helper"), ("function:web.a.View.show", "CALLS", "function:app.base.helper")}
    assert {k for k in e if k[1] == "IMPORTS"} == {("file:app/main.py", "IMPORTS", "package:os"), ("file:app/main.py", "IMPORTS", "module:app.base"), ("file:web/a.ts", "IMPORTS", "package:react")}
    assert ("function:web.a.View.show", "METHOD_OF", "class:web.a.View") in e and e[("class:app.base.Base", "DEFINED_IN", "file:app/base.py")] == {"line": "1", "end_line": "3"}


def test_stale_symbols_and_their_time_to_live(spark):
    day = lambda n: dt.datetime(2020, 1, n)
    rows = [("function:a.f", "Function", {"path": "a", "doc": "kept"}, None), ("function:a.g", "Function", {"path": "a"}, None), ("function:a.old", "Function", {"path": "a"}, day(1)), ("class:b.B", "Class", {"path": "b"}, None), ("package:x", "Dependency", None, None), ("function:a.back", "Function", {"path": "a"}, day(1))]
    stored = spark.createDataFrame(rows, "id string, label string, props map<string,string>, stale_at timestamp")
    parsed = spark.createDataFrame([("function:a.f", "Function", {"path": "a", "line": "3"}), ("function:a.back", "Function", {"path": "a"}), ("function:a.new", "Function", {"path": "a"})], "id string, label string, props map<string,string>")
    out = codegraph.merged(stored, parsed, spark.createDataFrame([("a",), (None,)], "path string"), F.lit(day(9)))
    got = {r["id"]: (r["props"], r["stale_at"]) for r in out.collect()}
    assert got["function:a.f"] == ({"path": "a", "doc": "kept", "line": "3"}, None) and got["function:a.g"][1] == day(9) and got["function:a.old"][1] == day(1)
    assert got["class:b.B"][1] is None and got["function:a.back"][1] is None and got["function:a.new"][1] is None and got["package:x"] == ({}, None)
    edges = spark.createDataFrame([("function:a.f", "function:a.old"), ("function:a.f", "function:a.g")], "src string, dst string")
    nodes, left = codegraph.expired(out, edges, F.lit(day(10)), 7)
    assert {r["id"] for r in nodes.collect()} == set(got) - {"function:a.old"} and [r["dst"] for r in left.collect()] == ["function:a.g"]


def test_records(spark):
    rows = ['{"id": "a", "n": 1, "f": 1.5, "t": true, "none": null, "tags": ["x", "y"], "in": {"k": [1]}, "to": ["b", 7, "", null, 1.5, "b"]}', '{"id": 7, "to": "a"}', '{"id": 1.5}', '{"id": null}', '{"x": 1}', "[1]", "5", "null", "{oops", None, '{"id": true, "to": {"id": 1}}', '{"id": "", "to": "zz"}', '{"id": 123456789012345678901234567890}', '{"id": "7", "z": "later"}']
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    nodes, edges, faults = ingest.records(df, "Rec", [ingest.Link("to", "Other", "ABOUT")])
    assert {r["reason"]: r["n"] for r in faults.collect()} == {"missing_or_invalid_id": 3, "not_a_dict": 3, "not_json": 2}
    got = {(r["id"], r["label"]): r for r in nodes.collect()}
    assert got[("a", "Rec")]["props"] == {"n": "1", "f": "1.5", "t": "true", "tags": '["x","y"]', "in": '{"k":[1]}', "to": '["b",7,"",null,1.5,"b"]'}
    assert {k for k in got if k[1] == "Rec"} == {(i, "Rec") for i in ("a", "7", "True", "", "123456789012345678901234567890")}
    assert got[("7", "Rec")]["props"] == {"to": "a"} or got[("7", "Rec")]["props"] == {"z": "later"}
    assert {k for k, r in got.items() if r["stub"]} == {(i, "Other") for i in ("a", "b", "7", "zz")}
    assert {(r["src"], r["dst"]): r["count"] for r in edges.collect()} == {("a", "b"): 2, ("a", "7"): 1, ("7", "a"): 1, ("", "zz"): 1}
    for label, kind in (("A-B", "X"), ("", "X"), ("A", "x"), ("A", "1X")):
        with pytest.raises(ValueError):
            ingest.records(df, label, [ingest.Link("to", "B", kind)])
    empty = ingest.records(df.limit(0), "Rec", [ingest.Link("to", "B", "X")])
    assert [d.count() for d in empty] == [0, 0, 0] and ingest.records(df, "Rec")[1].count() == 0
