"""Code-host items, batches and the registry of connectors on odd rows."""

import json

from pyspark.sql import functions as F

from lodestar.operators import registry
from lodestar.sources import codehost, connectors


def test_item_texts_and_batches_of_odd_rows(spark):
    rows = [("issue", "r", json.dumps({"number": 1, "title": "t", "pull_request": {"u": 1}, "updated_at": "2"})), ("issue", None, "{}"), ("commit", "r", json.dumps({"sha": "0123456789", "commit": {"message": "x" * 400}})), ("wiki", "r", "{}"), ("issue", "r", "oops"), ("issue", "r", None), ("issue", "r", "[1]")]
    got = [(r["kind"], r["text"]) for r in codehost.texts(spark.createDataFrame(rows, "kind string, repo string, item string")).collect()]
    assert sorted(got) == sorted([("pull_request", "Pull Request #1 in r: t\nAuthor: unknown | State:  | Labels: \n\n"), ("issue", "Issue # in : \nAuthor: unknown | State:  | Labels: \n\n"), ("commit", f"Commit 01234567 in r by unknown:\n{'x' * 300}\n")])
    df = spark.range(0, 45).select(F.lit("s").alias("s"), F.when(F.col("id") > 4, F.timestamp_seconds(F.col("id") * 40000)).alias("t"), "id", F.when(F.col("id") != 7, F.col("id").cast("string")).alias("text"))
    out = {r["batch"]: (r["n"], r["text"]) for r in codehost.batches(df, "s", "t", "id", 20, between=" ").collect()}
    words = [str(i) if i != 7 else "" for i in range(45)]
    assert out == {0: (20, " ".join(words[:20])), 1: (20, " ".join(words[20:40])), 2: (5, " ".join(words[40:]))}
    assert codehost.batches(df.limit(0), "s", "t", "id").count() == 0


def test_registry_with_nulls_and_repeats(spark):
    schema = "connector_id string, graph_id string, sample_row_limit long, status string, updated_at timestamp"
    stored = spark.createDataFrame([("a", "g", 5, "active", None), ("d", "h", 5, "deleted", None)], schema)
    made = registry.register(stored, spark.createDataFrame([("a", "g", 9), ("b", "g", 5000), ("b", "g", 5000), (None, "g", 1)], "connector_id string, graph_id string, sample_row_limit long"), F.lit("2020-01-01").cast("timestamp"))
    assert {(r[0], r[2], r[3]) for r in made.collect()} == {("a", 5, "active"), ("d", 5, "deleted"), ("b", 1000, "active")} and made.count() == 3
    gone = registry.remove(made, spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "connector_id string"), F.lit("2021-01-01").cast("timestamp"))
    assert [r[0] for r in registry.listed(gone, ["g"]).collect()] == ["b"] and gone.count() == 3
    results = spark.createDataFrame([("a", None, "ok", 1, None), ("zz", None, "ok", 1, None)], "connector_id string, occurred_at timestamp, status string, row_count long, error string")
    assert {r["last_sync_status"] for r in registry.synced(made, results).collect()} == {None}


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    fetch = connectors.paced(lambda p: (p, {}), 2.0, lambda: now[0], sleep)
    assert [fetch({"n": i})[0]["n"] for i in range(3)] == [0, 1, 2] and slept == [0.5, 0.5]
    free = connectors.paced(lambda p: (p, {}), 0, lambda: now[0], sleep)
    free({}), free({})
    assert slept == [0.5, 0.5]


def test_first_pages(spark):
    df = spark.createDataFrame([("http://h/r", "issue", None), ("http://h/r", "commit", "2020-01-01T00:00:00+00:00")], "base string, kind string, since string")
    got = [r[0] for r in df.select(codehost.item_url(F.col("base"), F.col("kind"), F.col("since"))).collect()]
    assert got == ["http://h/r/issues?state=all&per_page=100", "http://h/r/commits?per_page=100&since=2020-01-01T00%3A00%3A00%2B00%3A00"]
