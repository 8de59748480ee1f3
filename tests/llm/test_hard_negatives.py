"""Hard negatives against SQL on the table and brute force on made cases; ball trees against all inner products."""

import math
import random

import numpy as np
import pytest
from conftest import SF, rows

from lodestar.llm import hard_negatives as H


def plain(table, anchor=50):
    """The contract by loops over all pairs. table: (vec_id, embedding, label)."""
    own = {}
    for i, v, label in table:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v])
        own[i] = min(own.get(i, row), row)
    out = []
    for a, (label, v) in own.items():
        if a % anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other == label) for i, (other, w) in own.items() if i != a)
        for below, p, _ in [x for x in scored if x[2]][:5]:
            hard = [(i, -s) for s, i, same in scored if not same and 50 * -below <= 100 * -s <= 95 * -below][:3]
            out += [(a, p, k + 1, i, -below, s) for k, (i, s) in enumerate(hard)]
    return sorted(out)


def found_rows(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_equals_sql(spark, duck):
    found = H.op13_hard_negatives(spark, SF).toPandas()
    assert len(found) and rows(found) == rows(duck.sql(H.OP13_SQL).df())


def made(n, rng, labels=4, width=8):
    """Clusters, equal vectors with one or several labels, zeros, and rows that take no part."""
    centres = [[rng.gauss(0, 0.5) for _ in range(width)] for _ in range(6)]
    table = [(i, [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]
    table += [(n + i, [0.5] * width, 1) for i in range(120)] + [(n + 200 + i, [0.5] * width, i % 3) for i in range(40)]
    table += [(n + 300 + i, [0.0] * width, i % 2) for i in range(30)] + [(n + 350, [0.25] * (width - 3), 1), (-50, [0.4] * width, 1), (-7, [0.4] * width, 9)]
    table += [(n + 400, None, 1), (n + 450, [0.1] * width, None), (None, [0.1] * width, 1), (n + 500, [float("nan")] * width, 1), (n + 550, [float("inf")] * width, 1), (n + 600, [None, *[0.1] * (width - 1)], 1), (n + 650, [], 1)]
    return table + table[:40] + [(5, [0.3] * width, 0)]


@pytest.mark.parametrize(("size", "leaf"), [(40, 4), (4096, 64)])
def test_made_cases_equal_brute_force(spark, size, leaf):
    rng = random.Random(size)
    table = made(600, rng)
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS q", "1 AS tree", "'y' AS score", "2 AS block").repartition(4)
    some = H.rows_of(df)
    assert found_rows(H.mine(some, some.where("vec_id % 50 = 0").select("vec_id"), size, leaf)) == plain(table)


def test_empty_and_lonely(spark):
    empty = H.rows_of(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert H.mine(empty, empty.select("vec_id")).count() == 0
    one = H.rows_of(spark.createDataFrame([(50, [0.5, 0.5], 1), (51, [0.25, 0.25], 2)], "vec_id long, embedding array<float>, label int"))
    assert H.mine(one, one.where("vec_id = 50").select("vec_id")).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_trees_give_what_all_products_give_and_prune(same):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 200, (12, 16))
    x = np.rint(centres[rng.integers(0, 12, 3000)] + rng.normal(0, 25, (3000, 16))).astype(np.int64)
    labels, ids = rng.integers(0, 5, 3000), rng.permutation(3000).astype(np.int64)
    order, nodes = H.build(x, labels, 32)
    assert sorted(order) == list(range(3000))
    for n in nodes:
        own = x[order[n["start"] : n["stop"]]]
        assert (np.sqrt(((own - n["centre"]) ** 2).sum(1)) <= n["radius"] + 1e-6).all()
    tree = {"nodes": nodes, "ids": ids[order], "labels": labels[order], "vectors": x[order].astype("<i8").tobytes(), "width": 16}
    q, ql = x[:40], labels[:40]
    scores = q @ x.T
    low = np.stack([np.full(40, -(2**62)), scores.max(1) // 2], 1)
    high = np.stack([np.full(40, 2**62), scores.max(1) * 8 // 10], 1)
    best = H.Best(low, high, np.full(low.shape, -(2**62)), 3)
    scored = H.search(tree, q, ql, best, same)
    assert scored < 0.7 * 40 * 3000
    for k in range(40):
        for w in range(2):
            inside = [(-int(s), int(i)) for s, i, y in zip(scores[k], ids, labels, strict=True) if (y == ql[k]) == same and low[k, w] <= s <= high[k, w]]
            wanted = sorted(inside)[:3]
            assert [(-int(s), int(i)) for s, i in zip(best.scores[k, w], best.ids[k, w], strict=True) if i != np.iinfo(np.int64).max] == wanted
