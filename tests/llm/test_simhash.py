"""SimHash near duplicates against brute force: fingerprints, coverings, components."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest import SF

from lodestar.llm import simhash as S


def plain_fingerprint(text):
    """The contract's words, by other means."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps: dict[int, int], radius=3):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_of_odd_texts():
    texts = [None, "", " \t\n", "Eins", "eins  ZWEI", "a b c", "a b c a b c a b c", "É x Y\x1fz\x0bw " * 50, "Kelvin K k", "x " * 40_000 + "end", "ein\x00wort \U0001f600   x"]
    for t in texts:
        assert S.fingerprint(t) == plain_fingerprint(t), t


@pytest.mark.parametrize("free", [2**64 - 1, 0xFFFF0000FFFF0000, 0x1FF])
def test_every_difference_within_the_radius_leaves_some_mask_equal(free):
    masks, places, rng = [m & 2**64 - 1 for m in S.masks(free)], [i for i in range(64) if free >> i & 1], random.Random(1)
    assert len(masks) == 15 and all(m and not m & ~free for m in masks)
    for _ in range(5000):
        d = sum(1 << i for i in rng.sample(places, rng.randint(1, 3)))
        assert any(not m & d for m in masks)


def test_query_equals_brute_force(spark):
    found = S.op11_simhash(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    fps = dict(zip(docs.doc_id, map(plain_fingerprint, docs.text), strict=True))
    assert dict(zip(found.doc_id, found.fingerprint, strict=True)) == {i: f"{x:016x}" for i, x in fps.items()}
    assert dict(zip(found.doc_id, found.component_id, strict=True)) == plain_components(fps)


@pytest.mark.parametrize("leaf", [20, S.LEAF])
def test_large_buckets_lose_no_pair(spark, leaf):
    """A ball about one fingerprint, chains that leave it and noise, with buckets that must be split again and again."""
    rng = random.Random(leaf)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(250):
        fps.add(centre ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 6))))
    x = centre
    for _ in range(20):
        x ^= sum(1 << i for i in rng.sample(range(64), 3))
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1, 1, 2**63}
    rows = dict(enumerate(rng.sample(sorted(fps), len(fps))))
    reps = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in rows.items()], "id long, fp long")
    near = S.near_links(reps, leaf=leaf)
    links = near.collect()
    assert all((rows[r.id] ^ rows[r.root]).bit_count() <= 64 for r in links) and len(links) <= 15 * 15 * len(rows)
    found = {r.id: r.component for r in S.components(near).collect()}
    assert {i: found.get(i, i) for i in rows} == plain_components(rows)


def test_nulls_copies_repeated_ids_and_clashing_columns(spark):
    rows = [(5, "a b c d", 1), (3, "A  B c d", 2), (None, "a b c d", 3), (7, None, 4), (8, "", 5), (9, "other words here", 6), (9, "a b c d", 7), (2, "other words here", 8), (5, "a b c d", 9), (None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnsRenamed({"fp": "fp"})
    docs = docs.selectExpr("*", "'x' AS id", "'y' AS node", "'z' AS fingerprint", "1 AS component_id", "2 AS root")
    found = S.simhash_groups(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == {5: 2, 3: 2, None: None, 7: 7, 8: 7, 9: 2, 2: 2}
    assert sorted(r.fingerprint for r in found if r.doc_id in (7, 8)) == ["0" * 16] * 2
    assert S.simhash_groups(docs.where("false")).count() == 0
