import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.functions.similarity import jaro_winkler


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("name", "wanted"),
    [("Acme B.V.", "acme"), ("Acme Holdings Ltd", "acme"), ("GroupMe", "groupme"), ("acme.com", "acme"), ("Group", "group"), ("  Acme   GmbH ", "acme"), ("Acme Corp. Inc.", "acme")],
)
def test_canonical_name(spark, name, wanted):
    assert one(spark, C.canonical_name(F.col("n")), n=name) == wanted


def test_jaro_winkler():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert jaro_winkler("ibm", "international business machines") == pytest.approx(0.577, abs=1e-3)
    assert jaro_winkler("", "a") == 0.0
    assert jaro_winkler("abc", "abc") == 1.0


@pytest.mark.parametrize(("kind", "rate"), [("episodic", 0.05), ("semantic", 0.005), ("procedural", 0.01), ("other", 0.01)])
def test_importance(spark, kind, rate):
    then, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 11)
    found = one(spark, C.importance(F.lit(0.8), F.col("k"), F.col("a"), F.lit(3), F.lit(now)), k=kind, a=then)
    assert found == pytest.approx(min(1, 0.8 * math.exp(-rate * 10) + min(0.3, 0.05 * math.log1p(3))))


def test_base_importance(spark):
    base = lambda s, k, c: one(spark, C.base_importance(F.col("s"), F.col("k"), F.col("c")), s=s, k=k, c=c)
    assert [base("user_feedback", "semantic", 0.1), base("agent", "episodic", 0.9), base("inference", "semantic", 0.9), base("agent", "semantic", 0.95)] == [1.0, 0.4, 0.3, 0.8]
    assert base("agent", "semantic", 0.5) == pytest.approx(0.45)


def test_names_and_dates(spark):
    assert one(spark, C.camel_case(F.col("n")), n="created_at") == "createdAt"
    assert one(spark, C.pascal_case(F.col("n")), n="t_emp-proj") == "TEmpProj"
    assert one(spark, C.normalise_name(F.col("n")), n="Acme, Inc. & Co") == "acme"
    assert str(one(spark, C.normalise_date(F.col("n")), n="2021")) == "2021-01-01 00:00:00"
    assert one(spark, C.normalise_date(F.col("n")), n="soon") is None


def test_vectors(spark):
    assert one(spark, C.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 0.0]) == 1.0
    assert one(spark, C.cosine_score(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[-1.0, 0.0]) == 0.0
    assert one(spark, C.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) is None
    assert one(spark, C.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 0.0]) is None


def test_hashes_do_not_depend_on_order(spark):
    assert one(spark, C.property_hash(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))), x=1) == one(spark, C.property_hash(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))), x=1)
    assert one(spark, C.member_id(F.array(F.lit("x"), F.lit("y"))), x=1) == one(spark, C.member_id(F.array(F.lit("y"), F.lit("x"))), x=1)


def test_tokens_and_cost(spark):
    assert one(spark, C.token_estimate(F.col("t")), t="") == 1
    assert one(spark, C.token_estimate(F.col("t")), t="x" * 41) == 10
    assert str(one(spark, C.cost(F.col("p"), F.col("c"), F.lit(2.5), F.lit(10.0)), p=1000, c=500)) == "7.500000"
