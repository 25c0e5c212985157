"""Operators that must stay exact when data is uneven or large."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vernissage.operators import quantile, sampling, skew


@pytest.fixture(scope="module")
def uneven(spark):
    """300 rows of one key, some of others, some of none; a right side with repeats."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{i % 40}") for i in range(900)]
    left = spark.createDataFrame(rows, "n long, k string").repartition(4)
    right = spark.createDataFrame(
        [(f"k{i}", i) for i in range(0, 60, 2)] + [("hot", -i) for i in range(25)], "k string, v long"
    )
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("both", [False, True])
def test_skewed_join_equals_plain_join(uneven, how, both):
    left, right = uneven
    spread = F.col("v") if both else None
    got = skew.skewed_join(left, right, "k", F.col("n"), how, right_spread=spread, hot_rows=10, small_rows=0)
    want = left.join(right, "k", how)
    order = ["n", "v"]
    assert got.columns == want.columns
    assert got.orderBy(order).collect() == want.orderBy(order).collect()


def test_skewed_join_spreads_the_hot_key(uneven):
    left, right = uneven
    plan = skew.skewed_join(left, right, "k", F.col("n"), hot_rows=10, small_rows=0)
    text = left.sparkSession._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "extended")
    assert "_l_at" in text


def test_skewed_join_without_hot_keys_is_plain(uneven):
    left, right = uneven
    plan = skew.skewed_join(left, right, "k", F.col("n"), hot_rows=10_000, small_rows=0)
    text = left.sparkSession._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "extended")
    assert "_l_at" not in text


@pytest.mark.parametrize("n", [0, 1, 7, 250, 999, 1000, 5000, -1, None])
def test_first_n_is_exact_when_narrowing(spark, n):
    rng = random.Random(5)
    keys = [rng.choice([0, 1, 2, 10**6]) * 1000 + rng.randrange(400) for _ in range(1000)]
    rows = [(k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k long, t long").repartition(5)
    got = sorted(tuple(r) for r in skew.first_n(df, n, "k", "t", in_memory=20).collect())
    assert got == sorted(rows)[: len(rows) if n in (-1, None) else n]


def test_first_n_when_all_keys_are_equal(spark):
    df = spark.createDataFrame([(1, i) for i in range(200)], "k long, t long")
    got = sorted(r.t for r in skew.first_n(df, 50, "k", "t", in_memory=10).collect())
    assert got == list(range(50))


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_ordinals_follow_the_order(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(100) if i % 3 else 7, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, t long").repartition(6)
    got = {(r.k, r.t): r.ord for r in skew.with_ordinal(df, "k", "t", parts=parts).collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows))}


@pytest.mark.parametrize("parts", [None, 1, 5, 60])
def test_ordinals_of_equal_keys_and_nulls(spark, parts):
    rows = [(None if i % 5 == 0 else 7, i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t long").repartition(6)
    got = sorted((r.ord, r.k, r.t) for r in skew.with_ordinal(df, "k", "t", parts=parts).collect())
    assert [o for o, _, _ in got] == list(range(400))
    assert [(k, t) for _, k, t in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))


def test_equal_keys_spread_over_ranges(spark, monkeypatch):
    written = []
    monkeypatch.setattr(skew, "materialize", lambda df, keep=skew.materialize: written.append(out := keep(df)) or out)
    skew.with_ordinal(spark.range(1000).selectExpr("1 as k"), "k", parts=10)
    sizes = [r["count"] for r in written[0].groupBy("_range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 300


def test_a_small_wide_side_is_not_broadcast(spark):
    right = spark.range(200).selectExpr("cast(id as string) as k", "repeat('x', 100000) as v")
    assert skew._is_small(right.limit(10), 1000) and not skew._is_small(right, 1000) and not skew._is_small(right, 10)


def test_percentile_moves_counts_alone(spark):
    df = spark.range(200_000).selectExpr("cast(id % 3 as string) as g", "cast(id % 50000 as double) as x")
    seen, keep = [], quantile.materialize
    quantile.materialize = lambda frame: seen.append(frame._jdf.queryExecution()) or keep(frame)
    try:
        quantile.exact_percentile(df, ["g"], "x", 0.95, "p").collect()
    finally:
        quantile.materialize = keep
    plan = spark._jvm.PythonSQLUtils.explainString(seen[1], "simple")
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_percentile_equals_numpy(spark, q, monkeypatch):
    monkeypatch.setattr(quantile, "ACCURACY", 100)  # small enough for the bracket to cut
    rng = np.random.default_rng(3)
    groups = {
        "many": rng.exponential(size=5000),
        "third": np.where(rng.random(3000) < 0.34, 2.5, rng.random(3000) * 5),
        "one": np.array([4.0]),
        "few": np.arange(10.0),
        "flat": np.full(700, 1.25),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("many", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: r.p for r in quantile.exact_percentile(df, ["g"], "x", q, "p").collect()}
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.percentile(xs, 100 * q), rel=1e-12), g


def test_sample_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(f"i{i}",) for i in range(500)] + [(None,)], "id string")
    one = [r.id for r in sampling.sample_rank(df.coalesce(1), 40).orderBy("rank").collect()]
    many = [r.id for r in sampling.sample_rank(df.repartition(13), 40).orderBy("rank").collect()]
    assert one == many and len(set(one)) == 40
    assert {r.id for r in sampling.sample_n(df, 40).collect()} == set(one)
    assert [r.id for r in sampling.sample_rank(df, -1).filter("rank <= 40").orderBy("rank").collect()] == one
    assert sampling.sample_n(df, 10_000).count() == 500
    assert sampling.sample_n(df, 40, seed=7).join(sampling.sample_n(df, 40), "id").count() < 40


def test_take(spark):
    df = spark.range(20)
    assert sampling.take(df, -1, "id").count() == 20
    assert [r.id for r in sampling.take(df, 3, "id").collect()] == [0, 1, 2]
