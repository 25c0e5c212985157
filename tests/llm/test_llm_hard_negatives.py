"""Packed products and hard negatives against brute force, with copies, hot labels and unusable rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vernissage.llm.hard_negatives import hard_negatives, packed_products


@pytest.mark.parametrize("low, high", [(-200, 200), (0, 5), (-9, -3), (3, 3), (-(1 << 27), 1 << 27)])
def test_packed_products_are_exact(low, high):
    rng = np.random.default_rng(4)
    a, b = rng.integers(low, high + 1, (7, 33)), rng.integers(low, high + 1, (5000, 33))
    assert np.array_equal(packed_products(a, b), a @ b.T)
    assert packed_products(a[:0], b).shape == (0, 5000) and packed_products(a, b[:0]).shape == (7, 0)
    assert not packed_products(a[:, :0], b[:, :0]).any()


def test_products_beyond_64_bits_are_an_error():
    with pytest.raises(ValueError):
        packed_products(np.full((1, 4), 1 << 31), np.full((1, 4), 1 << 31))


def brute(rows, every):
    usable = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
              if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, label, v) in enumerate(usable):
        if i % every:
            continue
        scored = sorted([(-sum(x * y for x, y in zip(v, w)), j, other) for m, (j, other, w) in enumerate(usable) if m != k])
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            near = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


def check(spark, rows, every, **options):
    frame = spark.createDataFrame([(i, label, v, 1, 2) for i, label, v in rows], "vec_id bigint, label int, embedding array<float>, n int, tile int")
    stored = [(i, label, v and [x if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    found = hard_negatives(frame, F.col("vec_id") % every == 0, **options).collect()
    assert sorted(map(tuple, found)) == brute(stored, every)
    return found


def test_mining_matches_brute_force_with_a_hot_label(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 12)) / 3
    rows = [(i, 0 if i % 3 == 0 else int(rng.integers(1, 6)), (base[i % 40] + 0.05 * rng.standard_normal(12)).tolist()) for i in range(700)]
    rows += [(1000 + i, i % 4, base[0].tolist()) for i in range(60)]  # copies under several labels: ties by identifier
    assert len(check(spark, rows, 20, tile_rows=200, tile_anchors=16)) > 300


def test_unusable_and_repeated_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 0.9]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [nan, 1.0]),
            (7, 2, [inf, 1.0]), (8, 2, [1.0, -inf]), (None, 2, [1.0, 1.0]), (9, 2, [1.0, 0.8]), (9, 2, [1.0, 0.8]), (10, 1, [-1.0, -1.0]),
            (11, 3, []), (12, 2, [1.0, 0.9, 7.0]), (20, 9, [1.0, 1.0]), (0, 1, [1.0, 2.0])]
    assert check(spark, rows, 10)
    assert check(spark, rows[:1], 10) == [] and check(spark, [], 10) == []


def test_labels_of_text(spark):
    rows = [(0, "a", [1.0]), (1, "a", [1.0]), (2, "b", [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>")
    assert [tuple(r) for r in hard_negatives(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 65536)]
