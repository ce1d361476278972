"""Hard negatives against plain loops over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import op11_negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, negatives=3, low=50, high=95, divisor=50, relabel=True):
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if relabel and i % 7 == 0:
            label = (label + 1) % 10
        known.setdefault(i, (label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (of, x) in known.items():
        if a % divisor:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), i) for i, (_, y) in known.items() if i != a)
        for p_minus, p in [s for s in scores if known[s[1]][0] == of][:positives]:
            found = [(-m, i) for m, i in scores if known[i][0] != of and low * -p_minus <= 100 * -m <= high * -p_minus]
            out += [(a, p, k + 1, i, -p_minus, s) for k, (s, i) in enumerate(found[:negatives])]
    return sorted(out)


def found(df):
    return sorted(tuple(r)[:6] for r in N.op11_negatives(df).collect())


def random_rows(n, width, grid, seed):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-grid, 2 * grid) / 16 for _ in range(width)], rng.randrange(3)) for i in range(n)]


def test_all_pairs_with_ties(spark):
    rows = random_rows(420, 6, 3, 1)
    expected = plain(rows)
    assert len(expected) > 60
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected


def test_small_blocks_give_the_same(spark, monkeypatch):
    for name, value in (("ANCHOR_BLOCK", 3), ("ROW_BLOCK", (16, 16)), ("STEP_ROWS", 7)):
        monkeypatch.setattr(N, name, value)
    rows = random_rows(300, 4, 2, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == plain(rows)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    every = N.hard_negatives(df, F.col("vec_id") % 50 == 0, label=label, prune=False)
    assert sorted(tuple(r)[:6] for r in every.collect()) == plain(rows)


def test_zero_scores_take_earlier_ids(spark):
    # A positive of score 0 opens a window at which negatives of smaller ids have already passed.
    rows = [(50, [1.0, 0.0], 1), (60, [0.0, 1.0], 1), (51, [0.0, 2.0], 2), (52, [0.0, 3.0], 2), (61, [0.0, 5.0], 2), (62, [0.0, 6.0], 2)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == [(50, 60, 1, 51, 0, 0), (50, 60, 2, 52, 0, 0), (50, 60, 3, 61, 0, 0)] == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(160, 3, 3, 3) + [(200, None, 1), (201, [0.5, None, 1.0], 1), (202, [nan, 1.0, 1.0], 1), (203, [1.0, inf, 1.0], 0), (204, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (250, [1.0, -inf, 1.0], 1), (300, [], 1), (301, [1.0], 0), (350, [0.5, 0.5, 0.5, 9.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"anchor": F.lit(1), "Score": F.lit("x"), "r": F.lit(2), "cell": F.lit(None)})
    assert found(df) == plain(rows)
    # Rows that repeat an id count once; a third of all rows may.
    again = df.union(df.filter("vec_id = 50")).union(df.filter("vec_id = 51")).union(spark.range(80).selectExpr("50L", "array(9f, 9f, 9f)", "cast(9 as int)", "1", "'x'", "2", "null"))
    assert found(again) == plain(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == []
    assert found(spark.createDataFrame([(51, [1.0], 1), (52, [1.0], 1)], SCHEMA)) == []


def test_products_beyond_doubles():
    a = np.array([[2.0**40, 1.0], [3.0, 1.0]])
    b = np.array([[2.0**20, 1.0], [2.0**13 + 1, -1.0], [5.0, 7.0]])
    assert N.products(a, b).tolist() == [[N.MOST, N.MOST, min(N.MOST, 5 * 2**40 + 7)], [3 * 2**20 + 1, 3 * (2**13 + 1) - 1, 22]]


@pytest.mark.parametrize("score", [-7, -1, 0, 1, 2, 19, 20, 21, 1000])
def test_windows(score):
    low, high = N.windows(score)
    assert [n for n in range(-1100, 1100) if 50 * score <= 100 * n <= 95 * score] == list(range(low, high + 1))
