"""Blocked running columns equal plain windows, whatever the block size and partitioning."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clauseloom.operators import sampling as S
from clauseloom.operators.ordered import running, split_join, top_rows, with_totals
from tests.conftest import rows


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(1)
    # One key holds a third of all rows, another a single one.
    data = [("hot" if i % 3 == 0 else f"k{i % 7}", i, rnd.choice([None, None, f"v{i}"]), rnd.randrange(5)) for i in range(600)] + [("one", 5, None, 1)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "k string, at long, v string, n long").cache()


@pytest.mark.parametrize("size", [1, 7, 100000])
@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_running_equals_a_window(spark, events, size, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = running(events, ["k"], [F.floor(F.col("at") / size)], ["at"], {"total": F.col("n")}, {"last": F.col("v")}, {"prev": F.col("v")})
        w = Window.partitionBy("k").orderBy("at")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        plain = events.select("k", "at", F.sum("n").over(upto).alias("total"), F.last("v", True).over(upto).alias("last"), F.lag("v").over(w).alias("prev"))
        columns = ("k", "at", "total", "last", "prev")
        assert rows(found, *columns) == rows(plain, *columns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_draws_repeat_and_stay_in_range(spark):
    df = spark.range(1000).select(S.draw("s", F.lit(7), "id").alias("d"), S.draw("s", F.lit(7), "id").alias("e"))
    found = df.collect()
    assert all(r["d"] == r["e"] and 0 <= r["d"] < 7 for r in found)
    assert {r["d"] for r in found} == set(range(7))


def test_samples(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "g string, i long")
    got = S.sample_without_replacement(df, ["g"], "i", 5, "s")
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"a": 5, "b": 1}
    order = S.seeded_shuffle(df, ["g"], "i", "s")
    assert sorted(r["place"] for r in order.filter("g = 'a'").collect()) == list(range(1, 51))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("size", [1, 3, 1000])
def test_split_join_makes_every_pair_once(spark, how, size):
    left = spark.createDataFrame([("hot", i) for i in range(20)] + [("cold", 1), ("alone", 2)], "k string, a long")
    right = spark.createDataFrame([("hot", i) for i in range(11)] + [("cold", 7), ("unused", 3)], "k string, b long")
    assert rows(split_join(left, right, ["k"], how, size), "k", "a", "b") == rows(left.join(right, "k", how), "k", "a", "b")
    # The same with the many rows on the right.
    assert rows(split_join(right, left, ["k"], how, size), "k", "a", "b") == rows(right.join(left, "k", how), "k", "a", "b")


def test_a_hot_side_is_dealt_out(spark):
    few = spark.createDataFrame([("hot", i) for i in range(3)], "k string, a long")
    many = spark.range(300).selectExpr("'hot' as k", "id as b")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for one, other in ((few, many), (many, few)):
            made = split_join(one, other, ["k"], rows=10).withColumn("part", F.spark_partition_id())
            assert made.count() == 900 and made.select("part").distinct().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_totals_and_top_rows(spark, events):
    n = with_totals(events, ["k"], {"size": F.count("*")})
    assert {r["k"]: r["size"] for r in n.select("k", "size").distinct().collect()} == {r["k"]: r["count"] for r in events.groupBy("k").count().collect()}
    top = top_rows(events, ["k"], [F.col("at").desc()], 2)
    assert top.filter("k = 'hot'").count() == 2 and top.filter("k = 'one'").count() == 1
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("coarse", [2, 50, 10**6])
def test_blocks_of_blocks_and_nulls(spark, coarse):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), i if i % 11 else None, i, rnd.choice([None, f"v{i}"])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, at long, tie long, v string")
    block = [F.floor(F.col("at") / coarse), F.floor(F.col("at") / 7), F.col("at")]
    found = running(df, ["k"], block, ["at", "tie"], {"n": F.lit(1)}, {"last": F.col("v")}, {"prev": F.col("tie")})
    w = Window.partitionBy("k").orderBy("at", "tie")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("k", "tie", F.count("*").over(upto).alias("n"), F.last("v", True).over(upto).alias("last"), F.lag("tie").over(w).alias("prev"))
    assert found.count() == 300
    assert rows(found, "k", "tie", "n", "last", "prev") == rows(plain, "k", "tie", "n", "last", "prev")


def test_draws_have_sixty_bits(spark):
    many = spark.range(200).select(S.draw("s", F.lit(10**17), "id").alias("d")).agg(F.max("d")).first()[0]
    assert many > 2**33
