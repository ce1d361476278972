"""Settings that the registered queries plan by."""

from pyspark.sql import functions as F

from clauseloom.plans import registry


def test_compressed_side_is_not_broadcast(spark, tmp_path):
    """A small file of repeated texts is large as rows: what is broadcast goes by these."""
    rows = spark.range(20000).select("id", F.expr("repeat(concat('text ', id % 7), 200)").alias("text"))
    rows.repartition(2).write.parquet(f"{tmp_path}/texts")
    assert sum(f.stat().st_size for f in (tmp_path / "texts").glob("*.parquet")) < 1_000_000

    def joined(spark, sf):
        texts = spark.read.parquet(f"{sf}/texts")
        return texts.withColumnRenamed("text", "other").join(texts, "id")

    registry.query("compressed_side")(joined)
    try:
        found = registry.QUERIES["compressed_side"](spark, str(tmp_path)).select((F.length("text") + F.length("other")).alias("n"))
        assert sum(r.n for r in found.collect()) == 20000 * 6 * 200 * 2
    finally:
        del registry.QUERIES["compressed_side"]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_own_threshold_stays(spark):
    name = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, static = spark.conf.get(name, None), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "123456")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "654321")
    try:
        registry.plan_by_sizes(spark)
        assert spark.conf.get(name) == "123456"
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "654321"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", static)
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
