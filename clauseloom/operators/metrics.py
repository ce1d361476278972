"""Scores over pairs and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.ordered import running
from clauseloom.session import cut_lineage


def pair_same_cluster(pairs: DataFrame, clusters: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Adjacency pairs (meeting, anchor, positive) with both clusters and whether they agree.

    ``extra`` are further key columns of ``clusters``, such as the vector size they came from."""
    keys = ["meeting", *extra]
    a = clusters.select(*keys, F.col("id").alias("anchor"), F.col("cluster").alias("anchor_cluster"))
    b = clusters.select(*keys, F.col("id").alias("positive"), F.col("cluster").alias("positive_cluster"))
    return (
        pairs.join(a, ["meeting", "anchor"])
        .join(b, [*keys, "positive"])
        .withColumn("same", (F.col("anchor_cluster") == F.col("positive_cluster")).cast("long"))
    )


def same_cluster_accuracy(pairs: DataFrame, clusters: DataFrame, by: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    return (
        pair_same_cluster(pairs, clusters, extra)
        .groupBy(*by, *extra)
        .agg(F.count("*").alias("pairs"), F.sum("same").alias("agreeing"), F.avg(F.col("same").cast("double")).alias("accuracy"))
    )


def score_steps(scored: DataFrame, cells: float = 1024.0) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives at it and up to it.

    Rows are counted per score first; the cumulative counts then run over blocks of scores, so
    neither the rows nor the distinct scores pass through one task. ``cells`` is the number of
    blocks per unit of score. Rows without a score can't be placed on the curve: they count neither
    in the steps nor in the totals."""
    steps = scored.filter(F.col("score").isNotNull()).groupBy("score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") != 1).cast("long")).alias("neg")
    )
    # Counts per score, made by one pass over the rows and read three times.
    steps = cut_lineage(steps)
    down = -F.col("score")
    cumulative = running(steps, [], [F.floor(down * cells)], [down], sums={"tp": F.col("pos"), "fp": F.col("neg")})
    return cumulative.withColumns({"all_pos": steps.agg(F.sum("pos")).scalar(), "all_neg": steps.agg(F.sum("neg")).scalar()})


def roc_curve(scored: DataFrame, cells: float = 1024.0) -> DataFrame:
    """(score, fpr, tpr) at every distinct score, and the starting point (null, 0, 0)."""
    steps = score_steps(scored, cells)
    points = steps.select(
        "score",
        F.try_divide(F.col("fp"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("all_pos")).alias("tpr"),
    )
    start = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def roc_auc(scored: DataFrame, cells: float = 1024.0) -> DataFrame:
    """Area under the curve by trapezoids, ties counted half."""
    steps = score_steps(scored, cells)
    twice = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")))
    return steps.agg(
        F.max("all_pos").alias("positives"),
        F.max("all_neg").alias("negatives"),
        F.try_divide(twice, 2 * F.max("all_pos") * F.max("all_neg")).alias("auc"),
    )
