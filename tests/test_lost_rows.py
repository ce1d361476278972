"""Rows that used to get lost: null scores and labels, other vector lengths, changed files."""

import inspect

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import vectors as V
from clauseloom.operators import metrics as R
from clauseloom.operators.labels import encode_labels
from clauseloom.operators.topics import fit_topic_distribution
from clauseloom.operators.weights import filter_extremes
from clauseloom.session import staged


def test_null_scores_are_in_neither_count(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0), (None, 1), (None, 0)]
    scored = spark.createDataFrame(rows, "score double, label int")
    auc = R.roc_auc(scored).first()
    assert (auc.positives, auc.negatives, auc.auc) == (2, 2, 0.75)
    assert R.roc_curve(scored).filter("score = 0.1").first()[1:] == (1.0, 1.0)


def test_other_lengths_are_errors(spark):
    df = spark.createDataFrame([([1.0, 0.0, 5.0], [1.0, 0.0, -5.0])], "a array<double>, b array<double>")
    for f in (V.cosine_similarity, V.euclidean_distance, V.manhattan_distance, V.chebyshev_distance):
        with pytest.raises(Exception, match="exactly 2 numbers"):
            df.select(f(F.col("a"), F.col("b"), 2)).collect()
        assert df.select(f(F.col("a"), F.col("b"), 3)).first()[0] == df.select(f(F.col("a"), F.col("b"))).first()[0]
    none = spark.createDataFrame([(None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert none.select(V.cosine_similarity(F.col("a"), F.col("b"), 2)).first()[0] is None


def test_null_labels_are_encoded(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("ab",)], "column_1 string")
    codes = {r.column_1: r.column_4 for r in encode_labels(df).collect()}
    assert codes == {"a": 1, "ab": 2, "b": 3} or codes == {None: 0, "a": 1, "ab": 2, "b": 3}


def test_changed_files_are_seen(spark, tmp_path):
    source = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(source)
    get = lambda: staged(spark, str(tmp_path), "rows", lambda: spark.read.parquet(source)).count()
    assert get() == 3 and get() == 3
    spark.range(4).write.mode("append").parquet(source)
    assert get() == 7


def test_no_default_caps():

    assert inspect.signature(filter_extremes).parameters["keep"].default is None
    assert inspect.signature(fit_topic_distribution).parameters["vocabulary"].default == 2**31 - 1
