import pytest
from pyspark.sql import functions as F

from clauseloom.operators import dialog as D
from clauseloom.operators import labels as L
from clauseloom.sources import tables as T
from clauseloom.sources import vectors as V
from tests.conftest import rows


def test_unknown_extension_is_an_error(spark, tmp_path):
    for name in ("x.parquet", "noextension"):
        with pytest.raises(ValueError):
            T.read_table(spark, str(tmp_path / name))


def test_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a,"b"\nc '), (2, ""), (3, None)], "id long, s string")
    for name in ("t.csv", "t.tsv"):
        path = str(tmp_path / name)
        T.write_table(df, path)
        assert rows(T.read_table(spark, path, "id long, s string", has_header=True), "id", "s") == rows(df, "id", "s")


def test_headerless_names(spark, tmp_path):
    (tmp_path / "nli.tsv").write_text("yes\ta b\tc\nno\td\te\n")
    df = T.read_headerless(spark, str(tmp_path / "nli.tsv"))
    assert df.columns == ["column_1", "column_2", "column_3"]
    assert rows(L.encode_labels(df), "column_1", "column_4") == [("no", 0), ("yes", 1)]


def test_json_table(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": {"b":\n [1, 2]}}')
    assert T.read_table(spark, str(tmp_path / "m.json"), "a struct<b: array<long>>").first()["a"]["b"] == [1, 2]


def test_vector_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("甲", 3000), ("乙", 10)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{i}.0,{i}.5\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = V.read_vectors(spark, str(tmp_path)).cache()
        assert df.rdd.getNumPartitions() > 1
        assert df.filter(F.get("vec", F.lit(0)) != F.col("id")).count() == 0
        assert rows(df.groupBy("meeting").count(), "meeting", "count") == [("乙", 10), ("甲", 3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_vector_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([(m, i, [float(i), -1e-9]) for m in "ab" for i in range(25)], "meeting string, id long, vec array<double>")
    path = str(tmp_path / "v")
    V.write_vectors(df, path, 10)
    assert rows(V.read_vectors(spark, path), "meeting", "id", "vec") == rows(df, "meeting", "id", "vec")


def test_store_scores_only_missing_texts(spark, tmp_path):
    path = str(tmp_path / "store")
    one = spark.createDataFrame([("a", [1.0])], "text string, prob array<double>").withColumn("kind", F.lit("t"))
    V.save_to_store(one, path)
    texts = spark.createDataFrame([("a",), ("b",), ("b",)], "text string")
    V.append_missing(texts, lambda t: t.withColumn("prob", F.array(F.lit(2.0))), spark, path, "t")
    V.append_missing(texts, lambda t: t.withColumn("prob", F.array(F.lit(3.0))), spark, path, "t")
    assert rows(V.load_from_store(texts, spark, path, "t"), "text", "prob") == [("a", [1.0]), ("b", [2.0]), ("b", [2.0])]
    assert V.load_from_store(texts, spark, path, "other").count() == 0


def test_examples(spark):
    df = spark.createDataFrame([(0, "a", "b", None), (1, "c", "a", "d"), (2, "e", "f", "g")], "n long, x string, y string, z string")
    made = T.load_triples(df, "file", ["n"], ["x", "y", "z"], F.col("n"))
    assert rows(made, "guid", "texts") == [("file-0", ["a", "b", "None"]), ("file-1", ["c", "a", "d"]), ("file-2", ["e", "f", "g"])]
    assert T.load_triples(df, "file", ["n"], ["x", "y", "z"], F.col("n"), 2).count() == 2
    sentences, pairs = D.sentence_registry(made.withColumn("at", F.substring_index("guid", "-", -1).cast("long")), "at", block=2)
    assert rows(sentences, "id", "sentence")[:4] == [("0", "a"), ("1", "b"), ("2", "None"), ("3", "c")]
    assert rows(pairs, "at", "id1", "id2") == [(0, "0", "1"), (1, "3", "0"), (2, "5", "6")]
    assert D.anchor_pos_neg(made).columns == ["guid", "anchor", "positive", "negative"]
