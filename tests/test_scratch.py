"""What queries leave on disk on their way."""

import os

from pyspark.sql import functions as F

from clauseloom import session
from clauseloom.operators import models as K
from clauseloom.operators import topics as P
from clauseloom.operators import weights as W


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffles(spark)
    made = session.cut_lineage(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count())
    assert shuffles(spark) <= before
    assert made.count() == 700 and made.agg(F.sum("count")).first()[0] == 5000
    assert spark.conf.get(session.DROP_SHUFFLES, None) is None


def test_forgotten_tables_are_deleted(spark):
    one, two = (session.cut_lineage(spark.range(n)) for n in (3, 4))
    paths = [os.path.dirname(df.inputFiles()[0]).removeprefix("file:").replace("///", "/") for df in (one, two)]
    session.forget(one, spark.range(3))
    session.forget(one)
    assert [os.path.exists(p) for p in paths] == [False, True] and two.count() == 4


def test_a_staged_relation_leaves_only_itself(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t.parquet"))
    paths = []

    def build():
        step = session.cut_lineage(spark.range(7))
        paths.append(os.path.dirname(step.inputFiles()[0]).removeprefix("file:").replace("///", "/"))
        return session.cut_lineage(step.filter("id > 2")).withColumn("n", F.lit(1))

    kept = session.cut_lineage(spark.range(2))
    assert session.staged(spark, str(tmp_path), "some", build).count() == 4
    assert not os.path.exists(paths[0]) and kept.count() == 2
    assert session.staged(spark, str(tmp_path), "some", build).count() == 4 and len(paths) == 1


def test_topic_shares_are_not_written(spark, monkeypatch):
    """Of meetings that fit a task only what the model is made of is written: no row holds the shares of a word in a document."""
    written, cut = [], session.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    docs = spark.createDataFrame([("m", f"d{i % 5}", f"w{i % 9}", 1.0) for i in range(90)], "meeting string, doc string, word string, weight double")
    words, _ = P.fit_topics(docs, spark.createDataFrame([("m", 3)], "meeting string, k long"), rounds=3)
    assert words.count() == 27
    assert written and not any("r" in columns for columns in written)


def test_runs_of_small_meetings_are_not_written(spark, monkeypatch):
    written, cut = [], session.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    df = spark.createDataFrame([("m", i, i % 2, ["aa", f"b{i}", "cc", "dd", "ee"]) for i in range(8)], "meeting string, id long, doc long, words array<string>")
    assert P.cluster_shares(df.select("meeting", "id", "words"), W.bag_of_words(df, F.col("words"))).count() == 16
    assert written and not any({"start", "dot", "near", "weight"} & set(columns) for columns in written)


def test_pairs_are_made_once_for_the_classifier(spark):
    data = [("same" if i % 2 else "other", "test" if i > 30 else "train", [1.0, 0.0], [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)]
    pairs = spark.createDataFrame(data, "column_1 string, part string, u array<double>, v array<double>")
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    predicted, _ = K.pair_classifier(pairs.rdd.map(seen).toDF(pairs.schema))
    assert {r["part"]: r["accuracy"] for r in K.label_accuracy(predicted).collect()} == {"train": 1.0, "test": 1.0}
    assert made.value == 40


def test_meetings_of_many_topics_hold_sums_only(spark, monkeypatch):
    """A meeting too large for a bucket has its rounds in a task of its own, with the results of joins."""
    rows = [("m", f"d{i % 29}" if i % 50 else None, f"w{i * i % 83 if i % 3 else i % 83}" if i % 41 else None, 1.0 + i % 4) for i in range(900)] + [("n", f"d{i % 40}", f"w{i}", 2.0) for i in range(300)]
    bag = spark.createDataFrame(rows, "meeting string, doc string, word string, weight double").groupBy("meeting", "doc", "word").agg(F.sum("weight").alias("weight"))
    k = spark.createDataFrame([("m", 7), ("n", 3)], "meeting string, k long")
    made = []
    for cells, own in ((10**6, 0), (0, 10**6), (0, 0)):
        monkeypatch.setattr(P, "CELLS", cells)
        monkeypatch.setattr(P, "OWN_ROWS", own, raising=False)
        joined = P._joined_rounds
        with monkeypatch.context() as m:
            m.setattr(P, "_joined_rounds", joined if cells == own else None)
            words, theta = P.fit_topics(bag, k, rounds=4)
            words = sorted((r["meeting"], r["topic"], r["word"], round(r["probability"], 10)) for r in words.collect())
            theta = sorted((r["meeting"], r["doc"], [round(x, 10) for x in r["theta"]]) for r in theta.collect())
        made.append((words, theta))
    assert made[0] == made[1] == made[2] and len(made[0][0]) > 1000


def test_a_speakers_words_are_cut_once_for_all_titles(spark):
    said = spark.createDataFrame([("m", i, ("a", "b", "c")[i % 3], f"x{i % 4} y{i}", 0) for i in range(30)], "meeting string, id long, speaker_name string, utterance string, discussion int")
    pairs = spark.createDataFrame([("m", t, "a", "b") for t in range(6)], "meeting string, title_id long, questioner string, respondent string")
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x.split(" ")

    tokens = F.udf(seen, "array<string>")(F.col("utterance"))
    words = P.lda_bow(said, pairs, tokens, no_above=1.0, rounds=2)
    assert words.select("word").distinct().count() == 24 and words.count() == 24 * 6
    assert made.value <= 30
