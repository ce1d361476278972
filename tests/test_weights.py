import math

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators import weights as W

DOCS = [("m", "d1", ["a", "a", "b"]), ("m", "d2", ["b", "c"]), ("m", "d3", ["b", "d", "d", "d"])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "meeting string, doc string, tokens array<string>")


@pytest.fixture(scope="module", params=["spread over rows", "one row each"])
def bag(docs, request):
    if request.param == "one row each":
        return W.document_bag(docs, F.col("tokens"))
    return W.bag_of_words(docs, F.col("tokens"))


def table(df, column):
    return {(r["doc"], r["word"]): r[column] for r in df.collect()}


def close(found, expected):
    assert set(found) == set(expected)
    assert all(math.isclose(found[k], v, abs_tol=1e-6) for k, v in expected.items())


def test_idf(bag, docs):
    found = {r["word"]: r["idf"] for r in W.inverse_doc_frequency(bag, W.document_counts(docs)).collect()}
    close(found, {"a": 0.916291, "b": 0.559616, "c": 0.916291, "d": 0.916291})


def test_tf_idf(bag, docs):
    found = table(W.tf_idf(bag, W.document_counts(docs)), "tf_idf")
    close(found, {("d1", "a"): 0.610860, ("d1", "b"): 0.186539, ("d2", "b"): 0.279808, ("d2", "c"): 0.458145, ("d3", "b"): 0.139904, ("d3", "d"): 0.687218})


def test_l1(bag, docs):
    found = table(W.doc_representation(bag, W.document_counts(docs)), "weight")
    close(found, {("d1", "a"): 0.766066, ("d1", "b"): 0.233934, ("d2", "b"): 0.379168, ("d2", "c"): 0.620832, ("d3", "b"): 0.169145, ("d3", "d"): 0.830855})


def test_l2_smooth(bag, docs):
    found = table(W.smooth_l2_tfidf(bag, W.document_counts(docs)), "weight")
    close(found, {("d1", "a"): 0.972772, ("d1", "b"): 0.231765, ("d2", "b"): 0.430165, ("d2", "c"): 0.902750, ("d3", "b"): 0.156869, ("d3", "d"): 0.987619})


def test_l2_log2(bag, docs):
    close(table(W.log2_l2_tfidf(bag, W.document_counts(docs)), "weight"), {("d1", "a"): 1.0, ("d2", "c"): 1.0, ("d3", "d"): 1.0})


def test_filter_extremes(bag, docs):
    n = W.document_counts(docs)
    assert W.filter_extremes(bag, n).count() == 0
    assert {r["word"] for r in W.filter_extremes(bag, n, 2, 1.0).collect()} == {"b"}
    assert {r["word"] for r in W.filter_extremes(bag, n, 1, 1.0, keep=2).collect()} == {"b", "a"}


def test_ranking_is_the_plain_order(spark):
    scores = [("m", f"w{i:03d}", [0.5, 0.25, 0.25, 0.0, -1.0, 1e-9 * i][i % 6]) for i in range(300)]
    df = spark.createDataFrame(scores, "meeting string, word string, s double")
    found = {r["word"]: r["rank"] for r in W.word_ranking(df, ["meeting"], "s").collect()}
    plain = sorted(scores, key=lambda r: (-r[2], r[1]))
    assert found == {word: i for i, (_, word, _) in enumerate(plain, 1)}


def test_first_seen_order(docs):
    seen = W.concat_documents(docs, F.col("tokens"), ["meeting"], "doc")
    made = W.dedupe_in_order(seen, ["meeting"], ["doc", "pos"], [F.col("first.doc")])
    assert [r["word"] for r in made.orderBy("place").collect()] == ["a", "b", "c", "d"]


def test_class_weights(bag):
    found = table(W.class_tfidf(bag.drop("doc_len")), "weight")
    assert math.isclose(found[("d1", "a")], 2 / 3 * math.log(1 + 3 / 2))


def test_dense_export(docs):
    clauses = docs.select("meeting", F.col("doc").alias("cluster"), F.array_join("tokens", " ").alias("utterance"))
    weights = W.cluster_tfidf(clauses, F.array(F.col("utterance"), F.lit("zz")))
    wide = W.dense_scores(weights, "cluster", ["d1", "d2", "d3"])
    assert wide.columns == ["meeting", "words", "cluster1", "cluster2", "cluster3"]
    assert {r["words"] for r in wide.collect()} == {"zz"}


def test_weights_have_unit_size(bag, docs):
    n = W.document_counts(docs)
    l1 = W.doc_representation(bag, n).groupBy("doc").agg(F.sum("weight").alias("s"))
    assert all(math.isclose(r["s"], 1.0) for r in l1.collect())
    for made in (W.smooth_l2_tfidf(bag, n), W.log2_l2_tfidf(bag, n)):
        l2 = made.groupBy("doc").agg(F.sum(F.col("weight") * F.col("weight")).alias("s"))
        assert all(math.isclose(r["s"], 1.0) for r in l2.collect())


def test_document_bag_shuffles_texts_only(spark, tmp_path):
    """Words are counted in the task that unfolds them; rows that repeat a document are counted together."""
    data = [("m", 1, "a b a"), ("m", 1, "a c c"), ("m", 1, "d"), ("n", 1, "a"), ("m", 2, None), (None, 3, "a a"), ("m", None, "b")]
    spark.createDataFrame(data, "meeting string, doc long, text string").write.parquet(f"{tmp_path}/docs")
    bag = W.document_bag(spark.read.parquet(f"{tmp_path}/docs"), F.split("text", " "))
    want = [("m", 1, "a", 3, 3), ("m", 1, "b", 3, 1), ("m", 1, "c", 3, 2), ("m", 1, "d", 1, 1), ("n", 1, "a", 1, 1), (None, 3, "a", 2, 2), ("m", None, "b", 1, 1)]
    assert sorted(map(str, map(tuple, bag.collect()))) == sorted(map(str, want))
    final = bag._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "word" not in final.split("Exchange hashpartitioning(")[1].split(")")[0]


def test_texts_are_tokenized_once(spark):
    texts = spark.createDataFrame([("m", "d", "水道 park"), ("m", "e", None)], "meeting string, doc string, text string")
    for made in (W.bag_of_words(texts, X.tokenize(F.col("text"))), W.concat_documents(texts, X.tokenize(F.col("text")), ["meeting"], "doc")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1 and "translate(" not in plan
        assert sorted(r["word"] for r in made.collect()) == ["park", "水道"]


@pytest.mark.parametrize("most, one", [(200_000, True), (250, False)])
def test_ranking_takes_one_window_unless_a_key_is_large(spark, monkeypatch, most, one):
    monkeypatch.setattr(W, "RANKED_WORDS", most)
    scores = [(m, f"w{i:03d}", [0.5, 0.25, 0.25, 0.0, -1.0, 1e-9 * i][i % 6]) for m, n in (("m", 300), ("n", 200)) for i in range(n)]
    made = W.word_ranking(spark.createDataFrame(scores, "meeting string, word string, s double"), ["meeting"], "s")
    plain = {m: sorted((r for r in scores if r[0] == m), key=lambda r: (-r[2], r[1])) for m in "mn"}
    assert {(r["meeting"], r["word"]): r["rank"] for r in made.collect()} == {r[:2]: i for rows in plain.values() for i, r in enumerate(rows, 1)}
    assert (made._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1) == one


def test_bounds_spare_the_scores_a_table_of_their_own(spark, monkeypatch):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 2.0)], "meeting string, word string, s double")
    written = []
    monkeypatch.setattr(W, "cut_lineage", lambda x: written.append(x.columns) or x)
    made = W.word_ranking(df, ["meeting"], "s", df.groupBy("meeting").agg(F.count("*").alias("n")))
    assert written == [["meeting"]] and {(r["word"], r["rank"]) for r in made.collect()} == {("b", 1), ("a", 2)}
