import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseloom.functions import vectors as V
from clauseloom.operators import density as C
from clauseloom.operators import metrics as R
from clauseloom.operators import models as K
from clauseloom.operators import vectors as O
from tests.conftest import rows


@pytest.mark.parametrize("dim", [None, 4])
def test_distances(spark, dim):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4], [0.4, 0.3, 0.1, 0.2], [0.1, 0.1, 0.1, 0.7], [0.0] * 4)], "a array<double>, c array<double>, z array<double>, o array<double>")
    a, c, z, o = (F.col(n) for n in "aczo")
    got = df.select(
        V.cosine_similarity(a, c, dim), V.euclidean_distance(a, c, dim), V.manhattan_distance(a, c, dim), V.chebyshev_distance(a, c, dim),
        V.histogram_kl(a, c), V.histogram_kl(a, z), V.cosine_similarity(a, o, dim), V.histogram_kl(o, o),
    ).first()
    for value, expected in zip(got, (0.7, 0.424264, 0.8, 0.3, 0.0, 5.481871)):
        assert math.isclose(value, expected, abs_tol=1e-6)
    assert got[6] is None and got[7] == 0


CLUSTERED = [(0, 1, "p"), (1, 1, "q"), (2, 1, "r"), (3, 2, "s"), (9, 1, "r")]
VECS = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [3.0, 4.0]), (9, [1.0, 1.0])]


def test_centroid_filter(spark):
    clustered = spark.createDataFrame([("m", *r) for r in CLUSTERED], "meeting string, id long, cluster long, utterance string")
    vectors = spark.createDataFrame([("m", *r) for r in VECS], "meeting string, id long, vec array<double>")
    middle = {r["cluster"]: r["vec"] for r in O.centroid(clustered, vectors).collect()}
    assert all(math.isclose(x, 2 / 3) for x in middle[1])
    central = O.cosine_to_centroid(clustered, vectors)
    found = {r["id"]: round(r["cos_similarity_to_com"], 6) for r in central.collect()}
    assert found == {0: 0.707107, 1: 0.707107, 2: 1.0, 3: 1.0}
    assert [r["id"] for r in O.above_cluster_mean(central, 9).collect()] == [2]


def test_roc(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0)], "score double, label long")
    assert rows(R.roc_curve(scored), "fpr", "tpr") == sorted([(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)], key=str)
    assert R.roc_auc(scored).first()["auc"] == 0.875


def test_auc_equals_pair_ranking(spark):
    rnd = random.Random(3)
    data = [(round(rnd.random(), 2), rnd.randrange(2)) for _ in range(300)]
    pairs = [(p, n) for p, a in data if a for n, b in data if not b]
    expected = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    for cells in (1 / 8, 16.0, 1024.0):
        got = R.roc_auc(spark.createDataFrame(data, "score double, label long"), cells).first()["auc"]
        assert math.isclose(got, expected)


def test_same_cluster_accuracy_per_setting(spark):
    pairs = spark.createDataFrame([("m", 1, 2), ("m", 2, 3)], "meeting string, anchor long, positive long")
    data = [("m", d, i, c) for d, cs in ((3, (1, 1, 2)), (5, (1, 1, 1))) for i, c in enumerate(cs, 1)]
    clusters = spark.createDataFrame(data, "meeting string, dim long, id long, cluster long")
    assert rows(R.same_cluster_accuracy(pairs, clusters, extra=["dim"]), "dim", "pairs", "accuracy") == [(3, 2, 0.5), (5, 2, 1.0)]


def test_nearest_without_a_speaker_is_null(spark):
    asked = spark.createDataFrame([("m", 0, "a", [1.0, 0.0]), ("m", 1, "b", [1.0, 0.0])], "meeting string, id long, speaker_name string, vec array<double>")
    minutes = spark.createDataFrame([("m", 7, "a", [1.0, 1.0]), ("m", 8, "a", [2.0, 0.1])], "meeting string, id long, speaker_name string, vec array<double>")
    assert rows(O.nearest_same_speaker(asked, minutes), "id", "near_id") == [(0, 8), (1, None)]
    mean = O.topk_mean_vector(asked, minutes).first()["vec"]
    assert [round(x, 6) for x in mean] == [1.0, round(1.1 / 3, 6)]
    counted = O.topk_mean_vector(asked, minutes, divide_by="count").first()["vec"]
    assert [round(x, 6) for x in counted] == [1.5, 0.55]


def test_self_matches_are_left_out_of_distances_only(spark):
    titles = spark.createDataFrame([("m", 1, "t", [0.2, 0.8]), ("m", 2, "t", [0.9, 0.1])], "meeting string, title_id long, title string, vec array<double>")
    clauses = spark.createDataFrame([("m", 0, "x", [0.2, 0.8]), ("m", 1, "y", [0.5, 0.5])], "meeting string, clause_id long, clause string, vec array<double>")
    metrics = O.title_clause_metrics(titles, clauses, 2)
    assert sorted(r["id"] for r in metrics.collect()) == [0, 1, 2, 3]
    top = O.topk_by_metric(metrics, 1)
    best = {(r["title_id"], r["metric"]): r["clause"] for r in top.collect()}
    assert best[(1, "cos_similarity")] == "x" and best[(1, "euclidean_distance")] == "y"
    truth = spark.createDataFrame([("m", 1, "x")], "meeting string, title_id long, clause string")
    report = {r["metric"]: r["rate"] for r in O.metric_report(O.clause_in_topk(truth, top)).collect()}
    assert report["cos_similarity"] == 1.0 and report["euclidean_distance"] == 0.0


def brute_components(points, eps):
    root = {k: k for k in points}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(points)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if a[0] == b[0] and (points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2 <= eps * eps:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("eps", [0.03, 0.08])
def test_density_clusters_equal_brute_force(spark, eps):
    rnd = random.Random(5)
    points = {("m", i): (rnd.random(), rnd.random()) for i in range(250)}
    # A chain, a hot spot of copies and near copies, and another meeting in the same place.
    points |= {("m", 1000 + i): (2 + 0.9 * eps * i, 2.0) for i in range(40)}
    points |= {("m", 2000 + i): (3.0 + rnd.choice([0, 0, eps / 50]), 3.0) for i in range(150)}
    points |= {("n", i): (rnd.random() / 3, rnd.random() / 3) for i in range(60)}
    roots = brute_components(points, eps)
    sizes = {}
    for r in roots.values():
        sizes[r] = sizes.get(r, 0) + 1
    big = {m: sorted(r for r, n in sizes.items() if n >= 4 and r[0] == m) for m in "mn"}
    expected = {k: big[k[0]].index(r) if r in big[k[0]] else -1 for k, r in roots.items()}
    df = spark.createDataFrame([(*k, *v) for k, v in points.items()], "meeting string, id long, x double, y double")
    found = {(r["meeting"], r["id"]): r["cluster"] for r in C.density_cluster(df, eps, 4).collect()}
    assert found == expected


def test_user_encoder_and_reduction(spark):
    docs = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(20)], "id long, text string")
    vecs = K.embed_with(docs, lambda texts: [[len(t), 1.0, len(t) % 3] for t in texts], "text")
    assert {len(r["vec"]) for r in K.reduce_dimension(vecs).collect()} == {2}
    clusters = {r["cluster"] for r in K.variance_cluster(vecs, 4).collect()}
    assert min(clusters) == 1 and max(clusters) <= 4
    again = K.variance_cluster(vecs, 4)
    assert rows(again, "id", "cluster") == rows(K.variance_cluster(vecs, 4), "id", "cluster")


@pytest.mark.parametrize("block,from_right", [(2048, False), (9, True)])
def test_nearest_by_metric_equals_all_pairs(spark, monkeypatch, block, from_right):
    """Blocks against the pair table, with ties, zero vectors, equal vectors and rows without a vector."""
    from clauseloom.operators import blocks as B

    monkeypatch.setattr(B, "BLOCK_ROWS", block)
    rnd = random.Random(block)
    vec = lambda: [float(rnd.randrange(3)) for _ in range(4)]
    left = [(m, i, vec()) for m in ("a", None) for i in range(14)] + [("a", 90, [0.0] * 4), ("alone", 1, vec())]
    right = [(m, i, vec()) for m in ("a", None, "b") for i in range(25)] + [("a", 90, [0.0] * 4), ("a", 91, None)]
    dl = spark.createDataFrame(left, "meeting string, title_id long, vec array<double>")
    dr = spark.createDataFrame(right, "meeting string, clause_id long, vec array<double>")
    a, b = F.col("x.vec"), F.col("y.vec")
    divergence = V.histogram_kl(b, a) if from_right else V.histogram_kl(a, b)
    values = [V.cosine_similarity(a, b), divergence, V.chebyshev_distance(a, b), V.euclidean_distance(a, b), V.manhattan_distance(a, b)]
    pairs = dl.alias("x").join(dr.alias("y"), F.col("x.meeting").eqNullSafe(F.col("y.meeting")) & F.col("y.vec").isNotNull())
    pairs = pairs.select("x.meeting", "title_id", "clause_id", *[F.round(v, 9).alias(n) for v, n in zip(values, O.METRICS, strict=True)]).collect()
    want = set()
    for metric in O.METRICS:
        sign = -1 if metric == O.METRICS[0] else 1
        for key in {(r.meeting, r.title_id) for r in pairs}:
            mine = [(r[metric] is None, sign * (r[metric] or 0.0), r.clause_id) for r in pairs if (r.meeting, r.title_id) == key and (sign < 0 or r[metric] != 0)]
            want |= {(*key, metric, k, c, None if null else sign * v + 0.0) for k, (null, v, c) in enumerate(sorted(mine)[:3], 1)}
    got = O.nearest_by_metric(dl, dr, ["meeting"], "title_id", "clause_id", 3, O.METRICS, 9, True, from_right)
    assert {(r.meeting, r.title_id, r.metric, r["rank"], r.clause_id, None if r.value is None else r.value + 0.0) for r in got.collect()} == want
    assert O.nearest_by_metric(dl.limit(0), dr, ["meeting"], "title_id", "clause_id", 3).collect() == []


def test_histograms_of_blocks_are_those_of_columns(spark, monkeypatch):
    """Nulls, undefined and infinite numbers and constants too; no column of them is written or dealt out."""
    nan, inf = float("nan"), float("inf")
    vecs = [[0.1, 0.7, 0.3], [2.0, 2.0, 2.0], [None, 1.0, 3.0], [None, None, None], [nan, 1.0, 2.0], [nan, nan, nan], [nan, None, 1.0], [inf, 0.0, 1.0], [-inf, inf, 0.0], [-0.0, 0.0, 0.3]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, vec array<double>")
    want = [r.h for r in df.select("id", V.histogram(F.col("vec")).alias("h")).orderBy("id").collect()]
    flat = pa.array([x for v in vecs for x in v], pa.float64(), from_pandas=False)
    assert O._histograms(flat, np.array(flat, float).reshape(len(vecs), -1)).tolist() == want

    def none(vec):
        raise AssertionError("a histogram column")

    monkeypatch.setattr(V, "histogram", none)
    named = df.filter("id < 2").select(F.lit("m").alias("meeting"), "id", F.col("id").alias("other"), "vec")
    assert O.nearest_by_metric(named, named, ["meeting"], "id", "other", 1, O.METRICS[1:2]).count() == 2


def test_cluster_shares(spark):
    from clauseloom.operators import topics as P

    docs = spark.createDataFrame([("m", 1, ["a", "b"]), ("m", 2, ["a", "c", "zz", "c", "c"]), ("m", 3, []), ("m", 4, None), ("n", 1, ["a"])], "meeting string, id long, words array<string>")
    bag = spark.createDataFrame([("m", 0, "a", 2), ("m", 0, "b", 1), ("m", 1, "c", 3)], "meeting string, doc long, word string, n long")
    shares = {(r.meeting, r.id, r.cluster): r.share for r in P.cluster_shares(docs, bag).collect()}
    # Class lengths are 3 and 3: idf is ln(1 + 3 / f). Text 1 is like cluster 0 only.
    idf = {"a": math.log(1 + 3 / 2), "b": math.log(4), "c": math.log(2)}
    weight = {0: {"a": 2 / 3 * idf["a"], "b": 1 / 3 * idf["b"]}, 1: {"c": idf["c"]}}

    def near(words, c):
        x = {w: words.count(w) * idf[w] for w in set(words) if w in idf}
        dot = sum(v * weight[c].get(w, 0.0) for w, v in x.items())
        return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in weight[c].values()))

    runs = [["a", "c", "zz", "c"], ["c", "zz", "c", "c"]]
    sums = [sum(v for r in runs if (v := near(r, c)) >= 0.1) for c in (0, 1)]
    assert set(shares) == {("m", 1, 0), ("m", 2, 0), ("m", 2, 1)} and shares["m", 1, 0] == 1.0
    assert all(math.isclose(shares["m", 2, c], sums[c] / sum(sums)) for c in (0, 1))


def test_pairs_that_bring_their_vectors_are_not_joined_again(spark):
    rows = [("m", 0, "t", "a", "x", [1.0, 0.0]), ("m", 1, "t", "b", "y", [1.0, 1.0]), ("m", 2, "u", "b", "y", [0.0, 0.0]), ("n", 0, "t", "c", "z", [3.0, 4.0])]
    df = spark.createDataFrame(rows, "meeting string, id long, title string, speaker_name string, clause string, vec array<double>")
    pairs = O.speaker_pair_relation(df).drop("policy_clause", "reply_clause")
    joined = O.pair_similarity(pairs, df.select("meeting", "id", "vec"), 2)
    carried = O.pair_similarity(O.speaker_pair_relation(df.withColumn("norm", V.norm(F.col("vec"), 2)), ("vec", "norm")), dim=2)
    assert carried.columns == joined.columns
    assert sorted(carried.collect()) == sorted(joined.collect()) and carried.count() == 2
    assert carried._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_mean_of_vectors_of_known_length(spark):
    df = spark.createDataFrame([("m", 1, [1.0, 2.0]), ("m", 1, [3.0, None]), ("m", 2, None), ("m", 3, [None, 1.0]), (None, 4, [1.0, 1.0])], "meeting string, id int, vec array<double>")
    for divisor in (None, 3):
        known, plain = (O.mean_vector(df, ["meeting", "id"], divisor, dim) for dim in (2, None))
        assert rows(known, "meeting", "id", "vec") == rows(plain, "meeting", "id", "vec")
        assert "Generate" not in known._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="without exactly 3"):
        O.mean_vector(df, ["meeting", "id"], None, 3).collect()


def test_cosines_to_centroids_are_made_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(O, "cut_lineage", lambda df: written.append(df.columns) or df)
    near = spark.createDataFrame([("m", 1, 7, "a", 0.5), ("m", 2, 7, "b", 0.9), ("m", 3, 8, "c", 1.0)], "meeting string, id int, cluster int, utterance string, cos_similarity_to_com double")
    assert [r["id"] for r in O.above_cluster_mean(near).collect()] == [2]
    assert written == [near.columns]
    members = near.select("meeting", "id", "cluster", "utterance")
    vectors = spark.createDataFrame([("m", i, [1.0, float(i)]) for i in (1, 2, 3)], "meeting string, id int, vec array<double>")
    assert "Generate" not in O.cosine_to_centroid(members, vectors, 2)._jdf.queryExecution().optimizedPlan().toString()
