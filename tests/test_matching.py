import random

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import matching as M
from clauseloom.operators import sampling as S
from tests.conftest import rows

TITLES = "meeting string, title_no long, title string"
WORDS = "meeting string, cluster_no long, rank long, word string"


def test_greedy_orders(spark):
    titles = spark.createDataFrame([("m", 0, "防災"), ("m", 1, "水道")], TITLES)
    words = spark.createDataFrame([("m", 1, 1, "水道"), ("m", 1, 2, "防災"), ("m", 2, 1, "防災")], WORDS)
    assert rows(M.greedy_match(titles, words), "cluster_no", "title_no") == [(1, 0)]
    assert rows(M.greedy_match_by_rank(titles, words), "cluster_no", "title_no") == [(1, 1), (2, 0)]


@pytest.mark.parametrize("seed,walked", [(0, 4096), (1, 7), (2, 1)])
def test_greedy_equals_the_plain_loops(spark, monkeypatch, seed, walked):
    monkeypatch.setattr(M, "WALKED", walked)
    rnd = random.Random(seed)
    letters = "abcdefgh"
    titles, words = [], []
    for m in "xyz":
        titles += [(m, t, "".join(rnd.sample(letters, 2))) for t in range(12)]
        words += [(m, c, r, w) for c in range(6) for r, w in enumerate(rnd.sample(letters, 5), 1)]
    by_cluster, by_rank = set(), set()
    for m in "xyz":
        mine = {t: s for mm, t, s in titles if mm == m}
        free = dict(mine)
        for c in range(6):
            own = [w for mm, cc, r, w in words if (mm, cc) == (m, c)]
            for t in sorted(free):
                if any(w in free[t] for w in own):
                    by_cluster.add((m, c, t))
                    del free[t]
                    break
        free, left = dict(mine), list(range(6))
        for rank in range(1, 6):
            for t in sorted(free):
                for c in left:
                    if [w for mm, cc, r, w in words if (mm, cc, r) == (m, c, rank)][0] in mine[t]:
                        by_rank.add((m, c, t))
                        del free[t]
                        left.remove(c)
                        break
    tdf, wdf = spark.createDataFrame(titles, TITLES), spark.createDataFrame(words, WORDS)
    assert {tuple(r) for r in M.greedy_match(tdf, wdf).select("meeting", "cluster_no", "title_no").collect()} == by_cluster
    assert {tuple(r) for r in M.greedy_match_by_rank(tdf, wdf).select("meeting", "cluster_no", "title_no").collect()} == by_rank


def test_counts_and_rate(spark):
    titles = spark.createDataFrame([("m", 0, "abc"), ("m", 1, "xyz"), ("n", 0, "abc")], "meeting string, title_id long, title string")
    words = spark.createDataFrame([("m", 0, "ab"), ("m", 1, "ab"), ("m", 1, "c")], "meeting string, topic long, word string")
    assert rows(M.word_match_count(titles, words), "meeting", "title_id", "match_num") == [("m", 0, 3), ("m", 1, 0), ("n", 0, 0)]
    matched = M.any_word_match(titles, words)
    assert M.match_rate(matched).first()["match_rate"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("n,sizes", [(9, (7, 0, 2)), (10, (8, 1, 1)), (11, (8, 1, 2)), (25, (20, 2, 3))])
def test_split_sizes(spark, n, sizes):
    df = spark.range(n).withColumnRenamed("id", "at")
    made = S.split_by_position(df, "at", [F.floor(F.col("at") / 4)])
    found = {r["part"]: r["count"] for r in made.groupBy("part").count().collect()}
    assert tuple(found.get(p, 0) for p in ("train", "eval", "test")) == sizes
    assert [r["at"] for r in made.filter("part = 'train'").orderBy("at").collect()] == list(range(sizes[0]))


def test_summary_hits_count_every_reply_row(spark):
    pairs = spark.createDataFrame([("m", "ab cd", "q", "r"), ("m", "ab cd", "q", "r"), ("n", "zz", "q", "r")], "meeting string, short_summary string, questioner string, respondent string")
    scores = spark.createDataFrame([("m", 0, "q", "r", w, s) for w, s in (("ab", 0.9), ("cd", 0.8), ("no", 0.7))], "meeting string, discussion long, questioner string, respondent string, word string, ratio double")
    assert rows(M.pair_summary_hits(pairs, scores), "meeting", "hits") == [("m", 4), ("n", 0)]


def test_order_may_meet_the_edges(spark):
    titles = spark.createDataFrame([("m", 1, "tax law"), ("m", 2, "park tax"), ("m", 3, "road")], "meeting string, title_no long, title string")
    words = spark.createDataFrame([("m", 7, 1, "tax"), ("m", 7, 2, "road"), ("m", 8, 1, "tax"), ("m", 8, 2, "park"), ("m", 9, 1, "law")], "meeting string, cluster long, rank long, word string")
    order = spark.createDataFrame([("m", 9, 1), ("m", 8, 2), ("m", 7, 3)], "meeting string, cluster long, cluster_no long")
    joined = M.greedy_match_by_rank(titles, words.join(order, ["meeting", "cluster"]).drop("cluster"))
    late = M.greedy_match_by_rank(titles, words, order)
    assert sorted(late.collect()) == sorted(joined.collect()) and late.count() == 3
