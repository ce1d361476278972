"""Topic words against digest titles.

Titles: meeting, title_id, title (and ``title_no``, their order). Words: meeting, cluster or topic,
rank, word. A word matches a title that contains it. All joins are on the meeting first; the
substring test is a filter inside that join, and what is counted or reduced is reduced there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions.text import contains_word
from clauseloom.operators.ordered import split_join, top_rows
from clauseloom.session import cut_lineage


def top_words(scores: DataFrame, n: int = 5, keys: Sequence[str] = ("meeting", "cluster"), score: str = "weight", digits: int | None = None) -> DataFrame:
    """The n best words per key with their rank."""
    by = F.round(score, digits) if digits is not None else F.col(score)
    return top_rows(scores, list(keys), [by.desc(), F.col("word")], n)


def word_lists(ranked: DataFrame, keys: Sequence[str] = ("meeting", "cluster")) -> DataFrame:
    """Ranked words as one array per key; for the few words of a top-n."""
    return ranked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda w: w["word"]).alias("words")
    )


def word_hits(titles: DataFrame, words: DataFrame) -> DataFrame:
    """Every (title, word entry) of a meeting where the title contains the word."""
    return split_join(titles, words, ["meeting"]).filter(contains_word(F.col("title"), F.col("word")))


def any_word_match(titles: DataFrame, words: DataFrame) -> DataFrame:
    """Titles with ``matched`` 1 if any of the meeting's words occurs in them, else 0. A word that
    stands in several topics is tested once."""
    hit = word_hits(titles, words.select("meeting", "word").distinct()).select("meeting", "title_id").distinct()
    return titles.join(hit.withColumn("matched", F.lit(1).cast("long")), ["meeting", "title_id"], "left").na.fill(0, ["matched"])


def word_match_count(titles: DataFrame, words: DataFrame) -> DataFrame:
    """Number of (topic, word) entries contained in each title, 0 included."""
    entries = words.groupBy("meeting", "word").agg(F.count("*").alias("entries"))
    hits = word_hits(titles, entries).groupBy("meeting", "title_id").agg(F.sum("entries").alias("match_num"))
    return titles.join(hits, ["meeting", "title_id"], "left").na.fill(0, ["match_num"])


def match_rate(matched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return matched.groupBy(*keys).agg(
        F.count("*").alias("titles"), F.sum("matched").alias("matched"), F.avg(F.col("matched").cast("double")).alias("match_rate")
    )


def match_difference(titles: DataFrame, matches: DataFrame) -> DataFrame:
    """Titles that no cluster was matched to."""
    return titles.join(matches, ["meeting", "title_id"], "left_anti")


def pair_summary_hits(pairs: DataFrame, pair_scores: DataFrame, n: int = 5, score: str = "ratio", digits: int | None = None) -> DataFrame:
    """Per meeting: how many of the n best words of each debating pair occur in the pair's short
    summaries. The pair counts in every discussion it debates in, and once per pair row."""
    keys = ["meeting", "discussion", "questioner", "respondent"]
    best = top_words(pair_scores, n, keys, score, digits)
    hits = pairs.join(best, ["meeting", "questioner", "respondent"]).filter(contains_word(F.col("short_summary"), F.col("word")))
    counts = hits.groupBy("meeting").agg(F.count("*").alias("hits"))
    return pairs.select("meeting").distinct().join(counts, "meeting", "left").na.fill(0, ["hits"])


def _take_free(edges: Column) -> Column:
    """Go through sorted edges, keeping each whose cluster and title are still free."""
    start = F.struct(
        F.array().cast("array<long>").alias("clusters"),
        F.array().cast("array<long>").alias("titles"),
        F.slice(edges, 1, 0).alias("kept"),
    )

    def step(state: Column, edge: Column) -> Column:
        taken = F.array_contains(state["clusters"], edge["cluster_no"]) | F.array_contains(state["titles"], edge["title_no"])
        added = F.struct(
            F.array_append(state["clusters"], edge["cluster_no"]).alias("clusters"),
            F.array_append(state["titles"], edge["title_no"]).alias("titles"),
            F.array_append(state["kept"], edge).alias("kept"),
        )
        return F.when(taken, state).otherwise(added)

    return F.aggregate(edges, start, step, lambda state: state["kept"])


#: Edges of a meeting that one step walks through in sequence.
WALKED = 4096


def _greedy(edges: DataFrame, order: Sequence[str], sizes: DataFrame, walked: int | None = None) -> DataFrame:
    """Greedy matching over ordered edges (meeting, cluster_no, title_no, rank, word), in rounds.

    A round walks through the first ``walked`` edges of each meeting; the clusters and titles they take
    then take all their other edges with them, by anti-joins, and the next round goes on with what is
    left. That is the walk through all edges, but no task holds more than a round's edges of a meeting.
    Only the first k edges of a cluster can matter, k being the meeting's number of clusters: when the
    k-th fails too, k other clusters would have to hold k titles."""
    walked = walked or WALKED
    by_cluster = Window.partitionBy("meeting", "cluster_no").orderBy(*order)
    few = edges.join(sizes, "meeting").withColumn("nth", F.row_number().over(by_cluster)).filter(F.col("nth") <= F.col("k"))
    left = cut_lineage(few.select("meeting", "cluster_no", "title_no", "rank", "word"))
    # Sorting compares the struct's fields in turn, so the order columns come first.
    fields = [*order, *[c for c in ("cluster_no", "title_no", "rank", "word") if c not in order]]
    taken: DataFrame | None = None
    while True:
        place = F.row_number().over(Window.partitionBy("meeting").orderBy(*order))
        ahead = left.withColumn("nth", place).filter(F.col("nth") <= walked)
        listed = ahead.groupBy("meeting").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("edges"))
        kept = listed.select("meeting", F.element_at("edges", -1).alias("last"), F.inline(_take_free(F.col("edges"))))
        kept = cut_lineage(kept.select("meeting", "cluster_no", "title_no", "rank", "word", "last"))
        taken = kept if taken is None else taken.unionByName(kept)
        # What comes after the walked edges; every walk takes an edge, so a meeting with any is among them.
        ends = kept.groupBy("meeting").agg(F.first("last").alias("last"))
        rest = left.join(ends, "meeting").filter(F.struct(*fields) > F.col("last"))
        for end in ("cluster_no", "title_no"):
            rest = rest.join(kept.select("meeting", end), ["meeting", end], "left_anti")
        left = cut_lineage(rest.select(*left.columns))
        if left.isEmpty():
            return taken.select("meeting", "cluster_no", "title_no", "rank", "word")


def cluster_numbers(words: DataFrame) -> DataFrame:
    """k per meeting: the number of clusters."""
    return words.select("meeting", "cluster_no").distinct().groupBy("meeting").agg(F.count("*").alias("k"))


def greedy_match(titles: DataFrame, words: DataFrame, n: int = 5) -> DataFrame:
    """Clusters in order: each takes the first free title containing any of its n best words.

    titles: meeting, title_no, title; words: meeting, cluster_no, rank, word."""
    used = words.filter(F.col("rank") <= n)
    edges = word_hits(titles, used).groupBy("meeting", "cluster_no", "title_no").agg(F.min(F.struct("rank", "word")).alias("w"))
    edges = edges.select("meeting", "cluster_no", "title_no", "w.rank", "w.word")
    return _greedy(edges, ["cluster_no", "title_no"], cluster_numbers(used))


def greedy_match_by_rank(titles: DataFrame, words: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Ranks in order: per title, the first free cluster whose word at that rank is in the title.

    ``cluster_no`` is the clusters' (shuffled) order: a column of the words, or of ``order`` (meeting,
    cluster, cluster_no), which meets the edges, far fewer than words. An edge counts at its lowest rank
    only: if it fails there, one end is taken and stays taken."""
    cluster = "cluster_no" if order is None else "cluster"
    edges = word_hits(titles, words).groupBy("meeting", cluster, "title_no").agg(F.min(F.struct("rank", "word")).alias("w"))
    edges = edges if order is None else edges.join(order, ["meeting", "cluster"])
    edges = edges.select("meeting", "cluster_no", "title_no", "w.rank", "w.word")
    return _greedy(edges, ["rank", "title_no", "cluster_no"], cluster_numbers(words if order is None else order))
