"""Queries matching topic words to titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators import dialog as D
from clauseloom.operators import matching as M
from clauseloom.operators import sampling as S
from clauseloom.operators import weights as W
from clauseloom.operators.ordered import row_index
from clauseloom.plans import dialogue as DQ
from clauseloom.plans import weighting as WQ
from clauseloom.plans.registry import part, query
from clauseloom.plans.relations import CHAIR, clauses, titles
from clauseloom.plans.text import tokens_sql
from clauseloom.session import staged

# One-letter words are left out, as everywhere.
MIN_LEN = 2

part(
    "topic_clauses",
    "SELECT meeting, id, label AS cluster, utterance FROM clauses WHERE speaker_name = 'assistant'",
    "clauses",
)
part(
    "topic_words",
    f"""
    SELECT meeting, cluster, word, weight, row_number() OVER (PARTITION BY meeting, cluster ORDER BY weight DESC, word) AS rank
    FROM (
      SELECT meeting, cluster, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY meeting, cluster)), 6) AS weight
      FROM (SELECT b.meeting, b.cluster, b.word, b.n * (ln(c.k / b.df) + 1) AS x
            FROM (SELECT *, count(*) OVER (PARTITION BY meeting, word) AS df FROM (
                    SELECT meeting, cluster, word, count(*) AS n FROM (
                      SELECT meeting, cluster, unnest(list_filter({tokens_sql('utterance')}, lambda t: length(t) >= {MIN_LEN})) AS raw, lower(raw) AS word FROM topic_clauses)
                    GROUP BY ALL)) b
            JOIN (SELECT meeting, count(DISTINCT cluster) AS k FROM topic_clauses GROUP BY ALL) c ON c.meeting = b.meeting))""",
    "topic_clauses",
)
part(
    "cluster_order",
    """
    SELECT meeting, cluster, row_number() OVER (PARTITION BY meeting ORDER BY cluster) AS cluster_no,
           row_number() OVER (PARTITION BY meeting ORDER BY md5('s7:' || meeting || ':' || cluster), cluster) AS shuffled
    FROM (SELECT DISTINCT meeting, cluster FROM topic_clauses)""",
    "topic_clauses",
)
part("title_order", "SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY title_id) AS title_no FROM titles", "titles")
part("topic_top", "SELECT * FROM topic_words WHERE rank <= 5", "topic_words")


def topic_words(spark, sf):
    """Ranked words of each assistant turn; the turns are the clusters of their conversation."""

    def build():
        rows = clauses(spark, sf).filter(F.col("speaker_name") == "assistant").withColumnRenamed("label", "cluster")
        tokens = X.drop_tokens(X.tokenize(F.col("utterance")), MIN_LEN)
        weights = WQ.rounded(W.cluster_tfidf(rows, tokens), "weight")
        # A word has two characters or more.
        most = rows.groupBy("meeting", "cluster").agg((F.sum(F.length("utterance")) / 2).alias("n"))
        return W.word_ranking(weights, ["meeting", "cluster"], "weight", most)

    return staged(spark, sf, "topic_words", build)


def topic_top(spark, sf):
    return topic_words(spark, sf).filter(F.col("rank") <= 5)


@query(
    "any_word_match",
    "SELECT t.meeting, t.title_id, t.title, (EXISTS (SELECT 1 FROM topic_top w WHERE w.meeting = t.meeting AND contains(t.title, w.word)))::BIGINT AS matched FROM titles t",
    "topic_top",
    "titles",
)
def any_word_match(spark, sf):
    return M.any_word_match(titles(spark, sf), topic_top(spark, sf))


@query(
    "match_rate",
    """
    , m AS (SELECT t.meeting, (EXISTS (SELECT 1 FROM topic_top w WHERE w.meeting = t.meeting AND contains(t.title, w.word)))::BIGINT AS matched FROM titles t)
    SELECT count(*) AS titles, sum(matched)::BIGINT AS matched, round(avg(matched), 6) AS match_rate FROM m""",
    "topic_top",
    "titles",
)
def match_rate(spark, sf):
    return M.match_rate(M.any_word_match(titles(spark, sf), topic_top(spark, sf))).withColumn("match_rate", F.round("match_rate", 6))


@query(
    "word_match_count",
    "SELECT t.meeting, t.title_id, t.title, count(w.word) AS match_num FROM titles t LEFT JOIN topic_top w ON w.meeting = t.meeting AND contains(t.title, w.word) GROUP BY ALL",
    "topic_top",
    "titles",
)
def word_match_count(spark, sf):
    return M.word_match_count(titles(spark, sf), topic_top(spark, sf))


@query(
    "pair_summary_hits",
    f"""
    , said AS (SELECT * FROM clauses WHERE speaker_name <> 'system'),
    words AS (SELECT meeting, speaker_name, unnest({tokens_sql('utterance')}) AS word FROM said),
    corpus AS (SELECT meeting, word, count(*) AS total FROM words GROUP BY ALL),
    firsts AS (SELECT meeting, arg_min(speaker_name, id) AS questioner FROM said GROUP BY ALL),
    pairs AS (SELECT DISTINCT c.meeting, f.questioner, c.speaker_name AS respondent FROM said c JOIN firsts f ON f.meeting = c.meeting WHERE c.speaker_name <> f.questioner),
    scores AS (SELECT p.meeting, p.questioner, p.respondent, w.word, round(count(*) / any_value(t.total), 6) AS ratio
               FROM pairs p JOIN words w ON w.meeting = p.meeting AND w.speaker_name IN (p.questioner, p.respondent)
               JOIN corpus t ON t.meeting = w.meeting AND t.word = w.word GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY meeting, questioner, respondent ORDER BY ratio DESC, word) AS rank FROM scores) WHERE rank <= 5)
    SELECT d.meeting, count(b.word) AS hits FROM debater_pairs d LEFT JOIN best b ON b.meeting = d.meeting AND b.questioner = d.questioner
      AND b.respondent = d.respondent AND contains(d.short_summary, b.word) GROUP BY d.meeting""",
    "debater_pairs",
    "clauses",
)
def pair_summary_hits(spark, sf):
    """Each conversation without its chair is one discussion."""
    rows = D.without_chair(clauses(spark, sf), CHAIR).withColumn("discussion", F.lit(0))
    scores = W.corpus_ratio(rows)
    return M.pair_summary_hits(D.debater_pairs(DQ.digest(spark, sf)), scores, 5, "ratio", 6)


def numbered_titles(spark, sf):
    return row_index(titles(spark, sf), ["meeting"], D.block_of("title_id"), ["title_id"], "title_no")


def numbered_words(spark, sf):
    words = topic_words(spark, sf)
    order = row_index(D.distinct_values(words, ["meeting"], "cluster"), ["meeting"], D.block_of("cluster"), ["cluster"], "cluster_no")
    return words.join(order, ["meeting", "cluster"]).select("meeting", "cluster_no", "rank", "word")


def shuffled_clusters(spark, sf):
    present = D.distinct_values(topic_words(spark, sf), ["meeting"], "cluster")
    return S.seeded_shuffle(present, ["meeting"], "cluster", DQ.SEED).withColumnRenamed("place", "cluster_no")


def greedy_sql(edges: str, order: str) -> str:
    """Walk each meeting's edges in order, keeping lists of the clusters and titles taken."""
    return f"""
    edges AS ({edges}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY {order}) AS step FROM edges),
    walk AS (
      SELECT meeting, 0::BIGINT AS step, []::BIGINT[] AS cs, []::BIGINT[] AS ts, NULL::BIGINT AS cluster_no, NULL::BIGINT AS title_no, NULL::BIGINT AS rank, NULL::VARCHAR AS word
      FROM (SELECT DISTINCT meeting FROM placed)
      UNION ALL
      SELECT w.meeting, p.step,
             CASE WHEN list_contains(w.cs, p.cluster_no) OR list_contains(w.ts, p.title_no) THEN w.cs ELSE list_append(w.cs, p.cluster_no) END,
             CASE WHEN list_contains(w.cs, p.cluster_no) OR list_contains(w.ts, p.title_no) THEN w.ts ELSE list_append(w.ts, p.title_no) END,
             CASE WHEN NOT list_contains(w.cs, p.cluster_no) AND NOT list_contains(w.ts, p.title_no) THEN p.cluster_no END, p.title_no, p.rank, p.word
      FROM walk w JOIN placed p ON p.meeting = w.meeting AND p.step = w.step + 1)
    SELECT meeting, cluster_no, title_no, rank, word FROM walk WHERE cluster_no IS NOT NULL"""


EDGES_SQL = """
    SELECT t.meeting, o.{no} AS cluster_no, t.title_no, min(w.rank) AS rank, arg_min(w.word, w.rank) AS word
    FROM title_order t JOIN {words} w ON w.meeting = t.meeting AND contains(t.title, w.word) JOIN cluster_order o ON o.meeting = w.meeting AND o.cluster = w.cluster
    GROUP BY t.meeting, o.{no}, t.title_no"""


@query("greedy_match", ", " + greedy_sql(EDGES_SQL.format(no="cluster_no", words="topic_top"), "cluster_no, title_no").strip(), "topic_top", "title_order", "cluster_order")
def greedy_match(spark, sf):
    return M.greedy_match(numbered_titles(spark, sf).select("meeting", "title_no", "title"), numbered_words(spark, sf))


@query(
    "greedy_match_by_rank",
    ", " + greedy_sql(EDGES_SQL.format(no="shuffled", words="topic_words"), "rank, title_no, cluster_no").strip(),
    "topic_words",
    "title_order",
    "cluster_order",
)
def greedy_match_by_rank(spark, sf):
    words = topic_words(spark, sf).select("meeting", "cluster", "rank", "word")
    return M.greedy_match_by_rank(numbered_titles(spark, sf).select("meeting", "title_no", "title"), words, shuffled_clusters(spark, sf))


@query(
    "match_difference",
    "SELECT meeting, title_id, title FROM titles t WHERE NOT EXISTS (SELECT 1 FROM topic_top w WHERE w.meeting = t.meeting AND contains(t.title, w.word))",
    "topic_top",
    "titles",
)
def match_difference(spark, sf):
    rows = titles(spark, sf)
    hit = M.word_hits(rows, topic_top(spark, sf)).select("meeting", "title_id").distinct()
    return M.match_difference(rows, hit)
