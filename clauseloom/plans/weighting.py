"""Queries over word weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators import dialog as D
from clauseloom.operators import matching as M
from clauseloom.operators import weights as W
from clauseloom.plans.registry import part, query
from clauseloom.plans.relations import CHAIR, clauses, discussion_docs, table
from clauseloom.plans.text import tokens_sql
from clauseloom.session import staged

part("docs", "SELECT source AS meeting, doc_id AS doc, text FROM documents")
part("doc_tokens", f"SELECT meeting, doc, unnest({tokens_sql('text')}) AS word FROM docs", "docs")
part("bag", "SELECT meeting, doc, word, count(*) AS n FROM doc_tokens GROUP BY ALL", "doc_tokens")
part("n_docs", "SELECT meeting, count(DISTINCT doc) AS n_docs FROM docs GROUP BY ALL", "docs")
part("dfs", "SELECT meeting, word, count(*) AS df, sum(n) AS f FROM bag GROUP BY ALL", "bag")
part(
    "tf_idfs",
    """
    SELECT b.meeting, b.doc, b.word, b.n, b.n / sum(b.n) OVER (PARTITION BY b.meeting, b.doc) AS tf, ln(c.n_docs / (d.df + 1) + 1) AS idf
    FROM bag b JOIN dfs d ON d.meeting = b.meeting AND d.word = b.word JOIN n_docs c ON c.meeting = b.meeting""",
    "dfs",
    "n_docs",
)


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("meeting"), F.col("doc_id").alias("doc"), "text")


def bag(spark, sf):
    """The documents' word counts, written once for all weights built on them."""
    return staged(spark, sf, "bag", lambda: W.document_bag(docs(spark, sf), X.tokenize(F.col("text"))))


def n_docs(spark, sf):
    return W.document_counts(docs(spark, sf))


def rounded(df, column):
    return df.withColumn(column, F.round(column, 6))


@query("bag_of_words", "SELECT meeting, doc, word, n FROM bag", "bag")
def bag_of_words(spark, sf):
    return W.bag_of_words(docs(spark, sf), X.tokenize(F.col("text")))


@query("term_frequency", "SELECT meeting, doc, word, round(tf, 6) AS tf FROM tf_idfs", "tf_idfs")
def term_frequency(spark, sf):
    return rounded(W.term_frequency(bag(spark, sf)).select("meeting", "doc", "word", "tf"), "tf")


@query("inverse_doc_frequency", "SELECT DISTINCT meeting, word, round(idf, 6) AS idf FROM tf_idfs", "tf_idfs")
def inverse_doc_frequency(spark, sf):
    return rounded(W.inverse_doc_frequency(bag(spark, sf), n_docs(spark, sf)).select("meeting", "word", "idf"), "idf")


@query("tf_idf", "SELECT meeting, doc, word, round(tf * idf, 6) AS tf_idf FROM tf_idfs", "tf_idfs")
def tf_idf(spark, sf):
    return rounded(W.tf_idf(bag(spark, sf), n_docs(spark, sf)).select("meeting", "doc", "word", "tf_idf"), "tf_idf")


@query(
    "doc_representation",
    "SELECT meeting, doc, word, round(tf * idf / sum(tf * idf) OVER (PARTITION BY meeting, doc), 6) AS weight FROM tf_idfs",
    "tf_idfs",
)
def doc_representation(spark, sf):
    return rounded(W.doc_representation(bag(spark, sf), n_docs(spark, sf)), "weight")


@query(
    "filter_extremes",
    "SELECT d.meeting, d.word, d.df FROM dfs d JOIN n_docs c ON c.meeting = d.meeting WHERE df >= 1 AND df <= floor(0.1::DOUBLE * n_docs)",
    "dfs",
    "n_docs",
)
def filter_extremes(spark, sf):
    return W.filter_extremes(bag(spark, sf), n_docs(spark, sf))


@query(
    "gensim_tfidf",
    """
    , w AS (SELECT b.meeting, b.doc, b.word, b.n * log2(c.n_docs / d.df) AS x
            FROM bag b JOIN dfs d ON d.meeting = b.meeting AND d.word = b.word JOIN n_docs c ON c.meeting = b.meeting WHERE d.df < c.n_docs)
    SELECT meeting, doc, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY meeting, doc)), 6) AS weight FROM w""",
    "dfs",
    "n_docs",
)
def gensim_tfidf(spark, sf):
    return rounded(W.log2_l2_tfidf(bag(spark, sf), n_docs(spark, sf)), "weight")


part(
    "cluster_words",
    f"SELECT meeting, label AS cluster, unnest(regexp_extract_all(lower(array_to_string({tokens_sql('utterance')}, ' ')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word "
    "FROM clauses WHERE speaker_name <> 'system'",
    "clauses",
)
part(
    "cluster_weights",
    """
    SELECT meeting, cluster, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY meeting, cluster)), 6) AS weight
    FROM (SELECT b.meeting, b.cluster, b.word, b.n * (ln(c.k / d.df) + 1) AS x
          FROM (SELECT meeting, cluster, word, count(*) AS n FROM cluster_words GROUP BY ALL) b
          JOIN (SELECT meeting, word, count(DISTINCT cluster) AS df FROM cluster_words GROUP BY ALL) d ON d.meeting = b.meeting AND d.word = b.word
          JOIN (SELECT meeting, count(DISTINCT label) AS k FROM clauses WHERE speaker_name <> 'system' GROUP BY ALL) c ON c.meeting = b.meeting)""",
    "cluster_words",
)
part(
    "ranked_words",
    "SELECT meeting, cluster, word, weight, row_number() OVER (PARTITION BY meeting, cluster ORDER BY weight DESC, word) AS rank FROM cluster_weights",
    "cluster_weights",
)


def cluster_weights(spark, sf):
    """Paragraphs as clusters: word scores over the clauses of everyone but the chair."""
    rows = D.without_chair(clauses(spark, sf), CHAIR).withColumnRenamed("label", "cluster")
    return rounded(W.cluster_tfidf(rows), "weight")


def ranked_words(spark, sf):
    return staged(spark, sf, "ranked_words", lambda: W.word_ranking(cluster_weights(spark, sf), ["meeting", "cluster"], "weight"))


@query("cluster_tfidf", "SELECT meeting, cluster, word, weight FROM cluster_weights", "cluster_weights")
def cluster_tfidf(spark, sf):
    return cluster_weights(spark, sf)


@query("word_ranking", "SELECT meeting, cluster, word, weight, rank FROM ranked_words", "ranked_words")
def word_ranking(spark, sf):
    return W.word_ranking(cluster_weights(spark, sf), ["meeting", "cluster"], "weight")


def top_five(spark, sf):
    return M.top_words(cluster_weights(spark, sf), 5)


@query(
    "top5_words",
    "SELECT meeting, cluster, string_agg(word, ' ' ORDER BY rank) AS words FROM ranked_words WHERE rank <= 5 GROUP BY ALL",
    "ranked_words",
)
def top5_words(spark, sf):
    return M.word_lists(top_five(spark, sf)).select("meeting", "cluster", F.array_join("words", " ").alias("words"))


@query(
    "concat_documents",
    f"""
    SELECT meeting, label AS cluster, id, unnest(range(0, len(ts))) AS pos, unnest(ts) AS word
    FROM (SELECT meeting, label, id, {tokens_sql('utterance')} AS ts FROM clauses)""",
    "clauses",
)
def concat_documents(spark, sf):
    rows = clauses(spark, sf).withColumnRenamed("label", "cluster")
    made = W.concat_documents(rows, X.tokenize(F.col("utterance")), ["meeting", "cluster"], "id")
    return made.withColumn("pos", F.col("pos").cast("long"))


@query(
    "dedupe_in_order",
    f"""
    , seen AS (SELECT meeting, doc, unnest(range(0, len(ts))) AS pos, unnest(ts) AS word FROM (SELECT meeting, doc, {tokens_sql('text')} AS ts FROM docs)),
    firsts AS (SELECT meeting, word, min({{'doc': doc, 'pos': pos}}) AS first_at FROM seen GROUP BY ALL)
    SELECT meeting, word, row_number() OVER (PARTITION BY meeting ORDER BY first_at.doc, first_at.pos) - 1 AS place FROM firsts""",
    "docs",
)
def dedupe_in_order(spark, sf):
    seen = W.concat_documents(docs(spark, sf), X.tokenize(F.col("text")), ["meeting"], "doc")
    return W.dedupe_in_order(seen, ["meeting"], ["doc", "pos"], [F.floor(F.col("first.doc") / 65536), F.col("first.doc")]).select("meeting", "word", "place")


@query(
    "corpus_ratio",
    f"""
    , words AS (SELECT meeting, discussion, speaker_name, unnest({tokens_sql('utterance')}) AS word FROM discussion_docs),
    totals AS (SELECT meeting, word, count(*) AS total FROM words GROUP BY ALL),
    firsts AS (SELECT meeting, discussion, arg_min(speaker_name, id) AS questioner FROM discussion_docs GROUP BY ALL),
    pairs AS (SELECT DISTINCT d.meeting, d.discussion, f.questioner, d.speaker_name AS respondent
              FROM discussion_docs d JOIN firsts f ON f.meeting = d.meeting AND f.discussion = d.discussion WHERE d.speaker_name <> f.questioner)
    SELECT p.meeting, p.discussion, p.questioner, p.respondent, w.word, count(*) AS n, round(count(*) / any_value(t.total), 6) AS ratio
    FROM pairs p JOIN words w ON w.meeting = p.meeting AND w.discussion = p.discussion AND w.speaker_name IN (p.questioner, p.respondent)
    JOIN totals t ON t.meeting = w.meeting AND t.word = w.word GROUP BY ALL""",
    "discussion_docs",
)
def corpus_ratio(spark, sf):
    rows = discussion_docs(spark, sf)
    return rounded(W.corpus_ratio(rows).select("meeting", "discussion", "questioner", "respondent", "word", "n", "ratio"), "ratio")


@query(
    "class_tfidf",
    f"""
    , words AS (SELECT lang AS meeting, source AS doc, unnest({tokens_sql('text')}) AS word FROM documents),
    counts AS (SELECT meeting, doc, word, count(*) AS n FROM words GROUP BY ALL),
    sizes AS (SELECT meeting, doc, sum(n) AS class_len FROM counts GROUP BY ALL),
    means AS (SELECT meeting, avg(class_len) AS mean_len FROM sizes GROUP BY ALL),
    totals AS (SELECT meeting, word, sum(n) AS f FROM counts GROUP BY ALL)
    SELECT c.meeting, c.doc, c.word, round(c.n / s.class_len * ln(1 + m.mean_len / t.f), 6) AS weight
    FROM counts c JOIN sizes s ON s.meeting = c.meeting AND s.doc = c.doc JOIN means m ON m.meeting = c.meeting
    JOIN totals t ON t.meeting = c.meeting AND t.word = c.word""",
    "docs",
)
def class_tfidf(spark, sf):
    """Languages as meetings, sources as classes."""
    rows = table(spark, sf, "documents").select(F.col("lang").alias("meeting"), F.col("source").alias("doc"), "text")
    return rounded(W.class_tfidf(W.bag_of_words(rows, X.tokenize(F.col("text")))), "weight")
