"""The main flow, each stage on what the one before gives: clauses, vectors, clusters, centroids,
central clauses, word weights, best words, titles matched."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators import dialog as D
from clauseloom.operators import matching as M
from clauseloom.operators import vectors as O
from clauseloom.operators import weights as W
from clauseloom.operators.ordered import row_index
from clauseloom.plans.matching import EDGES_SQL, MIN_LEN, greedy_sql, numbered_titles
from clauseloom.plans.registry import part, query
from clauseloom.plans.relations import DIM, clauses
from clauseloom.plans.text import tokens_sql
from clauseloom.plans.vectorial import clause_vectors, cos_sql
from clauseloom.plans.weighting import rounded
from clauseloom.session import cut_lineage

part(
    "flow_members",
    """
    SELECT d.meeting, d.cluster, d.id, d.utterance, v.vec
    FROM (SELECT meeting, cluster, utterance, min(id) AS id FROM topic_clauses GROUP BY ALL) d
    JOIN clause_vecs v ON v.meeting = d.meeting AND v.id = d.id""",
    "topic_clauses",
    "clause_vecs",
)
part(
    "flow_central",
    f"""
    SELECT m.meeting, m.cluster, m.id, m.utterance, round({cos_sql('m.vec', 'c.com')}, 6) AS near
    FROM flow_members m JOIN (
      SELECT meeting, cluster, list(x ORDER BY pos) AS com FROM (
        SELECT meeting, cluster, pos, avg(x) AS x FROM (
          SELECT meeting, cluster, unnest(vec) AS x, unnest(range(0, len(vec))) AS pos FROM flow_members) GROUP BY ALL) GROUP BY ALL) c
    ON c.meeting = m.meeting AND c.cluster = m.cluster""",
    "flow_members",
)
part(
    "flow_kept",
    "SELECT * FROM (SELECT *, avg(near) OVER (PARTITION BY meeting, cluster) AS mean FROM flow_central) WHERE near > round(mean, 6)",
    "flow_central",
)
part(
    "flow_words",
    f"""
    SELECT * FROM (
      SELECT meeting, cluster, word, row_number() OVER (PARTITION BY meeting, cluster ORDER BY weight DESC, word) AS rank FROM (
        SELECT meeting, cluster, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY meeting, cluster)), 6) AS weight FROM (
          SELECT b.meeting, b.cluster, b.word, b.n * (ln(c.k / b.df) + 1) AS x
          FROM (SELECT *, count(*) OVER (PARTITION BY meeting, word) AS df FROM (
                  SELECT meeting, cluster, word, count(*) AS n FROM (
                    SELECT meeting, cluster, unnest(list_filter({tokens_sql('utterance')}, lambda t: length(t) >= {MIN_LEN})) AS raw, lower(raw) AS word FROM flow_kept)
                  GROUP BY ALL)) b
          JOIN (SELECT meeting, count(DISTINCT cluster) AS k FROM flow_kept GROUP BY ALL) c ON c.meeting = b.meeting)))
    WHERE rank <= 5""",
    "flow_kept",
)
part("flow_order", "SELECT meeting, cluster, row_number() OVER (PARTITION BY meeting ORDER BY cluster) AS cluster_no FROM (SELECT DISTINCT meeting, cluster FROM flow_words)", "flow_words")

# The walk's common tables, and what it finds, as a table of its own.
WALKED, FOUND = (x.strip() for x in greedy_sql(EDGES_SQL.format(no="cluster_no", words="flow_words").replace("cluster_order", "flow_order"), "cluster_no, title_no").strip().rsplit("\n    SELECT ", 1))
FOUND = f"SELECT {FOUND}"


@query(
    "topic_words_vs_titles",
    f"""
    , {WALKED}, found AS ({FOUND})
    SELECT t.meeting, count(*) AS titles, count(f.title_no) AS matched, round(count(f.title_no) / count(*), 6) AS match_rate
    FROM title_order t LEFT JOIN found f ON f.meeting = t.meeting AND f.title_no = t.title_no GROUP BY t.meeting""",
    "title_order",
    "flow_order",
)
def topic_words_vs_titles(spark, sf):
    """Assistant turns are the clusters; the vectors are letter profiles; titles are user turns."""
    rows = clauses(spark, sf).filter(F.col("speaker_name") == "assistant").withColumnRenamed("label", "cluster")
    vectors = clause_vectors(spark, sf).select("meeting", "id", "vec")
    near = O.cosine_to_centroid(rows.select("meeting", "id", "cluster", "utterance"), vectors, DIM)
    # Written, as the number of clusters is counted beside the words.
    kept = cut_lineage(O.above_cluster_mean(near.withColumn("cos_similarity_to_com", F.round("cos_similarity_to_com", 6)), 6))
    tokens = X.drop_tokens(X.tokenize(F.col("utterance")), MIN_LEN)
    best = M.top_words(rounded(W.cluster_tfidf(kept, tokens), "weight"), 5)
    order = row_index(D.distinct_values(best, ["meeting"], "cluster"), ["meeting"], D.block_of("cluster"), ["cluster"], "cluster_no")
    words = best.join(order, ["meeting", "cluster"]).select("meeting", "cluster_no", "rank", "word")
    titles = numbered_titles(spark, sf).select("meeting", "title_no", "title")
    found = M.greedy_match(titles, words).select("meeting", "title_no", F.lit(1).cast("long").alias("matched"))
    matched = titles.join(found, ["meeting", "title_no"], "left").na.fill(0, ["matched"])
    return M.match_rate(matched, ["meeting"]).withColumn("match_rate", F.round("match_rate", 6))
