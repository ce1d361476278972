"""Queries over models. Fitted ones have no SQL counterpart; density clusters at a fixed eps do."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators import density as C
from clauseloom.operators import dialog as D
from clauseloom.operators import hierarchy as H
from clauseloom.operators import models as K
from clauseloom.operators import sampling as S
from clauseloom.operators import topics as P
from clauseloom.operators import vectors as O
from clauseloom.operators import weights as W
from clauseloom.plans import dialogue as DQ
from clauseloom.plans.registry import query
from clauseloom.plans.relations import CHAIR, clauses, digest, titles, vectors
from clauseloom.plans.text import tokens_sql
from clauseloom.session import new_path, staged

EPS = 0.02


@query(
    "density_cluster",
    f"""
    , pts AS (SELECT meeting, id, vec[1] AS x, vec[2] AS y FROM vectors),
    near AS (SELECT a.meeting, a.id AS u, b.id AS v FROM pts a JOIN pts b ON b.meeting = a.meeting AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS} * {EPS}),
    walk AS (SELECT meeting, u, v FROM near UNION SELECT w.meeting, w.u, n.v FROM walk w JOIN near n ON n.meeting = w.meeting AND n.u = w.v),
    roots AS (SELECT meeting, u AS id, min(v) AS root FROM walk GROUP BY ALL),
    sizes AS (SELECT meeting, root, row_number() OVER (PARTITION BY meeting ORDER BY root) - 1 AS cluster FROM roots GROUP BY meeting, root HAVING count(*) >= 5)
    SELECT r.meeting, r.id, coalesce(s.cluster, -1) AS cluster FROM roots r LEFT JOIN sizes s ON s.meeting = r.meeting AND s.root = r.root""",
    "vectors",
)
def density_cluster(spark, sf):
    """The first two positions of each vector as points."""
    points = vectors(spark, sf).select("meeting", "id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))
    return C.density_cluster(points, EPS, 5)


def embedded(spark, sf):
    def build():
        docs = clauses(spark, sf).select("meeting", "id", X.tokenize(F.col("utterance")).alias("words"))
        return K.embed_text(docs, "words", 10).select("meeting", "id", "vec")

    return staged(spark, sf, "embedded", build)


@query("embed_text")
def embed_text(spark, sf):
    return embedded(spark, sf).select("meeting", "id", F.size("vec").cast("long").alias("dim"), F.get("vec", F.lit(0)).alias("first"))


@query("reduce_dimension")
def reduce_dimension(spark, sf):
    low = K.reduce_dimension(vectors(spark, sf))
    return low.select("meeting", "id", *[F.get("vec", F.lit(i)).alias(n) for i, n in enumerate("xy")])


@query("variance_cluster")
def variance_cluster(spark, sf):
    """Ward's tree of each meeting's vectors, cut into at most 49."""
    return H.ward_cluster(vectors(spark, sf).select("meeting", "id", "vec"))


@query("density_hierarchy")
def density_hierarchy(spark, sf):
    """The most stable clusters of each meeting's whole vectors."""
    return H.density_hierarchy(vectors(spark, sf).select("meeting", "id", "vec"), 5)


def noun_tokens():
    return X.tokenize(F.col("utterance"))


@query("lda_bow")
def lda_bow(spark, sf):
    """Each conversation without its chair is one discussion, its first replies give the title pairs."""
    rows = digest(spark, sf)
    pairs = D.title_first_reply(rows).withColumnRenamed("id", "title_id")
    said = D.without_chair(clauses(spark, sf), CHAIR).withColumn("discussion", F.lit(0))
    every = rows.filter(F.col("kind") == D.TITLE).select("meeting", F.col("id").alias("title_id"))
    # A conversation has a few documents, each of which is more than a tenth of them: no word is left out.
    words = P.lda_bow(said, pairs, noun_tokens(), no_above=1.0, titles=every)
    return P.topic_top_words(words, None)


def tfidf_topics(spark, sf):
    return staged(spark, sf, "tfidf_topics", lambda: P.lda_tfidf(clauses(spark, sf), titles(spark, sf), noun_tokens()))


@query("lda_tfidf")
def lda_tfidf(spark, sf):
    return tfidf_topics(spark, sf)


@query("topic_top_words")
def topic_top_words(spark, sf):
    return P.topic_top_words(tfidf_topics(spark, sf), 5)


def token_docs(spark, sf):
    return clauses(spark, sf).select("meeting", "id", X.tokenize(F.col("utterance")).alias("words"))


@query(
    "topic_distribution",
    f"""
    , words AS (SELECT meeting, id, label AS cluster, {tokens_sql('utterance')} AS words FROM clauses),
    bag AS (SELECT meeting, cluster, word, count(*) AS n FROM (SELECT meeting, cluster, unnest(words) AS word FROM words) GROUP BY ALL),
    sizes AS (SELECT meeting, cluster, sum(n) AS class_len FROM bag GROUP BY ALL),
    means AS (SELECT meeting, avg(class_len) AS mean_len FROM sizes GROUP BY ALL),
    idf AS (SELECT b.meeting, b.word, ln(1 + any_value(m.mean_len) / sum(b.n)) AS idf FROM bag b JOIN means m ON m.meeting = b.meeting GROUP BY ALL),
    weights AS (SELECT b.meeting, b.cluster, b.word, b.n / s.class_len * i.idf AS weight FROM bag b JOIN sizes s ON s.meeting = b.meeting AND s.cluster = b.cluster
                JOIN idf i ON i.meeting = b.meeting AND i.word = b.word),
    wide AS (SELECT meeting, cluster, sqrt(sum(weight * weight)) AS width FROM weights GROUP BY ALL),
    starts AS (SELECT meeting, id, words, unnest(range(0, greatest(len(words) - 4, 0) + 1)) AS start FROM words),
    x AS (SELECT r.meeting, r.id, r.start, r.word, count(*) * any_value(i.idf) AS x FROM (SELECT meeting, id, start, unnest(words[start + 1:start + 4]) AS word FROM starts) r
          JOIN idf i ON i.meeting = r.meeting AND i.word = r.word GROUP BY ALL),
    long AS (SELECT meeting, id, start, sqrt(sum(x * x)) AS length FROM x GROUP BY ALL),
    dots AS (SELECT x.meeting, x.id, x.start, w.cluster, sum(x.x * w.weight) AS dot FROM x JOIN weights w ON w.meeting = x.meeting AND w.word = x.word GROUP BY ALL),
    near AS (SELECT d.meeting, d.id, d.cluster, d.dot / (l.length * v.width) AS near FROM dots d JOIN long l ON l.meeting = d.meeting AND l.id = d.id AND l.start = d.start
             JOIN wide v ON v.meeting = d.meeting AND v.cluster = d.cluster),
    sums AS (SELECT meeting, id, cluster, sum(near) AS near FROM near WHERE near >= 0.1 GROUP BY ALL)
    SELECT meeting, id, cluster, round(near / sum(near) OVER (PARTITION BY meeting, id), 6) AS share FROM sums""",
    "clauses",
)
def topic_distribution(spark, sf):
    """The clusters are the turns of a conversation."""
    rows = clauses(spark, sf).select("meeting", "id", F.col("label").alias("doc"), X.tokenize(F.col("utterance")).alias("words"))
    shares = P.cluster_shares(rows.select("meeting", "id", "words"), W.bag_of_words(rows, F.col("words")))
    return shares.withColumn("share", F.round("share", 6))


def saved(spark, sf):
    docs = token_docs(spark, sf)
    path = new_path(spark, "model")
    model = P.fit_topic_distribution(docs, "words", 4)
    K.save_model(model, path)
    return docs, model, path


@query("save_model")
def save_model(spark, sf):
    """The shares of a model that was written and loaded again."""
    docs, _, path = saved(spark, sf)
    made = P.topic_distribution(K.load_model(path), docs)
    return made.select("meeting", "id", F.posexplode("prob").alias("topic", "share"))


@query("load_model", "SELECT count(*) AS clauses, 0::BIGINT AS different FROM clauses", "clauses")
def load_model(spark, sf):
    """Clauses, and those to which the loaded model gives other shares than the one that was saved."""
    docs, model, path = saved(spark, sf)
    one, other = P.topic_distribution(model, docs), P.topic_distribution(K.load_model(path), docs)
    different = K.shares_differ(one, other, ["meeting", "id"], "prob")
    return docs.agg(F.count("*").alias("clauses")).crossJoin(different.agg(F.count("*").alias("different")))


@query("pair_classifier")
def pair_classifier(spark, sf):
    """Adjacent clauses against clauses drawn elsewhere, told apart by their mean word vectors."""
    triples = DQ.numbered_triples(spark, sf)
    both = F.explode(
        F.array(
            F.struct(F.lit("adjacent").alias("column_1"), F.col("positive_clause_id").alias("b"), F.lit(0).alias("half")),
            F.struct(F.lit("other").alias("column_1"), F.col("other_clause_id").alias("b"), F.lit(1).alias("half")),
        )
    )
    pairs = triples.select("meeting", "number", F.col("anchor_clause_id").alias("a"), both.alias("p")).select(
        "meeting", (F.col("number") * 2 + F.col("p.half")).alias("at"), "a", "p.column_1", "p.b"
    )
    vecs = embedded(spark, sf)
    split = S.split_by_position(pairs, "at", D.block_of("at"))
    ready = split.join(vecs.select("meeting", F.col("id").alias("a"), F.col("vec").alias("u")), ["meeting", "a"]).join(
        vecs.select("meeting", F.col("id").alias("b"), F.col("vec").alias("v")), ["meeting", "b"]
    )
    return K.label_accuracy(K.pair_classifier(ready)[0])
