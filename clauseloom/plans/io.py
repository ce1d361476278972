"""Queries that write a given table in some format and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.plans.registry import query
from clauseloom.plans.relations import clauses, profile, profile_sql, table, turns, vectors
from clauseloom.session import new_path
from clauseloom.sources import tables as T
from clauseloom.sources import vectors as TV

CLAUSES_SCHEMA = "meeting long, id long, speaker_name string, utterance string, label long"
CLAUSES_SQL = "SELECT meeting, id, speaker_name, utterance, label FROM clauses"


@query("read_table", CLAUSES_SQL, "clauses")
def read_table(spark, sf):
    """Delimited text with line breaks inside fields, read back with its schema."""
    path = new_path(spark, "clauses") + ".csv"
    T.write_table(clauses(spark, sf).drop("turn"), path)
    return T.read_table(spark, path, CLAUSES_SCHEMA, has_header=True)


@query("write_table", "SELECT event_id, user_id, event_type, props FROM events")
def write_table(spark, sf):
    path = new_path(spark, "events") + ".tsv"
    T.write_table(table(spark, sf, "events").select("event_id", "user_id", "event_type", "props"), path)
    return T.read_table(spark, path, "event_id long, user_id long, event_type string, props string", has_header=True)


@query("read_headerless", "SELECT lang AS column_1, text AS column_2, source AS column_3 FROM documents")
def read_headerless(spark, sf):
    path = new_path(spark, "pairs") + ".tsv"
    table(spark, sf, "documents").select("lang", "text", "source").write.options(**T.TEXT_OPTIONS, sep="\t").csv(path)
    return T.read_headerless(spark, path, 3)


@query(
    "read_meetings",
    "SELECT h.half, speaker_name, text FROM turns, (SELECT unnest(['assembly', 'digest']) AS half) h",
    "turns",
)
def read_meetings(spark, sf):
    """Turns as nested JSON lines; the written files' own prefix takes the place of the fixed one."""
    path = new_path(spark, "minutes")
    nested = turns(spark, sf).select(
        F.struct(F.array(F.struct(F.col("speaker_name").alias("speaker"), F.array("text").alias("utterance"))).alias("utterances")).alias("assembly"),
        F.struct(F.array(F.struct("speaker_name", F.col("text").alias("summury"))).alias("speakers")).alias("digest"),
    )
    nested.select(F.to_json(F.struct("assembly", "digest")).alias("value")).write.text(path)
    found = T.read_meetings(spark, path, prefix="part-", multi_line=False)
    named = found.filter("meeting like 'part-%'")
    said = F.explode("assembly.utterances").alias("u")
    left = named.select(said).select(F.lit("assembly").alias("half"), F.col("u.speaker").alias("speaker_name"), F.explode("u.utterance").alias("text"))
    right = named.select(F.explode("digest.speakers").alias("s")).select(F.lit("digest").alias("half"), "s.speaker_name", F.col("s.summury").alias("text"))
    return left.unionByName(right)


@query("read_vectors", "SELECT 'all' AS meeting, vec_id AS id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def read_vectors(spark, sf):
    """One meeting of all embeddings written in pieces of 200 lines, ids from the line numbers."""
    path = new_path(spark, "vectors")
    rows = table(spark, sf, "embeddings").select(
        F.lit("all").alias("meeting"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    TV.write_vectors(rows, path, 200)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return TV.read_vectors(spark, path).select("meeting", "id", F.round(total, 6).alias("total"))


@query(
    "write_vectors",
    "SELECT meeting, pos, count(*) AS lines, round(sum(x), 6) AS total FROM (SELECT meeting, unnest(vec) AS x, unnest(range(0, len(vec))) AS pos FROM vectors) GROUP BY meeting, pos",
    "vectors",
)
def write_vectors(spark, sf):
    path = new_path(spark, "vectors")
    TV.write_vectors(vectors(spark, sf), path)
    lines = spark.read.text(path)
    each = lines.select("meeting", F.posexplode(F.split("value", ",")).alias("pos", "x"))
    made = each.groupBy("meeting", "pos").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("x").cast("double")), 6).alias("total"))
    return made.withColumn("pos", F.col("pos").cast("long"))


def stored_texts(spark, sf):
    return clauses(spark, sf).select(F.col("utterance").alias("text"))


def score(texts):
    return texts.withColumn("prob", profile(F.col("text")))


@query(
    "vector_store",
    f"SELECT meeting, id, round({profile_sql('utterance')}[5], 6) AS share FROM clauses WHERE speaker_name = 'user'",
    "clauses",
)
def vector_store(spark, sf):
    """All distinct clause texts are stored; the user's clauses look theirs up."""
    path = new_path(spark, "store")
    TV.save_to_store(score(stored_texts(spark, sf).distinct()).withColumn("kind", F.lit("clause")), path)
    asked = clauses(spark, sf).filter(F.col("speaker_name") == "user").select("meeting", "id", F.col("utterance").alias("text"))
    return TV.load_from_store(asked, spark, path, "clause").select("meeting", "id", F.round(F.get("prob", F.lit(4)), 6).alias("share"))


@query(
    "append_missing",
    f"SELECT DISTINCT utterance AS text, round({profile_sql('utterance')}[5], 6) AS share FROM clauses",
    "clauses",
)
def append_missing(spark, sf):
    """The store starts with the user's clauses; only the other texts are scored and added."""
    path = new_path(spark, "store")
    first = clauses(spark, sf).filter(F.col("speaker_name") == "user").select(F.col("utterance").alias("text"))
    TV.save_to_store(score(first.distinct()).withColumn("kind", F.lit("clause")), path)
    TV.append_missing(stored_texts(spark, sf), score, spark, path, "clause")
    return spark.read.schema(TV.STORE_SCHEMA).parquet(path).select("text", F.round(F.get("prob", F.lit(4)), 6).alias("share"))


@query("write_partitioned", "SELECT speaker_name, label AS cluster, count(*) AS n FROM clauses GROUP BY ALL", "clauses")
def write_partitioned(spark, sf):
    path = new_path(spark, "clusters")
    rows = clauses(spark, sf).select("speaker_name", F.col("label").alias("cluster"), "id", "utterance")
    T.write_partitioned(rows, path, ["speaker_name", "cluster"])
    found = spark.read.schema("id long, utterance string, speaker_name string, cluster long").parquet(path)
    return found.groupBy("speaker_name", "cluster").agg(F.count("*").alias("n"))
