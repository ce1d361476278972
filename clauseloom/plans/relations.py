"""The given tables seen as the package's relations, in Spark and in SQL.

conversations: a conversation is a meeting, a turn a paragraph, a role a speaker, ``system`` the
chair. Its digest: a user turn is a title, the turn's clauses are the policy's or the reply's. A
turn is also a discussion-sized unit: every assistant turn is a cluster of clauses.
documents: a source is a meeting, a document a document; as discussion, a language is a speaker.
events: a user is a meeting, an event a clause, an ``error`` opens a discussion.
embeddings: a label is a cluster; the document of the same number gives text and meeting (language).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators import dialog as D
from clauseloom.operators.ordered import row_index, running
from clauseloom.plans.registry import part
from clauseloom.session import spread, staged

CHAIR = ("system",)
# Letters whose shares make up a text's profile vector.
LETTERS = "abcdefghilmnorst"
DIM = len(LETTERS)
VEC_DIM = 64


# Tables whose rows carry whole texts and get split, cleaned or tokenized.
TEXTS = ("documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting"), "turn", F.col("role").alias("speaker_name"), "text"
    )


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, id, speaker_name, utterance, label, turn; a table of its own, as most queries use it."""
    return staged(spark, sf_dir, "clauses", lambda: make_clauses(spark, sf_dir))


def make_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.clauses_from_turns(turns(spark, sf_dir), X.CLAUSE_END_WESTERN)


CLAUSE_RE = f"[^{X.CLAUSE_END_WESTERN}]+[{X.CLAUSE_END_WESTERN}]?"

part("turns", "SELECT conv_id AS meeting, turn, role AS speaker_name, text FROM conversations")
part(
    "turn_parts",
    f"""
    SELECT meeting, turn, speaker_name, row_number() OVER (PARTITION BY meeting ORDER BY turn) AS label,
           regexp_extract_all(text, '{CLAUSE_RE}') AS parts
    FROM turns""",
    "turns",
)
part(
    "turn_clauses",
    """
    SELECT meeting, turn, speaker_name, label, unnest(parts) AS utterance, unnest(range(1, len(parts) + 1)) AS pos
    FROM turn_parts""",
    "turn_parts",
)
part(
    "clauses",
    """
    SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY turn, pos) - 1 AS id, speaker_name, utterance, label, turn
    FROM turn_clauses""",
    "turn_clauses",
)


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "digest", lambda: make_digest(spark, sf_dir))


def make_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, id, speaker_name, utterance, kind: per user turn a title (the whole text), then the
    turn's clauses; an assistant turn gives reply clauses, a system turn one summary."""
    role = F.col("speaker_name")
    cut = X.split_clauses(F.col("text"), X.CLAUSE_END_WESTERN)

    def rows(kind: str, texts) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("utterance")))

    parts = (
        F.when(role == "system", rows(D.SUMMARY, F.array("text")))
        .when(role == "user", F.concat(rows(D.TITLE, F.array("text")), rows(D.POLICY, cut)))
        .otherwise(rows(D.REPLY, cut))
    )
    made = turns(spark, sf_dir).withColumn("parts", parts)
    numbered = running(made, ["meeting"], D.block_of("turn"), ["turn"], sums={"upto": F.size("parts").cast("long")})
    unfolded = numbered.select(
        "meeting", "speaker_name", "turn", (F.col("upto") - F.size("parts")).alias("first"), F.posexplode_outer("parts").alias("pos", "r")
    )
    return unfolded.filter(F.col("pos").isNotNull()).select("meeting", (F.col("first") + F.col("pos")).alias("id"), "speaker_name", "r.utterance", "r.kind", "turn")


part(
    "digest_rows",
    f"""
    SELECT meeting, turn, 0 AS pos, speaker_name, text AS utterance,
           CASE speaker_name WHEN 'system' THEN 'speaker.summury' ELSE 'policy.title' END AS kind
    FROM turns WHERE speaker_name IN ('system', 'user')
    UNION ALL
    SELECT meeting, turn, pos, speaker_name, utterance,
           CASE speaker_name WHEN 'user' THEN 'policy.utterance' ELSE 'reply.utterance' END AS kind
    FROM turn_clauses WHERE speaker_name <> 'system'""",
    "turns",
    "turn_clauses",
)
part(
    "digest",
    """
    SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY turn, pos) - 1 AS id, speaker_name, utterance, kind, turn
    FROM digest_rows""",
    "digest_rows",
)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, title_id (the turn), title."""
    return (
        turns(spark, sf_dir)
        .filter(F.col("speaker_name") == "user")
        .select("meeting", F.col("turn").alias("title_id"), F.col("text").alias("title"))
    )


part("titles", "SELECT meeting, turn AS title_id, text AS title FROM turns WHERE speaker_name = 'user'", "turns")


def profile(text: Column) -> Column:
    """Share of each letter in a text, a vector both engines compute alike."""
    low = F.lower(text)
    size = F.greatest(F.length(low), F.lit(1))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / size for c in LETTERS])


def profile_sql(text: str) -> str:
    low = f"lower({text})"
    return "[" + ", ".join(f"(length({low}) - length(replace({low}, '{c}', '')))::DOUBLE / greatest(length({low}), 1)" for c in LETTERS) + "]"


def discussion_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one discussion per source: speaker = language, order = doc_id."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("meeting"),
        F.lit(0).cast("long").alias("discussion"),
        F.col("doc_id").alias("id"),
        F.col("lang").alias("speaker_name"),
        F.col("text").alias("utterance"),
    )


part(
    "discussion_docs",
    "SELECT source AS meeting, 0::BIGINT AS discussion, doc_id AS id, lang AS speaker_name, text AS utterance FROM documents",
)


def event_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "event_clauses", lambda: make_event_clauses(spark, sf_dir))


def make_event_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clauses: meeting = user, id = place in time, speaker = type, text = type and props."""
    named = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("meeting"),
        "ts",
        "event_id",
        F.col("event_type").alias("speaker_name"),
        F.concat_ws(" ", "event_type", "props").alias("utterance"),
        F.lit(1).cast("long").alias("label"),
    )
    # A block is a day of a user's events.
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000))
    numbered = row_index(named, ["meeting"], [day], ["ts", "event_id"], "place")
    return numbered.select("meeting", (F.col("place") - 1).alias("id"), "speaker_name", "utterance", "label")


part(
    "event_clauses",
    """
    SELECT user_id AS meeting, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS id,
           event_type AS speaker_name, event_type || ' ' || props AS utterance, 1::BIGINT AS label
    FROM events""",
)


def event_discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_clauses(spark, sf_dir)
    return staged(spark, sf_dir, "event_discussions", lambda: D.segment_discussions(rows, F.col("speaker_name") == "error", ()))


part(
    "event_discussions",
    """
    SELECT * EXCLUDE (last_id) FROM (
      SELECT *, sum(CASE WHEN speaker_name = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY meeting ORDER BY id)::BIGINT - 1 AS discussion,
             max(id) OVER (PARTITION BY meeting) AS last_id
      FROM event_clauses)
    WHERE discussion >= 0 AND id < last_id""",
    "event_clauses",
)


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, id, cluster, utterance, speaker_name: labelled vectors with their document's text."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("meeting"), F.col("text").alias("utterance"), F.col("source").alias("speaker_name")
    )
    return labels.join(docs, "id").select("meeting", "id", "cluster", "utterance", "speaker_name")


part(
    "clustered",
    """
    SELECT d.lang AS meeting, e.vec_id AS id, e.label::BIGINT AS cluster, d.text AS utterance, d.source AS speaker_name
    FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""",
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, id, vec (double); the meeting is the language of the document of the same number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("meeting"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return vecs.join(docs, "id").select("meeting", "id", "vec")


part(
    "vectors",
    """
    SELECT d.lang AS meeting, e.vec_id AS id, e.embedding::DOUBLE[] AS vec
    FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""",
)
