"""Queries over text expressions and flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators import dialog as D
from clauseloom.operators.labels import encode_labels
from clauseloom.plans.registry import part, query
from clauseloom.plans.relations import CHAIR, CLAUSE_RE, clauses, digest, make_clauses, table, turns

NOUNS_SQL = r"[\p{Han}々〆ヶ]{2,}|[\p{Katakana}ー]{2,}|[\p{Latin}]{2,}"
RUNS_SQL = r"[\p{Han}々〆ヶ]+|[\p{Katakana}ー]+|[\p{Hiragana}]+|[\p{Latin}]+"


def clean_sql(text: str) -> str:
    out = f"regexp_replace({text}, '[【】（）()［］\\[\\]]', ' ', 'g')"
    out = f"regexp_replace({out}, '[@＠][\\p{{L}}\\p{{N}}_]+', '', 'g')"
    out = f"regexp_replace({out}, '\\p{{Nd}}+\\.*\\p{{Nd}}*', '', 'g')"
    return f"regexp_replace({out}, '[、。]', '', 'g')"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all({clean_sql(text)}, '{NOUNS_SQL}'), lambda t: NOT regexp_full_match(t, '[ぁ-ゖ]+') AND length(t) >= 2)"


def raw_speaker():
    """Speaker as printed in minutes, made of the turn's role, number and first word."""
    word = F.regexp_extract("text", r"\p{L}+", 0)
    return (
        F.when(F.col("speaker_name") == "user", F.concat(F.lit("◯"), F.col("turn").cast("string"), F.lit("番（"), word, F.lit("君）")))
        .when(F.col("speaker_name") == "assistant", F.concat(F.lit("◯知事（"), word, F.lit("君）")))
        .otherwise(F.lit("◯議長"))
    )


part(
    "raw_speakers",
    r"""
    SELECT *, CASE speaker_name WHEN 'user' THEN '◯' || turn || '番（' || regexp_extract(text, '\p{L}+') || '君）'
                                WHEN 'assistant' THEN '◯知事（' || regexp_extract(text, '\p{L}+') || '君）' ELSE '◯議長' END AS raw
    FROM turns""",
    "turns",
)
part(
    "named_speakers",
    r"""
    SELECT * EXCLUDE (name), CASE WHEN regexp_matches(raw, '◯.+番（.+）') THEN CASE WHEN name <> '' THEN regexp_replace(name, '[（）君]', '', 'g') END
                ELSE regexp_replace(raw, '◯|（.+）', '', 'g') END AS name
    FROM (SELECT *, regexp_extract(raw, '（\P{Nd}+君）') AS name FROM raw_speakers)""",
    "raw_speakers",
)


@query("normalize_speaker", "SELECT meeting, turn, raw, name FROM named_speakers", "named_speakers")
def normalize_speaker(spark, sf):
    return turns(spark, sf).withColumn("raw", raw_speaker()).select("meeting", "turn", "raw", X.normalize_speaker(F.col("raw")).alias("name"))


@query("split_clauses", "SELECT meeting, turn, pos - 1 AS pos, utterance FROM turn_clauses", "turn_clauses")
def split_clauses(spark, sf):
    cut = F.posexplode(X.split_clauses(F.col("text"), X.CLAUSE_END_WESTERN)).alias("pos", "utterance")
    return turns(spark, sf).select("meeting", "turn", cut).withColumn("pos", F.col("pos").cast("long"))


@query("sequence_ids", "SELECT meeting, id, speaker_name, utterance, label FROM clauses", "clauses")
def sequence_ids(spark, sf):
    return make_clauses(spark, sf).drop("turn")


@query(
    "flatten_assembly",
    f"""
    , lines AS (
      SELECT meeting || '-' || turn AS meeting, name, unnest(string_split(text, chr(10))) AS line,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM named_speakers),
    paragraphs AS (
      SELECT meeting, name, line_no, unnest(string_split(line, ', ')) AS paragraph,
             unnest(range(1, len(string_split(line, ', ')) + 1)) AS par_no FROM lines),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY line_no, par_no) AS label,
             regexp_extract_all(paragraph, '{CLAUSE_RE}') AS parts FROM paragraphs),
    cut AS (
      SELECT meeting, name AS speaker_name, label, unnest(parts) AS utterance, unnest(range(1, len(parts) + 1)) AS pos FROM numbered)
    SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY label, pos) - 1 AS id, speaker_name, utterance, label FROM cut""",
    "named_speakers",
)
def flatten_assembly(spark, sf):
    """Each turn becomes a nested document: lines as utterances, comma parts as paragraphs."""
    lines = F.split("text", "\n", -1)
    utterances = F.transform(lines, lambda s: F.struct(F.col("raw").alias("speaker"), F.split(s, ", ", -1).alias("utterance")))
    raw = (
        turns(spark, sf)
        .withColumn("raw", raw_speaker())
        .select(
            F.concat_ws("-", F.col("meeting").cast("string"), F.col("turn").cast("string")).alias("meeting"),
            F.to_json(F.struct(utterances.alias("utterances"))).alias("json"),
        )
    )
    return D.flatten_assembly(raw.select("meeting", F.from_json("json", D.ASSEMBLY_TYPE).alias("assembly")), X.CLAUSE_END_WESTERN)


@query(
    "flatten_digest",
    r"""
    , docs AS (SELECT meeting || '-' || turn AS meeting, speaker_name AS role, text, string_split(text, chr(10)) AS lines FROM turns),
    lined AS (SELECT meeting, role, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS no FROM docs),
    policy AS (
      SELECT meeting, role, line, no, list_filter(string_split_regex('(1)' || replace(line, '. ', '.〔２〕'), '[(〔]\p{Nd}+[〕)]'), lambda x: x <> '') AS ps,
             list_filter(string_split_regex(replace(line, ', ', ',(10)'), '[(〔]\p{Nd}+[〕)]'), lambda x: x <> '') AS rs FROM lined),
    emitted AS (
      SELECT meeting, 0 AS no, 0 AS kind_no, 0 AS pos, role AS speaker_name, text AS utterance, 'speaker.summury' AS kind FROM docs
      UNION ALL SELECT meeting, no, 1, 0, role, line, 'policy.title' FROM policy
      UNION ALL SELECT meeting, no, 2, unnest(range(1, len(ps) + 1)), role, unnest(ps), 'policy.utterance' FROM policy
      UNION ALL SELECT meeting, no, 3, unnest(range(1, len(rs) + 1)), '知事（' || role || '）', unnest(rs), 'reply.utterance' FROM policy)
    SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY no, kind_no, pos) - 1 AS id, speaker_name, utterance, kind FROM emitted""",
    "turns",
)
def flatten_digest(spark, sf):
    """Each turn becomes a nested digest: its lines are policies with enumerated parts and one reply."""
    role = F.col("speaker_name")

    def policy(line):
        reply = F.create_map(F.lit("who"), F.concat(F.lit("知事（"), role, F.lit("）")), F.lit("said"), F.replace(line, F.lit(", "), F.lit(",(10)")))
        parts = F.concat(F.lit("(1)"), F.replace(line, F.lit(". "), F.lit(".〔２〕")))
        return F.struct(line.alias("title"), parts.alias("utterance"), F.array(reply).alias("replies"))

    speaker = F.struct(
        F.concat(role, F.lit("（無所属）")).alias("speaker_name"),
        F.col("text").alias("summury"),
        F.transform(F.split("text", "\n", -1), policy).alias("policies"),
    )
    raw = turns(spark, sf).select(
        F.concat_ws("-", F.col("meeting").cast("string"), F.col("turn").cast("string")).alias("meeting"),
        F.to_json(F.struct(F.array(speaker).alias("speakers"))).alias("json"),
    )
    return D.flatten_digest(raw.select("meeting", F.from_json("json", D.DIGEST_TYPE).alias("digest")))


@query("reply_by_position", "SELECT meeting, turn, speaker_name, text FROM turns", "turns")
def reply_by_position(spark, sf):
    raw = turns(spark, sf).select("meeting", "turn", F.to_json(F.struct(F.col("speaker_name").alias("z"), F.col("text").alias("a"))).alias("json"))
    reply = D.reply_by_position(F.from_json("json", "map<string,string>"))
    return raw.select("meeting", "turn", reply.alias("r")).select("meeting", "turn", "r.speaker_name", "r.text")


@query(
    "split_enumerated",
    r"""
    , parts AS (SELECT doc_id, list_filter(string_split_regex(replace(text, ', ', '(12)'), '[(〔]\p{Nd}+[〕)]'), lambda x: x <> '') AS ps FROM documents)
    SELECT doc_id, unnest(range(0, len(ps))) AS pos, unnest(ps) AS part FROM parts""",
    "turns",
)
def split_enumerated(spark, sf):
    marked = F.replace(F.col("text"), F.lit(", "), F.lit("(12)"))
    cut = F.posexplode(X.split_enumerated(marked)).alias("pos", "part")
    return table(spark, sf, "documents").select("doc_id", cut).withColumn("pos", F.col("pos").cast("long"))


@query("exclude_speakers", "SELECT meeting, id, speaker_name, utterance FROM clauses WHERE speaker_name NOT IN ('system')", "clauses")
def exclude_speakers(spark, sf):
    return D.without_chair(clauses(spark, sf), CHAIR).select("meeting", "id", "speaker_name", "utterance")


@query("min_length", "SELECT meeting, id, utterance FROM clauses WHERE length(utterance) > 10", "clauses")
def min_length(spark, sf):
    return clauses(spark, sf).filter(X.min_length(F.col("utterance"), 10)).select("meeting", "id", "utterance")


@query("filter_kind", "SELECT meeting, id, kind, utterance FROM digest WHERE kind IN ('policy.title', 'reply.utterance')", "digest")
def filter_kind(spark, sf):
    return D.titles_and_replies(digest(spark, sf)).select("meeting", "id", "kind", "utterance")


BOUNDARY = "(?:en|th|le|de).+[.?!]"


@query(
    "is_boundary",
    f"SELECT meeting, id, (speaker_name IN ('user', 'system') AND regexp_matches(utterance, '{BOUNDARY}')) AS boundary FROM clauses",
    "clauses",
)
def is_boundary(spark, sf):
    flag = X.is_boundary(F.col("speaker_name"), F.col("utterance"), ("user", "system"), BOUNDARY)
    return clauses(spark, sf).select("meeting", "id", flag.alias("boundary"))


@query(
    "project_rename",
    "SELECT meeting, id AS anchor_clause_id, speaker_name AS anchor_speaker_name, utterance AS anchor_utterance, label AS anchor_speaker_label FROM clauses",
    "clauses",
)
def project_rename(spark, sf):
    return D.renamed(clauses(spark, sf), "anchor", "anchor_clause_id")


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("tokenize", f"SELECT doc_id, unnest({tokens_sql('text')}) AS word FROM documents")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("word"))


@query(
    "drop_tokens",
    "SELECT meeting, turn, unnest(list_filter(string_split(text, ' '), lambda t: NOT regexp_full_match(t, '[ぁ-ゖ]+') AND length(t) >= 2)) AS word FROM turns",
    "turns",
)
def drop_tokens(spark, sf):
    return turns(spark, sf).select("meeting", "turn", F.explode(X.drop_tokens(F.split("text", " ", -1))).alias("word"))


@query(
    "tokenize_wakati",
    f"SELECT meeting, turn, unnest(list_filter(regexp_extract_all({clean_sql('text')}, '{RUNS_SQL}'), lambda t: NOT regexp_full_match(t, '[ぁ-ゖ]+'))) AS word FROM turns",
    "turns",
)
def tokenize_wakati(spark, sf):
    return turns(spark, sf).select("meeting", "turn", F.explode(X.tokenize_wakati(F.col("text"))).alias("word"))


@query("text_length", "SELECT doc_id, length(text) AS n FROM documents")
def text_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.text_length(F.col("text")).alias("n"))


@query("contains_word", "SELECT doc_id, contains(text, lang) AS found FROM documents")
def contains_word(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.contains_word(F.col("text"), F.col("lang")).alias("found"))


@query("encode_labels", "SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS code FROM documents")
def encode(spark, sf):
    return encode_labels(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "code")


@query(
    "file_stem",
    r"SELECT page_id, regexp_replace(list_extract(string_split(url, '/'), -1), '^(.*[^.])\.[^.]*$', '\1') AS stem FROM pages",
)
def stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.file_stem(F.col("url")).alias("stem"))


@query("json_nested", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_nested(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
