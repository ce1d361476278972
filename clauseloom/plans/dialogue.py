"""Queries over digests, discussions, pairs, triples and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators import dialog as D
from clauseloom.operators import sampling as S
from clauseloom.operators.ordered import top_rows
from clauseloom.plans.registry import part, query
from clauseloom.plans.relations import CHAIR, clauses, digest, discussion_docs, event_clauses, event_discussions, table
from clauseloom.session import staged
from clauseloom.sources.tables import load_triples

SEED = "s7"


def draw_sql(*keys: str, seed: str = SEED) -> str:
    joined = " || ':' || ".join([f"'{seed}'", *keys])
    return f"('0x' || substr(md5({joined}), 1, 15))::BIGINT"


def eligible(spark, sf):
    return D.eligible_clauses(clauses(spark, sf), CHAIR)


part("eligible", "SELECT * FROM clauses WHERE speaker_name NOT IN ('system') AND length(utterance) > 10", "clauses")
part(
    "neighbours",
    """
    SELECT * FROM (SELECT meeting, label, lead(label) OVER (PARTITION BY meeting ORDER BY label) AS next_label
                   FROM (SELECT DISTINCT meeting, label FROM eligible)) WHERE next_label IS NOT NULL""",
    "eligible",
)
part(
    "adjacent",
    """
    SELECT a.meeting, a.id AS anchor, b.id AS positive
    FROM eligible a JOIN neighbours n ON n.meeting = a.meeting AND n.label = a.label
    JOIN eligible b ON b.meeting = a.meeting AND b.label = n.next_label""",
    "neighbours",
)
part(
    "carried",
    """
    SELECT *, last_value(CASE WHEN kind = 'policy.title' THEN utterance END IGNORE NULLS) OVER w AS title,
           last_value(CASE WHEN kind = 'policy.title' THEN speaker_name END IGNORE NULLS) OVER w AS title_speaker
    FROM digest WINDOW w AS (PARTITION BY meeting ORDER BY id ROWS UNBOUNDED PRECEDING)""",
    "digest",
)
part(
    "sections",
    """
    SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY id) - 1 AS pos,
           sum(CASE WHEN kind = 'policy.title' THEN 1 ELSE 0 END) OVER (PARTITION BY meeting ORDER BY id)::BIGINT AS section
    FROM digest WHERE kind <> 'speaker.summury'""",
    "digest",
)
part(
    "unique_titles",
    """
    SELECT t.meeting, t.section, t.pos AS title_pos, t.utterance AS raw_title,
           CASE WHEN EXISTS (SELECT 1 FROM sections e JOIN sections c ON c.meeting = e.meeting AND c.section = e.section AND c.kind <> 'policy.title'
                             WHERE e.kind = 'policy.title' AND e.meeting = t.meeting AND e.utterance = t.utterance AND e.section < t.section)
                THEN t.utterance || t.pos ELSE t.utterance END AS title
    FROM sections t WHERE t.kind = 'policy.title'""",
    "sections",
)
part(
    "digest_clauses",
    """
    SELECT s.meeting, row_number() OVER (PARTITION BY s.meeting ORDER BY s.id) - 1 AS id, t.title, s.speaker_name, s.utterance AS clause, s.kind,
           s.section
    FROM sections s LEFT JOIN unique_titles t ON t.meeting = s.meeting AND t.section = s.section WHERE s.kind <> 'policy.title'""",
    "unique_titles",
)
part(
    "debater_pairs",
    "SELECT meeting, id, title AS short_summary, title_speaker AS questioner, speaker_name AS respondent FROM carried WHERE kind = 'reply.utterance'",
    "carried",
)


@query("carry_title", "SELECT meeting, id, kind, utterance, title, title_speaker FROM carried", "carried")
def carry_title(spark, sf):
    return D.carry_title(digest(spark, sf)).select("meeting", "id", "kind", "utterance", "title", "title_speaker")


@query("unique_title", "SELECT meeting, section, title_pos, raw_title, title FROM unique_titles", "unique_titles")
def unique_title(spark, sf):
    return D.unique_titles(digest(spark, sf)).select("meeting", "section", "title_pos", "raw_title", "title")


@query("digest_clause_table", "SELECT meeting, id, title, speaker_name, clause, kind, section FROM digest_clauses", "digest_clauses")
def digest_clause_table(spark, sf):
    return D.digest_clause_table(digest(spark, sf))


@query("debater_pairs", "SELECT * FROM debater_pairs", "debater_pairs")
def debater_pairs(spark, sf):
    return D.debater_pairs(digest(spark, sf))


@query(
    "title_first_reply",
    """
    , near AS (SELECT meeting, id, kind, speaker_name, lag(kind) OVER w AS was, lag(utterance) OVER w AS short_summary, lag(speaker_name) OVER w AS questioner
               FROM digest WHERE kind IN ('policy.title', 'reply.utterance') WINDOW w AS (PARTITION BY meeting ORDER BY id))
    SELECT meeting, id, short_summary, questioner, speaker_name AS respondent FROM near WHERE kind = 'reply.utterance' AND was = 'policy.title'""",
    "digest",
)
def title_first_reply(spark, sf):
    return D.title_first_reply(digest(spark, sf))


@query(
    "segment_discussions",
    "SELECT meeting, discussion, id, speaker_name, utterance FROM event_discussions WHERE speaker_name <> 'signup'",
    "event_discussions",
)
def segment_discussions(spark, sf):
    """An error opens a discussion; ``signup`` plays the chair that is removed afterwards."""
    cut = D.segment_discussions(event_clauses(spark, sf), F.col("speaker_name") == "error", ("signup",))
    return cut.select("meeting", "discussion", "id", "speaker_name", "utterance")


@query(
    "first_speaker",
    "SELECT meeting, discussion, arg_min(speaker_name, id) AS questioner FROM discussion_docs GROUP BY meeting, discussion",
    "discussion_docs",
)
def first_speaker(spark, sf):
    return D.first_speaker(discussion_docs(spark, sf))


@query("next_label", "SELECT meeting, label, next_label FROM neighbours", "neighbours")
def next_label(spark, sf):
    return D.next_label(eligible(spark, sf))


@query("adjacent_pairs", "SELECT meeting, anchor, positive FROM adjacent", "adjacent")
def adjacent_pairs(spark, sf):
    return D.adjacent_pairs(eligible(spark, sf))


@query(
    "cross_speaker_pairs",
    """
    , windowed AS (
      SELECT e.meeting, n.label AS w, e.id, e.label FROM eligible e JOIN neighbours n ON n.meeting = e.meeting AND e.label IN (n.label, n.next_label)),
    all_pairs AS (SELECT a.meeting, a.w, a.id AS anchor, b.id AS positive FROM windowed a JOIN windowed b ON b.meeting = a.meeting AND b.w = a.w AND a.id < b.id),
    same_pairs AS (SELECT a.meeting, a.w, a.id AS anchor, b.id AS positive FROM windowed a JOIN windowed b
                   ON b.meeting = a.meeting AND b.w = a.w AND a.id < b.id AND a.label = b.label)
    SELECT meeting, anchor, positive FROM (SELECT * FROM all_pairs EXCEPT SELECT * FROM same_pairs)""",
    "neighbours",
)
def cross_speaker_pairs(spark, sf):
    """All pairs of two neighbouring paragraphs less those inside one of them: as a join, none of
    the pairs to be subtracted is ever made. The SQL does the set algebra."""
    return D.adjacent_pairs(eligible(spark, sf))


@query(
    "ids_to_text",
    """
    SELECT p.meeting, p.anchor AS anchor_clause_id, p.positive AS positive_clause_id, a.utterance AS anchor_utterance, b.utterance AS positive_utterance
    FROM adjacent p JOIN eligible a ON a.meeting = p.meeting AND a.id = p.anchor JOIN eligible b ON b.meeting = p.meeting AND b.id = p.positive""",
    "adjacent",
)
def ids_to_text(spark, sf):
    rows = eligible(spark, sf)
    return D.ids_to_text(D.adjacent_pairs(rows), rows, ["anchor", "positive"]).select(
        "meeting", "anchor_clause_id", "positive_clause_id", "anchor_utterance", "positive_utterance"
    )


part(
    "triples_v2",
    f"""
    SELECT r.meeting, r.anchor, r.positive, o.other
    FROM (SELECT *, row_number() OVER (PARTITION BY meeting, anchor ORDER BY positive) AS rn FROM adjacent) r
    JOIN (
      SELECT meeting, anchor, other, row_number() OVER (PARTITION BY meeting, anchor ORDER BY step) AS rn
      FROM (
        SELECT d.meeting, d.anchor, d.step, p.id AS other
        FROM (
          SELECT a.meeting, a.anchor, step, ({draw_sql('a.meeting', 'a.anchor', seed=SEED + '-start')} % n + step) % n + 1 AS place
          FROM (SELECT a.meeting, a.anchor, n, unnest(range(0, least(2 * k + 1, n))) AS step
                FROM (SELECT meeting, anchor, count(*) AS k FROM adjacent GROUP BY ALL) a
                JOIN (SELECT meeting, count(*) AS n FROM eligible GROUP BY ALL) s ON s.meeting = a.meeting) a) d
        JOIN (SELECT meeting, id, row_number() OVER (PARTITION BY meeting ORDER BY md5('{SEED}:' || meeting || ':' || id), id) AS place FROM eligible) p
          ON p.meeting = d.meeting AND p.place = d.place
        WHERE p.id <> d.anchor AND NOT EXISTS (SELECT 1 FROM adjacent x WHERE x.meeting = d.meeting AND x.anchor = d.anchor AND x.positive = p.id))) o
    ON o.meeting = r.meeting AND o.anchor = r.anchor AND o.rn = r.rn""",
    "adjacent",
)
part(
    "triple_texts",
    """
    SELECT t.meeting,
           a.id AS anchor_clause_id, a.speaker_name AS anchor_speaker_name, a.utterance AS anchor_utterance, a.label AS anchor_speaker_label,
           p.id AS positive_clause_id, p.speaker_name AS positive_speaker_name, p.utterance AS positive_utterance, p.label AS positive_speaker_label,
           o.id AS other_clause_id, o.speaker_name AS other_speaker_name, o.utterance AS other_utterance, o.label AS other_speaker_label
    FROM triples_v2 t JOIN eligible a ON a.meeting = t.meeting AND a.id = t.anchor
    JOIN eligible p ON p.meeting = t.meeting AND p.id = t.positive JOIN eligible o ON o.meeting = t.meeting AND o.id = t.other""",
    "triples_v2",
)


def text_triples(spark, sf):
    return D.triples_v2(clauses(spark, sf), SEED, CHAIR)


@query("triples_v2", "SELECT * FROM triple_texts", "triple_texts")
def triples_v2(spark, sf):
    return text_triples(spark, sf)


@query(
    "triples_v3",
    f"""
    , asked AS (SELECT d.*, arg_min(speaker_name, id) OVER (PARTITION BY meeting, discussion) AS questioner FROM event_discussions d),
    answering AS (SELECT *, row_number() OVER (PARTITION BY meeting, discussion ORDER BY speaker_name, id) - 1 AS place,
                  count(*) OVER (PARTITION BY meeting, discussion) AS total FROM asked WHERE speaker_name <> questioner),
    placed AS (SELECT *, min(place) OVER s AS run, count(*) OVER s AS size FROM answering WINDOW s AS (PARTITION BY meeting, discussion, speaker_name)),
    pairs AS (SELECT r.meeting, r.discussion, r.id AS anchor, q.id AS positive, r.run, r.size, r.total,
              {draw_sql('r.meeting', 'r.discussion', 'r.id', 'q.id')} % (r.total - r.size) AS number
              FROM placed r JOIN asked q ON q.meeting = r.meeting AND q.discussion = r.discussion AND q.speaker_name = q.questioner
              WHERE length(r.utterance) > 10 AND length(q.utterance) > 10 AND r.total > r.size)
    SELECT p.meeting, p.discussion, p.anchor AS anchor_clause_id, p.positive AS positive_clause_id, o.id AS other_clause_id,
           a.speaker_name AS anchor_speaker_name, q.speaker_name AS positive_speaker_name, o.speaker_name AS other_speaker_name,
           a.utterance AS anchor_utterance, q.utterance AS positive_utterance, o.utterance AS other_utterance
    FROM pairs p JOIN placed o ON o.meeting = p.meeting AND o.discussion = p.discussion
      AND o.place = p.number + CASE WHEN p.number >= p.run THEN p.size ELSE 0 END
    JOIN event_clauses a ON a.meeting = p.meeting AND a.id = p.anchor JOIN event_clauses q ON q.meeting = p.meeting AND q.id = p.positive""",
    "event_discussions",
)
def triples_v3(spark, sf):
    made = D.triples_v3(event_discussions(spark, sf), SEED)
    return made.select("meeting", "discussion", *[c for c in made.columns if c.startswith(("anchor_", "positive_", "other_")) and not c.endswith("_label")])


@query(
    "pair_documents",
    """
    , firsts AS (SELECT meeting, discussion, arg_min(speaker_name, id) AS questioner FROM discussion_docs GROUP BY ALL),
    pairs AS (SELECT DISTINCT d.meeting, d.discussion, f.questioner, d.speaker_name AS respondent
              FROM discussion_docs d JOIN firsts f ON f.meeting = d.meeting AND f.discussion = d.discussion WHERE d.speaker_name <> f.questioner)
    SELECT p.meeting, p.discussion, p.questioner, p.respondent, d.id, d.speaker_name, d.utterance
    FROM pairs p JOIN discussion_docs d ON d.meeting = p.meeting AND d.discussion = p.discussion
      AND (d.speaker_name = p.questioner OR d.speaker_name = p.respondent)""",
    "discussion_docs",
)
def pair_documents(spark, sf):
    made = D.pair_documents(discussion_docs(spark, sf))
    return made.select("meeting", "discussion", "questioner", "respondent", "id", "speaker_name", "utterance")


@query(
    "exclude_candidates",
    """
    SELECT c.meeting, c.anchor, c.other FROM (SELECT a.meeting, a.anchor, b.positive AS other FROM adjacent a JOIN adjacent b ON b.meeting = a.meeting AND b.anchor = a.positive
                                              UNION SELECT meeting, anchor, positive FROM adjacent UNION SELECT meeting, anchor, anchor FROM adjacent) c
    WHERE c.other <> c.anchor AND NOT EXISTS (SELECT 1 FROM adjacent x WHERE x.meeting = c.meeting AND x.anchor = c.anchor AND x.positive = c.other)""",
    "adjacent",
)
def exclude_candidates(spark, sf):
    """Candidates are the anchor, its positives and the positives of those; only the last remain."""
    pairs = D.adjacent_pairs(eligible(spark, sf))
    second = pairs.select("meeting", "anchor", F.col("positive").alias("step")).join(
        pairs.select("meeting", F.col("anchor").alias("step"), F.col("positive").alias("other")), ["meeting", "step"]
    )
    own = pairs.select("meeting", "anchor", F.explode(F.array("anchor", "positive")).alias("other"))
    candidates = D.union_rows(second.select("meeting", "anchor", "other"), own).distinct()
    return D.exclude_candidates(candidates, pairs)


@query(
    "sample_without_replacement",
    f"""
    SELECT meeting, speaker_name, id, rank FROM (
      SELECT meeting, speaker_name, id, row_number() OVER (PARTITION BY meeting, speaker_name ORDER BY md5('{SEED}:' || meeting || ':' || speaker_name || ':' || id), id) AS rank
      FROM eligible) WHERE rank <= 5""",
    "eligible",
)
def sample_without_replacement(spark, sf):
    rows = eligible(spark, sf).select("meeting", "speaker_name", "id")
    return S.sample_without_replacement(rows, ["meeting", "speaker_name"], "id", 5, SEED)


@query(
    "sample_with_replacement",
    f"""
    , pool AS (SELECT meeting, id, row_number() OVER (PARTITION BY meeting ORDER BY id) AS place, count(*) OVER (PARTITION BY meeting) AS n
               FROM eligible WHERE speaker_name = 'assistant')
    SELECT a.meeting, a.id AS asker, p.id AS drawn FROM eligible a JOIN pool p ON p.meeting = a.meeting
      AND p.place = {draw_sql('a.meeting', 'a.id')} % p.n + 1 WHERE a.speaker_name = 'user'""",
    "eligible",
)
def sample_with_replacement(spark, sf):
    rows = eligible(spark, sf)
    askers = rows.filter(F.col("speaker_name") == "user").select("meeting", F.col("id").alias("asker"))
    pool = rows.filter(F.col("speaker_name") == "assistant").select("meeting", F.col("id").alias("drawn"))
    return S.sample_with_replacement(askers, "asker", pool, "meeting", "drawn", SEED, D.block_of("drawn"))


@query(
    "seeded_shuffle",
    f"SELECT meeting, label, row_number() OVER (PARTITION BY meeting ORDER BY md5('{SEED}:' || meeting || ':' || label), label) AS place FROM (SELECT DISTINCT meeting, label FROM clauses)",
    "clauses",
)
def seeded_shuffle(spark, sf):
    return S.seeded_shuffle(D.distinct_values(clauses(spark, sf), ["meeting"], "label"), ["meeting"], "label", SEED)


@query(
    "split_by_position",
    """
    SELECT doc_id, CASE WHEN place <= floor(0.8::DOUBLE * n) THEN 'train' WHEN place <= floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'eval' ELSE 'test' END AS part
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM documents)""",
)
def split_by_position(spark, sf):
    return S.split_by_position(table(spark, sf, "documents").select("doc_id"), "doc_id", D.block_of("doc_id"))


def numbered_triples(spark, sf):
    """Triples with a global 0-based number in (meeting, anchor, positive) order, as a table."""

    def build():
        rows = eligible(spark, sf)
        ids = D.triple_ids_v2(rows, SEED)
        block = [F.floor(F.col("meeting") / 4096), F.col("meeting"), F.floor(F.col("anchor") / 1024)]
        return D.ids_to_text(D.numbered_triples(ids, ["meeting", "anchor", "positive"], block), rows, ["anchor", "positive", "other"])

    return staged(spark, sf, "triples", build)


UTTERANCES = ("anchor_utterance", "positive_utterance", "other_utterance")

part(
    "examples",
    """
    SELECT 'triples-' || number AS guid, number, anchor_utterance AS a, positive_utterance AS p, other_utterance AS o
    FROM (SELECT *, row_number() OVER (ORDER BY meeting, anchor_clause_id, positive_clause_id) - 1 AS number FROM triple_texts)""",
    "triple_texts",
)


def examples(spark, sf, max_examples=0):
    return load_triples(numbered_triples(spark, sf), "triples", ["number"], UTTERANCES, F.col("number"), max_examples)


@query("load_triples", "SELECT guid, a AS text0, p AS text1, o AS text2, 0 AS label FROM examples", "examples")
def triples_loaded(spark, sf):
    return examples(spark, sf).select("guid", *[F.get("texts", F.lit(i)).alias(f"text{i}") for i in range(3)], "label")


@query("limit_examples", "SELECT guid, a AS text0 FROM examples ORDER BY number LIMIT 100", "examples")
def limit_examples(spark, sf):
    return examples(spark, sf, 100).select("guid", F.get("texts", F.lit(0)).alias("text0"))


@query("anchor_pos_neg", "SELECT guid, a AS anchor, p AS positive, o AS negative FROM examples", "examples")
def anchor_pos_neg(spark, sf):
    return D.anchor_pos_neg(examples(spark, sf))


part(
    "registry",
    """
    SELECT (row_number() OVER (ORDER BY place) - 1)::VARCHAR AS id, sentence
    FROM (SELECT sentence, min(place) AS place FROM (
            SELECT a AS sentence, number * 3 AS place FROM examples UNION ALL SELECT p, number * 3 + 1 FROM examples UNION ALL SELECT o, number * 3 + 2 FROM examples)
          GROUP BY sentence)""",
    "examples",
)


@query("sentence_registry", "SELECT e.number AS at, r1.id AS id1, r2.id AS id2, r1.sentence FROM examples e JOIN registry r1 ON r1.sentence = e.a JOIN registry r2 ON r2.sentence = e.p", "registry")
def sentence_registry(spark, sf):
    numbered = numbered_triples(spark, sf)
    made = numbered.select("number", F.array(*UTTERANCES).alias("texts"))
    sentences, pairs = D.sentence_registry(made, "number")
    return pairs.join(sentences.withColumnRenamed("id", "id1"), "id1").select("at", "id1", "id2", "sentence")


@query(
    "topk_per_group",
    "SELECT meeting, id, n, rank FROM (SELECT meeting, id, length(utterance) AS n, row_number() OVER (PARTITION BY meeting ORDER BY length(utterance) DESC, id) AS rank FROM clauses) WHERE rank <= 3",
    "clauses",
)
def topk_per_group(spark, sf):
    rows = clauses(spark, sf).select("meeting", "id", X.text_length(F.col("utterance")).alias("n"))
    return top_rows(rows, ["meeting"], [F.col("n").desc(), F.col("id")], 3)


@query("sort_by_id", "SELECT meeting, id, utterance FROM clauses ORDER BY meeting, id", "clauses")
def sort_by_id(spark, sf):
    return D.sort_by_id(clauses(spark, sf).select("meeting", "id", "utterance"))


@query("union_rows", "SELECT meeting, id, utterance FROM clauses WHERE speaker_name = 'user' UNION ALL SELECT meeting, id, utterance FROM clauses WHERE speaker_name = 'assistant'", "clauses")
def union_rows(spark, sf):
    rows = clauses(spark, sf)
    return D.union_rows(*[rows.filter(F.col("speaker_name") == s).select("meeting", "id", "utterance") for s in ("user", "assistant")])


@query("distinct_values", "SELECT DISTINCT source AS meeting, lang AS speaker_name FROM documents")
def distinct_values(spark, sf):
    return D.distinct_values(discussion_docs(spark, sf), ["meeting"], "speaker_name")
