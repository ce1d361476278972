"""Clauses, digests, discussions and the pairs and triples made from them.

Relations: ``clauses`` (meeting, id, speaker_name, utterance, label = paragraph number from 1),
``digest`` (meeting, id, speaker_name, utterance, kind), ``discussions`` (clauses + discussion).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators.ordered import row_index, running, split_join
from clauseloom.operators.sampling import draw, seeded
from clauseloom.session import cut_lineage

BLOCK = 65536

# The kinds of digest rows.
SUMMARY, TITLE, POLICY, REPLY = "speaker.summury", "policy.title", "policy.utterance", "reply.utterance"

ASSEMBLY_TYPE = "struct<utterances: array<struct<speaker: string, utterance: array<string>>>>"
# A policy stays raw JSON until its keys have been listed in their own order.
DIGEST_TYPE = "struct<speakers: array<struct<speaker_name: string, summury: string, policies: array<string>>>>"
POLICY_TYPE = "struct<title: string, utterance: string, replies: array<map<string,string>>>"


def block_of(column: str, size: int = BLOCK) -> list[Column]:
    return [F.floor(F.col(column) / size)]


# --- flattening -----------------------------------------------------------------------------


def flatten_assembly(meetings: DataFrame, ends: str = X.CLAUSE_END) -> DataFrame:
    """Clauses of nested minutes (meeting, assembly). One meeting is one row, so paragraph and
    clause numbers come from array positions and nothing is shuffled."""
    paragraphs = F.flatten(
        F.transform(
            "assembly.utterances",
            lambda u: F.transform(
                u["utterance"],
                lambda p: F.struct(X.normalize_speaker(u["speaker"]).alias("speaker_name"), p.alias("paragraph")),
            ),
        )
    )
    clauses = F.flatten(
        F.transform(
            paragraphs,
            lambda p, i: F.transform(
                X.split_clauses(p["paragraph"], ends),
                lambda c: F.struct(p["speaker_name"].alias("speaker_name"), c.alias("utterance"), (i + 1).cast("long").alias("label")),
            ),
        )
    )
    return meetings.select("meeting", F.posexplode(clauses).alias("id", "c")).select(
        "meeting", F.col("id").cast("long").alias("id"), "c.speaker_name", "c.utterance", "c.label"
    )


def clauses_from_turns(turns: DataFrame, ends: str = X.CLAUSE_END, block: int = BLOCK) -> DataFrame:
    """Clauses of tabular minutes (meeting, turn, speaker_name, text), one turn being a paragraph.

    The running totals are taken over turns, before they are split into clauses. The outer form of
    posexplode keeps the planner from testing for empty turns by splitting the text once more."""
    cut = turns.withColumn("parts", X.split_clauses(F.col("text"), ends))
    numbered = running(
        cut,
        ["meeting"],
        block_of("turn", block),
        ["turn"],
        sums={"label": F.lit(1).cast("long"), "upto": F.size("parts").cast("long")},
    )
    unfolded = numbered.select(
        "meeting",
        "turn",
        "speaker_name",
        "label",
        (F.col("upto") - F.size("parts")).alias("first"),
        F.posexplode_outer("parts").alias("pos", "utterance"),
    )
    return unfolded.filter(F.col("pos").isNotNull()).select(
        "meeting", (F.col("first") + F.col("pos")).alias("id"), "speaker_name", "utterance", "label", "turn"
    )


def reply_by_position(reply: Column) -> Column:
    """A reply's first value is the speaker, its second the text, whatever the keys are called."""
    values = F.map_values(reply)
    return F.struct(F.get(values, F.lit(0)).alias("speaker_name"), F.get(values, F.lit(1)).alias("text"))


def flatten_digest(meetings: DataFrame) -> DataFrame:
    """Digest rows of nested minutes (meeting, digest), in the order of the JSON keys.

    The digest speaker loses the parenthesis after the name, a reply's speaker keeps it."""

    def row(speaker: Column, utterance: Column, kind: str) -> Column:
        return F.struct(speaker.alias("speaker_name"), utterance.alias("utterance"), F.lit(kind).alias("kind"))

    def policy_rows(speaker: Column, raw: Column) -> Column:
        policy = F.from_json(raw, POLICY_TYPE)
        title = F.array(row(speaker, policy["title"], TITLE))
        parts = F.transform(X.split_enumerated(policy["utterance"]), lambda p: row(speaker, p, POLICY))
        replies = F.flatten(
            F.transform(
                F.transform(policy["replies"], reply_by_position),
                lambda r: F.transform(X.split_enumerated(r["text"]), lambda p: row(r["speaker_name"], p, REPLY)),
            )
        )
        return F.flatten(
            F.transform(
                F.json_object_keys(raw),
                lambda k: F.when(k == "title", title)
                .when(k == "utterance", parts)
                .when(k == "replies", replies)
                .otherwise(F.slice(title, 1, 0)),
            )
        )

    def speaker_rows(s: Column) -> Column:
        name = X.strip_parenthesis(s["speaker_name"])
        policies = F.flatten(F.transform(s["policies"], lambda p: policy_rows(name, p)))
        return F.concat(F.array(row(name, s["summury"], SUMMARY)), policies)

    rows = F.flatten(F.transform("digest.speakers", speaker_rows))
    return meetings.select("meeting", F.posexplode(rows).alias("id", "r")).select(
        "meeting", F.col("id").cast("long").alias("id"), "r.speaker_name", "r.utterance", "r.kind"
    )


def without_chair(clauses: DataFrame, chairs: Sequence[str] = X.CHAIR_NAMES) -> DataFrame:
    return clauses.filter(X.not_chair(F.col("speaker_name"), chairs))


def eligible_clauses(clauses: DataFrame, chairs: Sequence[str] = X.CHAIR_NAMES, longer_than: int = 10) -> DataFrame:
    return without_chair(clauses, chairs).filter(X.min_length(F.col("utterance"), longer_than))


# --- digest -----------------------------------------------------------------------------------


def carry_title(digest: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add the latest title and its speaker to every row, title rows included."""
    is_title = F.col("kind") == TITLE
    return running(
        digest,
        ["meeting"],
        block_of("id", block),
        ["id"],
        carried={"title": F.when(is_title, F.col("utterance")), "title_speaker": F.when(is_title, F.col("speaker_name"))},
    )


def titles_and_replies(digest: DataFrame) -> DataFrame:
    return digest.filter(F.col("kind").isin(TITLE, REPLY))


def debater_pairs(digest: DataFrame, block: int = BLOCK) -> DataFrame:
    """(short_summary, questioner, respondent) for every reply row."""
    return (
        carry_title(titles_and_replies(digest), block)
        .filter(F.col("kind") == REPLY)
        .select(
            "meeting",
            "id",
            F.col("title").alias("short_summary"),
            F.col("title_speaker").alias("questioner"),
            F.col("speaker_name").alias("respondent"),
        )
    )


def title_first_reply(digest: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each title with the reply row directly after it; a title without one is left out."""
    return (
        running(
            titles_and_replies(digest),
            ["meeting"],
            block_of("id", block),
            ["id"],
            previous={"was": F.col("kind"), "short_summary": F.col("utterance"), "questioner": F.col("speaker_name")},
        )
        .filter((F.col("kind") == REPLY) & (F.col("was") == TITLE))
        .select("meeting", "id", "short_summary", "questioner", F.col("speaker_name").alias("respondent"))
    )


def sections(digest: DataFrame, block: int = BLOCK) -> DataFrame:
    """Digest without summaries, with ``pos`` (0-based row number) and ``section`` (titles so far)."""
    numbered = running(
        digest.filter(F.col("kind") != SUMMARY),
        ["meeting"],
        block_of("id", block),
        ["id"],
        sums={"pos": F.lit(1).cast("long"), "section": (F.col("kind") == TITLE).cast("long")},
    )
    return numbered.withColumn("pos", F.col("pos") - 1)


def unique_titles(digest: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per section with a title of its own: if an earlier section that has clauses bears
    the same title, the title row's position is appended."""
    return titles_of_sections(cut_lineage(sections(digest, block)), block)


def titles_of_sections(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``unique_titles`` from the rows that ``sections`` gives."""
    is_title = F.col("kind") == TITLE
    per_section = (
        parts.filter(F.col("section") > 0)
        .groupBy("meeting", "section")
        .agg(
            F.max(F.when(is_title, F.col("utterance"))).alias("title"),
            F.max(F.when(is_title, F.col("pos"))).alias("title_pos"),
            F.sum((~is_title).cast("long")).alias("clauses"),
        )
    )
    seen = running(
        cut_lineage(per_section),
        ["meeting", "title"],
        block_of("title_pos", block),
        ["title_pos"],
        sums={"filled": (F.col("clauses") > 0).cast("long")},
    )
    earlier = F.col("filled") - (F.col("clauses") > 0).cast("long")
    return seen.select(
        "meeting",
        "section",
        "title_pos",
        "clauses",
        F.col("title").alias("raw_title"),
        F.when(earlier > 0, F.concat("title", F.col("title_pos").cast("string"))).otherwise(F.col("title")).alias("title"),
    )


def digest_clause_table(digest: DataFrame, block: int = BLOCK) -> DataFrame:
    """Digest clauses with their section's unique title and a new 0-based id."""
    parts = cut_lineage(sections(digest, block))
    clauses = parts.filter(F.col("kind") != TITLE)
    titles = titles_of_sections(parts, block).select("meeting", "section", "title")
    return clauses.join(titles, ["meeting", "section"], "left").select(
        "meeting",
        (F.col("pos") - F.col("section")).alias("id"),
        "title",
        "speaker_name",
        F.col("utterance").alias("clause"),
        "kind",
        "section",
    )


# --- discussions --------------------------------------------------------------------------------


def segment_discussions(
    clauses: DataFrame, boundary: Column, chairs: Sequence[str] = X.CHAIR_NAMES, block: int = BLOCK
) -> DataFrame:
    """Cut each meeting at its boundary rows; discussion i starts with boundary i.

    Rows before the first boundary and the meeting's last row belong to no discussion, chairs are
    removed after the cut, and a discussion left empty still uses up its number."""
    cut = running(clauses, ["meeting"], block_of("id", block), ["id"], sums={"discussion": boundary.cast("long")})
    bounded = cut.join(clauses.groupBy("meeting").agg(F.max("id").alias("last_id")), "meeting")
    return without_chair(
        bounded.filter((F.col("discussion") > 0) & (F.col("id") < F.col("last_id")))
        .withColumn("discussion", F.col("discussion") - 1)
        .drop("last_id"),
        chairs,
    )


def first_speaker(discussions: DataFrame) -> DataFrame:
    """Questioner of each discussion: the speaker of its first row."""
    return discussions.groupBy("meeting", "discussion").agg(F.min_by("speaker_name", "id").alias("questioner"))


def debating_speakers(discussions: DataFrame) -> DataFrame:
    """(meeting, discussion, questioner, respondent): the questioner with every other speaker."""
    speakers = discussions.select("meeting", "discussion", F.col("speaker_name").alias("respondent")).distinct()
    return (
        speakers.join(first_speaker(discussions), ["meeting", "discussion"])
        .filter(F.col("respondent") != F.col("questioner"))
        .select("meeting", "discussion", "questioner", "respondent")
    )


def pair_speakers(pairs: DataFrame) -> DataFrame:
    """Turn 'speaker is the questioner or the respondent' into one row per pair and speaker, so
    that the lookup is an equi join. A pair of one person gives one row."""
    both = F.array_distinct(F.array("questioner", "respondent"))
    return pairs.withColumn("speaker_name", F.explode(both))


def pair_documents(discussions: DataFrame, pairs: DataFrame | None = None, said: DataFrame | None = None) -> DataFrame:
    """Clauses by either debater, for each pair of each discussion.

    With ``pairs`` (meeting, questioner, respondent, and anything that tells one title from
    another) there is one document per pair row whose questioner opened the discussion. With ``said``
    (meeting, discussion, speaker_name, and more) a document holds these rows in place of the clauses."""
    if pairs is None:
        sought = debating_speakers(discussions)
    else:
        sought = pairs.join(first_speaker(discussions), ["meeting", "questioner"])
    rows = said if said is not None else discussions.select("meeting", "discussion", "speaker_name", "id", "utterance")
    return pair_speakers(sought).join(rows, ["meeting", "discussion", "speaker_name"])


# --- pairs and triples ----------------------------------------------------------------------------


def next_label(clauses: DataFrame, block: int = BLOCK) -> DataFrame:
    """Neighbouring paragraph numbers among those that are present."""
    labels = clauses.select("meeting", "label").distinct()
    return (
        running(labels, ["meeting"], block_of("label", block), ["label"], previous={"before": F.col("label")})
        .filter(F.col("before").isNotNull())
        .select("meeting", F.col("before").alias("label"), F.col("label").alias("next_label"))
    )


def adjacent_pairs(eligible: DataFrame, block: int = BLOCK) -> DataFrame:
    """(anchor, positive): every clause of a paragraph with every clause of the next one.

    Takes clauses after the chair and length filters, so numbering gaps close up. Both joins are on
    the paragraph, never on the meeting alone."""
    rows = eligible.select("meeting", "label", "id")
    left = rows.withColumnRenamed("id", "anchor").join(next_label(eligible, block), ["meeting", "label"])
    right = rows.select("meeting", F.col("label").alias("next_label"), F.col("id").alias("positive"))
    return left.join(right, ["meeting", "next_label"]).select("meeting", "anchor", "positive")


def renamed(clauses: DataFrame, role: str, key: str) -> DataFrame:
    return clauses.select(
        "meeting",
        F.col("id").alias(key),
        F.col("speaker_name").alias(f"{role}_speaker_name"),
        F.col("utterance").alias(f"{role}_utterance"),
        F.col("label").alias(f"{role}_speaker_label"),
    )


def ids_to_text(ids: DataFrame, clauses: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Replace each ``<role>`` id by the clause's id, speaker, text and paragraph."""
    out = ids
    for role in roles:
        out = out.join(renamed(clauses, role, role), ["meeting", role])
    return out.withColumnsRenamed({role: f"{role}_clause_id" for role in roles})


def exclude_candidates(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop candidates (meeting, anchor, other) that are the anchor or one of its positives."""
    return candidates.filter(F.col("other") != F.col("anchor")).join(
        pairs.withColumnRenamed("positive", "other"), ["meeting", "anchor", "other"], "left_anti"
    )


def triple_ids_v2(eligible: DataFrame, seed: str, block: int = BLOCK) -> DataFrame:
    """(anchor, positive, other) ids: an anchor's k positives in id order, each with one of k
    negatives sampled without replacement.

    Clauses get a shuffled position per meeting once. An anchor draws 2k+1 neighbouring positions
    from a seeded start: at most k+1 of them are the anchor and its positives, so k remain. The
    work is proportional to the number of pairs; draws of one anchor are neighbours in the shuffled
    order. Pairs whose meeting has too few other clauses for this get no row."""
    # Read three times below: a narrow table of ids, written once.
    pairs = cut_lineage(adjacent_pairs(eligible, block))
    mixed = eligible.select("meeting", "id", seeded(seed, "meeting", "id").alias("h"))
    placed = row_index(mixed, ["meeting"], [F.substring("h", 1, 3)], ["h", "id"], "place").select("meeting", "place", F.col("id").alias("other"))
    sizes = eligible.groupBy("meeting").agg(F.count("*").alias("n"))
    anchors = pairs.groupBy("meeting", "anchor").agg(F.count("*").alias("k")).join(sizes, "meeting")
    start = draw(seed + "-start", F.col("n"), "meeting", "anchor")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.least(2 * F.col("k") + 1, F.col("n")) - 1))
    drawn = (
        anchors.select("meeting", "anchor", "n", start.alias("start"), steps.alias("step"))
        .withColumn("place", F.pmod(F.col("start") + F.col("step"), F.col("n")) + 1)
        .join(placed, ["meeting", "place"])
    )
    by_anchor = Window.partitionBy("meeting", "anchor")
    others = exclude_candidates(drawn, pairs).select(
        "meeting", "anchor", "other", F.row_number().over(by_anchor.orderBy("step")).alias("rn")
    )
    ranked = pairs.withColumn("rn", F.row_number().over(by_anchor.orderBy("positive")))
    return ranked.join(others, ["meeting", "anchor", "rn"]).select("meeting", "anchor", "positive", "other")


def triples_v2(clauses: DataFrame, seed: str, chairs: Sequence[str] = X.CHAIR_NAMES, longer_than: int = 10, block: int = BLOCK) -> DataFrame:
    eligible = eligible_clauses(clauses, chairs, longer_than)
    return ids_to_text(triple_ids_v2(eligible, seed, block), eligible, ["anchor", "positive", "other"])


def triple_ids_v3(discussions: DataFrame, seed: str, longer_than: int = 10, block: int = BLOCK) -> DataFrame:
    """(anchor, positive, other) ids per discussion: every longer respondent clause with every
    longer questioner clause, and one seeded clause of a third speaker (any length, reusable).

    The other speakers' rows are numbered by (speaker, id), where the respondent's rows form one
    run; a draw that lands at or behind the run is moved past it. So the pool is never copied per
    respondent. Pairs without a third speaker get no row."""
    where = ["meeting", "discussion"]
    asked = discussions.join(first_speaker(discussions), where)
    long_enough = X.min_length(F.col("utterance"), longer_than)
    positives = asked.filter((F.col("speaker_name") == F.col("questioner")) & long_enough).select(*where, F.col("id").alias("positive"))
    answering = asked.filter(F.col("speaker_name") != F.col("questioner")).select(*where, "speaker_name", "id", long_enough.alias("fits"))
    placed = row_index(answering, where, [F.col("speaker_name"), *block_of("id", block)], ["id"], "place").withColumn("place", F.col("place") - 1)
    # Read four times below: a narrow table of ids, written once.
    placed = cut_lineage(placed)
    runs = placed.groupBy(*where, "speaker_name").agg(F.min("place").alias("run"), F.count("*").alias("size"))
    pools = runs.groupBy(*where).agg(F.sum("size").alias("total"))
    anchors = (
        placed.filter("fits")
        .join(runs.join(pools, where), [*where, "speaker_name"])
        .filter(F.col("total") > F.col("size"))
        .select(*where, F.col("id").alias("anchor"), "run", "size", "total")
    )
    number = draw(seed, F.col("total") - F.col("size"), *where, "anchor", "positive")
    return (
        split_join(anchors, positives, where)
        .withColumn("number", number)
        .withColumn("place", F.col("number") + F.when(F.col("number") >= F.col("run"), F.col("size")).otherwise(0))
        .join(placed.select(*where, "place", F.col("id").alias("other")), [*where, "place"])
        .select(*where, "anchor", "positive", "other")
    )


def triples_v3(discussions: DataFrame, seed: str, longer_than: int = 10, block: int = BLOCK) -> DataFrame:
    return ids_to_text(triple_ids_v3(discussions, seed, longer_than, block), discussions, ["anchor", "positive", "other"])


def anchor_pos_neg(examples: DataFrame) -> DataFrame:
    """Three columns from examples (guid, texts[3], label)."""
    return examples.select(
        "guid",
        *[F.get("texts", F.lit(i)).alias(n) for i, n in enumerate(["anchor", "positive", "negative"])],
    )


def numbered_triples(ids: DataFrame, order: Sequence[str], block: Sequence[Column]) -> DataFrame:
    """Add ``number``, the 0-based place in the given order over all triples. Numbering the narrow
    id table before any text is attached keeps texts out of the shuffle."""
    return row_index(ids, [], block, order, "number").withColumn("number", F.col("number") - 1)


def sentence_registry(examples: DataFrame, order: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Distinct sentences with string ids in first-seen order, and the id pairs of the first two
    texts of every example. ``order`` is a numeric column of unique example numbers.

    The first-seen place of a sentence is a number of its own (3 * example + text), so the dense
    numbering is a running count over blocks of places."""
    seen = examples.select(F.posexplode("texts").alias("k", "sentence"), F.col(order).alias("at"))
    first = seen.groupBy("sentence").agg(F.min(F.col("at") * 3 + F.col("k")).alias("place"))
    numbered = row_index(first, [], block_of("place", block), ["place"], "n")
    sentences = numbered.select((F.col("n") - 1).cast("string").alias("id"), "sentence")
    two = examples.select(F.col(order).alias("at"), F.get("texts", F.lit(0)).alias("a"), F.get("texts", F.lit(1)).alias("b"))
    pairs = (
        two.join(sentences.select(F.col("id").alias("id1"), F.col("sentence").alias("a")), "a")
        .join(sentences.select(F.col("id").alias("id2"), F.col("sentence").alias("b")), "b")
        .select("at", "id1", "id2")
    )
    return sentences, pairs


def union_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Vertical concatenation by column name."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out


def distinct_values(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return rows.select(*keys, column).distinct()


def sort_by_id(rows: DataFrame) -> DataFrame:
    """Final order of an export: a range sort over (meeting, id)."""
    return rows.orderBy("meeting", "id")
