"""Word weights in long form: one row per document and word that occurs in it.

A *bag* is (meeting, doc, word, n). Document numbers come as (meeting, n_docs), counted from the
documents themselves, because a document without words still counts. Words are counted before any
shuffle (partial aggregation); weights per word are joined back as an aggregated vocabulary table,
so a word that occurs in every document never gathers in one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators.dialog import debating_speakers, pair_speakers
from clauseloom.operators.ordered import row_index, with_totals
from clauseloom.session import cut_lineage, dealt


def bag_of_words(docs: DataFrame, tokens: Column, keys: Sequence[str] = ("meeting", "doc")) -> DataFrame:
    """Counts of each word per key. Rows of one document may be spread over many input rows, which
    is how a cluster or pseudo document is concatenated: the order of words does not matter."""
    return _unfolded(docs, tokens, keys).groupBy(*keys, "word").agg(F.count("*").alias("n"))


def _unfolded(docs: DataFrame, tokens: Column, columns: Sequence[str]) -> DataFrame:
    """(columns, pos, word), a row a word. For the plain form of explode the planner tests for empty arrays
    beforehand, which tokenizes every text once more; the outer form's rows without a word are left out."""
    return docs.select(*columns, F.posexplode_outer(tokens).alias("pos", "word")).filter(F.col("pos").isNotNull())


def concat_documents(clauses: DataFrame, tokens: Column, keys: Sequence[str], order: str) -> DataFrame:
    """Tokens of each pseudo document as rows, in clause order."""
    return _unfolded(clauses, tokens, [*keys, order])


def document_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("meeting").agg(F.countDistinct("doc").alias("n_docs"))


def document_bag(docs: DataFrame, tokens: Column) -> DataFrame:
    """Bag of documents that are one row each, with ``doc_len`` carried along from that row, so
    that the length costs no aggregation of its own."""
    # The length is a column before the words are unfolded, else each word would carry the array;
    # and the outer form of explode keeps the planner from testing for empty arrays beforehand,
    # which would tokenize the text once more.
    # Texts are dealt out by document before they are unfolded, so that words are counted where they are.
    rows = dealt(docs, "meeting", "doc").select("meeting", "doc", tokens.alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long"))
    words = rows.select("meeting", "doc", "doc_len", F.explode_outer("tokens").alias("word")).filter(F.col("word").isNotNull())
    return words.groupBy("meeting", "doc", "word", "doc_len").agg(F.count("*").alias("n"))


def document_frequency(bag: DataFrame) -> DataFrame:
    return bag.groupBy("meeting", "word").agg(F.count("*").alias("df"))


def term_frequency(bag: DataFrame) -> DataFrame:
    """Count over document length."""
    if "doc_len" not in bag.columns:
        bag = with_totals(bag, ["meeting", "doc"], {"doc_len": F.sum("n")})
    return bag.withColumn("tf", F.col("n") / F.col("doc_len"))


def inverse_doc_frequency(bag: DataFrame, n_docs: DataFrame) -> DataFrame:
    """ln(N / (df + 1) + 1): the last 1 is added outside the quotient."""
    return document_frequency(bag).join(n_docs, "meeting").withColumn("idf", F.ln(F.col("n_docs") / (F.col("df") + 1) + 1))


def tf_idf(bag: DataFrame, n_docs: DataFrame) -> DataFrame:
    idf = inverse_doc_frequency(bag, n_docs).select("meeting", "word", "idf")
    return term_frequency(bag).join(idf, ["meeting", "word"]).withColumn("tf_idf", F.col("tf") * F.col("idf"))


def scaled(weights: DataFrame, keys: Sequence[str], power: int, one_row_docs: bool = False) -> DataFrame:
    """Divide ``weight`` by the key's sum (power 1) or Euclidean length (power 2).

    Where a document is one input row its words fit a task, and a window adds them up in the one
    shuffle by document. A cluster may be most of the data: its total is aggregated in parts first
    and joined back, over weights written once."""

    def total(of: Column) -> Column:
        return of if power == 1 else F.sqrt(of)

    mass = F.sum(F.pow("weight", F.lit(power)))
    if one_row_docs:
        divisor = total(mass.over(Window.partitionBy(*keys)))
        return weights.withColumn("weight", F.col("weight") / divisor)
    summed = with_totals(cut_lineage(weights), keys, {"mass": mass})
    return summed.withColumn("weight", F.col("weight") / total(F.col("mass"))).drop("mass")


def doc_representation(bag: DataFrame, n_docs: DataFrame) -> DataFrame:
    """TF-IDF of each document divided by its sum."""
    weights = tf_idf(bag, n_docs).select("meeting", "doc", "word", F.col("tf_idf").alias("weight"))
    return scaled(weights, ["meeting", "doc"], 1, "doc_len" in bag.columns)


def smooth_l2_tfidf(bag: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Count times (ln(N / df) + 1), each document scaled to length 1."""
    bag = cut_lineage(bag)
    idf = document_frequency(bag).join(n_docs, "meeting").select("meeting", "word", (F.ln(F.col("n_docs") / F.col("df")) + 1).alias("idf"))
    weights = bag.join(idf, ["meeting", "word"]).select("meeting", "doc", "word", (F.col("n") * F.col("idf")).alias("weight"))
    return scaled(weights, ["meeting", "doc"], 2, "doc_len" in bag.columns)


def cluster_tfidf(clauses: DataFrame, tokens: Column | None = None, cluster: str = "cluster") -> DataFrame:
    """Word scores per cluster (meeting, cluster, word, weight); a cluster is one document.

    Words are lower-cased and have two or more word characters."""
    docs = clauses.withColumnRenamed(cluster, "doc")
    words = X.word_terms(tokens if tokens is not None else X.tokenize(F.col("utterance")))
    return smooth_l2_tfidf(bag_of_words(docs, words), document_counts(docs)).withColumnRenamed("doc", "cluster")


def log2_l2_tfidf(bag: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Count times log2(N / df), each document scaled to length 1, zero weights left out."""
    idf = (
        document_frequency(bag)
        .join(n_docs, "meeting")
        .filter(F.col("df") < F.col("n_docs"))
        .select("meeting", "word", F.log2(F.col("n_docs") / F.col("df")).alias("idf"))
    )
    weights = bag.join(idf, ["meeting", "word"]).select("meeting", "doc", "word", (F.col("n") * F.col("idf")).alias("weight"))
    return scaled(weights, ["meeting", "doc"], 2, "doc_len" in bag.columns)


def filter_extremes(bag: DataFrame, n_docs: DataFrame, no_below: int = 1, no_above: float = 0.1, keep: int | None = None) -> DataFrame:
    """Vocabulary (meeting, word, df) with no_below <= df <= int(no_above * N), all of
    them or the ``keep`` most frequent per meeting."""
    kept = (
        document_frequency(bag)
        .join(n_docs, "meeting")
        .filter((F.col("df") >= no_below) & (F.col("df") <= F.floor(F.lit(no_above) * F.col("n_docs"))))
        .select("meeting", "word", "df")
    )
    if keep is None:
        return kept
    return (
        word_ranking(kept, ["meeting"], "df").filter(F.col("rank") <= keep).select("meeting", "word", "df")
    )


#: Words of a key that one task may rank.
RANKED_WORDS = 200_000


def word_ranking(scores: DataFrame, keys: Sequence[str], score: str, bounds: DataFrame | None = None) -> DataFrame:
    """Full ranking 1..V of the words per key, by score descending, then word ascending.

    Usually no key has more than ``RANKED_WORDS``, and a plain window ranks them in one shuffle; the words
    of larger keys go by cells. ``bounds`` (keys, n), at least the number of words of each key, tells this
    before the scores are made; without it they are written and counted."""
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), "word")).cast("long")

    def crowded(sizes: DataFrame) -> DataFrame:
        return cut_lineage(sizes.filter(F.col("n") > RANKED_WORDS).select(*keys))

    if bounds is not None and crowded(bounds).isEmpty():
        return scores.withColumn("rank", plain)
    rows = cut_lineage(scores)
    hot = crowded(rows.groupBy(*keys).agg(F.count("*").alias("n")))
    if hot.isEmpty():
        return rows.withColumn("rank", plain)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    few, many = (rows.alias("a").join(hot.alias("b"), same, how) for how in ("left_anti", "left_semi"))
    return few.withColumn("rank", plain).unionByName(_ranked_in_cells(cut_lineage(many), keys, score))


def _ranked_in_cells(scores: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """The ranking of keys of any size.

    A key's words are cut into cells of similar score, and a cell's words into blocks of one score
    and the first letters. Scores that are all different fill many cells, words that share one
    score many letters, so neither gathers a whole vocabulary in a task."""
    value = F.col(score)
    cell = F.when(value > 0, -F.floor(F.log2(value) * 64)).otherwise(F.lit(2**31))
    rows = scores.withColumn("__cell", cell)
    inside = row_index(rows, [*keys, "__cell"], [-value, F.substring("word", 1, 2)], ["word"], "rank")
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys, "__cell").agg(F.count("*").alias("n_in"))
    offsets = cells.select(*keys, "__cell", F.coalesce(F.sum("n_in").over(before), F.lit(0)).alias("__ahead"))
    ranked = inside.join(offsets, [*keys, "__cell"])
    return ranked.withColumn("rank", F.col("rank") + F.col("__ahead")).drop("__cell", "__ahead")


def dedupe_in_order(occurrences: DataFrame, keys: Sequence[str], order: Sequence[str], block: Sequence[Column]) -> DataFrame:
    """Vocabulary with its 0-based first-seen place per key. ``block`` is over the column
    ``first``, a struct of the order columns."""
    first = occurrences.groupBy(*keys, "word").agg(F.min(F.struct(*order)).alias("first"))
    return row_index(first, keys, block, ["first"], "place").withColumn("place", F.col("place") - 1)


def corpus_ratio(discussions: DataFrame, clauses: DataFrame | None = None, tokens: Column | None = None) -> DataFrame:
    """Per questioner and respondent: a word's count in their clauses over its count in the
    meeting's clauses (chairs already removed). Without ``clauses`` the discussions are all there is,
    and their texts are tokenized only once.

    Words are counted per speaker before speakers are combined into pairs, so the questioner's
    clauses are not copied for each respondent, only their word counts."""
    tokens = tokens if tokens is not None else X.tokenize(F.col("utterance"))
    where = ["meeting", "discussion", "speaker_name"]
    spoken = bag_of_words(discussions, tokens, where)
    if clauses is None:
        spoken = cut_lineage(spoken)
        corpus = spoken.groupBy("meeting", "word").agg(F.sum("n").alias("total"))
    else:
        corpus = bag_of_words(clauses, tokens, ["meeting"]).withColumnRenamed("n", "total")
    pairs = pair_speakers(debating_speakers(discussions))
    counts = pairs.join(spoken, where).groupBy("meeting", "discussion", "questioner", "respondent", "word").agg(F.sum("n").alias("n"))
    return counts.join(corpus, ["meeting", "word"]).withColumn("ratio", F.col("n") / F.col("total"))


def class_idf(bag: DataFrame) -> DataFrame:
    """(meeting, word, idf): ln(1 + mean class length / f), f the word's count over all classes of the meeting."""
    mean = bag.groupBy("meeting", "doc").agg(F.sum("n").alias("class_len")).groupBy("meeting").agg(F.avg("class_len").alias("mean_len"))
    words = bag.groupBy("meeting", "word").agg(F.sum("n").alias("f")).join(mean, "meeting")
    return words.select("meeting", "word", F.ln(1 + F.col("mean_len") / F.col("f")).alias("idf"))


def class_tfidf(bag: DataFrame) -> DataFrame:
    """Class-based weight: share of the word in the class times the word's ``class_idf``."""
    bag = cut_lineage(bag)
    sizes = bag.groupBy("meeting", "doc").agg(F.sum("n").alias("class_len"))
    return (
        bag.join(class_idf(bag), ["meeting", "word"])
        .join(sizes, ["meeting", "doc"])
        .select("meeting", "doc", "word", (F.col("n") / F.col("class_len") * F.col("idf")).alias("weight"))
    )


def dense_scores(weights: DataFrame, cluster: str, clusters: Sequence) -> DataFrame:
    """Export form: one row per word, one column per cluster in the given order, absent words 0."""
    wide = weights.groupBy("meeting", "word").pivot(cluster, list(clusters)).agg(F.first("weight"))
    return wide.na.fill(0.0).toDF("meeting", "words", *[f"cluster{i}" for i in range(1, len(clusters) + 1)])
