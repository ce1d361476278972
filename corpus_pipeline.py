"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

1. language: documents whose language can't be told go.
2. lines: chunks of lines that occur elsewhere in the corpus are taken out of the texts.
3. near_copies: of each group of near copies one document stays.
4. mix: the documents are put in the order of a mixture at target weights; none goes.
5. encode: ids of every text, with the document's place in the mixture.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import op1_mixing, op2_sentencepiece, op5_minhash, op6_language, op9_lines, op10_simhash
from clauseloom.llm.components import components
from clauseloom.session import cut_lineage, new_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with letters, most of whose words are in one language."""
    return op6_language.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated chunks of lines; n_chars follows. Every document stays."""
    found, _ = op9_lines.dedup_lines(docs)
    columns = {"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")} if "n_chars" in docs.columns else {}
    return found.withColumns(columns).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group. Groups are those of SimHash, whose links of at
    most two bits meet at the anchors of its covering code, joined by verified Jaccard similarities of 0.8
    on shingles of five words, in lower case as in SimHash: a pair at 0.8 differs in 10 of 64 bits at the
    mean, beyond what the anchors reach, so these links come from MinHash bands."""
    # An id may have several texts, so rows go by a number of both.
    rows = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    alike = op10_simhash.near_groups(rows, "row").select(F.col("doc_id").alias("row"), "component_id")
    classes = op5_minhash.classes(rows.withColumn("text", F.lower("text")), "row").select(F.col("doc_id").alias("row"), "class_id")
    both = cut_lineage(alike.distinct().join(classes.distinct(), "row"))
    joined = components(both.select(F.col("component_id").alias("u"), F.col("class_id").alias("v")))
    group = both.join(joined, F.col("class_id") == F.col("node"), "left").select("row", F.coalesce("label", "class_id").alias("group"))
    ids = cut_lineage(rows.select("doc_id", "row").distinct().join(group, "row").select("doc_id", "group"))
    least = ids.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return op10_simhash.keep_one(docs, groups=ids.join(least, "group").select("doc_id", "component_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mixture: part files in the order of their names, and rows
    in files, follow the schedule."""
    return op1_mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, shard, row, n_tokens, ids. Sorted by shard (number of the part file that
    held the document) and row (in it), documents are in the order of the mixture; both are null if
    ``docs`` doesn't come from files. Numbers of part files depend on how many were written."""
    try:
        placed = docs.select("doc_id", "lang", "source", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("shard"), F.col("_metadata.row_index").cast("long").alias("row"))
    except AnalysisException:
        placed = docs.select("doc_id", "lang", "source", "text", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("row"))
    tokens, ids = op2_sentencepiece.encode(placed)
    return tokens.select("doc_id", "lang", "source", "shard", "row", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: Forward-backward, rolling hashes and merges have no SQL form; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
