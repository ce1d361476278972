"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from clauseloom.llm.op1_mixing import op1_mixing, op1_sql
from clauseloom.llm.op2_sentencepiece import op2_sentencepiece
from clauseloom.llm.op3_neighbours import op3_neighbours
from clauseloom.llm.op4_repeats import op4_repeats
from clauseloom.llm.op5_minhash import op5_minhash
from clauseloom.llm.op6_language import op6_language
from clauseloom.llm.op7_frames import op7_frames
from clauseloom.llm.op8_secrets import op8_secrets
from clauseloom.llm.op9_lines import op9_lines
from clauseloom.llm.op10_simhash import op10_simhash
from clauseloom.llm.op11_negatives import OP11_SQL, op11_negatives
from clauseloom.llm.op12_resampling import op12_resampling, op12_sql
from clauseloom.llm.op13_licenses import op13_licenses, op13_sql

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def over_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "pipeline": corpus_pipeline.run,
    "op1_mixing": over_documents(op1_mixing),
    "op2_sentencepiece": over_documents(op2_sentencepiece),
    "op3_neighbours": lambda spark, sf_dir: op3_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op4_repeats": over_documents(op4_repeats),
    "op5_minhash": over_documents(op5_minhash),
    "op6_language": over_documents(op6_language),
    "op7_frames": over_documents(op7_frames),
    "op8_secrets": over_documents(op8_secrets),
    "op9_lines": over_documents(op9_lines),
    "op10_simhash": over_documents(op10_simhash),
    "op11_negatives": lambda spark, sf_dir: op11_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op12_resampling": op12_resampling,
    "op13_licenses": over_documents(op13_licenses),
}

ORACLES: dict[str, str] = {"op1_mixing": op1_sql(), "op11_negatives": OP11_SQL.strip(), "op12_resampling": op12_sql().strip(), "op13_licenses": op13_sql().strip()}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
