"""Tables: delimited text, JSON, one file per meeting, partitioned output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.text import MEETING_PREFIX, file_stem
from clauseloom.operators.dialog import ASSEMBLY_TYPE, DIGEST_TYPE
from clauseloom.operators.sampling import limit_examples

# A text file's separator by extension.
SEPARATORS = {".csv": ",", ".tsv": "\t"}

# Quoted fields may hold line breaks; a quote inside a field is doubled.
TEXT_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# Read back only: a field left empty is null, an empty pair of quotes is an empty text.
NOTHING = "\0"


def extension(path: str) -> str:
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return base[base.rindex(".") :] if "." in base else ""


def read_table(spark: SparkSession, path: str, schema: str | None = None, has_header: bool = False, multi_line: bool = True, infer: bool = True) -> DataFrame:
    """Choose the reader by the exact extension of the path; an unknown one is an error.

    The path may be a file or a folder written by ``write_table``. With a schema, or with ``infer``
    off (columns are text), nothing is read twice. A file whose fields may hold line breaks is read
    by one task; with ``multi_line`` off it is split, and JSON has one document a line."""
    kind = extension(path)
    if kind in SEPARATORS:
        reader = spark.read.options(**TEXT_OPTIONS, multiLine=multi_line, nullValue=NOTHING, header=has_header, sep=SEPARATORS[kind], inferSchema=infer and schema is None)
        if schema:
            reader = reader.schema(schema)
        df = reader.csv(path)
        return df if has_header or schema else df.toDF(*[f"column_{i}" for i in range(1, len(df.columns) + 1)])
    if kind == ".json":
        reader = spark.read.option("multiLine", multi_line)
        return (reader.schema(schema) if schema else reader).json(path)
    raise ValueError(f"no reader for {kind!r}: {path}")


def read_headerless(spark: SparkSession, path: str, columns: int | None = None, multi_line: bool = True) -> DataFrame:
    """Columns ``column_1`` to ``column_n`` as text."""
    if columns is not None:
        return read_table(spark, path, ", ".join(f"column_{i} string" for i in range(1, columns + 1)), multi_line=multi_line)
    return read_table(spark, path, multi_line=multi_line, infer=False)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Delimited text with a header; the separator follows the extension of the path."""
    df.write.mode(mode).options(**TEXT_OPTIONS, header=True, sep=SEPARATORS[extension(path)], emptyValue='""').csv(path)


def read_meetings(spark: SparkSession, folder: str, prefix: str = MEETING_PREFIX, multi_line: bool = True) -> DataFrame:
    """Rows of the minutes files whose name starts with the prefix: meeting (stem), assembly, digest.

    A file is one document, or with ``multi_line`` off one document per line, which can be split."""
    schema = f"assembly {ASSEMBLY_TYPE}, digest {DIGEST_TYPE}"
    raw = spark.read.schema(schema).option("multiLine", multi_line).option("pathGlobFilter", f"{prefix}*").json(folder)
    return raw.select(file_stem(F.col("_metadata.file_name")).alias("meeting"), "assembly", "digest")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists") -> None:
    """One folder per key combination, files of bounded size inside.

    Rows are dealt out by key and rebalanced: a key with most of the rows is split at run time into as
    many tasks, and files, as its bytes ask for, and small keys share a task."""
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)


def load_triples(df: DataFrame, name: str, order: Sequence[str], columns: Sequence[str], number: Column, max_examples: int = 0) -> DataFrame:
    """Training examples (guid, texts[3], label 0) from three columns; a null reads ``None``.

    ``number`` is the row's 0-based place in ``order``."""
    texts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns])
    rows = limit_examples(df, order, max_examples)
    return rows.select(F.concat_ws("-", F.lit(name), number.cast("string")).alias("guid"), texts.alias("texts"), F.lit(0).alias("label"))
