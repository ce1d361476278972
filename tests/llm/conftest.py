import pytest
from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text[, lang[, source]]) tuples, over several partitions."""

    def make(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT)
        for name in extra:
            df = df.withColumn(name, F.lit(7))
        return df.repartition(3) if rows else df

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest given table, if it is here."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the given tables are not here")
    return spark.read.parquet(path)

