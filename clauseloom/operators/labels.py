"""Label encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.ordered import row_index


def encode_labels(df: DataFrame, column: str = "column_1", encoded: str = "column_4") -> DataFrame:
    """Sorted distinct strings become 0..k-1. Only the distinct labels are numbered; the join back
    is left to the planner, which broadcasts them when they turn out small."""
    distinct = df.select(column).distinct()
    codes = row_index(distinct, [], [F.substring(column, 1, n) for n in (1, 2, 4)], [column], encoded)
    return df.join(codes.withColumn(encoded, F.col(encoded) - 1), column)
