"""Seeded draws, shuffles and splits that repeat exactly: every choice is an md5 of seed and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.operators.ordered import row_index, top_rows


def seeded(seed: str, *keys: str | Column) -> Column:
    """Hex digest of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def draw(seed: str, n: Column, *keys: str | Column) -> Column:
    """A whole number in [0, n), from 60 bits."""
    return F.pmod(F.conv(F.substring(seeded(seed, *keys), 1, 15), 16, 10).cast("long"), n)


def sample_without_replacement(candidates: DataFrame, per: Sequence[str], item: str, k: int, seed: str) -> DataFrame:
    """``k`` distinct candidate rows per group, or all of them where there are fewer."""
    return top_rows(candidates.withColumn("h", seeded(seed, *per, item)), per, [F.col("h"), F.col(item)], k).drop("h")


def sample_with_replacement(askers: DataFrame, asker: str, pool: DataFrame, group: str, item: str, seed: str, block: Sequence[Column]) -> DataFrame:
    """One pool row of the same group for every asker; a pool row may be drawn again."""
    sizes = pool.groupBy(group).agg(F.count("*").alias("n"))
    placed = row_index(pool.select(group, item), [group], block, [item], "place")
    picked = askers.join(sizes, group).withColumn("place", draw(seed, F.col("n"), group, asker) + 1)
    return picked.join(placed, [group, "place"]).drop("place", "n")


def seeded_shuffle(df: DataFrame, per: Sequence[str], item: str, seed: str) -> DataFrame:
    """Add ``place``: a 1-based seeded order of the items per group."""
    h = df.withColumn("h", seeded(seed, *per, item))
    return row_index(h, per, [F.substring("h", 1, 3)], ["h", item], "place").drop("h")


def split_by_position(df: DataFrame, order: str, block: Sequence[Column]) -> DataFrame:
    """Add ``part``: the first int(0.8 n) rows train, the next int(0.1 n) eval, the rest test."""
    train, evaluate = F.floor(F.col("n") * 0.8), F.floor(F.col("n") * 0.1)
    part = (
        F.when(F.col("place") <= train, "train").when(F.col("place") <= train + evaluate, "eval").otherwise("test")
    )
    n = df.agg(F.count("*")).scalar()
    return row_index(df, [], block, [order], "place").withColumn("n", n).withColumn("part", part).drop("place", "n")


def limit_examples(df: DataFrame, order: Sequence[str], max_examples: int = 0) -> DataFrame:
    """The first ``max_examples`` rows in order; 0 means all."""
    return df.orderBy(*order).limit(max_examples) if max_examples > 0 else df
