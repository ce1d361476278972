"""Running computations in a fixed order that survive one key holding most of the rows.

A plain window per meeting puts a whole meeting into one task. Here the caller names *block*
columns: ascending expressions that are a prefix of the order (``turn div 4096``, an hour, the
first letters of a word). The window then runs per (key, block), one summary row per block is
carried across blocks, and the carried value is joined back on (key, block), the partitioning the
rows already have. A task holds one block.

Summary rows are carried one block column at a time, from the last to the first: within equal values
of the columns before it, a window sees one row per value of one column. Several columns, coarse to
fine (``meeting div 4096``, ``meeting``, ``anchor div 1024``), keep each of these windows short.

Block expressions must depend on the row alone, so that a recomputed task cuts the same blocks. Null
keys and null blocks are groups of their own; null blocks come first, as nulls do in the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.session import cut_lineage


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: Sequence[Column],
    order: Sequence[str | Column],
    sums: Mapping[str, Column] | None = None,
    carried: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add per-key running columns in ascending (block, order).

    ``sums``: total up to and including the row. ``carried``: latest non-null value up to and
    including the row. ``previous``: value of the row before, null on the key's first row.
    """
    sums, carried, previous = dict(sums or {}), dict(carried or {}), dict(previous or {})
    marks = [f"__b{i}" for i in range(len(block))]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    # A struct is never null itself and equals a struct with the same nulls: joins and groups by it
    # keep rows with a null key or block.
    source = df.withColumns({m: F.struct(c.alias("v")) for m, c in zip(marks, block, strict=True)})
    source = source.withColumn("__k", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))

    within = Window.partitionBy("__k", *marks).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"__s_{n}": F.sum(c).over(upto) for n, c in sums.items()}
    local |= {f"__c_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in carried.items()}
    local |= {f"__p_{n}": F.lag(F.struct(c.alias("v"))).over(within) for n, c in previous.items()}
    rows = source.withColumns(local)

    totals = [F.sum(c).alias(f"__s_{n}") for n, c in sums.items()]
    totals += [F.max_by(c, F.when(c.isNotNull(), at)).alias(f"__c_{n}") for n, c in carried.items()]
    totals += [F.max_by(F.struct(c.alias("v")), at).alias(f"__p_{n}") for n, c in previous.items()]
    offsets = _carried(source.groupBy("__k", *marks).agg(*totals), marks, list(sums), list(carried), list(previous))
    final = {n: F.col(f"__s_{n}") + F.coalesce(f"__os_{n}", F.lit(0)) for n in sums}
    final |= {n: F.coalesce(f"__c_{n}", f"__oc_{n}") for n in carried}
    final |= {n: F.coalesce(f"__p_{n}", f"__op_{n}")["v"] for n in previous}
    kept = [c for c in df.columns if c not in final]
    return rows.join(offsets, ["__k", *marks]).select(*kept, *[c.alias(n) for n, c in final.items()])


def _carried(blocks: DataFrame, marks: Sequence[str], sums: Sequence[str], carried: Sequence[str], previous: Sequence[str]) -> DataFrame:
    """What comes before each block, from one summary row per block (``__s_`` sums, ``__c_`` latest
    non-null values, ``__p_`` last rows): ``__os_``, ``__oc_``, ``__op_``."""
    outer, last = list(marks[:-1]), marks[-1:]
    before = Window.partitionBy("__k", *outer).orderBy(*last).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.select(
        "__k",
        *marks,
        *[F.sum(f"__s_{n}").over(before).alias(f"__os_{n}") for n in sums],
        *[F.last(f"__c_{n}", ignorenulls=True).over(before).alias(f"__oc_{n}") for n in carried],
        *[F.last(f"__p_{n}").over(before).alias(f"__op_{n}") for n in previous],
    )
    if not outer:
        return inside
    latest = [F.max_by(f"__c_{n}", F.when(F.col(f"__c_{n}").isNotNull(), F.col(last[0]))).alias(f"__c_{n}") for n in carried]
    latest += [F.max_by(f"__p_{n}", last[0]).alias(f"__p_{n}") for n in previous]
    groups = blocks.groupBy("__k", *outer).agg(*[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums], *latest)
    ahead = _carried(groups, outer, sums, carried, previous)
    names = [f"__o{kind}_{n}" for kind, of in (("s", sums), ("c", carried), ("p", previous)) for n in of]
    joined = inside.join(ahead.withColumnsRenamed({n: f"{n}_a" for n in names}), ["__k", *outer])
    both = [
        *[(F.coalesce(f"__os_{n}", F.lit(0)) + F.coalesce(f"__os_{n}_a", F.lit(0))).alias(f"__os_{n}") for n in sums],
        *[F.coalesce(f"__oc_{n}", f"__oc_{n}_a").alias(f"__oc_{n}") for n in carried],
        *[F.coalesce(f"__op_{n}", f"__op_{n}_a").alias(f"__op_{n}") for n in previous],
    ]
    return joined.select("__k", *marks, *both)


def row_index(df: DataFrame, keys: Sequence[str], block: Sequence[Column], order: Sequence[str | Column], name: str) -> DataFrame:
    """Add a 1-based row number per key."""
    return running(df, keys, block, order, sums={name: F.lit(1).cast("long")})


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key. ``n`` is a literal, so every task keeps only its own first ``n``
    rows of a key before the shuffle and a hot key arrives already cut down."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def with_totals(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Add per-key aggregates by aggregating first and joining the small result back, so that no
    task has to hold all rows of a key."""
    per_key = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(per_key, list(keys))


# Rows of one key and side that one task may pair with the other side's rows of that key.
PAIRED_ROWS = 20_000


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", rows: int = PAIRED_ROWS) -> DataFrame:
    """Join (``inner`` or ``left``) two sides that both may have many rows per key.

    Both sides' rows are counted per key first. Usually no key has more than ``rows`` on either side,
    and the join is a plain one. Otherwise either side of such a key is dealt out in pieces, and each of
    its pieces is copied to every piece of the other side, so that the pairs of a hot key, wherever it
    is hot, are made by a grid of tasks. Every pair is made exactly once."""
    if how not in ("inner", "left"):
        raise ValueError("inner and left joins can be split")

    def pieces(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    hot = cut_lineage(pieces(left, "__pl").join(pieces(right, "__pr"), list(keys)).filter("__pl > 1 or __pr > 1"))
    if hot.isEmpty():
        return left.join(right, list(keys), how)

    def dealt(side: DataFrame, own: str, other: str, at: str, across: str) -> DataFrame:
        mine, theirs = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        # Plain columns, as ids are, tell rows apart; vectors and texts are hashed only if there is nothing else.
        plain = [f.name for f in side.schema.fields if f.name not in keys and isinstance(f.dataType, T.NumericType)]
        place = F.pmod(F.xxhash64(*(plain or [c for c in side.columns if c not in keys] or [F.lit(0)])), mine).cast("int")
        spread = side.join(hot, list(keys), "left").withColumns({at: place, across: F.sequence(F.lit(0), theirs - 1)})
        return spread.withColumn(across, F.explode(across)).drop("__pl", "__pr")

    grid = [*keys, "__i", "__j"]
    pairs = dealt(left, "__pl", "__pr", "__i", "__j").join(dealt(right, "__pr", "__pl", "__j", "__i"), grid).drop("__i", "__j")
    if how == "inner":
        return pairs
    alone = left.join(right.select(*keys).distinct(), list(keys), "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)
