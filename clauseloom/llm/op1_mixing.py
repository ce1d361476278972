"""Mixing sources to target weights by Pfair scheduling.

The text of a source is laid out in blocks of a fixed number of characters. With weight w, the i-th
block of a source (from 1) is released at slot floor((i-1)/w) and due by slot ceil(i/w); at every slot
the released block with the earliest deadline goes next. As the weights sum to one, no deadline is
missed, so at any slot each source is within one block of its target.

Weights are rounded to whole parts of a period. The schedule then repeats with the period, and depends
on the weights alone: a block's slot follows from its number and the schedule of one period, which has
as many entries as the period has parts. Nothing of the data passes through the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import column, fresh

#: Target weights of named sources; the sources without one share the rest.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.08, "src4": 0.06}
REST = 0.46
PERIOD = 100
BLOCK_CHARS = 65_536
SEED = "mix"
#: Hex digits of the order key by which a source's documents are dealt into ranges (16**3 of them).
RANGE_DIGITS = 3
REST_GROUP = "*"


def quotas(weights: Mapping[str, float], rest: float, period: int = PERIOD) -> dict[str, int]:
    """Blocks of each group in a period: shares by largest remainder, one at least. The group of
    all unnamed sources has the key ``*`` and comes last."""
    named = {f"={k}": float(w) for k, w in weights.items()} | {REST_GROUP: float(rest)}
    if any(w <= 0 for w in named.values()):
        raise ValueError("weights must be positive")
    if len(named) > period:
        raise ValueError("the period must have a part for each weight")
    total = sum(named.values())
    exact = {k: w / total * period for k, w in named.items()}
    parts = {k: max(1, int(x + 1e-9)) for k, x in exact.items()}
    while sum(parts.values()) < period:
        parts[max(exact, key=lambda k: exact[k] - parts[k])] += 1
    while sum(parts.values()) > period:
        parts[max((k for k in parts if parts[k] > 1), key=lambda k: parts[k] - exact[k])] -= 1
    return parts


def schedule(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each group's blocks in one period, by earliest deadline among released blocks; ties
    go to the group named first."""
    period = sum(parts.values())
    names = list(parts)
    coming = [(0, g, 1) for g in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    slots: dict[str, list[int]] = {k: [] for k in names}
    for t in range(period):
        while coming and coming[0][0] <= t:
            _, g, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-i * period // parts[names[g]]), g, i))
        due, g, i = heapq.heappop(ready)
        if due < t + 1:
            raise AssertionError("a deadline was missed")
        slots[names[g]].append(t)
        if i < parts[names[g]]:
            heapq.heappush(coming, (i * period // parts[names[g]], g, i + 1))
    return slots


def _group(source: Column, weights: Mapping[str, float]) -> Column:
    return F.when(source.isin(*weights), F.concat(F.lit("="), source)).otherwise(REST_GROUP) if weights else F.lit(REST_GROUP)


def place(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, rest: float = REST, period: int = PERIOD, block_chars: int = BLOCK_CHARS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its place in the mixture, and the names of the added columns: group (``=`` and
    the source, or ``*``), start (characters of its group before it), block (in its group), slot.

    Documents of a group come in the order of md5(seed:doc_id), so copies and neighbours are spread.
    A document belongs to the block in which it starts; one that is longer than a block fills the next
    ones as well. Every row stays: when a group runs dry, its slots stay empty and the others keep
    their proportions. Null texts have no characters, a null source is among the rest, rows that
    repeat an id (or have none) follow each other. No rows give no rows.
    """
    parts = quotas(weights, rest, period)
    slots = schedule(parts)
    n = {k: fresh(docs, k) for k in ("group", "start", "block", "slot", "range", "order", "size", "before", "at", "key")}
    g, rng, order, size, before, at, key = (F.col(n[k]) for k in ("group", "range", "order", "size", "before", "at", "key"))
    named = column(docs, source)
    rows = (
        docs.withColumn(n["group"], F.coalesce(_group(named, weights), F.lit(REST_GROUP)))
        .withColumn(n["order"], F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(docs, doc_id).cast("string"), F.lit(""))).cast("binary")))
        .withColumn(n["range"], F.substring(F.col(n["order"]), 1, RANGE_DIGITS))
        .withColumn(n["size"], F.coalesce(F.length(column(docs, text)), F.lit(0)).cast("long"))
    )
    # A row for each group and range: at most 16**RANGE_DIGITS a group, whatever the input.
    total = rows.groupBy(g.alias(n["at"]), rng.alias(n["key"])).agg(F.sum(size).alias(n["before"]))
    total = total.withColumn(n["before"], F.expr(f"sum({n['before']}) over (partition by {n['at']} order by {n['key']}) - {n['before']}"))
    rows = rows.join(total, (g == at) & (rng == key))
    inside = f"sum({n['size']}) over (partition by {n['group']}, {n['range']} order by {n['order']}, {n['size']} rows unbounded preceding) - {n['size']}"
    rows = rows.withColumn(n["start"], before + F.expr(inside)).withColumn(n["block"], F.expr(f"{n['start']} div {block_chars}"))
    slot = None
    for k, of in slots.items():
        found = F.expr(f"({n['block']} div {len(of)}) * {period}") + F.element_at(F.array(*map(F.lit, of)), F.expr(f"cast({n['block']} % {len(of)} as int) + 1"))
        slot = F.when(g == k, found) if slot is None else slot.when(g == k, found)
    rows = rows.withColumn(n["slot"], slot.cast("long"))
    added = ("group", "start", "block", "slot")
    return rows.select(*[column(docs, c) for c in docs.columns], *[F.col(n[k]) for k in added]), {k: n[k] for k in added}


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """All rows and columns of ``docs``, in the order of the mixture: partitions, and so the files
    written from them, hold consecutive slots, and rows are in order within. See ``place``."""
    rows, n = place(docs, **parameters)
    rows = rows.repartitionByRange(n["slot"], n["start"]).sortWithinPartitions(n["slot"], n["start"])
    return rows.select(*[column(docs, c) for c in docs.columns])


def op1_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, mix_group, start, block, slot."""
    rows, n = place(docs.select("doc_id", "text", "source"))
    return rows.select("doc_id", F.col(n["group"]).alias("mix_group"), *[F.col(n[k]).alias(k) for k in ("start", "block", "slot")])


def op1_sql() -> str:
    """The same in SQL: the schedule of a period as a recursive table, then running sums."""
    parts = quotas(WEIGHTS, REST)
    q = f"[{', '.join(map(str, parts.values()))}]"
    names = f"[{', '.join(repr(k) for k in parts)}]"
    return f"""
WITH RECURSIVE edf(t, pick, done) AS (
  SELECT 0, 0, list_transform({q}, lambda x: 0)
  UNION ALL
  SELECT t + 1, p, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END) FROM (
    SELECT t, done, list_min(list_transform({q}, lambda q, i: CASE WHEN done[i] < q AND done[i] * {PERIOD} // q <= t
      THEN (((done[i] + 1) * {PERIOD} + q - 1) // q) * {PERIOD} + i ELSE NULL END)) % {PERIOD} AS p
    FROM edf WHERE t < {PERIOD})
), slots AS (
  SELECT {names}[pick] AS g, {q}[pick] AS q, done[pick] - 1 AS i, t - 1 AS place FROM edf WHERE t > 0
), rows_ AS (
  SELECT doc_id, CASE WHEN list_contains({names}, '=' || source) THEN '=' || source ELSE '{REST_GROUP}' END AS g,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h, coalesce(length(text), 0) AS n FROM documents
), placed AS (
  SELECT doc_id, g, sum(n) OVER (PARTITION BY g ORDER BY h, n ROWS UNBOUNDED PRECEDING) - n AS start FROM rows_
)
SELECT doc_id, p.g AS mix_group, start::BIGINT AS start, (start // {BLOCK_CHARS})::BIGINT AS block,
  ((start // {BLOCK_CHARS}) // q * {PERIOD} + place)::BIGINT AS slot
FROM placed p JOIN slots s ON p.g = s.g AND (start // {BLOCK_CHARS}) % q = i
"""
