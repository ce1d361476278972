"""Hard negatives of anchors, by a secondary sort.

Vectors become whole numbers, floor(scale * x), so that inner products are exact. Anchors meet all rows
in a grid of cells, a block of anchors and a block of rows each, as one matrix product a step. What
leaves a cell is keyed by (anchor, descending score, id), dealt out by anchor and sorted by the whole
key. An iterator then streams each anchor from its nearest row on: a row of the anchor's label opens a
window of scores, a row of another label goes into the open windows that hold its score. It keeps the
open windows and the rows of the present score, never an anchor's rows.

Cells leave out only what can't come out: first each gives its best rows of the anchor's label, which
fixes the windows; then of the other labels it gives each window's first rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import column, ship
from clauseloom.session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Bounds of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Scores beyond this count as it; 100 times a score and a score times a step's rows stay longs.
MOST = 1 << 50
#: Anchors and rows of a cell: rows are a 256th of the table within these bounds.
ANCHOR_BLOCK = 2048
ROW_BLOCK = (512, 65536)
STEP_ROWS = 1024

NONE = np.iinfo(np.int64).min


def whole(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, a row for each vector; shorter ones are filled up with zeros."""
    size = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all pairs of rows of whole numbers, cut at MOST."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < 1 << 53:  # every partial sum is exact
        found = a @ b.T
    else:
        ints = np.frompyfunc(int, 1, 1)
        found = ints(a).dot(ints(b).T)
    return np.clip(found, -MOST, MOST).astype(np.int64)


def windows(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and the largest negative score that go with a positive's."""
    return -(-low * score // 100), high * score // 100


def first(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n largest entries of each row, without those that are NONE."""
    if key.shape[1] > n:
        at = np.argpartition(key, key.shape[1] - n, axis=1)[:, -n:]
    else:
        at = np.broadcast_to(np.arange(key.shape[1]), key.shape)
    row = np.repeat(np.arange(len(key)), at.shape[1])
    at = at.ravel()
    real = key[row, at] != NONE
    return row[real], at[real]


def _cells(scale: int, work):
    """Streams rows (ga, gr, side, vec_id, label, vector[, low, high]) sorted by (ga, gr, side): of each
    cell first the anchors, then the rows, which meet them in steps. ``work`` gets (anchors, ids, labels,
    scores), where anchors is a dict of a cell's columns, and returns (row of anchors, column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, anchors = None, [], None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                some, at, side = batch.slice(lo, hi - lo), tuple(key[:2, lo].tolist()), key[2, lo]
                if at != cell:
                    cell, held, anchors = at, [], None
                if side == 0:
                    held.append(some)
                    continue
                if not held:
                    continue
                if anchors is None:
                    full = pa.Table.from_batches(held).combine_chunks()
                    anchors = {name: full.column(name).combine_chunks() for name in full.column_names[3:]}
                    anchors |= {"id": anchors["vec_id"].to_numpy(), "of": anchors["label"].to_numpy(), "x": whole(anchors["vector"], scale)}
                for a in range(0, some.num_rows, STEP_ROWS):
                    step = some.slice(a, STEP_ROWS)
                    ids, labels = step.column(3).to_numpy(), step.column(4).to_numpy()
                    scores = products(anchors["x"], whole(step.column(5), scale))
                    row, col = work(anchors, ids, labels, scores)
                    yield pa.RecordBatch.from_arrays([pa.array(anchors["id"][row]), pa.array(scores[row, col]), pa.array(ids[col])], ["anchor_id", "score", "vec_id"])

    return run


def _order(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Keys that are larger for higher scores, and for smaller ids among equal scores."""
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return scores * len(ids) - rank


def _nearest(n: int):
    def work(anchors: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = (anchors["of"][:, None] == labels) & (anchors["id"][:, None] != ids)
        return first(np.where(same, _order(ids, scores), NONE), n)

    return work


def _inside(n: int):
    def work(anchors: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((anchors["of"][:, None] != labels) & (anchors["id"][:, None] != ids), _order(ids, scores), NONE)
        chosen = np.zeros(key.shape, bool)
        low, high = whole(anchors["low"], 1).astype(np.int64), whole(anchors["high"], 1).astype(np.int64)
        open_ = np.diff(anchors["low"].offsets.to_numpy())
        for k in range(low.shape[1]):
            some = np.flatnonzero((open_ > k) & (low[:, k] <= high[:, k]))
            part = scores[some]
            row, col = first(np.where((part >= low[some, k, None]) & (part <= high[some, k, None]), key[some], NONE), n)
            chosen[some[row], col] = True
        return np.nonzero(chosen)

    return work


def _everything(anchors: dict, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero((anchors["of"][:, None] != labels) & (anchors["id"][:, None] != ids))


def _stream(positives: int, negatives: int, low: int, high: int):
    """Streams (anchor_id, minus score, vec_id, positive) rows sorted by the first three columns. Gives
    the result's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = level = None
        opened = 0
        live: list[list] = []  # of each open window: positive, its score, its rank, low, high, number so far
        present: list[int] = []  # negatives of the present score, as many as a window can take
        out: list[tuple] = []
        for batch in batches:
            for a, minus, i, positive in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                score = -minus
                if a != anchor:
                    anchor, level, opened, live, present = a, None, 0, [], []
                if score != level:
                    level, present = score, []
                    live = [w for w in live if w[3] <= score]
                if positive:
                    if opened < positives:
                        opened += 1
                        least, most = windows(score, low, high)
                        window = [i, score, opened, least, most, 0]
                        if least <= most:
                            if least <= score <= most:  # negatives of this very score that came before
                                for n in present:
                                    window[5] += 1
                                    out.append((a, i, window[5], n, score, score, opened))
                            live.append(window)
                    continue
                if len(present) < negatives:
                    present.append(i)
                for w in live:
                    if w[3] <= score <= w[4] and w[5] < negatives:
                        w[5] += 1
                        out.append((a, w[0], w[5], i, w[1], score, w[2]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], NAMES)
                out = []

    return run


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]


def hard_negatives(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, prune: bool = True) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank): for
    each anchor, a row for which ``anchor`` holds, and each of its first ``positives`` rows of the same
    label, the first ``negatives`` rows of other labels whose scores are ``low`` to ``high`` hundredths
    of the positive's. The first are those of the highest scores, among equal ones of the smallest ids.

    Rows with a null id or label, or a vector that is null or holds null, infinite or undefined numbers,
    take no part. Vectors of different lengths meet over the shorter one; an empty vector scores 0 with
    all. Rows that repeat an id count once, the one of the smallest label, then vector. Scores beyond
    2^50 count as 2^50. No rows, or no anchors, give none. ``prune=False`` sends every pair through the
    sort: the same result, for tests.
    """
    spark = vectors.sparkSession
    ship(spark)
    of = column(vectors, label) if isinstance(label, str) else label
    odd = F.exists(column(vectors, vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(column(vectors, vec_id).cast("long").alias("vec_id"), of.cast("long").alias("label"), column(vectors, vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(odd.alias("odd"), F.lit(True)))
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("vec_id", "r.*"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    na = max(1, -(-size.a // ANCHOR_BLOCK))
    nr = max(1, -(-size.n // min(max(size.n // 256, ROW_BLOCK[0]), ROW_BLOCK[1])))
    place = F.xxhash64("vec_id")

    def met(anchors: DataFrame, work) -> DataFrame:
        more = [c for c in anchors.columns if c not in ("vec_id", "label", "vector")]
        one = anchors.withColumns({"ga": F.pmod(place, F.lit(na)).cast("int"), "gr": F.explode(F.sequence(F.lit(0), F.lit(nr - 1))), "side": F.lit(0)})
        two = rows.withColumns({"gr": F.pmod(place, F.lit(nr)).cast("int"), "ga": F.explode(F.sequence(F.lit(0), F.lit(na - 1))), "side": F.lit(1)} | {c: F.lit(None).cast(anchors.schema[c].dataType) for c in more})
        names = ["ga", "gr", "side", "vec_id", "label", "vector", *more]
        cells = one.select(names).union(two.select(names)).repartition("ga", "gr").sortWithinPartitions("ga", "gr", "side")
        return cells.mapInArrow(_cells(scale, work), "anchor_id long, score long, vec_id long")

    anchors = rows.filter("anchor").select("vec_id", "label", "vector")
    nearest = met(anchors, _nearest(positives if prune else 1 << 30))
    if prune:
        nearest = nearest.withColumn("k", F.expr("row_number() over (partition by anchor_id order by score desc, vec_id)")).filter(F.col("k") <= positives).drop("k")
        nearest = cut_lineage(nearest)
        # At most ``positives`` rows of an anchor meet; the windows are those of their scores.
        edges = nearest.select("anchor_id", "score").distinct().select("anchor_id", F.expr(f"-floor(-{low} * score / 100bd)").cast("long").alias("l"), F.expr(f"floor({high} * score / 100bd)").cast("long").alias("h"))
        edges = edges.groupBy("anchor_id").agg(F.collect_list(F.struct("l", "h")).alias("w")).select(F.col("anchor_id").alias("vec_id"), F.col("w.l").cast("array<double>").alias("low"), F.col("w.h").cast("array<double>").alias("high"))
        far = met(anchors.join(edges, "vec_id"), _inside(negatives))
    else:
        far = met(anchors, _everything)
    keyed = nearest.withColumn("positive", F.lit(True)).union(far.withColumn("positive", F.lit(False)))
    keyed = keyed.select("anchor_id", (-F.col("score")).alias("minus"), "vec_id", "positive")
    keyed = keyed.repartition("anchor_id").sortWithinPartitions("anchor_id", "minus", "vec_id")
    return keyed.mapInArrow(_stream(positives, negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")


def op11_negatives(embeddings: DataFrame) -> DataFrame:
    """Anchors: ids that 50 divides. Where 7 divides the id, the label is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, F.col("vec_id") % 50 == 0, label=label)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM met WHERE same
), found AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score, p.k,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positive p JOIN met n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
  WHERE p.k <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score, k::INTEGER AS positive_rank FROM found WHERE rank <= 3
"""
