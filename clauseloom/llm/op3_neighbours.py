"""Approximate nearest neighbours with a forest of random-projection trees.

A tree splits space by random directions at the median of a sample; its leaves are cells. Every vector
is dealt into a cell of every tree. A query goes down all trees through one shared priority queue: the
next branch, of whichever tree, is the one whose border is nearest, until the cells reached hold the
wanted number of rows. Cells are then read where they lie, and their vectors ranked by their exact
distance.

The trees are fitted on a bounded sample (``SAMPLE`` vectors) and broadcast; every row is indexed. The
forest has ``TREES`` trees with at most ``SAMPLE / LEAF`` cells each, whatever the input.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import column, ship
from clauseloom.session import cut_lineage

K = 10
TREES = 16
SAMPLE = 16_384
LEAF = 32
#: A query's cells hold this share of all rows, counted in every tree they are met in. Unstructured
#: vectors of 64 numbers need as much for a recall of 0.9; clustered ones far less.
SHARE = 1.5
#: Points of a cell that one piece holds; fuller cells are dealt into pieces.
PIECE = 4096
SEED = 23


@dataclass
class Forest:
    """Complete binary trees of one depth; node n has the children 2n+1 and 2n+2."""

    directions: np.ndarray  # tree, node, number
    borders: np.ndarray  # tree, node
    depth: int
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def inner(self) -> int:
        return (1 << self.depth) - 1

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector in each tree, numbered over all trees."""
        out = np.empty((len(self.borders), len(vectors)), np.int64)
        for t in range(len(self.borders)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, self.directions[t, node]) > self.borders[t, node]
                node = 2 * node + 1 + side
            out[t] = node - self.inner + (t << self.depth)
        return out

    def search(self, query: np.ndarray, wanted: float) -> list[int]:
        """Cells in the order in which the queue reaches them, until they hold ``wanted`` rows."""
        queue = [(0.0, t, 0) for t in range(len(self.borders))]
        found, held = [], 0
        while queue and held < wanted:
            far, t, node = heapq.heappop(queue)
            while node < self.inner:
                gap = float(query @ self.directions[t, node] - self.borders[t, node])
                near, other = (2 * node + 2, 2 * node + 1) if gap > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(far, abs(gap)), t, other))
                node = near
            cell = node - self.inner + (t << self.depth)
            if self.counts[cell]:
                found.append(cell)
                held += int(self.counts[cell])
        return found


def plant(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.log2(max(1, len(sample) / leaf))))
    nodes = (1 << depth) - 1
    directions = rng.normal(size=(trees, nodes, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    borders = np.zeros((trees, nodes))
    for t in range(trees):
        rows = [np.arange(len(sample))]
        for node in range(nodes):
            mine = rows[node]
            place = sample[mine] @ directions[t, node]
            borders[t, node] = np.median(place) if len(mine) else 0.0
            rows += [mine[place <= borders[t, node]], mine[place > borders[t, node]]]
    return Forest(directions, borders, depth)


def _matrix(values: pa.Array, size: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def nearest(points: np.ndarray, names: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest points by exact distance, ties to the smaller name; (names, distances)."""
    gap = points - query
    distance = np.sqrt((gap * gap).sum(axis=1))
    if len(distance) > k:
        bound = np.partition(distance, k - 1)[k - 1]
        some = np.flatnonzero(distance <= bound)
    else:
        some = np.arange(len(distance))
    best = some[np.lexsort((names[some], distance[some]))[:k]]
    return names[best], distance[best]


def _takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def search(rows: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, trees: int = TREES, sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` (a
    function of the id column) holds, among all other rows; score is the Euclidean distance.

    Rows without an id, and vectors that are null, empty, zero, hold a null or a number that isn't
    finite, or are of another length than most, take no part. Rows that repeat an id and vector count
    once. Equal vectors are one point with its k+1 smallest ids, which is all that any answer can use.
    Fewer candidates than k give fewer rows; no rows give none.
    """
    spark = rows.sparkSession
    ship(spark)
    named = rows.select(column(rows, vec_id).cast("long").alias("vec_id"), column(rows, vector).alias("vec"))
    named = named.filter(F.col("vec_id").isNotNull() & _takes_part(F.col("vec")))
    sizes = named.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes["size"]
    named = named.filter(F.size("vec") == size)

    # Equal vectors: ranked within tasks first, so that at most k+1 ids of each task are moved.
    least = named.withColumn("r", F.expr("dense_rank() over (partition by vec order by vec_id)")).filter(F.col("r") <= k + 1)
    points = cut_lineage(least.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "vec", "ids"))
    asked = named.filter(is_query(F.col("vec_id"))).distinct()
    asked = cut_lineage(asked.join(points.select("vec", "node"), "vec").select("vec_id", "node", "vec"))

    drawn = points.select("vec").orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(sample).toPandas()["vec"]
    forest = plant(np.array([np.asarray(v, np.float64) for v in drawn]), trees)
    bare = spark.sparkContext.broadcast(forest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bare.value.borders) << bare.value.depth, np.int64)
        for batch in batches:
            total += np.bincount(bare.value.cells(_matrix(batch.column(0), size)).ravel(), minlength=len(total))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["cell", "n"])

    forest.counts = np.zeros(trees << forest.depth, np.int64)
    # A row for each cell of the forest at most.
    for r in points.select("vec").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        forest.counts[r.cell] = r.n
    wanted = share * int(forest.counts[: 1 << forest.depth].sum())
    grown = spark.sparkContext.broadcast(forest)
    names = ["cell", "piece", "kind", "node", "vec"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = -(-grown.value.counts // PIECE)
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy(zero_copy_only=False)
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
            for cell in grown.value.cells(_matrix(batch.column(1), size)):
                kind = pa.array(np.zeros(len(node), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(mixed % pieces[cell]), kind, batch.column(0), batch.column(1)], names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = -(-grown.value.counts // PIECE)
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                cells, piece, row = [], [], []
                for i, query in enumerate(_matrix(batch.column(1), size)):
                    for cell in grown.value.search(query, wanted):
                        n = int(pieces[cell])
                        cells += [cell] * n
                        piece += range(n)
                        row += [i] * n
                at = pa.array(row, pa.int64())
                kind = pa.array(np.ones(len(row), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(piece, pa.int64()), kind, batch.column(0).take(at), batch.column(1).take(at)], names)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by piece, its points first: holds one piece's points and a batch of rows."""
        held, labels, key = [], [], None
        for batch in batches:
            cell, piece, kind, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            vectors = _matrix(batch.column(4), size)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            turn = np.flatnonzero(np.diff(cell) | np.diff(piece) | np.diff(kind)) + 1
            for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), len(cell)], strict=True):
                if hi == lo:
                    continue
                if (cell[lo], piece[lo]) != key:
                    key, held, labels = (cell[lo], piece[lo]), [], []
                if kind[lo] == 0:
                    held.append(vectors[lo:hi])
                    labels.append(node[lo:hi])
                elif held:
                    if len(held) > 1:
                        held, labels = [np.concatenate(held)], [np.concatenate(labels)]
                    for i in range(lo, hi):
                        found, score = nearest(held[0], labels[0], vectors[i], k + 1)
                        out.append((np.full(len(found), node[i]), found, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["query", "node", "score"])

    schema = f"cell long, piece long, kind int, node long, vec {points.schema['vec'].dataType.simpleString()}"
    dealt = points.select("node", "vec").mapInArrow(deal, schema).union(asked.select("node", "vec").dropDuplicates(["node"]).mapInArrow(route, schema))
    dealt = dealt.repartition("cell", "piece").sortWithinPartitions("cell", "piece", "kind")
    found = dealt.mapInArrow(rank, "query long, node long, score double")
    # Ranked within tasks first: of a query at most k+1 rows of each task are moved.
    best = found.withColumn("r", F.expr("dense_rank() over (partition by query order by score, node)")).filter(F.col("r") <= k + 1)
    best = cut_lineage(best.select("query", "node", "score").distinct())
    ids = best.join(points.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("id"))
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(ids, "query").filter("id <> query_id")
    top = pairs.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, id)")).filter(F.col("rank") <= k)
    return top.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3_neighbours(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the ten nearest found of every hundredth id."""
    return search(vectors, lambda i: i % 100 == 0)
