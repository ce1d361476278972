"""SimHash near-deduplication with a covering code as anchor points.

A 64-bit fingerprint is read as nine words of the perfect (7,4) Hamming code and one single bit. The
product code is the set of anchors: every point lies within covering radius 9 of one, at most one bit
per word. Two fingerprints that differ in at most two bits have a point between them that differs
from either in at most one bit, and that point's anchor is within the covering radius plus half the
threshold of both. So each fingerprint goes to the anchors of itself and of its 64 one-bit changes
(about 25 different ones), and fingerprints are compared only with those at the same anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import as_bytes, column, fresh, hex64, ship, steps
from clauseloom.llm.components import components
from clauseloom.session import cut_lineage

SEED = 42
SHINGLE = 3
THRESHOLD = 2
#: Fingerprints compared with each other at one anchor; fuller anchors are split into single points.
AT_ANCHOR = 256

WORDS, WIDTH = 9, 7


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles: a bit is 1 if it is set in over half the hashes."""
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size) + np.arange(len(words))
        start = (end - size)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start, end[shingle - 1 :].tolist(), strict=True)), np.uint64, len(start))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (long), one row per row. A null text counts as empty, and a text
    without words has fingerprint zero."""
    ship(docs.sparkSession)
    rows = docs.select(*[column(docs, k) for k in keep], column(docs, text).alias("_t"))
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep] + ["fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keep)
        for batch in steps(batches, at):
            found = np.fromiter((fingerprint(x) for x in as_bytes(batch.column(at))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found.view(np.int64))], [*keep, "fp"])

    return rows.mapInArrow(run, schema)


def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """Of each 7-bit word the number of its nearest code word, and the code words nearest to its
    one-bit changes other than that one (three, or none for a code word; -1 fills up)."""
    checks = [sum(1 << i for i in range(7) if (i + 1) >> b & 1) for b in range(3)]
    syndrome = [sum((bin(w & c).count("1") & 1) << b for b, c in enumerate(checks)) for w in range(128)]
    code = [w for w in range(128) if syndrome[w] == 0]
    near = [code.index(w ^ (1 << syndrome[w] - 1) if syndrome[w] else w) for w in range(128)]
    other = np.full((128, 3), -1, np.int64)
    for w in range(128):
        more = sorted({near[w ^ 1 << i] for i in range(7)} - {near[w]})
        other[w, : len(more)] = more
    return np.array(near, np.int64), other


NEAR, OTHER = _hamming()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor): the anchors of each fingerprint and of its one-bit changes."""
    fp = fp.view(np.uint64)
    words = [((fp >> np.uint64(WIDTH * b)) & np.uint64(127)).astype(np.int64) for b in range(WORDS)]
    home = (fp >> np.uint64(63)).astype(np.int64) << 4 * WORDS
    for b, w in enumerate(words):
        home |= NEAR[w] << 4 * b
    rows = np.arange(len(fp))
    index, found = [rows, rows], [home, home ^ (1 << 4 * WORDS)]
    for b, w in enumerate(words):
        rest = home & ~np.int64(15 << 4 * b)
        for k in range(OTHER.shape[1]):
            more = OTHER[w, k]
            has = more >= 0
            index.append(rows[has])
            found.append(rest[has] | more[has] << 4 * b)
    return np.concatenate(index), np.concatenate(found)


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        index, anchor = anchors(fp)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[index])], ["anchor", "fp"])


def _forest(u: np.ndarray, v: np.ndarray) -> list[int]:
    """Positions of the edges that join two trees, in order."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    used = []
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        if (a := find(a)) != (b := find(b)):
            top[a] = b
            used.append(k)
    return used


def linked(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints of an anchor (rows sorted by it) within ``threshold``."""
    us, vs, at = [], [], []
    live = np.arange(len(fp))
    shift = 0
    while len(live):
        shift += 1
        live = live[live + shift < len(fp)]
        live = live[anchor[live] == anchor[live + shift]]
        near = live[np.bitwise_count(fp.view(np.uint64)[live] ^ fp.view(np.uint64)[live + shift]) <= threshold]
        us.append(near)
        vs.append(near + shift)
    at = np.concatenate(us) if us else np.zeros(0, np.int64)
    to = np.concatenate(vs) if vs else np.zeros(0, np.int64)
    used = _forest(at, to)
    return fp[at[used]], fp[to[used]]


def _compare(threshold: int):
    """Streams rows sorted by anchor. Gives edges (u, v), and for anchors with too many rows the
    rows themselves, with a null v. Holds one record batch and one anchor's first rows at a time."""

    def rows(u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
        other = pa.nulls(len(u), pa.int64()) if v is None else pa.array(v)
        return pa.RecordBatch.from_arrays([pa.array(u), other], ["u", "v"])

    def split(anchor: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, back, count = np.unique(anchor, return_inverse=True, return_counts=True)
        full = (count > AT_ANCHOR)[back]
        if full.any():
            yield rows(fp[full], None)
        some = ~full & (count > 1)[back]
        yield rows(*linked(anchor[some], fp[some], threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, fp, full = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            anchor = np.concatenate([anchor, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if full is not None:  # the rest of an anchor that was found too full
                n = int(np.searchsorted(anchor, full, "right"))
                yield rows(fp[:n], None)
                anchor, fp = anchor[n:], fp[n:]
                full = full if not len(anchor) else None
            if not len(anchor):
                continue
            cut = int(np.searchsorted(anchor, anchor[-1], "left"))
            yield from split(anchor[:cut], fp[:cut])
            anchor, fp = anchor[cut:], fp[cut:]
            if len(anchor) > AT_ANCHOR:
                yield rows(fp, None)
                full, anchor, fp = anchor[0], anchor[:0], fp[:0]
        yield from split(anchor, fp)

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints ``fp`` wherever a chain of links within
    ``threshold`` bits does; a spanning forest per anchor, not all pairs.

    Anchors with over ``AT_ANCHOR`` fingerprints are split: each of theirs goes to itself and its 64
    one-bit changes. At such a point all are within two bits of each other, so there is nothing left
    to compare, and there are at most 65.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors serve thresholds of 0 to 2 bits")
    ship(distinct.sparkSession)
    at = distinct.select("fp").mapInArrow(_emit_anchors, "anchor long, fp long")
    at = at.repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = cut_lineage(at.mapInArrow(_compare(threshold), "u long, v long"))
    edges = found.filter("v is not null")
    full = found.filter("v is null").select(F.col("u").alias("fp")).distinct()
    if threshold == 2:
        # Fingerprints at a point are all linked, so each is linked to the least of them.
        point = F.expr("explode(transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i))))")
        at = full.select("fp", point.alias("point"))
        least = at.groupBy("point").agg(F.min("fp").alias("v"))
        more = at.join(least, "point").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    elif threshold == 1:
        changed = full.select("fp", F.expr("explode(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))").alias("v"))
        more = changed.join(full.select(F.col("fp").alias("v")), "v").select(F.col("fp").alias("u"), "v")
    else:
        more = full.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    return edges.union(more).distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``.

    component_id is the smallest id that can be reached over links between fingerprints, the row's
    own included. Equal fingerprints are one node, so copies are never paired. Null or empty texts
    have fingerprint zero and are linked like any other; rows that repeat an id each give a row; a
    null id is never a component's id unless no row of the component has one. Other columns play no
    part. No rows give no rows.
    """
    named = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    each = cut_lineage(fingerprints(named))
    nodes = cut_lineage(each.groupBy("fp").agg(F.min("doc_id").alias("root")))
    label = components(links(nodes, threshold))
    label = cut_lineage(label)
    least = label.join(nodes, nodes.fp == label.node).groupBy("label").agg(F.min("root").alias("top"))
    of = label.join(least, "label").select(F.col("node").alias("fp"), "top")
    # Written, so that the join below can split a fingerprint that many rows share.
    of = cut_lineage(nodes.join(of, "fp", "left").select("fp", F.coalesce("top", "root").alias("component_id")))
    return each.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, groups: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component the row of the
    smallest id stays, once if it is repeated. Rows without an id stay, as no decision can name them.
    ``groups`` (doc_id and the component's smallest id) takes the place of ``near_groups``.
    """
    if groups is None:
        groups = near_groups(docs.filter(column(docs, doc_id).isNotNull()), doc_id, text, threshold)
    groups = groups.toDF("doc_id", *groups.columns[1:-1], "component_id")
    key, order = fresh(docs, "key"), fresh(docs, "order")
    stay = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(stay, column(docs, doc_id) == F.col(key), "left_semi")
    # Rows of one id meet on the join's own partitioning.
    each = kept.withColumn(order, F.expr(f"row_number() over (partition by `{doc_id}` order by xxhash64(`{text}`))"))
    one = each.filter(F.col(order) == 1).select(*[column(docs, c) for c in docs.columns])
    return one.union(docs.filter(column(docs, doc_id).isNull()))


def op10_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_groups(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
