"""Importance resampling towards a target text, with a distributed quickselect for the draw.

Words and runs of words are hashed into buckets. What a bucket occurs in the target text against the
corpus is its gain, and a document's weight is the mean gain of its features: an array lookup. Gumbel
noise from the document's id turns the weights into scores, of which the k largest are a sample drawn
without replacement in proportion to exp(weight / 1000).

The k-th largest score is found without sorting: in rounds a few random keys of what is left are taken
as pivots, an exact count below, at and above each of them tells between which two the k-th key lies,
and the rest is left. Only the documents drawn are then ordered and numbered.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm.common import as_bytes, column, ship, steps
from clauseloom.operators.ordered import row_index
from clauseloom.session import cut_lineage

RUN = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Random keys of a round, each of which a row is compared with.
PIVOTS = 16
#: Bytes of a text whose words are in memory at once.
STRETCH = 1 << 20
#: Stands for a null id in the order: last.
LAST = (1 << 63) - 1

#: Bytes that belong to words stay, A-Z are lowered, all others end a word.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, stretch by stretch."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        part = text[at:end].translate(_TABLE)
        while end < len(text) and (cut := part.rfind(b" ")) < 0:  # one word so far
            part += text[end : end + STRETCH].translate(_TABLE)
            end += STRETCH
        if end < len(text):
            part = part[:cut]
            at += cut + 1
        else:
            at = end
        yield part.split()


def buckets(text: bytes, run: int = RUN, size: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features that end in them), stretch by stretch."""
    before: list[bytes] = []
    for words in word_lists(text):
        every = before + words
        found = [np.fromiter(map(zlib.crc32, words), np.int64, len(words))]
        for k in range(2, run + 1):
            runs = [b" ".join(every[i : i + k]) for i in range(max(0, len(before) - k + 1), len(every) - k + 1)]
            found.append(np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)))
        before = every[len(every) - run + 1 :] if run > 1 else []
        yield len(words), np.concatenate(found) % size


def bucket_counts(docs: DataFrame, text: str = "text", run: int = RUN, size: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket that occurs."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in steps(batches, 0):
            for x in as_bytes(batch.column(0)):
                for _, found in buckets(x, run, size):
                    total += np.bincount(found, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    each = docs.select(column(docs, text).alias("text")).mapInArrow(count, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", run: int = RUN, size: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths of a nat: ``size`` numbers, whatever the input."""

    def counts(df: DataFrame, name: str) -> np.ndarray:
        out = np.zeros(size, np.int64)
        for r in bucket_counts(df, name, run, size).collect():  # at most ``size`` rows
            out[r.bucket] = r.n
        return out

    s, t = counts(corpus, text), counts(target, target_text)
    up, down = (t + 1.0) * (float(s.sum()) + size), (s + 1.0) * (float(t.sum()) + size)
    return np.array([math.floor(1000 * math.log(x)) for x in (up / down).tolist()], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row per row."""
    ship(docs.sparkSession)
    size = len(gains)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = features = total = 0
                for n, found in buckets(x, run, size):
                    words, features, total = words + n, features + len(found), total + int(gains[found].sum())
                weight = total // features if features else 0
                rows.append((i, words, features, weight, weight + noise(i, seed)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "n_words", "n_features", "weight", "score"])

    named = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).alias("text"))
    return named.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long, score long")


def kth_key(rows: DataFrame, key: list[str], k: int, seed: int = SEED, pivots: int = PIVOTS) -> tuple:
    """The k-th smallest of the rows' keys (columns of longs, none null), k from 1 to their number. A
    round sends ``pivots`` keys and twice as many counts to the driver, and leaves about a
    ``pivots``-th of the rows."""
    below, low, high = 0, None, None  # keys at most ``low`` and from ``high`` on are out
    turn = 0
    while True:
        live = rows
        if low is not None:
            live = live.filter((F.col(key[0]) >= low[0]) & _above(key, low))
        if high is not None:
            live = live.filter((F.col(key[0]) <= high[0]) & _below(key, high))
        turn += 1
        draw = F.xxhash64(F.lit(seed + turn), *key)
        taken = sorted({tuple(r)[:-1] for r in live.select(*key, draw.alias("draw")).orderBy("draw").limit(pivots).collect()})
        if not taken:
            raise ValueError("there are fewer than k rows")
        # Twice the number of pivots below a key, and one more if it is a pivot itself.
        place = reduce(Column.__add__, [_above(key, p).cast("int") + (~_below(key, p)).cast("int") for p in taken])
        count = dict(map(tuple, live.groupBy(place.alias("place")).count().collect()))
        for at in range(2 * len(taken) + 1):
            if below + count.get(at, 0) >= k:
                break
            below += count.get(at, 0)
        if at % 2:
            return taken[at // 2]
        low, high = (taken[at // 2 - 1] if at else low), (taken[at // 2] if at < 2 * len(taken) else high)


def _above(key: list[str], bound: tuple) -> Column:
    """Whether a row's key is larger than ``bound``."""
    out = F.lit(False)
    for name, value in reversed(list(zip(key, bound, strict=True))):
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out


def _below(key: list[str], bound: tuple) -> Column:
    out = F.lit(False)
    for name, value in reversed(list(zip(key, bound, strict=True))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, size: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row per row of ``docs``: ``percent``
    hundredths, rounded down, of the documents with ``least_words`` or more are drawn and ranked from 1
    on, by falling score; equal scores go by the smaller id. Undrawn rows have no rank.

    A null text has no words: weight 0, not drawn. A null id counts as an empty string in the noise and
    comes last among equal scores. Rows that repeat an id have the same noise; among equal scores the
    one with fewer features comes first, and of fully equal rows any. Other columns play no part. An
    empty target gives all buckets their gain against nothing; no rows give none.
    """
    gains = bucket_gains(docs, target, text, target_text, run, size)
    key = ["minus", "at", "n_features"]
    rows = scored(docs, gains, doc_id, text, run, seed).withColumns({"minus": -F.col("score"), "at": F.coalesce("doc_id", F.lit(LAST))})
    rows = cut_lineage(rows)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    enough = F.col("n_words") >= least_words
    k = rows.filter(enough).count() * percent // 100
    if k == 0:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    last = kth_key(rows.filter(enough), key, k, seed)
    drawn = enough & ~_above(key, last)
    # Equal to the last key are only equal rows, so that more than k may be numbered here.
    ranked = row_index(rows.filter(drawn), [], [F.col("minus"), F.expr("at div 65536")], ["minus", "at", "n_features"], "rank")
    ranked = ranked.select(*names, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return ranked.union(rows.filter(~drawn).select(*names, F.lit(None).cast("long").alias("rank")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents, drawn towards the benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_sql() -> str:
    """The same in SQL; the checksum is the bitwise one, over the bytes of each distinct word."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    bit = "CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS words FROM documents),
dw AS (SELECT unnest(words) AS w FROM d),
bw AS (SELECT unnest({words}) AS w FROM benchmark),
checksums AS (
  SELECT w, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INTEGER, 2))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: {bit})), 4294967295) % {BUCKETS}) AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), s AS (SELECT bucket, count(*) AS n FROM dw JOIN checksums USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN checksums USING (w) GROUP BY 1),
gains AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b
), summed AS (
  SELECT doc_id, sum(gain) AS total FROM (SELECT doc_id, unnest(words) AS w FROM d) JOIN checksums USING (w) JOIN gains USING (bucket) GROUP BY 1
), noisy AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(floor(total / nullif(len(words), 0)), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM d LEFT JOIN summed USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank FROM noisy WHERE n_features >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, weight + noise AS score, rank::BIGINT AS rank
FROM noisy LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT count(*) FROM ranked) * {PERCENT} // 100) USING (doc_id)
"""
