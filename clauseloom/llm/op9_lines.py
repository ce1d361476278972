"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of the last lines chooses where a chunk ends, so that lines put in or
taken out early in a document don't shift the chunks after them. Chunks of several lines that occur
more than once in the corpus are removed, except the first occurrence. Equality is decided on the
chunks' bytes: occurrences are grouped by hash and text, and a hash counts only if all chunks that
have it are the same text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.llm.common import as_bytes, column, fresh, ship, steps
from clauseloom.session import cut_lineage

#: Lines under the rolling hash, the mean number of lines between ends, and bounds of a chunk's lines.
WINDOW = 2
MEAN = 4
LEAST = 2
MOST = 64
SEED = 11


def chunks(text: bytes, window: int = WINDOW, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> tuple[list[bytes], list[tuple[int, int]]]:
    """(lines, ranges of lines): a chunk ends after a line at which the rolling hash of the last
    ``window`` lines is divisible by ``mean``, but has ``least`` lines at least (its rest may be
    shorter, at the end) and ``most`` at most."""
    lines = text.split(b"\n")
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, SEED) for x in lines), np.uint64, len(lines))
    rolled = np.zeros(len(lines), np.uint64)
    for back in range(min(window, len(lines))):
        rolled[back:] += hashes[: len(lines) - back] * np.uint64(0x9E3779B97F4A7C15 ** (back + 1) & (1 << 64) - 1)
    ends = np.flatnonzero((rolled >> np.uint64(33)) % np.uint64(mean) == 0).tolist()
    found, start = [], 0
    for end in [*ends, len(lines) - 1]:
        while end - start + 1 > most:
            found.append((start, start + most))
            start += most
        if end - start + 1 >= least or (end == len(lines) - 1 and end >= start):
            found.append((start, end + 1))
            start = end + 1
    return lines, found


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _hashes(chunk: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(chunk, SEED)
    return _signed(value >> 64), _signed(value & (1 << 64) - 1)


def _several(text: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(start, end, hash, hash, bytes) of the chunks of several lines."""
    lines, ranges = chunks(text)
    for start, end in ranges:
        if end - start > 1:
            chunk = b"\n".join(lines[start:end])
            yield start, end, *_hashes(chunk), chunk


def line_chunks(docs: DataFrame) -> DataFrame:
    """(id, tid, h1, h2, chunk): every chunk of several lines of (id, tid, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 2):
            rows, h1, h2, texts = [], [], [], []
            for row, text in enumerate(as_bytes(batch.column(2))):
                for _, _, a, b, chunk in _several(text):
                    rows.append(row)
                    h1.append(a)
                    h2.append(b)
                    texts.append(chunk)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(texts, pa.binary())], ["id", "tid", "h1", "h2", "chunk"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tid long, h1 long, h2 long, chunk binary")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with repeated chunks taken out of the text, and the names of added columns: lines,
    removed (lines) and spans (maximal runs of removed lines).

    The first occurrence is that in the document of the smallest id (ids before null), and there the
    earliest. Chunks of one line are never removed. Rows that repeat an id and text share one
    decision. A null text stays null and has no lines; a text all of whose lines go becomes empty. No
    rows give no rows; other columns pass through.
    """
    ship(docs.sparkSession)
    named = docs.select(column(docs, doc_id).alias("id"), F.xxhash64(column(docs, text)).alias("tid"), column(docs, text).alias("text"))
    every = line_chunks(named)
    # One row for each text of a chunk; copies meet before the shuffle.
    same = every.groupBy("h1", "h2", "chunk").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    same = cut_lineage(same.filter("n > 1").select("h1", "h2", "n", "first"))
    light = cut_lineage(every.select("id", "tid", "h1", "h2"))
    # A hash shared by different texts doesn't count for any of them.
    whole = light.groupBy("h1", "h2").agg(F.count("*").alias("all")).filter("all > 1")
    sure = cut_lineage(same.join(whole, ["h1", "h2"]).filter("n = all").select("h1", "h2", "first"))
    hits = light.join(sure, ["h1", "h2"])
    mine = F.struct("h1", "h2", F.expr("first <=> id").alias("keep"))
    per_doc = hits.groupBy("id", "tid").agg(F.collect_set(mine).alias("gone"))

    new = {k: fresh(docs, k) for k in ("lines", "removed", "spans", "id", "tid", "gone", "key")}
    gone = per_doc.select(F.col("id").alias(new["id"]), F.col("tid").alias(new["key"]), F.col("gone").alias(new["gone"]))
    joined = docs.withColumn(new["tid"], F.xxhash64(column(docs, text))).join(gone, column(docs, doc_id).eqNullSafe(F.col(new["id"])) & (F.col(new["tid"]) == F.col(new["key"])), "left")
    joined = joined.select(*[column(docs, c) for c in docs.columns], new["gone"])
    at, width = docs.columns.index(text), len(docs.columns)
    added = [new[k] for k in ("lines", "removed", "spans")]
    names = [*docs.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            out, counts = list(texts), []
            for row, marked in enumerate(batch.column(width).to_pylist()):
                x = texts[row]
                n = 0 if x is None else x.count(b"\n") + 1
                if x is None or not marked:
                    counts.append((n, 0, 0))
                    continue
                keep = {(m["h1"], m["h2"]): m["keep"] for m in marked}
                left = np.ones(n, bool)
                for start, end, a, b, _ in _several(x):
                    if (a, b) in keep:
                        if not keep[a, b]:
                            left[start:end] = False
                        keep[a, b] = False
                runs = int((~left & np.concatenate([[True], left[:-1]])).sum())
                counts.append((n, n - int(left.sum()), runs))
                lines = x.split(b"\n")
                out[row] = b"\n".join(line for line, stays in zip(lines, left.tolist(), strict=True) if stays)
            arrays = [pa.array(out, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(a, T.LongType()) for a in added)])
    return joined.mapInArrow(run, schema), dict(zip(("lines", "removed", "spans"), added, strict=True))


def op9_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans, kept_sha256 (of the text that is left; of a null text too)."""
    found, n = dedup_lines(docs.select("doc_id", "text"))
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return found.select("doc_id", F.col(n["lines"]).alias("n_lines"), F.col(n["removed"]).alias("n_removed"), F.col(n["spans"]).alias("n_spans"), kept.alias("kept_sha256"))
