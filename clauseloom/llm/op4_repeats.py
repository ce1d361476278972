"""Removal of byte strings that occur elsewhere in the corpus, with a run-length suffix index.

A window is a string of ``LENGTH`` bytes. Every window is owned by the least of its k-byte hashes (its
anchor); windows next to each other mostly share one, and what they span together is a context. Equal
windows have equal anchors, at the same place, so only contexts of one anchor can hold equal windows.
Spark counts anchors and contexts by hash. Anchors that occur once are done with; a context that occurs
more than once is repeated whole. What is left are different contexts of one anchor, the edges of
repeated passages. Their texts are brought together and indexed:

* the suffixes are sorted and the Burrows-Wheeler transform is cut into runs; the ends of runs are
  sampled with the length of the match to the suffix before (or after) in order;
* matching statistics are streamed along the text: between samples the longest match elsewhere is one
  byte shorter at every step, so that the samples alone give it at every position;
* a position whose longest match has ``LENGTH`` bytes begins a repeated window.

Anchors with more than ``HOT`` different contexts are not brought together: each of their windows is
a context of its own, for which the count by hash decides, so no group of texts is unbounded.
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

LENGTH = 400
#: Bytes of an anchor.
ANCHOR = 48
#: Different contexts of an anchor that are indexed together, and bytes of one index.
HOT = 4096
INDEX_BYTES = 1 << 20
#: Window starts of a text that are worked through at once.
STRETCH = 4 << 20
SEED = 3
SEPARATOR = 0xFF

_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _hash_of(data: memoryview | bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(data, SEED)
    return _signed(value >> 64), _signed(value & (1 << 64) - 1)


def _owners(text: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Of each window the place of its anchor: the leftmost of the least hashes in it."""
    base = np.uint64(0x9E3779B97F4A7C15)
    values, have = _MIX[text], 1
    power = base
    result, done = None, 0
    left = anchor
    while left:  # hashes of ever longer strings, put together by the binary form of the length
        if left & 1:
            if result is None:
                result = values
            else:
                n = len(text) - done - have + 1
                result = result[:n] * power + values[done : done + n]
            done += have
        left >>= 1
        if left:
            values = values[: len(values) - have] * power + values[have:]
            have *= 2
            power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
    mixed = (result ^ result >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    packed = mixed >> np.uint64(24) << np.uint64(24) | np.arange(len(mixed), dtype=np.uint64)
    width, size = length - anchor + 1, 1
    while size * 2 <= width:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    if size < width:
        packed = np.minimum(packed[: len(packed) - (width - size)], packed[width - size :])
    return (packed & np.uint64((1 << 24) - 1)).astype(np.int64)


def contexts(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[int, int, int]]:
    """(first window, number of windows, place of the anchor), from left to right."""
    for base in range(0, len(text) - length + 1, STRETCH):
        part = np.frombuffer(text[base : base + STRETCH + length - 1], np.uint8)
        place = _owners(part, length, anchor)
        turn = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
        for a, b, p in zip((turn[:-1] + base).tolist(), (turn[1:] + base).tolist(), (place[turn[:-1]] + base).tolist(), strict=True):
            yield a, b - a, p


def context_rows(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(id, tid, at, n, anchor, c1, c2) of (id, tid, text) rows: window starts at to at+n-1, the
    anchor's hash, and the context's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 2):
            rows, at, many, anchors, first, second = [], [], [], [], [], []
            for row, text in enumerate(as_bytes(batch.column(2))):
                view = memoryview(text)
                for a, n, p in contexts(text, length, anchor):
                    rows.append(row)
                    at.append(a)
                    many.append(n)
                    anchors.append(_signed(xxhash.xxh64_intdigest(view[p : p + anchor], SEED)))
                    c1, c2 = _hash_of(view[a : a + n - 1 + length])
                    first.append(c1)
                    second.append(c2)
            take = pa.array(rows, pa.int64())
            arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int64()), pa.array(many, pa.int32()), *(pa.array(x, pa.int64()) for x in (anchors, first, second))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "tid", "at", "n", "anchor", "c1", "c2"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tid long, at long, n int, anchor long, c1 long, c2 long")


class RunIndex:
    """Suffix order, run-length Burrows-Wheeler transform and sampled run ends of some texts."""

    def __init__(self, texts: list[bytes]) -> None:
        size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(size + 1) - size - 1
        self.size = size
        sign = bytes([SEPARATOR])
        self.text = np.frombuffer(sign.join(texts) + sign, np.uint8)
        padded = np.concatenate([self.text, np.full(8, SEPARATOR, np.uint8)]).astype(np.uint64)
        key = np.zeros(len(self.text), np.uint64)
        for i in range(8):
            key = key << np.uint64(8) | padded[i : i + len(self.text)]
        self.key = key
        self.order = self._sorted()
        before = self.text[self.order - 1].astype(np.int16)
        before[self.order == 0] = -1  # nothing comes before: a run of its own
        turn = before[1:] != before[:-1]
        #: Rows at which a run of the transform begins, and ends.
        self.first = np.concatenate([[0], np.flatnonzero(turn) + 1])
        self.last = np.concatenate([np.flatnonzero(turn), [len(before) - 1]])

    def _sorted(self) -> np.ndarray:
        """Suffixes in order, by doubling the compared length; only ties are sorted again."""
        n = len(self.text)
        order = np.argsort(self.key)
        ranked = self.key[order]
        head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        at = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = at
        width = 8
        while True:
            alone = head & np.concatenate([head[1:], [True]])
            tied = order[~alone]
            if width >= n and len(tied):  # nothing but separators follows; any steady order will do
                order[~alone] = tied[np.lexsort((tied, rank[tied]))]
                return order
            if not len(tied):
                return order
            after = np.full(len(tied), n, np.int64)  # as if the last separator went on for ever
            inside = tied + width < n
            after[inside] = rank[tied[inside] + width]
            sort = np.argsort(rank[tied] * np.int64(n + 1) + after)
            tied, after = tied[sort], after[sort]
            group = rank[tied]
            opens = np.concatenate([[True], group[1:] != group[:-1]])
            where = group + np.arange(len(tied)) - np.maximum.accumulate(np.where(opens, np.arange(len(tied)), 0))
            order[where] = tied
            splits = opens | np.concatenate([[True], after[1:] != after[:-1]])
            head[where] = splits
            rank[tied] = where[np.maximum.accumulate(np.where(splits, np.arange(len(tied)), 0))]
            width *= 2

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of pairs of suffixes, up to the text's end."""
        n = len(self.text)
        long = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] + long[live], b[live] + long[live]
            inside = (x < n) & (y < n)
            live, x, y = live[inside], x[inside], y[inside]
            gap = self.key[x] ^ self.key[y]
            same = gap == 0
            bits = np.frexp((gap[~same] >> np.uint64(11)).astype(np.float64))[1] + 11
            low = gap[~same] >> np.uint64(11) == 0
            bits[low] = np.frexp(gap[~same][low].astype(np.float64))[1]
            long[live[~same]] += (64 - bits) // 8
            live = live[same]
            long[live] += 8
        return long

    def statistics(self) -> np.ndarray:
        """At every position the longest match that begins elsewhere, cut at the end of its text."""
        n = len(self.text)
        best = np.zeros(n, np.int64)
        for rows, other in ((self.first, self.first - 1), (self.last, self.last + 1)):
            has = (other >= 0) & (other < n)
            value = np.zeros(len(rows), np.int64)
            value[has] = self._match(self.order[rows[has]], self.order[other[has]])
            sampled = np.full(n, -1, np.int64)
            sampled[self.order[rows]] = value
            at = np.maximum.accumulate(np.where(sampled >= 0, np.arange(n), 0))
            best = np.maximum(best, sampled[at] - (np.arange(n) - at))
        # A match doesn't go past the end of its own text.
        room = np.repeat(self.start + self.size, self.size + 1) - np.arange(n)
        return np.minimum(best, room)

    def repeated(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first, number) of the runs of positions at which a repeated window begins."""
        on = self.statistics() >= length
        edge = np.diff(np.concatenate([[False], on, [False]]).astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(self.start, lo, "right") - 1
        return owner, lo - self.start[owner], hi - lo


def _index(length: int):
    """Streams (id, tid, at, anchor, text) rows sorted by anchor; gives (id, tid, from, to) spans. An
    index takes whole anchors up to ``INDEX_BYTES``; one anchor has ``HOT`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def matched(rows: list[tuple]) -> pa.RecordBatch:
            owner, first, many = RunIndex([r[4] for r in rows]).repeated(length)
            out = [(rows[o][0], rows[o][1], rows[o][2] + f, rows[o][2] + f + n - 1 + length) for o, f, n in zip(owner.tolist(), first.tolist(), many.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], ["id", "tid", "from", "to"])

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if not held or held[-1][3] != row[3]:
                    if size >= INDEX_BYTES:
                        yield matched(held)
                        held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield matched(held)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(id, tid, spans): of (id, tid, text) rows those with a repeated window, and the byte ranges
    (from, to) their windows cover, in no order and overlapping."""
    ship(docs.sparkSession)
    every = context_rows(docs, length, anchor)
    # Written, here and below, so that a join can split an anchor that many documents share.
    often = cut_lineage(every.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"))
    some = cut_lineage(every.join(often, "anchor"))
    row = F.xxhash64("id", "tid", "at")
    same = cut_lineage(some.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("copies"), F.min(row).alias("one")))
    kinds = same.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("copies") == 1, 1).otherwise(0)).alias("single"))
    mixed = cut_lineage(kinds.filter("kinds > 1 and single > 0").select("anchor", "kinds"))
    copied = some.join(same.filter("copies > 1").select("anchor", "c1", "c2"), ["anchor", "c1", "c2"])
    whole = copied.select("id", "tid", F.col("at").alias("from"), (F.col("at") + F.col("n") - 1 + length).alias("to"))
    open_ = cut_lineage(same.join(mixed, "anchor").select("anchor", "c1", "c2", "one", "kinds", "copies"))
    unlike = some.join(open_, ["anchor", "c1", "c2"]).filter((row == F.col("one")) | ((F.col("kinds") > hot) & (F.col("copies") > 1)))
    wanted = unlike.groupBy(F.col("id").alias("i"), F.col("tid").alias("t")).agg(F.collect_list(F.struct("at", "n", "anchor", (F.col("kinds") > hot).alias("hot"))).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 2):
            rows, at, anchors, first, second, texts = [], [], [], [], [], []
            for k, (text, asked) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                view = memoryview(text)
                for x in asked:
                    if x["hot"]:
                        for a in range(x["at"], x["at"] + x["n"]):
                            c1, c2 = _hash_of(view[a : a + length])
                            rows.append(k)
                            at.append(a)
                            anchors.append(x["anchor"])
                            first.append(c1)
                            second.append(c2)
                            texts.append(None)
                    else:
                        rows.append(k)
                        at.append(x["at"])
                        anchors.append(x["anchor"])
                        first.append(None)
                        second.append(None)
                        texts.append(text[x["at"] : x["at"] + x["n"] - 1 + length])
            take = pa.array(rows, pa.int64())
            arrays = [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, pa.int64()) for x in (at, anchors, first, second)), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "tid", "at", "anchor", "c1", "c2", "text"])

    met = docs.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("tid") == F.col("t"))).select("id", "tid", "text", "wanted")
    fetched = cut_lineage(met.mapInArrow(fetch, f"id {docs.schema['id'].dataType.simpleString()}, tid long, at long, anchor long, c1 long, c2 long, text binary"))
    texts = fetched.filter("text is not null").select("id", "tid", "at", "anchor", "text")
    matched = texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_index(length), "id long, tid long, `from` long, `to` long")
    alone = fetched.filter("text is null").select("id", "tid", "at", "anchor", "c1", "c2")
    twice = cut_lineage(alone.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("k")).filter("k > 1").select("anchor", "c1", "c2"))
    single = alone.join(twice, ["anchor", "c1", "c2"]).select("id", "tid", F.col("at").alias("from"), (F.col("at") + length).alias("to"))
    return whole.union(matched).union(single).groupBy("id", "tid").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered ranges, in order."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with two more columns, and their names: kept (binary, the bytes left) and spans (the
    maximal removed byte ranges, in order).

    A byte goes if it lies in a string of ``length`` bytes that also begins anywhere else, in the same
    text or another row's; all occurrences go. Strings don't cross texts and are judged on the input.
    A null text is empty. Rows that repeat, with or without an id, are occurrences like any other. No
    rows give no rows; other columns pass through.
    """
    ship(docs.sparkSession)
    named = docs.select(column(docs, doc_id).cast("long").alias("id"), F.xxhash64(column(docs, text)).alias("tid"), column(docs, text).alias("text"))
    spans = repeated_spans(named, length, anchor, hot)
    new = {k: fresh(docs, k) for k in ("tid", "i", "t", "found", "kept", "spans")}
    spans = spans.select(F.col("id").alias(new["i"]), F.col("tid").alias(new["t"]), F.col("spans").alias(new["found"]))
    joined = docs.withColumn(new["tid"], F.xxhash64(column(docs, text))).join(spans, column(docs, doc_id).cast("long").eqNullSafe(F.col(new["i"])) & (F.col(new["tid"]) == F.col(new["t"])), "left")
    width, at = len(docs.columns), docs.columns.index(text)
    joined = joined.select(*[column(docs, c) for c in docs.columns], new["found"])
    names = [*docs.columns, new["kept"], new["spans"]]
    pair = pa.struct([("from", pa.int64()), ("to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at):
            kept, removed = [], []
            for data, found in zip(as_bytes(batch.column(at)), batch.column(width).to_pylist(), strict=True):
                ranges = merged([(s["from"], s["to"]) for s in found or ()])
                edges = [0, *(x for r in ranges for x in r), len(data)]
                kept.append(b"".join(data[lo:hi] for lo, hi in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"from": lo, "to": hi} for lo, hi in ranges])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pair))], names)

    kind = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(new["kept"], T.BinaryType()), T.StructField(new["spans"], kind)])
    return joined.mapInArrow(run, schema), {"kept": new["kept"], "spans": new["spans"]}


def op4_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (from-to byte ranges, comma-joined), and
    text: what is left, where bytes that are no UTF-8, at cuts within a character, are U+FFFD."""
    found, n = remove_repeats(docs.select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    ranges = F.array_join(F.transform(n["spans"], lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string"))), ",")
    left = F.make_valid_utf8(F.col(n["kept"]).cast("string"))
    return found.select("doc_id", size.alias("n_bytes"), (size - F.length(n["kept"])).alias("n_removed"), F.size(n["spans"]).cast("long").alias("n_spans"), F.sha2(n["kept"], 256).alias("kept_sha256"), ranges.alias("removed"), left.alias("text"))
