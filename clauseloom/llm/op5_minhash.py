"""Document fingerprints by MinHash, and near-duplicate classes from them.

A text's shingles of five words are hashed to 32 bits, and K universal hash permutations
h(x) = a x + b mod 2^32, with odd a, are applied to all of them at once; the least value under each
permutation is one component of the signature. The share of equal components of two signatures
estimates the Jaccard similarity of the shingle sets.

For near duplicates signatures are cut into bands. Documents are joined in Spark with the first
document of each of their bands, then with those of their bands that this didn't tie to them, and the
Jaccard similarity is verified on the shingles themselves. Classes are the components of these links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import as_bytes, column, key_filter, may_hold, ship, steps
from clauseloom.llm.components import components
from clauseloom.session import cut_lineage

SHINGLE = 5
FUNCTIONS = 128
SEED = 7
#: Bands of a signature: at a similarity of 0.8, with 32 bands of 4, all but 5e-8 of pairs share one.
BANDS = 32
THRESHOLD = 0.8
#: Rows and shingles on either side of a cell in which followers of a band are compared, and shingles
#: that are counted at once.
CELL = 1024
CELL_SHINGLES = 1 << 19
COUNTED = 2048
#: Bytes of text of a range of ids, and bounds of the number of ranges: their heads go to the driver.
RANGE_BYTES = 16 << 20
RANGES = (512, 65536)
#: Bytes that are packed, or unpacked, in a step.
STEP_BYTES = 1 << 20
#: Texts that a task remembers to have cut into shingles.
REMEMBERED = 100_000

_rng = np.random.default_rng(SEED)
A = _rng.integers(0, 1 << 31, FUNCTIONS, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
B = _rng.integers(0, 1 << 32, FUNCTIONS, np.int64).astype(np.uint32)
del _rng
#: The component of a text without words.
EMPTY = np.uint32(0xFFFFFFFF)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct 32-bit hashes of the word shingles, in order; a shorter text is one shingle, and one
    without words has none. Words are what ASCII white space separates."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint32)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter(map(digest, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    mixed = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(words))):
        mixed = (mixed ^ each[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(29)
    found = (mixed >> np.uint64(32)).astype(np.uint32)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of every permutation over a text's shingles, as unsigned 32-bit integers."""
    best = np.full(FUNCTIONS, EMPTY, np.uint32)
    for lo in range(0, len(found), 1024):  # so that the products stay in the cache
        values = A[:, None] * found[lo : lo + 1024]
        values += B[:, None]
        np.minimum(best, values.min(axis=1), out=best)
    return best


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of the text's characters replaced by as many first ones of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _place(x: Column, bounds: list[float]) -> Column:
    """How many of the falling ``bounds`` are above x, in two steps of about a square root each."""
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    above = lambda some: F.size(F.filter(some, lambda b: b > x))
    number = lambda values: F.array(*map(F.lit, values))
    # Of a row the last bound is the least: rows whose last is above x count whole.
    whole = above(number([r[-1] for r in rows]))
    rest = F.coalesce(above(F.get(F.array(*map(number, rows)), whole)), F.lit(0))
    return F.least(whole * width, F.lit(len(bounds))) + F.when(whole < len(rows), rest).otherwise(0)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", narrow: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, packed, last, range, tid, kind, more's columns) rows dealt out by ranges of ids and
    sorted, descending, so that the next row is the next document. ``packed`` is the text as a zstandard
    frame, as texts are shuffled whole. ``last`` marks a range's extra row:
    the first document of the range after it (after the last: of the first one), so that no range
    needs another. ``tid`` is the text's hash.

    Range bounds are quantiles of the ids; they only decide how rows are dealt out. Rows that repeat
    an id follow each other by hash and text. ``narrow`` may give the rows' (doc_id, tid). ``more``,
    with doc_id, tid and other columns, adds rows (kind 0, nothing packed) ahead of theirs (kind 1).
    """
    text_of = F.coalesce(column(docs, text), F.lit(""))
    named = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of).alias("tid"), text_of.alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in steps(batches, at := 4, STEP_BYTES):
            packed = pa.array([packer.compress(x) for x in as_bytes(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], packed], [*batch.schema.names[:at], "packed"])

    narrow = narrow if narrow is not None else named.select("doc_id", "tid")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(max(size // RANGE_BYTES, RANGES[0]), RANGES[1])
    quantiles = narrow.select(F.col("doc_id").cast("double").alias("x")).dropna().approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.5 / ranges)
    bounds = sorted(set(quantiles), reverse=True)

    def placed(df: DataFrame) -> DataFrame:
        # Range 0 has the largest ids; a null id comes last of all.
        return df.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(_place(F.col("doc_id").cast("double"), bounds) if bounds else F.lit(0)))

    # A row for each range comes here: its first document, and the range before it.
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("tid").alias("h"))
    first = sorted(placed(narrow).groupBy("range").agg(F.max(order).alias("top")).collect())
    heads = [(r["range"], first[k - 1]["range"], r.top.id, r.top.h) for k, r in enumerate(first)]
    heads = F.broadcast(docs.sparkSession.createDataFrame(heads, "own int, to int, head long, h long"))
    found = placed(named).join(heads, F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("head")).filter((F.col("range") == F.col("own")) & (F.col("tid") == F.col("h")))
    extra = found.groupBy("to").agg(*[F.first(c).alias(c) for c in ("doc_id", "tid", "text")])
    dealt = placed(named).withColumn("last", F.lit(False)).unionByName(extra.withColumnRenamed("to", "range").withColumn("last", F.lit(True)))
    dealt = dealt.select("doc_id", "tid", "range", "last", "text").mapInArrow(pack, "doc_id long, tid long, range int, last boolean, packed binary")
    dealt = dealt.withColumn("kind", F.lit(1))
    if more is not None:
        dealt = dealt.unionByName(placed(more).withColumns({"last": F.lit(False), "kind": F.lit(0)}), allowMissingColumns=True)
    return dealt.repartition("range").sortWithinPartitions("range", "last", F.desc_nulls_last("doc_id"), F.desc("tid"), "kind")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, signature, edited_signature (binary, big-endian), near_edited,
    near_next, class_id, n_class), one row per row. ``rows`` may give the documents' (doc_id, tid), and
    ``classes`` (doc_id, tid, class_id, n_class), one for each pair; without, the last two are null.

    The next document is that of the next smaller id, after the smallest the first; alone, a document
    follows itself. A null text is empty; two texts without words are alike (1). Rows that repeat an
    id follow each other; a null id comes last. No rows give no rows.
    """
    ship(docs.sparkSession)

    def work(pairs: list[tuple]) -> pa.RecordBatch:
        out = []
        known: dict[str, np.ndarray] = {}

        def of(x: str) -> np.ndarray:
            if x not in known:
                known[x] = signature(shingles(x.encode()))
            return known[x]

        for i, x, class_id, n_class, following in pairs:
            changed = edited(x, following).encode()
            own, other, after = of(x), signature(shingles(changed)), of(following)
            out.append((i, len(x), hashlib.sha256(changed).hexdigest(), own.astype(">u4").tobytes(), other.astype(">u4").tobytes(), likeness(own, other), likeness(own, after), class_id, n_class))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        names = ["doc_id", "n_chars", "edited_sha256", "signature", "edited_signature", "near_edited", "near_next", "class_id", "n_class"]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        held = None  # the row before, which waits for its next one
        known = (None, None)
        for batch in steps(batches, 1, STEP_BYTES):
            pairs = []
            texts = ["" if x is None else unpacker.decompress(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            for i, x, last, kind, *of in zip(batch.column(0).to_pylist(), texts, *(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                if kind == 0:
                    known = tuple(of)
                    continue
                if held is not None:
                    pairs.append((*held, x))
                held = None if last else (i, x, *known)
            yield work(pairs)

    if classes is None:
        classes = docs.sparkSession.createDataFrame([], "doc_id long, tid long, class_id long, n_class long")
    schema = "doc_id long, n_chars long, edited_sha256 string, signature binary, edited_signature binary, near_edited double, near_next double, class_id long, n_class long"
    return with_next(docs, doc_id, text, rows, classes).select("doc_id", "packed", "last", "kind", "class_id", "n_class").mapInArrow(run, schema)


def _rows(docs: DataFrame, doc_id: str, text: str, bands: int) -> DataFrame:
    """(doc_id, tid, mark, bands) of every row, written: the hashes of its text and of its set of
    shingles, and of each band's components. Sets without shingles have no bands."""
    ship(docs.sparkSession)
    full = F.coalesce(column(docs, text), F.lit(""))
    named = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), F.xxhash64(full).alias("tid"), full.alias("text"))
    width = FUNCTIONS // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 2, STEP_BYTES):
            marks, keys = [], []
            for x in as_bytes(batch.column(2)):
                found = shingles(x)
                sig = signature(found).astype("<u4").tobytes()
                marks.append(_mark(found))
                keys.append([_key(sig[4 * k * width : 4 * (k + 1) * width], k) >> 32 for k in range(bands)] if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64()), pa.array(keys, pa.list_(pa.int32()))], ["doc_id", "tid", "mark", "bands"])
        pa.default_memory_pool().release_unused()

    return cut_lineage(named.mapInArrow(run, "doc_id long, tid long, mark long, bands array<int>"))


def _nodes(rows: DataFrame) -> DataFrame:
    """(mark, id, tid, bands) of every set of shingles, with the least id that has it, written. Rows of
    one set have equal bands, so any of them will do; copies meet before the shuffle."""
    return cut_lineage(rows.groupBy("mark").agg(F.min("doc_id").alias("id"), F.min("tid").alias("tid"), F.first("bands").alias("bands")))


def _sets(docs: DataFrame, text: str, need: DataFrame) -> DataFrame:
    """(mark, shingles) of the sets in ``need`` (mark, tid), one row each. Texts that aren't in a filter
    of the hashes are left where they are."""
    bits = key_filter(need.select("tid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part in steps(batches, 1, STEP_BYTES):
            tids, texts = part.column(0).to_numpy(), part.column(1).cast(pa.binary())
            made: dict[int, np.ndarray] = {}
            for k in np.flatnonzero(may_hold(bits.value, tids)).tolist():
                if (t := int(tids[k])) not in done:
                    found = shingles(texts[k].as_py())
                    made[_mark(found)] = found
                    if len(done) < REMEMBERED:
                        done.add(t)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([s.astype("<u4").tobytes() for s in made.values()], pa.binary())], ["mark", "shingles"])
        pa.default_memory_pool().release_unused()

    full = F.coalesce(column(docs, text), F.lit(""))
    made = docs.select(F.xxhash64(full).alias("tid"), full.alias("text")).mapInArrow(run, "mark long, shingles binary")
    return made.join(need.select("mark"), "mark", "left_semi").groupBy("mark").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(u, v, jaccard) of the pairs of marks whose sets reach ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                value.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64())], ["u", "v", "jaccard"])

    full = pairs.join(sets.select(F.col("mark").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("mark").alias("v"), F.col("shingles").alias("b")), "v")
    return full.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, jaccard double").filter(F.col("jaccard") >= threshold)


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of one list shares with each of the other."""
    flat = [np.concatenate(x) for x in (one, two)]
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two)]
    both = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    at = [np.searchsorted(both, x) for x in flat]
    known = [(k < len(both)) & (both[np.minimum(k, len(both) - 1)] == x) if len(both) else np.zeros(len(x), bool) for k, x in zip(at, flat, strict=True)]
    at, row = [k[on] for k, on in zip(at, known, strict=True)], [r[on] for r, on in zip(row, known, strict=True)]
    # Whole numbers below 2^24, which few sets reach, are exact in single precision.
    total = np.zeros((len(one), len(two)), np.float32 if max(map(len, one)) < 1 << 24 else np.float64)
    for lo in range(0, len(both), COUNTED):
        sides = []
        for k, r, n in zip(at, row, (len(one), len(two)), strict=True):
            some = (k >= lo) & (k < lo + COUNTED)
            side = np.zeros((n, min(COUNTED, len(both) - lo)), np.float32)
            side[r[some], k[some] - lo] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T  # whole numbers up to COUNTED are exact
    return total


def _across(threshold: float):
    """Streams rows (band, a, b, side, node, label, number, bands, shingles) sorted by cell (band, a, b).
    Of a cell's pairs of a row of side 0 and one of side 1 with different labels, at least ``threshold``
    alike, it gives (u, v, jaccard) of a spanning forest: not more rows than the cell has labels. Pairs
    that share a band of a smaller number are that band's."""

    def meet(side: np.ndarray, node: np.ndarray, label: np.ndarray, number: int, bands: np.ndarray, sets: list[bytes]) -> pa.RecordBatch:
        names, of = np.unique(label, return_inverse=True)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = of[one][:, None] != of[two]
        for k in range(number):
            own &= bands[one, k][:, None] != bands[two, k]
        us, vs, likes = [], [], []
        one, two = one[own.any(axis=1)], two[own.any(axis=0)]
        if len(one):
            own = own[own.any(axis=1)][:, own.any(axis=0)]
            x, y = ([np.frombuffer(sets[k], "<u4") for k in part] for part in (one, two))
            both = _shared(x, y)
            size = np.array([len(s) for s in y])
            tree = np.arange(len(names))
            for i in range(len(one)):
                shared = both[i].astype(np.float64)
                value = shared / (len(x[i]) + size - shared)
                cols, mine = np.flatnonzero(own[i] & (value >= threshold)), tree[of[one[i]]]
                tops, first = np.unique(tree[of[two[cols]]], return_index=True)
                for j in cols[first[tops != mine]].tolist():
                    us.append(min(node[one[i]], node[two[j]]))
                    vs.append(max(node[one[i]], node[two[j]]))
                    likes.append(value[j])
                tree[np.isin(tree, tops)] = mine
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(likes, pa.float64())], ["u", "v", "jaccard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cells(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([rows.column(k).to_numpy() for k in range(3)])
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            edges = [0, *edges.tolist(), *([rows.num_rows] if last else [])]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                some = rows.slice(lo, hi - lo)
                side, node, label = (some.column(k).to_numpy() for k in (3, 4, 5))
                bands = np.array(some.column(7).to_pylist(), np.int32)
                yield meet(side, node, label, some.column(6)[0].as_py(), bands, some.column(8).to_pylist())
            held = [] if last else rows.slice(edges[-1]).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                key = [batch.column(k) for k in range(3)]
                if any(c[0] != c[batch.num_rows - 1] for c in key) or any(c[0] != held[0].column(k)[0] for k, c in enumerate(key)):
                    yield from cells(False)
        if held:
            yield from cells(True)
        pa.default_memory_pool().release_unused()

    return run


def _rest(shared: DataFrame, nodes: DataFrame, sets: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """(u, v, jaccard): links that join all similar followers of a band that have different labels.

    Of each band, followers outside its commonest label meet all of its followers, in cells of about
    ``CELL`` rows and ``CELL_SHINGLES`` shingles a side, so that many tasks compare the pairs of a hot
    band; pairs are verified where they meet and never become rows. Pairs with the band's leader are
    not repeated.
    """
    named = shared.filter("leader <> mark").join(label.withColumnRenamed("node", "mark"), "mark", "left").select("band", "mark", F.coalesce("label", "mark").alias("label"))
    named = cut_lineage(named)
    weight = sets.select("mark", (F.length("shingles") / 4).alias("size"))
    count = named.join(weight, "mark").groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    open_ = count.groupBy("band").agg(F.sum("n").alias("all"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    parts = lambda n, size: F.ceil(F.greatest(n / CELL, size / CELL_SHINGLES)).cast("int")
    open_ = cut_lineage(open_.select("band", F.col("top.label").alias("major"), parts(F.col("all"), F.col("size")).alias("nb"), parts(F.col("all") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("na")))
    number = F.shiftright("band", 32).cast("int").alias("number")
    rows = named.join(open_, "band").join(nodes.select("mark", "bands"), "mark").join(sets, "mark")
    rows = rows.select("band", F.col("mark").alias("node"), "label", number, "bands", "shingles", "major", "na", "nb")
    place = F.xxhash64("node")
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), a.alias("a"), b.alias("b"))
            for side, a, b in (
                (0, F.array(F.pmod(place, F.col("na")).cast("int")), F.sequence(F.lit(0), F.col("nb") - 1)),
                (1, F.sequence(F.lit(0), F.col("na") - 1), F.array(F.pmod(place, F.col("nb")).cast("int"))),
            )
        ]
    )
    # A row goes to every cell of its line (side 0, if it isn't of the commonest label) and column (side 1).
    cells = rows.withColumn("s", F.explode(sides)).filter("s.side = 1 or label <> major")
    cells = cells.withColumn("a", F.explode("s.a")).withColumn("b", F.explode("s.b")).withColumn("side", F.col("s.side"))
    cells = cells.select("band", "a", "b", "side", "node", "label", "number", "bands", "shingles").repartition("band", "a", "b").sortWithinPartitions("band", "a", "b")
    return cells.mapInArrow(_across(threshold), "u long, v long, jaccard double")


def _shared_bands(nodes: DataFrame) -> DataFrame:
    """(band, mark, leader) of the bands that two or more sets have, written; the leader is the mark of
    the least id. A band's number is in its upper half."""
    # The bands of all sets are shuffled once, to be counted; those that occur once go no further.
    every = nodes.select(F.posexplode("bands").alias("k", "band")).select(F.expr("shiftleft(cast(k as bigint), 32) | (band & 4294967295)").alias("band"))
    twice = cut_lineage(every.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"))
    bits = key_filter(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF
            number = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            band, mark = number << 32 | flat, np.repeat(batch.column(0).to_numpy(), size)
            some = may_hold(bits.value, band)
            ids = batch.column(2).take(pa.array(np.repeat(np.arange(batch.num_rows), size)[some]))
            yield pa.RecordBatch.from_arrays([pa.array(band[some]), pa.array(mark[some]), ids], ["band", "mark", "id"])

    members = cut_lineage(nodes.select("mark", "bands", "id").mapInArrow(run, "band long, mark long, id long").join(twice, "band"))
    key = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "mark")
    leader = cut_lineage(members.groupBy("band").agg(F.min(key).alias("first")).select("band", F.col("first.mark").alias("leader")))
    return cut_lineage(members.join(leader, "band").select("band", "mark", "leader"))


def links(docs: DataFrame, nodes: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(edges, labels): verified links (u, v, jaccard) between marks of ``nodes``, and (node, label) of
    their components, in which all marks are that any chain of links of ``threshold`` or more joins.

    First each set meets the leader of each of its bands, the one of the least id. What then has
    different labels in a band is compared too, followers with followers, so that the components are
    those of all pairs that share a band.
    """
    shared = _shared_bands(nodes)
    need = nodes.select("mark", "tid").join(shared.select("mark").distinct(), "mark", "left_semi")
    sets = cut_lineage(_sets(docs, text, cut_lineage(need)))
    stars = shared.filter("leader <> mark").select(F.col("leader").alias("u"), F.col("mark").alias("v"))
    near = cut_lineage(_verified(stars.distinct(), sets, threshold))
    label = cut_lineage(components(near))
    more = cut_lineage(_rest(shared, nodes, sets, label, threshold))
    if more.isEmpty():
        return near, label
    return near.union(more), cut_lineage(components(near.union(more)))


def _classes(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """(mark, class_id, n_class, own): the least id of each set's component, the number of its sets, and
    the least id of the set itself."""
    of = nodes.select("mark", "id").join(label.withColumnRenamed("node", "mark"), "mark", "left").withColumn("label", F.coalesce("label", "mark"))
    top = of.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("n_class"))
    return cut_lineage(of.join(top, "label").select("mark", "class_id", "n_class", F.col("id").alias("own")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id): the smallest id that a chain of links reaches from each row, where a link is
    a verified Jaccard similarity of ``threshold`` or more.

    At the defaults a link is missed if its texts share no band: 5e-8 of pairs at 0.8, fewer above.
    Texts without words are one class. Rows that repeat give repeated rows; class_id is null only if
    no row of a class has an id. No rows give none.
    """
    rows = _rows(docs, doc_id, text, bands)
    nodes = _nodes(rows)
    _, label = links(docs, nodes, text, threshold)
    return rows.join(_classes(nodes, label), "mark").select("doc_id", "class_id")


def leaders(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(doc_id, leader_id, jaccard, class_id): for each row the most similar row of a smaller id among
    its verified links, itself (1.0) if there is none, and its class as in ``classes``. Ties go to the
    smaller id, and copies lead to the smallest id of their set.

    Links are those of ``links``: enough for all classes, not all pairs of a class. Texts without words
    lead themselves, as do rows without an id in a set that has none. Rows that repeat give repeated
    rows, no rows give none.
    """
    rows = _rows(docs, doc_id, text, bands)
    nodes = _nodes(rows)
    edges, label = links(docs, nodes, text, threshold)
    id_of = nodes.select("mark", "id")
    known = edges.join(id_of.toDF("u", "x"), "u").join(id_of.toDF("v", "y"), "v")
    down = known.filter("x < y").select(F.col("v").alias("mark"), F.col("x").alias("to"), "jaccard")
    down = down.union(known.filter("y < x").select("u", "y", "jaccard"))
    best = down.groupBy("mark").agg(F.max(F.struct("jaccard", (-F.col("to")).alias("minus"))).alias("b")).select("mark", (-F.col("b.minus")).alias("leader"), "b.jaccard")
    of = cut_lineage(_classes(nodes, label).join(best, "mark", "left"))
    empty = F.col("mark") == _mark(np.zeros(0, np.uint64))
    return rows.join(of, "mark").select("doc_id", F.when(empty, F.col("doc_id")).otherwise(F.coalesce("leader", "own")).alias("leader_id"), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"), "class_id")


def _mark(found: np.ndarray) -> int:
    return _key(found.astype("<u4").tobytes(), FUNCTIONS)


def _key(raw: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(raw, seed) - (1 << 63)


def op5_minhash(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex of the signature),
    near_edited, near_next, class_id (see ``classes``), n_class (different sets of shingles in it)."""
    rows = _rows(docs, "doc_id", "text", BANDS)
    nodes = _nodes(rows)
    _, label = links(docs, nodes)
    of = rows.select("doc_id", "tid", "mark").distinct().join(_classes(nodes, label), "mark").groupBy("doc_id", "tid").agg(F.min("class_id").alias("class_id"), F.max("n_class").alias("n_class"))
    found = fingerprints(docs, rows=rows.select("doc_id", "tid"), classes=of)
    return found.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("signature")).alias("fingerprint"), F.lower(F.hex("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id", "n_class")
