"""Helpers shared by the operators of this package."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Bytes of text that one step inside a task works on; a longer text forms a step of its own.
STEP_BYTES = 4 << 20

#: Strings kept by a store.
STORE = 150_000

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    path = os.path.join(tempfile.mkdtemp(prefix="clauseloom-ship-"), "clauseloom.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def column(df: DataFrame, name: str):
    """The column of that name, quoted: names may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def steps(batches: Iterator[pa.RecordBatch], text: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``limit`` bytes of their text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - size) // limit
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(lo, hi - lo)


def as_bytes(values: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in values.cast(pa.binary()).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def hex64(value):
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


#: Bits of a key filter at most.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame):
    """A broadcast set of bits that holds all ``keys`` (one long column, hash values): what it leaves out
    is none of them, what it lets pass must be checked. Its size has a fixed bound; with more keys than
    bits it only leaves out less."""
    name = keys.columns[0]
    n = min(FILTER_BITS, 1 << max(16, (16 * keys.count()).bit_length()))
    x = F.col(name)
    mixed = x.bitwiseXOR(F.shiftrightunsigned(x, 17)).bitwiseXOR(F.shiftleft(x, 13))
    at = F.explode(F.array(x.bitwiseAND(F.lit(n - 1)), mixed.bitwiseAND(F.lit(n - 1)))).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    found = words.toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(n // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (long) may be in the filter of these bits."""
    x, last = keys.view(np.uint64), np.uint64(64 * len(bits) - 1)
    has = np.ones(len(x), bool)
    for at in (x & last, (x ^ x >> np.uint64(17) ^ x << np.uint64(13)) & last):
        has &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return has


class Store:
    """Token lists by string, kept by a process; past its limit it goes on with the first half: common
    strings come early."""

    def __init__(self, limit: int | None = None) -> None:
        self.limit = limit or STORE
        self.number: dict[str, int] = {}
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def missing(self, used: list[str]) -> list[str]:
        """What isn't here yet, after making room for it."""
        new = [w for w in used if w not in self.number]
        if len(self.number) + len(new) > self.limit:
            n = min(self.limit // 2, len(self.number))
            self.number = dict(islice(self.number.items(), n))
            self.start, self.count = self.start[:n], self.count[:n]
            self.flat = self.flat[: int(self.count.sum())]
            new = [w for w in used if w not in self.number]
        return new

    def add(self, names: list[str], counts: np.ndarray, flat: np.ndarray) -> None:
        base = len(self.number)
        self.number.update(zip(names, range(base, base + len(names)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, flat])

    def gather(self, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each row, all of them), of rows of so many strings with these numbers."""
        per = self.count[at]
        ends = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(length)])]
        return np.diff(ends), self.flat[ragged(self.start[at], per)]


class HashStore:
    """Token lists of strings that are known by 128 bits of hash only, so that half a million take little
    memory and whole Arrow arrays are looked up at once. When it is full it starts anew."""

    BITS = 20

    def __init__(self, limit: int = 1 << 19) -> None:
        self.limit = limit
        rng = np.random.default_rng(5)
        self._mix = [rng.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
        self._base = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
        self._power = [np.ones(1, np.uint64)] * 2
        self._forget()

    def _forget(self) -> None:
        self.key, self.check = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.uint64)
        self.at = np.zeros(1 << self.BITS, np.int32)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def hashes(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        size = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(strings.cast(pa.binary()).to_pylist()) if strings.offset else strings.buffers()[2] or b"", np.uint8)[: int(size.sum())]
        start = np.cumsum(size) - size
        place = np.arange(len(data)) - np.repeat(start, size)
        has = size > 0
        out = []
        for mix, base, k in zip(self._mix, self._base, range(2), strict=True):
            need = int(size.max(initial=0))
            if len(self._power[k]) < need:
                factors = np.full(2 * need + 1, base, np.uint64)
                factors[0] = 1
                self._power[k] = np.cumprod(factors)
            value = size.astype(np.uint64)
            if len(data):
                value[has] += np.add.reduceat(mix[data] * self._power[k][place], start[has])
            value = (value ^ value >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
            out.append((value ^ value >> np.uint64(32)) | np.uint64(1 - k))  # the first is never 0
        return out[0], out[1]

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of the known ones, -1 for the others."""
        out = np.full(len(first), -1, np.int64)
        live, slot = np.arange(len(first)), (first >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(live):
            key = self.key[slot]
            hit = (key == first[live]) & (self.check[slot] == second[live])
            out[live[hit]] = self.at[slot[hit]]
            on = ~hit & (key != 0)
            live, slot = live[on], (slot[on] + 1) & (1 << self.BITS) - 1
        return out

    def room(self, new: int) -> bool:
        """Whether so many fit; if not, everything is forgotten first."""
        if len(self.count) + new <= self.limit:
            return True
        self._forget()
        return False

    def add(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        number = len(self.count) + np.arange(len(first))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count, self.flat = np.concatenate([self.count, counts]), np.concatenate([self.flat, flat])
        if len(self.count) > 1 << self.BITS - 1:
            return  # one step has more strings than the table: they serve this step only
        live, slot = np.arange(len(first)), (first >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(live):
            free = self.key[slot] == 0
            _, one = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[one]
            self.key[slot[take]], self.check[slot[take]], self.at[slot[take]] = first[live[take]], second[live[take]], number[live[take]]
            left = np.ones(len(live), bool)
            left[take] = False
            live, slot = live[left], slot[left]
            slot = np.where(self.key[slot] == 0, slot, (slot + 1) & (1 << self.BITS) - 1)

    def numbers(self, strings: pa.Array, learn) -> np.ndarray:
        """The number of each of some distinct strings. ``learn`` gives the token lists (counts, all
        tokens) of those that aren't here."""
        first, second = self.hashes(strings)
        at = self.find(first, second)
        new = np.flatnonzero(at < 0)
        if len(new) and not self.room(len(new)):
            new = np.arange(len(first))
        if len(new):
            base = len(self.count)
            self.add(first[new], second[new], *learn(strings.take(pa.array(new)).to_pylist()))
            at[new] = base + np.arange(len(new))
        return at

    gather = Store.gather
