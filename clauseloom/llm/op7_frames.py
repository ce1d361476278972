"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame for each document, in ascending order of ids: its token ids as little-endian
unsigned 32-bit integers, with zstandard's own content checksum. Then come two skippable frames: the
documents' ids (n as unsigned 32-bit, then n signed 64-bit integers), and last the seek table of the
zstandard seekable format: for every frame its compressed size, its size, and the low 32 bits of the
XXH64 of its content; the number of frames, a descriptor byte and the magic number end the file. A
reader takes the tables from a file's end, and then decompresses the frames of the documents it wants.

Tasks write files of their own and give back one row a file; only files listed there count, so a task
that is run again leaves at most an unlisted file behind.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import HashStore, Store, as_bytes, column, ragged, ship, steps
from clauseloom.session import cut_lineage, new_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
LEVEL = 3
#: Distinct runs of signs a process remembers.
RUNS_KEPT = 300_000
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 256 << 20

#: Fixed values of the formats.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
#: Stands for a null id.
NO_ID = -(1 << 63)

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_ENCODERS: dict[str, Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words whose runs the vocabulary's own pattern cuts like RUNS, once they are in lower case: letters of
#: Latin-1, digits, and other ASCII signs but the apostrophe, which may bind letters.
SIMPLE = re.compile(r"[\x21-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]+")
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class KeepingStore(HashStore):
    """A store that, when it is full, keeps the strings that were asked for again."""

    def _forget(self) -> None:
        super()._forget()
        self.first, self.second, self.used = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def add(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        super().add(first, second, counts, flat)
        self.first, self.second = np.concatenate([self.first, first]), np.concatenate([self.second, second])
        self.used = np.concatenate([self.used, np.zeros(len(first), np.int32)])

    def _halve(self) -> None:
        """Keep half of the limit at most, of the strings that were used the most used ones."""
        keep = np.flatnonzero(self.used)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: self.limit // 2]])
        first, second, counts = self.first[keep], self.second[keep], self.count[keep]
        flat = self.flat[ragged(self.start[keep], counts)]
        self._forget()
        self.add(first, second, counts, flat)

    def numbers(self, strings: pa.Array, learn) -> np.ndarray:
        first, second = self.hashes(strings)
        at = self.find(first, second)
        if len(self.count) + int((at < 0).sum()) > self.limit:
            self._halve()
            at = self.find(first, second)
        new = np.flatnonzero(at < 0)
        self.used[at[at >= 0]] += 1
        if len(new):
            base = len(self.count)
            self.add(first[new], second[new], *learn(strings.take(pa.array(new)).to_pylist()))
            at[new] = base + np.arange(len(new))
        return at


class Encoder:
    """The library's ids of whole texts. Its vocabulary drops white space and never joins words over
    it, nor runs of letters, single digits and runs of other signs over each other, so distinct words
    are put together from distinct runs, which the library encodes once. Words that aren't simple, and
    spaces other than blanks and newlines, are the library's matter as they stand, as are whole texts
    that hold one of its added tokens, in any case. Known words are told apart by 128 bits of hash: two
    words with equal ones would get the ids of the first."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = sorted({t.content.lower() for t in self.library.get_added_tokens_decoder().values()})
        self.words, self.runs = KeepingStore(), Store(RUNS_KEPT)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [RUNS.findall(w.lower()) if SIMPLE.fullmatch(w) else [w] for w in words]
        new = self.runs.missing(list(set().union(*runs)))
        for lo in range(0, len(new), 4000):
            some = new[lo : lo + 4000]
            found = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)) if found.ids else np.zeros(len(some), np.int64)
            self.runs.add(some, counts, np.array(found.ids, np.int32))
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        at = np.fromiter(map(self.runs.number.__getitem__, chain.from_iterable(runs)), np.int64, int(length.sum()))
        return self.runs.gather(length, at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, all of them)."""
        texts = pc.fill_null(texts, "")
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # not UTF-8
            texts = pa.array([x.decode("utf-8", "replace") for x in as_bytes(texts)])
        # The vocabulary is in lower case: A to Z can be lowered first, so that fewer words differ.
        low = pc.ascii_lower(texts)
        odd = np.zeros(len(low), bool)
        for token in self.added:
            odd |= pc.match_substring(low, token).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(low)
        counts, ids = self._plain(pc.if_else(pa.array(odd), "", low))
        ends, pieces, last = np.cumsum(counts), [], 0
        for row in np.flatnonzero(odd).tolist():
            own = np.array(self.library.encode(texts[row].as_py(), add_special_tokens=False).ids, np.int32)
            pieces += [ids[last : ends[row]], own]
            counts[row], last = len(own), ends[row]
        return counts, np.concatenate([*pieces, ids[last:]])

    def _plain(self, low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        at = self.words.numbers(numbered.dictionary, self._learn)[numbered.indices.to_numpy(zero_copy_only=False)]
        return self.words.gather(split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), at)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text), in ascending order of ids over and within partitions, nulls first."""
    rows = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))


def encoding(vocabulary: str | None = None, end_id: int = END_ID) -> Batches:
    """What turns batches of (doc_id, text) into those of (doc_id, data)."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in steps(batches, 1, 1 << 20):
            counts, ids = words.encode(batch.column(1))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32) * 4
            data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), data], ["doc_id", "data"])

    return run


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, data), in ascending order of ids over and within partitions, nulls first. ``data``:
    the ids of a whole text and the end id, as little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)
    return in_order(docs, doc_id, text).mapInArrow(encoding(vocabulary, end_id), "doc_id long, data binary")


class FrameWriter:
    """One file. ``sink`` is anything with ``write``."""

    def __init__(self, sink, level: int = LEVEL) -> None:
        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.ids: list[int] = []
        self.entries: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        frame = self.packer.compress(data)
        self.sink.write(frame)
        self.size += len(frame)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.entries.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        index = struct.pack("<I", len(self.ids)) + np.array(self.ids, "<i8").tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_IDS, len(index)) + index)
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Reads one file's tables, and then only the frames asked for. ``source`` can seek and read."""

    def __init__(self, source) -> None:
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        at = size - 9 - 12 * n - 8
        source.seek(at)
        head = struct.unpack("<II", source.read(8))
        if head != (SKIPPABLE_SEEK, 12 * n + 9):
            raise ValueError("the seek table's frame is damaged")
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        source.seek(at - 8 * n - 12)
        head = struct.unpack("<III", source.read(12))
        if head != (SKIPPABLE_IDS, 8 * n + 4, n):
            raise ValueError("the frame of document ids is damaged")
        self.ids = np.frombuffer(source.read(8 * n), "<i8")
        self.offset = np.cumsum(self.table[:, 0]) - self.table[:, 0]

    def __len__(self) -> int:
        return len(self.table)

    def read(self, number: int) -> bytes:
        """The content of one frame, after its checks."""
        self.source.seek(int(self.offset[number]))
        return self._open(number, self.source.read(int(self.table[number, 0])))

    def all(self, at_once: int = 8 << 20) -> Iterator[bytes]:
        """All contents, in order, read in larger pieces."""
        lo = 0
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.offset, self.offset[lo] + at_once)))
            self.source.seek(int(self.offset[lo]))
            piece = self.source.read(int(self.table[lo:hi, 0].sum()))
            for k in range(lo, hi):
                at = int(self.offset[k] - self.offset[lo])
                yield self._open(k, piece[at : at + int(self.table[k, 0])])
            lo = hi

    def _open(self, number: int, frame: bytes) -> bytes:
        data = self.unpacker.decompress(frame) if self.table[number, 1] else b""
        if len(data) != self.table[number, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[number, 2]:
            raise ValueError(f"frame {number} fails its check")
        return data


def _files(path: str):
    """File system and path of a folder that all tasks reach, from a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_frames(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES, first: Batches | None = None) -> DataFrame:
    """Write (doc_id, data) rows, in the order they are in, to files in ``folder``. ``first`` makes
    them of other rows, in the process that writes them. Returns the list of files, itself written:
    shard, part, path, n_docs, n_bytes (uncompressed), first_id, last_id,
    base (bytes of all documents in files before it). The files of the list are in order of (shard, part).
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        system, root = _files(folder)
        writer = sink = name = None
        part, listed = 0, []

        def end() -> None:
            writer.close()
            sink.close()
            ids = [None if i == NO_ID else i for i in (writer.ids[0], writer.ids[-1])]
            listed.append((shard, part, name, len(writer.ids), sum(struct.unpack("<III", e)[1] for e in writer.entries), *ids))

        for batch in first(batches) if first else batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is not None and writer.size >= file_bytes:
                    end()
                    writer, part = None, part + 1
                if writer is None:
                    name = f"{folder}/{shard:06d}-{part:05d}-{uuid.uuid4().hex}.zst"
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}", compression=None)
                    writer = FrameWriter(sink)
                writer.add(doc_id, data or b"")
        if writer is not None:
            end()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in listed], t) for k, t in enumerate(kinds)], ["shard", "part", "path", "n_docs", "n_bytes", "first_id", "last_id"])

    files = cut_lineage(rows.mapInArrow(run, "shard int, part int, path string, n_docs long, n_bytes long, first_id long, last_id long"))
    # A row for each shard meets in one window, and a row for each file in its shard's.
    shards = files.groupBy("shard").agg(F.sum("n_bytes").alias("size")).withColumn("before", F.expr("sum(size) over (order by shard) - size"))
    inside = F.expr("sum(n_bytes) over (partition by shard order by part) - n_bytes")
    return cut_lineage(files.join(shards.select("shard", "before"), "shard").withColumn("base", F.col("before") + inside).drop("before"))


def read_frames(files: DataFrame) -> DataFrame:
    """(doc_id, start, data) of all documents of the listed files; start counts the tokens of all
    documents before. Raises if a frame or a table is damaged."""
    ship(files.sparkSession)
    rows = files.select("path", "base").repartition(max(1, files.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = _files(path)
                with system.open_input_file(place) as source:
                    frames = FrameReader(source)
                    starts = (base + np.cumsum(frames.table[:, 1]) - frames.table[:, 1]) // 4
                    held, lo = [], 0
                    for k, data in enumerate(frames.all(), 1):
                        held.append(data)
                        if len(held) == 2000 or k == len(frames):
                            ids = frames.ids[lo:k]
                            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(starts[lo:k]), pa.array(held, pa.binary())], ["doc_id", "start", "data"])
                            held, lo = [], k

    return rows.mapInArrow(run, "doc_id long, start long, data binary")


def read_some(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, data) of the documents whose ids are in ``wanted`` (column doc_id, non-null).

    Ids are found in the tables at the files' ends; of the rest only their frames are read."""
    ship(files.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = _files(path)
                with system.open_input_file(place) as source:
                    frames = FrameReader(source)
                    n = len(frames)
                    starts = (base + np.cumsum(frames.table[:, 1]) - frames.table[:, 1]) // 4
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(n)), pa.array(frames.ids.astype(np.int64)), pa.array(starts)], ["path", "frame", "doc_id", "start"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, data = batch.column(0).to_pylist(), []
            last, source, frames = None, None, None
            for path, k in zip(paths, batch.column(1).to_pylist(), strict=True):
                if path != last:
                    if source is not None:
                        source.close()
                    system, place = _files(path)
                    last, source = path, system.open_input_file(place)
                    frames = FrameReader(source)
                data.append(frames.read(k))
            if source is not None:
                source.close()
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(data, pa.binary())], ["doc_id", "start", "data"])

    found = files.select("path", "base").repartition(max(1, files.count()), "path").mapInArrow(index, "path string, frame long, doc_id long, start long")
    found = found.join(wanted.select("doc_id").distinct(), "doc_id").select("path", "frame", "doc_id", "start")
    return found.repartition("path").sortWithinPartitions("path", "frame").mapInArrow(fetch, "doc_id long, start long, data binary")


def op7_frames(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32. A null text is empty and has the end id alone; a null id
    comes first; rows that repeat an id follow each other; no rows give no files and no rows."""
    files = write_frames(in_order(docs), new_path(docs.sparkSession, "frames"), first=encoding())
    return read_frames(files).select("doc_id", "start", (F.length("data") / 4).cast("long").alias("n_tokens"), F.crc32("data").alias("ids_crc32"))
