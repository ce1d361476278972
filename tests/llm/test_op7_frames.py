"""Frame files: round trips, tables, damage, and ids against the library."""

import io
import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

from clauseloom.llm import op7_frames as Z
from clauseloom.session import new_path

ODD = ["", None, " ", "Hello, World! it's 12 o'clock", "two  spaces\n\n\ttab\x0b\x0cvt nbsp", "Ünï ﬁ Å é é İ ẞ", "<|endoftext|> x<|startoftext|>y", "a<|EndOfText|>b <|endoftext|", "é<|endoftext|><|endoftext|>\n<| endoftext |> don't", "plain between", "日本語 🙂🙂", "a b", "x" * 5000, "'s 're don't", "́ lone mark"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(Z.vocabulary_path())


def plain(library, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_odd_texts(make_docs, library):
    rows = list(enumerate(ODD)) + [(500, "again"), (500, "again"), (None, "no id"), (-3, "below")]
    assert found(Z.op7_frames(make_docs(rows, extra=("data", "START", "path")))) == plain(library, rows)
    assert Z.op7_frames(make_docs([])).collect() == []


def test_ids_of_another_width(spark, library):
    rows = [(k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert found(Z.op7_frames(df)) == plain(library, rows)


def test_a_full_store_keeps_what_is_used(library):
    import pyarrow as pa

    words = Z.Encoder(Z.vocabulary_path())
    words.words.limit = 60
    for k in range(40):
        texts = [f"the common words {k} of{k % 7} every w{k * 31} text", f"x{k}y <|endoftext|> é{k}" if k % 5 == 0 else f"and others{k}", ""]
        counts, ids = words.encode(pa.array(texts))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(words.words.count) <= 60 and len(words.words.first) == len(words.words.count)


def test_given_table(documents, library):
    assert found(Z.op7_frames(documents)) == plain(library, [(r.doc_id, r.text) for r in documents.collect()])


def file_of(items):
    sink = io.BytesIO()
    writer = Z.FrameWriter(sink)
    for i, data in items:
        writer.add(i, data)
    writer.close()
    return sink.getvalue()


def test_the_file_is_plain_zstandard():
    items = [(5, b"abcd" * 9), (None, b""), (9, b"\x01\x00\x00\x00")]
    raw = file_of(items)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(d for _, d in items)
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert (n, flags, magic) == (3, 0x80, 0x8F92EAB1)
    entries = np.frombuffer(raw[-9 - 36 : -9], "<u4").reshape(3, 3)
    assert entries[0, 2] == xxhash.xxh64_intdigest(b"abcd" * 9) & 0xFFFFFFFF
    assert struct.unpack("<II", raw[-9 - 36 - 8 : -9 - 36]) == (0x184D2A5E, 45)


def test_single_frames():
    items = [(k, bytes([k]) * (k * 40)) for k in range(20)]
    reader = Z.FrameReader(io.BytesIO(file_of(items)))
    assert reader.ids.tolist() == list(range(20)) and list(reader.all(100)) == [d for _, d in items]
    assert reader.read(13) == items[13][1] and reader.read(0) == b""
    assert list(Z.FrameReader(io.BytesIO(file_of([]))).all()) == []


@pytest.mark.parametrize("where", [12, -4, -15])
def test_damage_is_seen(where):
    raw = bytearray(file_of([(1, bytes(range(200))), (2, b"xyz" * 50)]))
    raw[where] ^= 0x41
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader = Z.FrameReader(io.BytesIO(bytes(raw)))
        list(reader.all())


def test_small_files_and_wanted_documents(spark, make_docs, library):
    rows = [(i * 3, f"document number {i} " * (i % 7)) for i in range(120)]
    files = Z.write_frames(Z.encode(make_docs(rows)), new_path(spark, "frames"), file_bytes=300)
    assert files.count() > 5 and files.select("path").distinct().count() == files.count()
    want = {r[0]: r for r in plain(library, rows)}
    wanted = spark.createDataFrame([(0,), (30,), (357,), (31,), (30,)], "doc_id long")
    some = Z.read_some(files, wanted).collect()
    assert sorted(r.doc_id for r in some) == [0, 30, 357]
    for r in some:
        assert (r.start, zlib.crc32(bytes(r.data))) == (want[r.doc_id][1], want[r.doc_id][3])
    assert {r.doc_id: r.start for r in Z.read_frames(files).collect()} == {i: w[1] for i, w in want.items()}


def test_texts_are_encoded_where_they_are_written(spark, make_docs):
    docs = make_docs([(i, "word " * i if i % 3 else None) for i in range(40)] + [(None, "a"), (5, "twice")])
    apart = Z.read_frames(Z.write_frames(Z.encode(docs), new_path(spark, "frames")))
    writing = Z.read_frames(Z.write_frames(Z.in_order(docs), new_path(spark, "frames"), first=Z.encoding()))
    assert sorted(map(str, writing.collect())) == sorted(map(str, apart.collect())) and writing.count() == 42
