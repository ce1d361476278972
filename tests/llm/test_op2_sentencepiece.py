"""SentencePiece ids and texts against the library."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from clauseloom.llm import common
from clauseloom.llm import op2_sentencepiece as S

ODD = [
    "", " ", "  ", "x ", " x", "two  spaces", "a \n b", "\n", "\n\n x", "tab\there", "▁", "a▁b", "ﬁ Å é 日本 <s> </s> <0x41> <unk>", "🙂🙂 x🙂y",
    "\x00\x01a\x01", "'''''-----====", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa 12345678901234567890", "x² y³z", "ÀÀÀÀÀ", "def f(x):\n        return x  # no\n",
    "Ω≈ç√∫ ñandú Straße", "don't stop. Wait?! (see: a.b/c)", "é combining", " " * 40 + "end",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.model_path())


def same(library, texts):
    pieces = S.vocabulary(S.model_path())
    counts, ids = pieces.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    want = library.encode([t or "" for t in texts])
    for text, lo, hi, w in zip(texts, (ends - counts).tolist(), ends.tolist(), want, strict=True):
        assert ids[lo:hi].tolist() == w, text
    assert pieces.decode(counts, ids) == library.decode(want)


def test_odd_texts(library):
    same(library, [*ODD, None])


def test_random_texts(library):
    rng = random.Random(6)
    letters = "aaeeiotnsrh lmd ▁\n.,'-AÉéß12²日🙂 the ing "
    same(library, ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(1500)])


def test_given_texts(library, documents):
    same(library, [r.text for r in documents.collect()])


def test_small_store_and_long_words(library, monkeypatch):
    monkeypatch.setattr(common, "STORE", 50)
    monkeypatch.setattr(S, "INDEXED", 7)
    monkeypatch.setitem(S._VOCABULARIES, S.model_path(), S.Vocabulary(S.model_path()))
    rng = random.Random(8)
    for _ in range(4):
        same(library, ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(20)] + ["q" * 5000, "ab" * 3000])


def test_suffix_order():
    text = np.frombuffer(b"banana\xffananas\xffban", np.uint8)
    raw = text.tobytes()
    order = S.suffix_order(S._keys(text), 32)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:] + b"\xff" * 40)


def test_query(make_docs, library):
    rows = list(enumerate([*ODD, None, "again", "again"]))
    got = S.op2_sentencepiece(make_docs(rows, extra=("_ids", "_text", "IDS"))).collect()
    tokens, name = S.encode(make_docs(rows, extra=("_ids", "_TEXT")))
    lists = {r.doc_id: r[name] for r in tokens.select("doc_id", name).collect()}
    assert lists == {i: library.encode(t or "") for i, t in rows}
    back, text = S.decode(tokens, name)
    want = {i: library.decode(library.encode(t or "")) for i, t in rows}
    assert {r.doc_id: r[text] for r in back.select("doc_id", text).collect()} == want
    hashed = {r.doc_id: (r.h, r.s) for r in back.select("doc_id", F.xxhash64(name).alias("h"), F.sha2(F.col(text).cast("binary"), 256).alias("s")).collect()}
    assert {r.doc_id: (r.ids_xxhash64, r.decoded_sha256) for r in got} == hashed
    assert S.op2_sentencepiece(make_docs([])).collect() == []
