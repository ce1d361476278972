"""Repeated byte strings against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from clauseloom.llm import op4_repeats as R


def plain(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=40, length=400):
    rng = random.Random(seed)
    word = ["".join(rng.choice("abcdefé ") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    text = lambda k: " ".join(rng.choice(word) for _ in range(k))
    shared = [text(rng.choice([30, 100, 300])) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [text(rng.choice([0, 5, 60, 200])) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            cut = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(len(parts) + 1), s[cut : cut + rng.randrange(length // 2, 3 * length)])
        rows.append((i, "".join(parts)))
    return rows


def found(docs, **args):
    from pyspark.sql import functions as F

    df, n = R.remove_repeats(docs, **args)
    rows = df.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("b"), n["kept"], n["spans"]).collect()
    return sorted(((r.doc_id, r.b, r.b - len(r[2]), len(r[3]), hashlib.sha256(bytes(r[2])).hexdigest()) for r in rows), key=str)


@pytest.mark.parametrize("hot", [R.HOT, 1])
def test_brute_force(make_docs, hot):
    rows = passages(3)
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (None, rows[1][1]), (102, None), (103, ""), (104, "z" * 3000), (105, "ab" * 900), (106, "x" * 399)]
    want = plain(rows, 400)
    assert sum(r[2] for r in want) > 5000
    assert found(make_docs(rows, extra=("tid", "_kept", "SPANS", "id")), hot=hot) == want


def test_short_windows_and_small_indexes(make_docs, monkeypatch):
    monkeypatch.setattr(R, "INDEX_BYTES", 500)
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    assert found(make_docs(rows), length=12, anchor=4) == plain(rows, 12)


def test_stretches(monkeypatch):
    text = random.Random(1).randbytes(5000).hex().encode()
    whole = {s for a, n, _ in R.contexts(text) for s in range(a, a + n)}
    monkeypatch.setattr(R, "STRETCH", 700)
    parts = list(R.contexts(text))
    assert whole == {s for a, n, _ in parts for s in range(a, a + n)} == set(range(len(text) - 399))
    for a, n, p in parts:
        assert a + n - 1 <= p and p + R.ANCHOR <= a + 400


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_matching_statistics(letters):
    rng = random.Random(letters)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
            if texts and rng.random() < 0.6:
                o = rng.choice(texts).decode()
                t = t[:10] + o[rng.randrange(len(o) + 1) :]
            texts.append(t.encode())
        index = R.RunIndex(texts)
        got = index.statistics()
        places = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
        for k, i in places:
            best = 0
            for q, j in places:
                if (q, j) != (k, i):
                    a, b = texts[k][i:], texts[q][j:]
                    n = 0
                    while n < min(len(a), len(b)) and a[n] == b[n]:
                        n += 1
                    best = max(best, n)
            assert got[index.start[k] + i] == best


def test_few_runs_in_repetitive_texts():
    text = random.Random(2).randbytes(300).hex().encode()
    index = R.RunIndex([text + bytes([65 + k]) for k in range(20)])
    assert len(index.first) < len(index.text) / 10


def test_query(documents, make_docs):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = R.op4_repeats(documents).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(rows, 400)
    whole = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    for r in got:
        cut = [tuple(map(int, x.split("-"))) for x in r.removed.split(",") if x]
        edges = [0, *(x for c in cut for x in c), len(whole[r.doc_id])]
        kept = b"".join(whole[r.doc_id][a:b] for a, b in zip(edges[::2], edges[1::2]))
        assert hashlib.sha256(kept).hexdigest() == r.kept_sha256 and sum(b - a for a, b in cut) == r.n_removed
        assert kept.decode("utf-8", "ignore") == r.text.replace("\ufffd", "")
    assert R.op4_repeats(make_docs([])).collect() == []
