"""Line chunks: boundaries, and removal against plain code."""

import hashlib
import random

import pytest

from clauseloom.llm import op9_lines as C


def plain(rows):
    """Chunks in order of (id, place); ids before null. Rows of one id and text share a decision."""
    seen, where = {}, []
    distinct = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    count = {}
    for i, t in rows:
        for s, e, *_, chunk in C._several((t or "").encode()) if t is not None else ():
            count[chunk] = count.get(chunk, 0) + 1
    kept = {}
    for i, t in distinct:
        lines, ranges = C.chunks(t.encode())
        left = [True] * len(lines)
        for s, e in ranges:
            chunk = b"\n".join(lines[s:e])
            if e - s > 1 and count[chunk] > 1:
                first = seen.setdefault(chunk, (i, t, s))
                if first[0] != i or (first[1] == t and first[2] != s):
                    left[s:e] = [False] * (e - s)
        kept[i, t] = (lines, left)
    for i, t in rows:
        if t is None:
            where.append((i, 0, 0, 0, hashlib.sha256(b"").hexdigest()))
            continue
        lines, left = kept[i, t]
        spans = sum(not x and (k == 0 or left[k - 1]) for k, x in enumerate(left))
        text = b"\n".join(x for x, s in zip(lines, left, strict=True) if s)
        where.append((i, len(lines), left.count(False), spans, hashlib.sha256(text).hexdigest()))
    return sorted(where, key=str)


def found(docs):
    return sorted(map(tuple, C.op9_lines(docs).collect()), key=str)


def line_rows(seed=4, n=80):
    rng = random.Random(seed)
    lines = [f"line {k} é" for k in range(60)] + ["", "", "same"]
    block = [rng.choice(lines) + str(k) for k in range(40)]
    rows = []
    for i in range(n):
        body = [rng.choice(lines) + str(rng.randrange(10**6)) for _ in range(rng.randrange(6))]
        if rng.random() < 0.6:
            lo = rng.randrange(30)
            body[rng.randrange(len(body) + 1) : 0] = block[lo : lo + rng.randrange(2, 25)]
        rows.append((i, "\n".join(body)))
    return rows


def test_against_plain(make_docs):
    rows = line_rows() + [(500, None), (501, ""), (502, "\n\n\n\n\n\n\n\n"), (503, "one line"), (504, "one line"), (505, "x\n" * 300)]
    rows += [(600, rows[0][1]), (600, rows[0][1])]
    want = plain(rows)
    assert sum(r[2] for r in want) > 100
    assert found(make_docs(rows, extra=("h1", "_GONE", "tid", "first"))) == want
    assert found(make_docs([])) == []


def test_null_ids_come_last(make_docs):
    text = "\n".join(f"a{k}" for k in range(12))
    got = found(make_docs([(None, text), (7, text), (9, text)]))
    assert {r[0]: r[2] for r in got} == {7: 0, 9: 12, None: 12} or {r[0] for r in got if r[2] == 0} == {7}


def test_boundaries_resist_shifts():
    lines = [f"text {k * k % 977}" for k in range(400)]
    whole = C.chunks("\n".join(lines).encode())
    shifted = C.chunks("\n".join(["new", "lines", "first", *lines]).encode())
    same = {tuple(whole[0][s:e]) for s, e in whole[1]} & {tuple(shifted[0][s:e]) for s, e in shifted[1]}
    assert len(same) >= len(whole[1]) - 3


@pytest.mark.parametrize("n", [1, 2, 3, 50, 300])
def test_chunks_cover_all_lines(n):
    for text in ("\n".join(map(str, range(n))), "\n" * (n - 1)):
        lines, ranges = C.chunks(text.encode())
        assert len(lines) == n and ranges[0][0] == 0 and ranges[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        assert all(C.LEAST <= e - s <= C.MOST for s, e in ranges[:-1]) and ranges[-1][1] - ranges[-1][0] <= C.MOST


def test_columns_pass_through(make_docs):
    df = make_docs([(1, "a\nb"), (2, "a\nb")], extra=("_lines", "_REMOVED"))
    got, names = C.dedup_lines(df)
    assert got.columns[: len(df.columns)] == df.columns and len(names) == 3
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a\nb", 2: ""}


def test_given_table(documents):
    assert found(documents) == plain([(r.doc_id, r.text) for r in documents.collect()])
