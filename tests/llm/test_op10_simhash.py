"""SimHash groups against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from clauseloom.llm import op10_simhash as S
from clauseloom.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(rows, threshold=2):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                label[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, f"{fps[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(map(tuple, S.op10_simhash(df).collect()), key=str)


def near_rows(n=120, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 80, 400]))]
        for _ in range(rng.choice([1, 1, 4])):
            copy = list(base)
            if len(copy) > 50 and rng.random() < 0.8:
                copy[rng.randrange(len(copy))] = "Édit"
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    return rows


def test_brute_force(make_docs):
    rows = near_rows()
    want = plain_groups(rows)
    assert len({r[2] for r in want}) < len(rows) - 20
    assert found(make_docs(rows)) == want


def test_full_anchors_are_split(make_docs, monkeypatch):
    rows = near_rows(60, 9)
    monkeypatch.setattr(S, "AT_ANCHOR", 1)
    assert found(make_docs(rows)) == plain_groups(rows)
    u, v = np.array([3, 3, 3, 9]), np.array([0, 1, 7, 9])
    parts = list(S._compare(2)(iter([__import__("pyarrow").RecordBatch.from_arrays([u, v], ["anchor", "fp"])])))
    assert sum(p.column(1).null_count for p in parts) == 3


@pytest.mark.parametrize("threshold", [0, 1, 2])
def test_thresholds(spark, threshold):
    rng = random.Random(threshold)
    fps = {rng.getrandbits(63) for _ in range(40)}
    for f in list(fps):
        for _ in range(rng.randrange(6)):
            f ^= 1 << rng.randrange(63)
            fps.add(f)
    fps = sorted(fps)
    got = components(S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), threshold))
    of = {f: f for f in fps} | {r.node: r.label for r in got.collect()}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= threshold:
                assert of[a] == of[b]
    groups = {}
    for f in fps:
        groups.setdefault(of[f], []).append(f)
    for members in groups.values():  # each is connected
        reach, todo = {members[0]}, [members[0]]
        while todo:
            a = todo.pop()
            new = [b for b in members if b not in reach and (a ^ b).bit_count() <= threshold]
            reach.update(new)
            todo += new
        assert reach == set(members)


def test_every_anchor_pair_is_met():
    rng = random.Random(1)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        at = [set(S.anchors(np.array([x], np.uint64))[1].tolist()) for x in (a, b)]
        assert at[0] & at[1]


def test_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, "x" * 300_000), (None, "alone here")]
    df = make_docs(rows, extra=("fp", "u", "V", "component_id", "root"))
    assert found(df) == plain_groups(rows)
    assert found(make_docs([])) == []


def test_keep_one(make_docs):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "A b c d"), (10, "other words here now")]
    df = make_docs(rows, extra=("_key", "_ORDER"))
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 10, 3, None]
    assert S.keep_one(make_docs([])).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (None, 3)]
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6)]
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
    chain = spark.range(60).selectExpr("id as u", "id + 1 as v")
    assert {r.label for r in components(chain).collect()} == {0}


def test_given_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(documents) == plain_groups(rows)
