"""Importance resampling against plain code, and the quickselect against sorting."""

import hashlib
import math
import random
import re
import zlib

import pytest

from clauseloom.llm import op12_resampling as R

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, run):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % R.BUCKETS for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, run=1, percent=10, least=20):
    s, t = [0] * R.BUCKETS, [0] * R.BUCKETS
    for _, text in rows:
        for b in features(text, run):
            s[b] += 1
    for text in target:
        for b in features(text, run):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + R.BUCKETS) / ((s[b] + 1) * (sum(t) + R.BUCKETS)))) for b in range(R.BUCKETS)]
    out = []
    for i, text in rows:
        own = [gain[b] for b in features(text, run)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{R.SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], R.LAST if r[0] is None else r[0], r[1]))
    for k, r in enumerate(enough[: len(enough) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def found(docs, target, **parameters):
    return sorted((tuple(r) for r in R.resample(docs, target, **parameters).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def random_rows(n, seed):
    rng = random.Random(seed)
    bank = ["alpha", "Beta", "gamma", "été", "ÉTÉ", "x9", "9", "co-op", "don't", "日本", "K", "_", "delta\x00mu"]
    return [(i * 3, " ".join(rng.choice(bank) for _ in range(rng.randrange(60)))) for i in range(n)]


TARGET = ["Alpha alpha GAMMA x9 日本", None, "", "beta beta delta"]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")


@pytest.mark.parametrize("run", [1, 2, 3])
def test_against_plain(make_docs, target, run):
    rows = random_rows(300, run) + [(1, None), (2, ""), (5, "... --- !!!"), (None, "Alpha " * 30), (4, "a" * 100_000 + " b")]
    expected = plain(rows, TARGET, run)
    assert sum(r[4] is not None for r in expected) > 10
    assert found(make_docs(rows, extra=("minus", "at", "Score")), target, run=run) == expected


def test_texts_longer_than_a_stretch(make_docs, target, monkeypatch):
    monkeypatch.setattr(R, "STRETCH", 7)
    rows = random_rows(40, 9)
    for run in (1, 3):
        for _, text in rows:
            got = [b for _, part in R.buckets(text.encode(), run) for b in part.tolist()]
            assert sorted(got) == sorted(features(text, run))


def test_repeated_rows_and_ties(make_docs, target):
    rows = random_rows(60, 4)
    rows += [rows[7]] * 100 + [(rows[8][0], "Alpha " * 25), (rows[8][0], "Alpha " * 25), (None, "gamma " * 22), (None, "gamma " * 22)]
    for percent in (10, 50, 100):
        assert found(make_docs(rows), target, percent=percent) == plain(rows, TARGET, percent=percent)


def test_nothing_to_draw(make_docs, spark, target):
    assert found(make_docs([]), target) == []
    rows = [(k, "alpha " * 25) for k in range(9)]
    assert found(make_docs(rows), target) == plain(rows, TARGET)
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(make_docs(rows), none, percent=50) == plain(rows, [], percent=50)


def test_quickselect(spark):
    rng = random.Random(6)
    keys = sorted((rng.randrange(12), rng.randrange(40)) for _ in range(1500))
    df = spark.createDataFrame(keys, "a long, b long").repartition(4).cache()
    for k in (1, 2, 700, 1499, 1500):
        assert R.kth_key(df, ["a", "b"], k, seed=k, pivots=5) == keys[k - 1]
    same = spark.createDataFrame([(1, 1)] * 50, "a long, b long")
    assert R.kth_key(same, ["a", "b"], 30) == (1, 1)
    with pytest.raises(ValueError):
        R.kth_key(same, ["a", "b"], 51)
