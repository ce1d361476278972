"""Pfair mixing: schedule properties, plain running sums, order of written files."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clauseloom.llm import op1_mixing as M


@pytest.mark.parametrize("weights,rest,period", [({"a": 0.5, "b": 0.25}, 0.25, 8), ({"a": 0.9}, 0.1, 1000), ({f"s{i}": i + 1 for i in range(20)}, 3, 100), ({}, 1, 7)])
def test_every_prefix_is_within_one_block(weights, rest, period):
    parts = M.quotas(weights, rest, period)
    assert sum(parts.values()) == period and min(parts.values()) >= 1
    slots = M.schedule(parts)
    assert sorted(t for of in slots.values() for t in of) == list(range(period))
    for k, of in slots.items():
        for t in range(period + 1):
            assert abs(sum(s < t for s in of) - t * parts[k] / period) < 1
        for i, s in enumerate(of, 1):
            assert (i - 1) * period // parts[k] <= s < -(-i * period // parts[k])


def test_bad_weights():
    with pytest.raises(ValueError):
        M.quotas({"a": 0}, 1)
    with pytest.raises(ValueError):
        M.quotas({"a": 1, "b": 1}, 1, 2)


def plain(rows, weights, rest, period, block):
    parts = M.quotas(weights, rest, period)
    slots = M.schedule(parts)
    done = dict.fromkeys(parts, 0)
    out = []
    for i, n, source in sorted(rows, key=lambda r: (hashlib.md5(f"{M.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])):
        g = f"={source}" if source in weights else "*"
        b = done[g] // block
        out.append((i, g, done[g], b, b // parts[g] * period + slots[g][b % parts[g]]))
        done[g] += n
    return sorted(out, key=str)


def test_against_plain_sums(make_docs):
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([0, 1, 30, 500]), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)]
    rows += [(3, "x" * 30, "en", "a"), (None, None, "en", "b")]
    docs = make_docs(rows, extra=("_slot", "_START", "block"))
    args = dict(weights={"a": 0.5, "b": 0.2}, rest=0.3, period=10, block_chars=200)
    got, n = M.place(docs, **args)
    assert got.columns[: len(docs.columns)] == docs.columns
    found = sorted((tuple(r) for r in got.select("doc_id", n["group"], n["start"], n["block"], n["slot"]).collect()), key=str)
    assert found == plain([(r[0], len(r[1] or ""), r[3]) for r in rows], args["weights"], 0.3, 10, 200)


def test_files_follow_the_schedule(spark, make_docs, tmp_path):
    rows = [(i, "y" * (i % 90), "en", "abc"[i % 3]) for i in range(200)]
    docs = make_docs(rows)
    args = dict(weights={"a": 0.5}, rest=0.5, period=4, block_chars=100)
    M.mix(docs, **args).write.parquet(str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.columns == docs.columns and back.count() == 200
    order = back.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r")).orderBy("f", "r").collect()
    placed, n = M.place(docs, **args)
    at = {r[0]: (r[1], r[2]) for r in placed.select("doc_id", n["slot"], n["start"]).collect()}
    keys = [at[r.doc_id] for r in order]
    assert keys == sorted(keys)


def test_no_rows(make_docs):
    assert M.op1_mixing(make_docs([])).collect() == [] and M.mix(make_docs([])).collect() == []
