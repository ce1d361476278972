"""Forest search: recall, exact ranking, copies, odd vectors."""

import numpy as np
import pytest

from clauseloom.llm import op3_neighbours as N


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def plain(rows, k=10):
    size = 0
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.asarray(v, np.float32).astype(float)
    if not good:
        return {}
    lengths = [len(v) for v in good.values()]
    size = max(set(lengths), key=lambda n: (lengths.count(n), -n))
    ids = np.array([i for i in sorted(good) if len(good[i]) == size])
    x = np.stack([good[i] for i in ids])
    out = {}
    for i in ids[ids % 100 == 0]:
        d = np.sqrt(((x - good[i]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(best)]
    return out


def found(df):
    out = {}
    for r in N.op3_neighbours(df).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_few_rows_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(230)]
    rows += [(1000 + i, rows[100][1], 0) for i in range(40)]  # copies of a query's vector, more than k
    rows += [(400, None, 0), (500, [0.0] * 8, 0), (600, [1.0, None] * 4, 0), (700, [float("nan")] * 8, 0), (800, [float("inf")] + [1.0] * 7, 0), (900, [1.0, 2.0], 0), (None, rows[5][1], 0), (2000, [], 0)]
    rows += [rows[3]]
    got, want = found(frame(spark, rows)), plain(rows)
    assert set(got) == set(want)
    for q in want:
        assert [(r, i) for r, i, _ in got[q]] == [(r, i) for r, i, _ in want[q]]
        assert np.allclose([s for *_, s in got[q]], [s for *_, s in want[q]], atol=1e-12)


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, clustered, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 100)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 64))
    x = centre[rng.integers(12, size=3000)] + 0.1 * rng.normal(size=(3000, 64)) if clustered else rng.normal(size=(3000, 64))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    got, want = found(frame(spark, rows)), plain(rows)
    hits = [len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / 10 for q in want]
    assert set(got) == set(want) and np.mean(hits) >= 0.9
    for q, of in got.items():
        assert [r for r, *_ in of] == list(range(1, 11))
        for _, i, s in of:
            assert abs(s - np.sqrt(((x[q].astype(np.float32).astype(float) - x[i].astype(np.float32)) ** 2).sum())) < 1e-9


def test_nothing(spark):
    assert found(frame(spark, [])) == {}
    assert found(frame(spark, [(0, None, 0), (100, [0.0], 0)])) == {}
    assert found(frame(spark, [(0, [1.0], 0)])) == {}
