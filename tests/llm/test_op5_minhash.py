"""MinHash fingerprints against plain text handling and true Jaccard similarity."""

import hashlib
import random

import numpy as np

from clauseloom.llm import op5_minhash as M


def sets(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def docs_of(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"wörd{i}" for i in range(400)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 40, 300, 1500])))
        rows.append((rng.randrange(10**6) * 1000 + i, text))
        if rng.random() < 0.3:
            rows.append((rng.randrange(10**6) * 1000 + 500 + i, text))
    return rows


def check(rows, got):
    order = sorted(rows, key=lambda r: -r[0])
    found = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    prints = {}
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(sets(text), sets(changed))) < 0.25
        assert abs(r.near_next - jaccard(sets(text), sets(following))) < 0.25
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        if changed == text:
            assert r.near_edited == 1.0


def test_against_plain(make_docs):
    rows = docs_of()
    check(rows, M.op5_minhash(make_docs(rows, extra=("range", "LAST", "signature"))).collect())


def test_small_tables(make_docs):
    for rows in ([(5, "one two three")], [(5, None)], [(1, ""), (2, "a b c d e f g h i")], [(-7, "x y z"), (10**15, "é" * 10_000), (3, None)]):
        check(rows, M.op5_minhash(make_docs(rows)).collect())
    assert M.op5_minhash(make_docs([])).collect() == []


def test_repeated_and_null_ids(make_docs):
    rows = [(1, "a b c"), (1, "a b c"), (None, "d e f"), (2, "g h i")]
    got = M.op5_minhash(make_docs(rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
    changed = {r.doc_id: r.edited_sha256 for r in got}
    # In order: 2, 1, 1, null, and then 2 again.
    for i, want in ((2, "g h" + " i"[:1] + "a"), (None, "d e" + " f"[:1] + "g")):
        assert changed[i] == hashlib.sha256(want.encode()).hexdigest()


def test_estimates_are_unbiased():
    rng = random.Random(1)
    error = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(20):
            base = [str(rng.random()) for _ in range(300)]
            other = [w if rng.random() < share else str(rng.random()) for w in base]
            a, b = (M.shingles(" ".join(w).encode()) for w in (base, other))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            error.append(M.likeness(M.signature(a), M.signature(b)) - true)
    assert abs(np.mean(error)) < 0.015 and np.std(error) < 0.05


def test_given_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(rows, M.op5_minhash(documents).collect())


def test_leaders(make_docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(25):
        base = [rng.choice(words) for _ in range(200)]
        rows.append((i * 10, " ".join(base)))
        for k in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(200)] = "edit"
            rows.append((i * 10 + k + 1, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "short"), (903, "short"), (None, "short"), (902, "short")]
    got = M.leaders(make_docs(rows, extra=("node", "Bands"))).collect()
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.leader_id in (None, 902)
            continue
        true = jaccard(sets(text[r.doc_id]), sets(text[r.leader_id]))
        assert r.leader_id <= r.doc_id and r.jaccard >= 0.8 and abs(true - r.jaccard) < 1e-9
        near = [j for j in text if j is not None and j < r.doc_id and sets(text[j]) and jaccard(sets(text[j]), sets(text[r.doc_id])) >= 0.95]
        if near:
            assert r.leader_id < r.doc_id
    assert M.leaders(make_docs([])).collect() == []


def similar_rows():
    """Chains and stars of edited copies, whose members are similar to each other and not to the first."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(5000)]
    rows, i = [], 0
    for n, size in ((12, 60), (8, 200), (30, 120)):
        for _ in range(4):
            text = [rng.choice(words) for _ in range(size)]
            start = list(text)
            for k in range(n):
                rows.append((i, " ".join(text)))
                i += 1
                text = list(text if k % 3 else start)
                for _ in range(max(1, size // 80)):
                    at = rng.randrange(len(text))
                    text[at : at + 1] = [rng.choice(words)] * rng.randrange(1, 3)
    ids = list(range(i))
    rng.shuffle(ids)
    return [(ids[k], t) for k, t in rows] + [(5000, None), (5001, "")]


def true_classes(rows):
    """By Jaccard similarity of all pairs."""
    found = [(i, sets(t)) for i, t in sorted(rows)]
    label = {i: i for i, _ in found}
    pairs = [(a, b) for k, (b, y) in enumerate(found) for a, x in found[:k] if jaccard(x, y) >= 0.8]
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {i: new if g == old else g for i, g in label.items()}
    return label, pairs


def test_every_pair_is_in_one_class(make_docs, monkeypatch):
    rows = similar_rows()
    want, pairs = true_classes(rows)
    assert len(pairs) > 150 and len(set(want.values())) < len(rows) - 80
    got = {r.doc_id: r.class_id for r in M.op5_minhash(make_docs(rows)).collect()}
    assert got == want
    monkeypatch.setattr(M, "CELL", 3)  # several cells a band
    assert {r.doc_id: r.class_id for r in M.leaders(make_docs(rows)).collect()} == want


def hot_rows(n, size, share, seed):
    """Texts of one pattern, each of which keeps ``share`` of its words: alike, but less than 0.8."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    return [(i, " ".join(w if rng.random() < share else f"x{rng.random()}" for w in base)) for i in range(n)]


def test_followers_of_a_hot_band_are_compared(make_docs, monkeypatch):
    """All share bands, few are links: what the cells give out stays below their number of rows."""
    rows = hot_rows(150, 400, 0.975, 5)
    copies = [(1000 + i, t.replace("b7 ", "edit ").replace("b300 ", "edit ")) for i, t in rows[:40]]
    want, pairs = true_classes(rows + copies)
    assert 40 <= len(pairs) < 400
    made = []
    plain = M._rest
    monkeypatch.setattr(M, "_rest", lambda *a: made.append(M.cut_lineage(plain(*a))) or made[0])
    monkeypatch.setattr(M, "CELL", 64)
    got = {r.doc_id: r.class_id for r in M.classes(make_docs(rows + copies)).collect()}
    assert got == want
    assert made[0].count() < 32 * len(want)


def test_cells_give_a_forest():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.choice(10**6, 500, replace=False)
    sets = [np.sort(np.concatenate([np.delete(base, rng.choice(500, 40, replace=False)), rng.integers(2 * 10**6, 10**9, 20)])).astype("<u4") for _ in range(300)]
    n = len(sets)
    cols = {"band": np.zeros(2 * n, np.int64), "a": np.zeros(2 * n, np.int32), "b": np.zeros(2 * n, np.int32), "side": np.repeat([0, 1], n).astype(np.int32), "node": np.tile(np.arange(n), 2), "label": np.tile(np.arange(n), 2), "number": np.full(2 * n, 1, np.int32)}
    arrays = [pa.array(c) for c in cols.values()] + [pa.array([[5, 6]] * (2 * n), pa.list_(pa.int32())), pa.array([s.tobytes() for s in sets] * 2, pa.binary())]
    batch = pa.RecordBatch.from_arrays(arrays, [*cols, "bands", "shingles"])
    assert sum(b.num_rows for b in M._across(0.8)(iter([batch]))) == 0  # they share the first band, which is not this one
    batch = batch.set_column(6, "number", pa.array(np.zeros(2 * n, np.int32)))
    got = [r for b in M._across(0.8)(iter([batch.slice(0, 100), batch.slice(100)])) for r in b.to_pylist()]
    assert len(got) == n - 1
    for r in got:
        x, y = sets[r["u"]], sets[r["v"]]
        assert abs(r["jaccard"] - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 1e-12 and r["jaccard"] >= 0.8


def test_ranges_of_ids(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 50, 200):
        bounds = [float(b) for b in sorted(random.Random(n).sample(range(1000), n), reverse=True)]
        got = spark.range(-5, 1005).select("id", M._place(F.col("id").cast("double"), bounds).alias("p")).collect()
        assert all(r.p == sum(b > r.id for b in bounds) for r in got)
