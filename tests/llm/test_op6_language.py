"""The random field: exact sums, held-out accuracy, odd texts."""

import itertools
import random
import zlib

import numpy as np
import pytest

from clauseloom.llm import op6_language as L

WORDS = {
    "en": "the and of to in is that it was for on are with they at this have from one had word but not what all were when your can said there".split(),
    "de": "der die und das ist nicht ein ich zu mit auf für es sich auch dem von werden haben über können straße wenn nur noch nach wie zeit".split(),
    "fr": "le la les des est que une pour dans qui sur pas avec plus être fait nous mais comme où très été deux même leur aussi sans".split(),
}


def labelled(n=240, seed=1, low=30):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(low, 200)))
        rows.append((i, text.capitalize(), lang))
    return rows


def field_of(rows):
    return L.fit([(lang, L.words_of(text)[k : k + 32]) for _, text, lang in rows for k in range(0, 90, 32)], rounds=120)


@pytest.fixture(scope="module")
def field():
    return field_of(labelled())


def test_marginals_are_exact():
    rng = np.random.default_rng(5)
    for lengths in ([1], [4, 0, 7], [3, 1, 2]):
        n, k = sum(lengths), 3
        score, moves = rng.normal(size=(n, k)).astype(np.float32), rng.normal(size=(k, k)).astype(np.float32)
        got = L.marginals(score, np.array(lengths), moves)
        at = 0
        for m in lengths:
            want = np.zeros((m, k))
            for path in itertools.product(range(k), repeat=m) if m else ():
                weight = np.exp(sum(score[at + t, p] for t, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
                for t, p in enumerate(path):
                    want[t, p] += weight
            if m:
                assert np.allclose(got[at : at + m], want / want.sum(axis=1, keepdims=True), atol=1e-5)
            at += m


def test_spans_do_not_matter(monkeypatch):
    rng = np.random.default_rng(6)
    score, moves = rng.normal(size=(500, 4)).astype(np.float32) * 3, rng.normal(size=(4, 4)).astype(np.float32) * 4
    lengths = np.array([200, 1, 0, 33, 64, 202])
    one = L.marginals(score, lengths, moves)
    monkeypatch.setattr(L, "SPAN", 7)
    assert np.allclose(one, L.marginals(score, lengths, moves), atol=1e-4)


def test_switches_are_labelled(field):
    rng = random.Random(3)
    right = total = 0
    for _ in range(30):
        want, words = [], []
        for lang in rng.sample(sorted(WORDS), 2):
            some = [rng.choice(WORDS[lang]) for _ in range(12)]
            words += some
            want += [lang] * 12
        got = L.label_words(field, " ".join(words))
        right += sum(a == b[1] for a, b in zip(want, got, strict=True))
        total += len(want)
    assert right / total > 0.9
    assert np.exp(field.transitions).trace() > np.exp(field.transitions).sum() / 3


def test_held_out_accuracy(make_docs):
    rows = labelled()
    got = {r.doc_id: r for r in L.op6_language(make_docs(rows, extra=("_lang", "_SCORE", "piece"))).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_the_text_counts(make_docs, field):
    rows = [(i, t, None, None) for i, t, _ in labelled(40, 9)]
    one, n, s = L.predict(make_docs(rows), field)
    two, n2, s2 = L.predict(make_docs([(i + 7000, t, "xx", "other") for i, t, *_ in rows]), field)
    assert [tuple(r) for r in one.orderBy("doc_id").select(n, s).collect()] == [tuple(r) for r in two.orderBy("doc_id").select(n2, s2).collect()]


def test_odd_texts(make_docs, field):
    long = " ".join(WORDS["de"] * 3000)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "²³ ½"), (5, long), (5, long), (None, "the and of to"), (6, "Ω"), (7, "x" * 200_000)]
    found, n, s = L.predict(make_docs(rows), field)
    got = {r.doc_id: (r[n], r[s]) for r in found.collect()}
    assert found.count() == len(rows)
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert got[5][0] == "de" and got[None][0] == "en" and got[6][0] in WORDS and got[7][0] in WORDS


def test_nothing_to_learn(make_docs):
    assert L.op6_language(make_docs([])).collect() == []
    got = L.op6_language(make_docs([(1, "the and", None), (2, None, "en")])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_accepted(make_docs):
    rows = labelled() + [(900, "1234", "en"), (901, None, "en")]
    df = make_docs(rows)
    kept = L.accepted(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {900, 901} and len(ids) >= 238


def test_given_table(documents):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    got = [r for r in L.op6_language(documents).collect() if r.held_out]
    assert got and np.mean([lang[r.doc_id] == r.lang_pred for r in got]) >= 0.95
