"""License scans against plain code for the base phrases, and planted, changed notices."""

import random
import re

from clauseloom.llm import op13_licenses as L

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
BASE = [(["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl")]


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows):
    out = []
    for i, text in rows:
        words = words_of(text)
        places = [(k, label) for phrase, label in BASE for k in range(len(words)) if words[k : k + len(phrase)] == phrase]
        starts = [p[0] for p in places]
        out.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[1] for p in places}))))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r)[:6] for r in L.op13_licenses(docs).collect()), key=str)


def random_rows(n, seed):
    rng = random.Random(seed)
    bits = ["MIT", "license", "License", "Apache", "general", "public", "General Public License", "mit-license", "MİT license", "Kelvin", "the", "été", "9", "licenses", "\n", ".", "mit license" * 2]
    return [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(n)]


def test_base_phrases(make_docs):
    rows = random_rows(300, 1) + [(400, None), (401, ""), (402, "license"), (403, "x"), (None, "the MIT license"), (404, "mit license " * 20_000), (404, "mit license " * 20_000), (405, "w" * 200_000)]
    assert found(make_docs(rows, extra=("k1", "H", "label", "base"))) == plain(rows)
    assert found(make_docs([])) == []


def test_copies_share_a_scan(make_docs):
    rows = [(i, "Released under the MIT License. " + L.NOTICES[0][0]) for i in range(200)] + [(None, "plain words"), (7, "plain words")]
    got = L.op13_licenses(make_docs(rows)).collect()
    assert len(got) == 202 and {(r.n_base, r.first_word, r.labels) for r in got} == {(1, 3, "mit"), (0, None, "")}


def changed(words, rng, rate):
    out = []
    for w in words:
        x = rng.random()
        if x < rate / 3:
            continue
        if x < rate * 2 / 3:
            out.append("blah")
        out.append("other" if rate * 2 / 3 <= x < rate else w)
    return " ".join(out)


def test_changed_notices_are_found(make_docs):
    rng = random.Random(3)
    filler = [f"word{i}" for i in range(400)]
    rows, expected = [], {}
    for n, (text, label) in enumerate(L.NOTICES):
        words = words_of(text)
        for copy in range(6):
            rate = 0.0 if copy < 3 or len(words) < 25 else 0.02
            before, after = (" ".join(rng.choice(filler) for _ in range(rng.randrange(50))) for _ in range(2))
            i = n * 10 + copy
            rows.append((i, f"{before}\n{changed(words, rng, rate).upper() if copy % 2 else changed(words, rng, rate)}\n{after}"))
            expected[i] = label, rate
    got = {r.doc_id: r for r in L.op13_licenses(make_docs(rows)).collect()}
    exact = [i for i, (_, rate) in expected.items() if not rate]
    assert all(expected[i][0] in got[i].labels.split(",") and got[i].score == 1.0 for i in exact)
    edited = [i for i, (_, rate) in expected.items() if rate]
    hit = sum(expected[i][0] in got[i].labels.split(",") for i in edited)
    assert hit >= 0.8 * len(edited), (hit, len(edited))


def test_scattered_words_are_no_notice(make_docs):
    rng = random.Random(4)
    words = words_of(L.NOTICES[0][0])
    shuffled = [rng.sample(words, len(words)) for _ in range(30)]
    # Single runs of a notice, far from each other.
    torn = [" ".join(" ".join(words[k : k + 5]) + " x" * 40 for k in range(0, len(words), 5)) for _ in range(2)]
    rows = [(i, " ".join(w)) for i, w in enumerate([*shuffled, *(t.split() for t in torn)])]
    got = L.op13_licenses(make_docs(rows)).collect()
    assert all(r.labels == "" and r.score == 0.0 for r in got)


def test_half_a_notice_is_none(make_docs):
    words = words_of(L.NOTICES[6][0])
    rows = [(0, " ".join(words[: len(words) // 2])), (1, " ".join(words) + " and " + " ".join(words)), (2, "Licensed under CC BY 4.0"), (3, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.labels, r.score) for r in L.op13_licenses(make_docs(rows)).collect()}
    assert got == {0: ("", 0.0), 1: ("bsd", 1.0), 2: ("cc-by", 1.0), 3: ("cc-by-nc", 1.0)}
