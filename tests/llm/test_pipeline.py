"""The pipeline against plain code, stage by stage, on a small table."""

import hashlib
import random

import pytest
import sentencepiece

import corpus_pipeline as P
from clauseloom.llm import op1_mixing, op2_sentencepiece, op6_language, op9_lines, op10_simhash
from test_op5_minhash import jaccard, sets, similar_rows, true_classes
from test_op6_language import WORDS

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(seed=7, n=150):
    rng = random.Random(seed)
    shared = ["\n".join(" ".join(rng.choice(WORDS["en"]) for _ in range(7)) for _ in range(9)) for _ in range(3)]
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        body = [" ".join(rng.choice(WORDS[lang]) for _ in range(8)) for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.3:
            body.insert(rng.randrange(len(body) + 1), rng.choice(shared))
        text = rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.2 else "\n".join(body)
        if rows and rng.random() < 0.15:  # a near copy, beyond two bits of SimHash
            words = max((r[1] for r in rng.sample(rows, min(5, len(rows)))), key=len).split(" ")
            words[len(words) // 2] = rng.choice(WORDS[lang])
            text = " ".join([*words, rng.choice(WORDS[lang])])
        rows.append((i, text, lang, rng.choice(["src0", "src0", "src1", "src9", None])))
    rows += [(900, None, "en", "src0"), (901, "12 34", "en", "src1"), (902, "", None, None), (3, rows[3][1], rows[3][2], rows[3][3])]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows_of(), DOCUMENT).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plain(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    field = op6_language.fit(op6_language.training_pieces(docs, op6_language.is_held_out))
    name, score = op6_language.judge(field, [r[1] or "" for r in rows])
    rows = [r for r, a, s in zip(rows, name, score, strict=True) if a != "und" and s >= 0.5]
    # Repeated chunks of lines, from all but their first place.
    count, first = {}, {}
    for r in sorted(rows):
        for s, e, *_, chunk in op9_lines._several(r[1].encode()):
            count[chunk] = count.get(chunk, 0) + 1
            first.setdefault(chunk, (r[0], s))
    cut = []
    for r in rows:
        lines, ranges = op9_lines.chunks(r[1].encode())
        left = [True] * len(lines)
        for s, e in ranges:
            chunk = b"\n".join(lines[s:e])
            if e - s > 1 and count[chunk] > 1 and first[chunk] != (r[0], s):
                left[s:e] = [False] * (e - s)
        cut.append((r[0], b"\n".join(x for x, k in zip(lines, left, strict=True) if k).decode(), *r[2:4]))
    # One of each group of texts that are 0.8 alike, on shingles of five words in lower case.
    shingled = [sets(r[1].lower()) for r in cut]
    group = list(range(len(cut)))
    for i in range(len(cut)):
        for j in range(i):
            if jaccard(shingled[i], shingled[j]) >= 0.8 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, cut, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    fps = [op10_simhash.fingerprint(r[1].encode()) for r in cut]
    assert any(group[i] == group[j] and (fps[i] ^ fps[j]).bit_count() > 2 for i in range(len(cut)) for j in range(i))
    kept = sorted({r for g, r in zip(group, cut, strict=True) if least[g] == r[0]}, key=str)
    # The order of the mixture.
    parts = op1_mixing.quotas(op1_mixing.WEIGHTS, op1_mixing.REST)
    slots, done, placed = op1_mixing.schedule(parts), dict.fromkeys(parts, 0), []
    for r in sorted(kept, key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
        g = f"={r[3]}" if r[3] in op1_mixing.WEIGHTS else "*"
        b = done[g] // op1_mixing.BLOCK_CHARS
        placed.append((b // parts[g] * op1_mixing.PERIOD + slots[g][b % parts[g]], done[g], r))
        done[g] += len(r[1])
    library = sentencepiece.SentencePieceProcessor(model_file=op2_sentencepiece.model_path())
    return [(r[0], *r[2:4], library.encode(r[1])) for *_, r in sorted(placed, key=lambda x: x[:2])]


def test_against_plain(spark, table):
    got = P.run(spark, table).orderBy("shard", "row").collect()
    want = plain(spark, table)
    assert 20 < len(want) < 140
    assert sorted(map(str, ((r.doc_id, r.lang, r.source, r.ids) for r in got))) == sorted(map(str, want))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_copies", "mix", "encode"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, table).columns == docs.columns
    placed = P.STAGES[-1][1](spark, docs.unionByName(docs.limit(0)), table)
    assert placed.columns[:3] == ["doc_id", "lang", "source"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_without_files(spark):
    docs = spark.createDataFrame([(1, "the end", "en", "src0", 7)], DOCUMENT)
    assert [tuple(r)[:6] for r in P.encode(spark, docs, "").collect()] == [(1, "en", "src0", None, None, 2)]


def test_near_copies_against_true_jaccard(make_docs):
    """Copies of five-word Jaccard similarity 0.8 and more go, whatever bits of SimHash they differ in."""
    rows = similar_rows()
    want, pairs = true_classes(rows)
    text = dict(rows)
    fp = {i: op10_simhash.fingerprint((t or "").encode()) for i, t in rows}
    assert sum((fp[a] ^ fp[b]).bit_count() > 2 and text[a] != text[b] for a, b in pairs) > 100
    shout = [(i + 6000, t.upper()) for i, t in rows[:20]]
    got = P.near_copies(None, make_docs([*rows, *shout, (None, rows[0][1])]), "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(set(want.values()))
    assert sum(r.doc_id is None for r in got) == 1


def test_near_copies_follow_simhash_links(make_docs):
    """Texts within two bits of SimHash are one group, however few sets of shingles they share; other texts
    of an id don't tie groups together."""
    base = "in the end " * 400
    rows = [(1, base + " ".join(f"a{i}" for i in range(12))), (2, base + " ".join(f"b{i}" for i in range(12)))]
    fp = [op10_simhash.fingerprint(t.encode()) for _, t in rows]
    assert (fp[0] ^ fp[1]).bit_count() <= 2 and jaccard(*(sets(t) for _, t in rows)) < 0.8
    alone = [(5, "one text that nothing here is like at all"), (6, "and some other words of another one altogether")]
    got = P.near_copies(None, make_docs([*rows, *alone, (7, alone[0][1]), (7, alone[1][1])]), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 5, 6]
