"""The small minutes document: clauses, digest, discussions, pairs and triples."""

import json

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators import dialog as D
from clauseloom.operators import weights as W
from clauseloom.sources import tables as T
from tests.conftest import rows

MINUTES = {
    "assembly": {
        "utterances": [
            {"speaker": "◯議長（佐藤一郎君）", "utterance": ["三番山田太郎君。"]},
            {"speaker": "◯三番（山田太郎君）", "utterance": ["防災対策について、知事に伺います。", "次に、待機児童の解消を求めます。見解は？"]},
            {"speaker": "◯知事（鈴木花子君）", "utterance": ["防災対策を、着実に進めてまいります。"]},
            {"speaker": "◯福祉局長（田中次郎君）", "utterance": ["待機児童の解消に向け、保育所の整備を進めます。"]},
            {"speaker": "◯議長（佐藤一郎君）", "utterance": ["五番高橋君。"]},
            {"speaker": "◯五番（高橋三郎君）", "utterance": ["水道事業について伺います。"]},
            {"speaker": "◯知事（鈴木花子君）", "utterance": ["水道事業の強化に取り組みます。"]},
            {"speaker": "◯議長（佐藤一郎君）", "utterance": ["散会します。"]},
        ]
    },
    "digest": {
        "speakers": [
            {
                "speaker_name": "山田太郎（無所属）",
                "summury": "防災と子育て",
                "policies": [
                    {"title": "防災対策", "utterance": "(1)防災を進めよ。〔２〕備蓄は。", "replies": [{"who": "知事（鈴木）", "text": "(1)着実に進める。"}]},
                    {"title": "待機児童の解消", "utterance": "解消を求める。", "replies": [{"who": "福祉局長", "text": "整備を進める。"}]},
                ],
            }
        ]
    },
}


@pytest.fixture(scope="module")
def meetings(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("minutes")
    (folder / "一般質問(要旨)1月1日.json").write_text(json.dumps(MINUTES, ensure_ascii=False), encoding="utf-8")
    (folder / "代表質問.json").write_text(json.dumps(MINUTES, ensure_ascii=False), encoding="utf-8")
    return T.read_meetings(spark, str(folder))


@pytest.fixture(scope="module")
def clauses(meetings):
    return D.flatten_assembly(meetings).cache()


@pytest.fixture(scope="module")
def digest(meetings):
    return D.flatten_digest(meetings).cache()


@pytest.fixture(scope="module")
def discussions(clauses):
    return D.segment_discussions(clauses, X.is_boundary(F.col("speaker_name"), F.col("utterance"))).cache()


def test_only_prefixed_files_are_read(meetings):
    assert rows(meetings, "meeting") == [("一般質問(要旨)1月1日",)]


def test_clauses(clauses):
    found = [tuple(r) for r in clauses.orderBy("id").select("id", "speaker_name", "utterance", "label").collect()]
    assert found == [
        (0, "議長", "三番山田太郎君。", 1),
        (1, "山田太郎", "防災対策について、", 2),
        (2, "山田太郎", "知事に伺います。", 2),
        (3, "山田太郎", "次に、", 3),
        (4, "山田太郎", "待機児童の解消を求めます。", 3),
        (5, "山田太郎", "見解は？", 3),
        (6, "知事", "防災対策を、", 4),
        (7, "知事", "着実に進めてまいります。", 4),
        (8, "福祉局長", "待機児童の解消に向け、", 5),
        (9, "福祉局長", "保育所の整備を進めます。", 5),
        (10, "議長", "五番高橋君。", 6),
        (11, "高橋三郎", "水道事業について伺います。", 7),
        (12, "知事", "水道事業の強化に取り組みます。", 8),
        (13, "議長", "散会します。", 9),
    ]


def test_tokens(clauses):
    found = {r["id"]: r["t"] for r in clauses.select("id", X.tokenize(F.col("utterance")).alias("t")).collect()}
    assert found[4] == ["待機児童", "解消"]
    assert found[3] == []
    assert found[12] == ["水道事業", "強化"]


def test_digest(digest):
    found = [tuple(r) for r in digest.orderBy("id").select("id", "speaker_name", "utterance", "kind").collect()]
    assert found == [
        (0, "山田太郎", "防災と子育て", D.SUMMARY),
        (1, "山田太郎", "防災対策", D.TITLE),
        (2, "山田太郎", "防災を進めよ。", D.POLICY),
        (3, "山田太郎", "備蓄は。", D.POLICY),
        (4, "知事（鈴木）", "着実に進める。", D.REPLY),
        (5, "山田太郎", "待機児童の解消", D.TITLE),
        (6, "山田太郎", "解消を求める。", D.POLICY),
        (7, "福祉局長", "整備を進める。", D.REPLY),
    ]


def test_digest_follows_the_order_of_the_keys(spark):
    raw = '{"speakers": [{"speaker_name": "甲", "summury": "要", "policies": [{"replies": [{"a": "乙", "b": "答"}], "title": "題", "note": "x", "utterance": "問"}]}]}'
    made = spark.createDataFrame([("m", raw)], "meeting string, json string").select("meeting", F.from_json("json", D.DIGEST_TYPE).alias("digest"))
    assert [r["utterance"] for r in D.flatten_digest(made).orderBy("id").collect()] == ["要", "答", "題", "問"]


def test_discussions(discussions):
    assert rows(discussions, "discussion", "id") == sorted([(0, i) for i in range(1, 10)] + [(1, 11), (1, 12)], key=str)


@pytest.mark.parametrize("block", [2, 65536])
def test_adjacent_pairs(clauses, block):
    found = rows(D.adjacent_pairs(D.eligible_clauses(clauses), block), "anchor", "positive")
    assert found == sorted([(4, 7), (7, 8), (7, 9), (8, 11), (9, 11), (11, 12)], key=str)


def test_triples_v3(discussions):
    found = D.triple_ids_v3(discussions, "s").collect()
    allowed = {(7, 4): {8, 9}, (8, 4): {6, 7}, (9, 4): {6, 7}}
    assert {(r["anchor"], r["positive"]) for r in found} == set(allowed)
    assert all(r["other"] in allowed[(r["anchor"], r["positive"])] for r in found)


def test_triples_v2_never_pair_a_positive_as_negative(clauses):
    eligible = D.eligible_clauses(clauses)
    pairs = {(r["anchor"], r["positive"]) for r in D.adjacent_pairs(eligible).collect()}
    triples = D.triple_ids_v2(eligible, "s").collect()
    assert triples and all((t["anchor"], t["other"]) not in pairs and t["anchor"] != t["other"] for t in triples)
    assert {(t["anchor"], t["positive"]) for t in triples} <= pairs
    negatives = [(t["anchor"], t["other"]) for t in triples]
    assert len(negatives) == len(set(negatives))


@pytest.mark.parametrize("all_in_discussions", [True, False])
def test_corpus_ratio(clauses, discussions, all_in_discussions):
    made = W.corpus_ratio(discussions, None if all_in_discussions else D.without_chair(clauses))
    found = {(r["questioner"], r["respondent"], r["word"]): r["ratio"] for r in made.collect()}
    a, b, c = ("山田太郎", "知事"), ("山田太郎", "福祉局長"), ("高橋三郎", "知事")
    expected = {(*a, w): v for w, v in {"防災対策": 1, "知事": 1, "見解": 1, "着実": 1, "待機児童": 0.5, "解消": 0.5}.items()}
    expected |= {(*b, w): v for w, v in {"防災対策": 0.5, "知事": 1, "解消": 1, "待機児童": 1, "見解": 1, "保育所": 1, "整備": 1}.items()}
    expected |= {(*c, w): 1 for w in ("水道事業", "強化")}
    assert found == expected


def test_titles_and_respondents(digest):
    expected = sorted([("防災対策", "山田太郎", "知事（鈴木）"), ("待機児童の解消", "山田太郎", "福祉局長")], key=str)
    # The policy rows between a title and its reply are filtered away first.
    assert rows(D.title_first_reply(digest), "short_summary", "questioner", "respondent") == expected
    assert rows(D.debater_pairs(digest), "short_summary", "questioner", "respondent") == expected


@pytest.mark.parametrize("block", [1, 3, 65536])
def test_repeated_title_gets_its_position(spark, block):
    kinds = [(D.TITLE, "a"), (D.POLICY, "x"), (D.TITLE, "b"), (D.TITLE, "b"), (D.REPLY, "y"), (D.TITLE, "a"), (D.REPLY, "z"), (D.REPLY, "w")]
    data = [("m", i, "s", t, k) for i, (k, t) in enumerate(kinds)]
    digest = spark.createDataFrame(data, "meeting string, id long, speaker_name string, utterance string, kind string")
    found = [tuple(r) for r in D.digest_clause_table(digest, block).orderBy("id").select("id", "title", "clause").collect()]
    # The first b has no clause, so the second keeps the plain title.
    assert found == [(0, "a", "x"), (1, "b", "y"), (2, "a5", "z"), (3, "a5", "w")]


@pytest.mark.parametrize(
    "raw,name",
    [
        ("◯三番（君島花子君）", "島花子"),
        ("◯三番（山田）", None),
        ("◯三番（山田2君）", None),
        ("◯議長（佐藤一郎君）", "議長"),
        ("知事", "知事"),
        ("◯財務局長（甲）代理（乙）", "財務局長"),
    ],
)
def test_normalize_speaker(spark, raw, name):
    df = spark.createDataFrame([(raw,)], "s string").select(X.normalize_speaker(F.col("s")).alias("n"))
    assert df.first()["n"] == name


def test_text_functions(spark):
    # A mention runs over every word character, kana and the 12 included.
    df = spark.createDataFrame([("【甲】@user_1は12.5円（税）、ア。ｱ１２",)], "s string")
    assert df.select(X.clean_text(F.col("s")).alias("c")).first()["c"] == " 甲 .円 税 アｱ"
    split = spark.createDataFrame([("。。一、二！\n三",)], "s string").select(X.split_clauses(F.col("s")).alias("c")).first()["c"]
    assert split == ["一、", "二！", "\n三"]
    wakati = spark.createDataFrame([("水のアpark",)], "s string").select(X.tokenize_wakati(F.col("s")).alias("c")).first()["c"]
    assert wakati == ["水", "ア", "park"]
    hook = X.user_tokenizer(lambda s: s.split("の"))
    assert spark.createDataFrame([("水の道",)], "s string").select(hook(F.col("s")).alias("c")).first()["c"] == ["水", "道"]


def test_clauses_rebuild_their_paragraph(spark):
    text = "一つ、二つ。三つ！？四つ"
    parts = spark.createDataFrame([(text,)], "s string").select(X.split_clauses(F.col("s")).alias("c")).first()["c"]
    assert "".join(parts) == text.replace("！？", "！")


def test_clauses_are_cut_without_looking_for_runs(spark):
    """The same clauses as the pattern of a run and its mark."""
    odd = ["", None, ".", "..a", "a", "a.", "a..b", "。a。。", "a\n.\r\nb!?", "\U0001f600.\U0001f600", "]^-.", " . "]
    df = spark.createDataFrame([(s,) for s in odd], "s string")
    pattern = F.regexp_extract_all("s", F.lit(f"[^{X.CLAUSE_END_WESTERN}]+[{X.CLAUSE_END_WESTERN}]?"), F.lit(0))
    for row in df.select("s", X.split_clauses(F.col("s"), X.CLAUSE_END_WESTERN).alias("found"), pattern.alias("plain")).collect():
        assert row["found"] == row["plain"], row["s"]

    assert "regexp_extract_all" not in str(X.split_clauses(F.col("s")))


def test_tokens_are_those_of_cleaned_text(spark):
    odd = ["ab[12]cd（ef）gh", "x1@a.5y", "水、道[駅]前ヶー丘アーケード", "ªºß×÷Ÿé @park１２ ＠公園 a1.2b", "１[@x]２。b", "kﬀK", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string")
    runs = r"[\p{IsHan}々〆ヶ]{2,}|[\p{IsKatakana}ー]{2,}|[\p{IsLatin}]{2,}"
    plain = F.regexp_extract_all(X.clean_text(F.col("s")), F.lit(runs), F.lit(0))
    for row in df.select("s", X.tokenize(F.col("s")).alias("found"), plain.alias("plain")).collect():
        assert row["found"] == row["plain"], row["s"]
