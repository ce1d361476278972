"""String expressions over clauses, speakers and words. All stay in the JVM.

Java's ``\\d`` and ``\\w`` know ASCII only, so the Unicode classes are spelled out, and ``(?d)``
makes ``.`` stop at a newline only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They decide the results.
CHAIR_NAMES = ("議長", "副議長")
CLAUSE_END = "。！？!?、"
CLAUSE_END_WESTERN = "。！？!?、."
MEETING_PREFIX = "一般質問"
BOUNDARY_PATTERN = "[一二三四五六七八九十百]+番.+[さん君]+。"
MEMBER_PATTERN = "◯.+番（.+）"
MEMBER_NAME_PATTERN = r"（\P{Nd}+君）"
ENUMERATION_PATTERN = r"[(〔]\p{Nd}+[〕)]"
KANA_ONLY_PATTERN = "^[ぁ-ゖ]+$"
# Runs of Han, of Katakana or of Latin letters. No run begins with ASCII up to @, and most letters are told
# by their ranges, before their script is looked up.
NOUN_RUN_PATTERN = r"(?![\x00-@])(?:[[a-zA-Zà-öø-ÿ]\p{IsLatin}]{2,}|[\p{IsHan}々〆ヶ]{2,}|[\p{IsKatakana}ー]{2,})"
ANY_RUN_PATTERN = r"[\p{IsHan}々〆ヶ]+|[\p{IsKatakana}ー]+|[\p{IsHiragana}]+|[\p{IsLatin}]+"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def split_clauses(text: Column, ends: str = CLAUSE_END) -> Column:
    """Array of clauses; each keeps the one end mark that closes it, runs of only marks vanish."""
    # Cutting after every mark takes a tenth of the time of looking for runs that hold none.
    return F.filter(F.split(text, f"(?<=[{ends}])", -1), lambda part: ~part.isin("", *ends))


def normalize_speaker(raw: Column) -> Column:
    """Bare speaker name. A numbered member is known by the name in parentheses, others by office.

    A numbered member without a usable name gives null.
    """
    name = F.regexp_extract(raw, MEMBER_NAME_PATTERN, 0)
    member = F.when(name != "", F.regexp_replace(name, "[（）君]", ""))
    office = F.regexp_replace(raw, "(?d)◯|（.+）", "")
    return F.when(raw.rlike("(?d)" + MEMBER_PATTERN), member).otherwise(office)


def strip_parenthesis(raw: Column) -> Column:
    return F.regexp_replace(raw, "(?d)（.+）", "")


def split_enumerated(text: Column) -> Column:
    """Parts between markers such as ``(1)`` or ``〔２〕``, without the empty ones."""
    return F.filter(F.split(text, ENUMERATION_PATTERN, -1), lambda part: part != "")


def clean_text(text: Column) -> Column:
    """Brackets become spaces; mentions, numbers and ``、。`` go. The order of the steps matters."""
    out = F.translate(text, "【】（）()［］[]", " " * 10)
    out = F.regexp_replace(out, r"[@＠][\p{L}\p{N}_]+", "")
    out = F.regexp_replace(out, r"\p{Nd}+\.*\p{Nd}*", "")
    return F.translate(out, "、。", "")


def drop_tokens(tokens: Column, min_len: int = 2) -> Column:
    """Drop hiragana-only tokens and those shorter than ``min_len`` code points."""
    return F.filter(tokens, lambda t: ~t.rlike(KANA_ONLY_PATTERN) & (F.length(t) >= min_len))


def tokenize(text: Column, min_len: int = 2) -> Column:
    """Noun-like surface forms: runs of two or more Han, Katakana or Latin letters.

    It keeps the filters of a noun tokenizer (no hiragana-only and no one-letter token) without its
    dictionary, so it makes no part-of-speech test; ``user_tokenizer`` plugs in one that does. No
    run is hiragana or shorter than two, so nothing is left to drop up to a ``min_len`` of 2.
    """
    # As in ``clean_text``, but for the brackets: they are in no run, so they end one as a space does.
    out = F.regexp_replace(text, r"[@＠][\p{L}\p{N}_]+", "")
    out = F.regexp_replace(out, r"\p{Nd}+\.*\p{Nd}*", "")
    for mark in "、。":
        out = F.replace(out, F.lit(mark), F.lit(""))
    runs = F.regexp_extract_all(out, F.lit(NOUN_RUN_PATTERN), F.lit(0))
    return runs if min_len <= 2 else drop_tokens(runs, min_len)


def tokenize_wakati(text: Column) -> Column:
    """All runs of one script, one-letter ones too; only hiragana-only tokens are dropped."""
    return drop_tokens(F.regexp_extract_all(clean_text(text), F.lit(ANY_RUN_PATTERN), F.lit(0)), 1)


def word_terms(tokens: Column) -> Column:
    """Lower-cased words of two or more word characters, found again in space-joined tokens."""
    return F.regexp_extract_all(F.lower(F.array_join(tokens, " ")), F.lit(WORD_PATTERN), F.lit(0))


def user_tokenizer(split: Callable[[str], Sequence[str]]) -> Callable[[Column], Column]:
    """Wrap a Python tokenizer (text to tokens) as an Arrow-batched column function."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: list(split(s)) if s is not None else [])

    return run


def text_length(text: Column) -> Column:
    return F.length(text).cast("long")


def min_length(text: Column, n: int) -> Column:
    """More than ``n`` code points."""
    return F.length(text) > n


def is_boundary(speaker: Column, text: Column, chairs: Sequence[str] = CHAIR_NAMES, pattern: str = BOUNDARY_PATTERN) -> Column:
    """True where a chair calls up a numbered member, which opens a discussion."""
    return speaker.isin(*chairs) & text.rlike("(?d)" + pattern)


def not_chair(speaker: Column, chairs: Sequence[str] = CHAIR_NAMES) -> Column:
    """True for everyone else, also for a speaker without a name."""
    return F.coalesce(~speaker.isin(*chairs), F.lit(True))


def contains_word(text: Column, word: Column) -> Column:
    """Substring test, without word boundaries."""
    return F.contains(text, word)


def file_stem(path: Column) -> Column:
    """Last path part without its extension (a leading dot belongs to the name)."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
