"""Language identification with a linear-chain conditional random field.

Every word of a text gets a label; a word's features are its affixes, its character n-grams (with
marks for its ends, hashed) and the lexicons it is in; learned transitions tie neighbouring words. The
sums over all labellings are taken by forward-backward, and a text's language is the one with the most
expected words. A text in several languages has words of each label: see ``label_words``.

The field is fitted on a bounded sample of labelled rows, on sequences that join short pieces of
texts of different languages, so that both staying and switching are learned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.llm.common import as_bytes, column, fresh, ragged, ship, steps

#: A run of letters; what has only other numerals is dropped by ``is_word``.
WORD = re.compile(r"[^\W\d_]+")
NONE = "und"

#: Bounds of the sample that the field is fitted on: rows of a language, pieces of a row, words of a piece.
SAMPLE_ROWS = 400
SAMPLE_PIECES = 12
PIECE_WORDS = 32
LEXICON = 400

TABLE = 1 << 16
GRAMS = (2, 3, 4)
AFFIXES = (1, 2, 3)
SEQUENCE = 48
ROUNDS = 300
BATCH = 64
RATE = 0.4
SEED = 17
#: Words of a text that are worked through side by side.
SPAN = 32


def is_word(word: str) -> bool:
    return any(c.isalpha() for c in word)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Field:
    """Weights of hashed features (and, after them, of a lexicon per label), and of transitions."""

    labels: list[str]
    lexicon: dict[str, list[int]]
    weights: np.ndarray
    transitions: np.ndarray

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, how many each word has)."""
        raw = [b"\x02" + w.encode() + b"\x03" for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(size) - size
        byte = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        word = np.repeat(np.arange(len(raw)), size)
        place = np.arange(len(byte)) - start[word]
        left = size[word] - place
        code = byte + np.uint64(1)
        found, of = [], []
        for n in range(2, max(*GRAMS, *AFFIXES) + 2):
            code = code[: len(byte) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + byte[n - 1 :]
            fits = left[: len(code)] >= n
            if n in GRAMS:
                found.append(self._slot(code[fits], n))
                of.append(word[: len(code)][fits])
            if n - 1 in AFFIXES:  # with the mark of the word's end
                first, last = fits & (place[: len(code)] == 0), fits & (left[: len(code)] == n)
                found += [self._slot(code[first], 100 + n), self._slot(code[last], 200 + n)]
                of += [word[: len(code)][first], word[: len(code)][last]]
        known = [(i, TABLE + k) for i, w in enumerate(words) for k in self.lexicon.get(w, ())]
        if known:
            found.append(np.array([k for _, k in known], np.int64))
            of.append(np.array([i for i, _ in known], np.int64))
        number, owner = np.concatenate(found), np.concatenate(of)
        order = np.argsort(owner, kind="stable")
        return number[order], np.bincount(owner, minlength=len(words))

    @staticmethod
    def _slot(code: np.ndarray, salt: int) -> np.ndarray:
        mixed = (code ^ np.uint64(salt * 0x2545F4914F6CDD1D & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(48)).astype(np.int64) % TABLE

    def scores(self, words: list[str]) -> np.ndarray:
        """Of each word the score of each label: its features' weights over the root of their number."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        number, count = self.features(words)
        total = np.add.reduceat(self.weights[number], np.cumsum(count) - count, axis=0)
        return total / np.sqrt(count, dtype=np.float32)[:, None]


def marginals(score: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every word. ``score`` has the words of all sequences, one after the
    other. Sequences are cut into spans: a span's product of step matrices is formed for all spans
    side by side, the products are chained along each sequence, and then every span is worked
    through from its known ends. That is the same sum over labellings as word by word."""
    n, k = score.shape
    if not n:
        return np.zeros((0, k), np.float32)
    emit = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float32)
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    lengths = lengths[lengths > 0]
    spans = -(-lengths // SPAN)
    total = int(spans.sum())
    first = np.cumsum(spans) - spans
    slot = ragged(first * SPAN, lengths)  # of each word among padded spans
    padded = np.ones((total * SPAN, k), np.float32)
    padded[slot] = emit
    padded = padded.reshape(total, SPAN, k)
    real = np.zeros(total * SPAN, bool)
    real[slot] = True
    real = real.reshape(total, SPAN)
    real[first, 0] = False  # a sequence's first word is entered from no other
    none = np.eye(k, dtype=np.float32)

    product = np.broadcast_to(none, (total, k, k)).copy()
    for t in range(SPAN):
        moved = np.matmul(product, step) * padded[:, t, None, :]
        product = np.where(real[:, t, None, None], moved, product)
        product /= product.max(axis=(1, 2), keepdims=True)
    enter = np.ones((total, k), np.float32)  # before the span's first word
    leave = np.ones((total, k), np.float32)  # after its last word
    enter[first] = padded[first, 0] / padded[first, 0].sum(axis=1, keepdims=True)
    for s in range(1, int(spans.max())):
        at = first[spans > s] + s
        moved = np.matmul(enter[at - 1, None, :], product[at - 1])[:, 0]
        enter[at] = moved / moved.sum(axis=1, keepdims=True)
    for s in range(int(spans.max()) - 1, 0, -1):
        at = first[spans > s] + s
        moved = np.matmul(product[at], leave[at, :, None])[:, :, 0]
        leave[at - 1] = moved / moved.sum(axis=1, keepdims=True)

    out = np.empty((total, SPAN, k), np.float32)
    now = enter
    for t in range(SPAN):
        moved = np.matmul(now, step) * padded[:, t]
        moved /= moved.sum(axis=1, keepdims=True)
        now = np.where(real[:, t, None], moved, now)
        out[:, t] = now
    back = leave
    for t in range(SPAN - 1, -1, -1):
        out[:, t] *= back
        moved = np.matmul(padded[:, t] * back, step.T)
        moved /= moved.sum(axis=1, keepdims=True)
        back = np.where(real[:, t, None], moved, back)
    found = out.reshape(-1, k)[slot]
    return found / found.sum(axis=1, keepdims=True)


def fit(pieces: list[tuple[str, list[str]]], rounds: int = ROUNDS, seed: int = SEED) -> Field | None:
    """A field from (label, words) pieces; None without any."""
    pieces = sorted((label, [w for w in words if is_word(w)]) for label, words in pieces)
    pieces = [p for p in pieces if p[1]]
    if not pieces:
        return None
    labels = sorted({label for label, _ in pieces})
    k = len(labels)
    lexicon: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        often = Counter(w for of, words in pieces if of == label for w in words)
        for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(i)
    field = Field(labels, lexicon, np.zeros((TABLE + k, k), np.float32), np.zeros((k, k), np.float32))
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words in pieces for w in words}))}
    number, count = field.features(list(vocabulary))
    at = np.cumsum(count) - count
    by_label = [[np.array([vocabulary[w] for w in words]) for of, words in pieces if of == label] for label in labels]
    rng = np.random.default_rng(seed)
    past_w, past_t = np.full_like(field.weights, 1e-2), np.full_like(field.transitions, 1e-2)
    for _ in range(rounds):
        seqs, gold = np.zeros((BATCH, SEQUENCE), np.int64), np.zeros((BATCH, SEQUENCE), np.int64)
        for b in range(BATCH):
            filled = 0
            while filled < SEQUENCE:
                label = int(rng.integers(k))
                words = by_label[label][int(rng.integers(len(by_label[label])))]
                lo = int(rng.integers(len(words)))
                some = words[lo : lo + int(rng.integers(4, 33))][: SEQUENCE - filled]
                seqs[b, filled : filled + len(some)] = some
                gold[b, filled : filled + len(some)] = label
                filled += len(some)
        used, back = np.unique(seqs, return_inverse=True)
        mine, sizes = number[ragged(at[used], count[used])], count[used]
        scale = 1 / np.sqrt(sizes, dtype=np.float32)
        score = np.add.reduceat(field.weights[mine], np.cumsum(sizes) - sizes, axis=0) * scale[:, None]
        score = score[back.reshape(-1)].reshape(BATCH, SEQUENCE, k)
        p, pair = _expected(score, field.transitions)
        p[np.arange(BATCH)[:, None], np.arange(SEQUENCE)[None], gold] -= 1
        of_word = np.zeros((len(used), k), np.float32)
        np.add.at(of_word, back.reshape(-1), p.reshape(-1, k))
        grad = np.zeros_like(field.weights)
        np.add.at(grad, mine, np.repeat(of_word * scale[:, None], sizes, axis=0))
        grad /= BATCH
        np.subtract.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        pair /= BATCH
        hit = grad.any(axis=1)
        past_w[hit] += grad[hit] ** 2
        field.weights[hit] -= RATE * grad[hit] / np.sqrt(past_w[hit])
        past_t += pair**2
        field.transitions -= RATE * pair / np.sqrt(past_t)
    return field


def _expected(score: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities, and expected numbers of label pairs over all sequences of one length."""
    b, n, k = score.shape
    emit, step = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(transitions - transitions.max())
    ahead, back = np.empty((b, n, k), np.float32), np.ones((b, n, k), np.float32)
    ahead[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        x = (ahead[:, t - 1] @ step) * emit[:, t]
        ahead[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(n - 2, -1, -1):
        x = (emit[:, t + 1] * back[:, t + 1]) @ step.T
        back[:, t] = x / x.sum(axis=1, keepdims=True)
    p = ahead * back
    p /= p.sum(axis=2, keepdims=True)
    pair = ahead[:, :-1, :, None] * step * (emit * back)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return p, pair.sum(axis=(0, 1))


def training_pieces(docs: DataFrame, held_out=None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> list[tuple[str, list[str]]]:
    """Pieces of the labelled rows with the smallest hashes of their id, ``rows`` of each label at
    most; of each row up to ``SAMPLE_PIECES`` pieces of ``PIECE_WORDS`` words, spread over its whole
    text. What comes to the driver is bounded by these numbers times the number of labels."""
    ship(docs.sparkSession)
    named = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"), column(docs, lang).alias("lang"))
    may = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    if held_out is not None:
        may = may & ~held_out(F.col("doc_id"))
    draw = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    ranked = named.filter(may).select("lang", draw.alias("h")).distinct().withColumn("r", F.expr("row_number() over (partition by lang order by h)"))
    bounds = {r.lang: r.h for r in ranked.filter(F.col("r") <= rows).groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not bounds:
        return []
    chosen = F.lit(False)
    for label, h in bounds.items():
        chosen = chosen | ((F.col("lang") == label) & (draw <= h))
    some = named.filter(may & chosen).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            out = []
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(x)
                places = np.unique(np.linspace(0, max(0, len(words) - PIECE_WORDS), SAMPLE_PIECES).astype(int))
                out += [(label, " ".join(words[p : p + PIECE_WORDS])) for p in places.tolist() if words]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["lang", "piece"])

    return [(r.lang, r.piece.split()) for r in some.mapInArrow(cut, "lang string, piece string").collect()]


def _chances(field: Field | None, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(probabilities of each word, words of each text, distinct words, word numbers)."""
    known: dict[str, int] = {}
    numbers, lengths = [], []
    for x in texts:
        mine = [known.setdefault(w, len(known)) for w in words_of(x)]
        numbers += mine
        lengths.append(len(mine))
    words = list(known)
    number, length = np.array(numbers, np.int64), np.array(lengths, np.int64)
    real = np.fromiter(map(is_word, words), bool, len(words))
    if not real.all():
        of = np.repeat(np.arange(len(length)), length)
        number, of = number[real[number]], of[real[number]]
        length = np.bincount(of, minlength=len(length))
    if field is None:
        return np.zeros((len(number), 0), np.float32), length, words, number
    return marginals(field.scores(words)[number], length, field.transitions), length, words, number


def judge(field: Field | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and its share of the expected words, of each text."""
    p, length, _, _ = _chances(field, texts)
    name, score = [NONE] * len(texts), np.zeros(len(texts))
    has = np.flatnonzero(length)
    if field is not None and len(has):
        start = np.cumsum(length) - length
        share = np.add.reduceat(p.astype(np.float64), start[has], axis=0) / length[has, None]
        best = share.argmax(axis=1)
        for row, label, value in zip(has.tolist(), best.tolist(), share.max(axis=1).tolist(), strict=True):
            name[row], score[row] = field.labels[label], min(1.0, value)
    return name, score


def label_words(field: Field, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) along a text."""
    p, _, words, number = _chances(field, [text])
    return [(words[w], field.labels[int(q.argmax())], float(q.max())) for w, q in zip(number.tolist(), p, strict=True)]


def predict(docs: DataFrame, field: Field | None, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, language and score, and their names.

    Whole texts are read, and nothing but the text. A null text, or one without a letter, is ``und``
    with score 0, as is every text if there was nothing to learn from. Ties go to the language first
    in the alphabet. Repeated rows give repeated rows, no rows give none.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(field)  # TABLE rows, a row and a lexicon per label
    name, score = fresh(docs, "lang"), fresh(docs, "score")
    at = len(docs.columns)
    names = [*docs.columns, name, score]
    rows = docs.select(*[column(docs, c) for c in docs.columns], column(docs, text).alias(fresh(docs, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at):
            texts = [x.decode("utf-8", "replace") for x in as_bytes(batch.column(at))]
            found, sure = judge(model.value, texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.string()), pa.array(sure)], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(run, schema), name, score


def is_held_out(doc_id):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    field = fit(training_pieces(docs, is_held_out))
    found, name, score = predict(docs.select("doc_id", "text"), field)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("lang_pred"), F.col(score).alias("score"))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is known: most of their words are labelled with one language. All
    columns stay. Rejected are texts without a letter and texts without a main language."""
    found, name, score = predict(docs, fit(training_pieces(docs, is_held_out)))
    return found.filter((F.col(name) != NONE) & (F.col(score) >= least)).select(*[column(docs, c) for c in docs.columns])
