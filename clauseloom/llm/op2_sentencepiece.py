"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The distinct new words of a batch are laid end to end and their suffixes sorted. Every piece of the
vocabulary is looked up by binary search, which gives the range of all its occurrences; each one is an
edge from its start to its end. Edges are sorted by their end and relaxed in that order: the last piece
of a prefix's encoding is the one edge that starts where another encoding ends and that may follow its
last piece. Two pieces may follow each other if undoing their merges, latest first, never shows a merge
across their border that would have come earlier. The result is that of merging pair by pair.

No piece has a space mark after another character, so words (with the mark before them) are encoded
each by itself, and bounded stores keep words and their runs. Runs of marks are the one place where
pieces share a score; words with such a run are merged pair by pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.llm.common import HashStore, Store, as_bytes, column, fresh, ragged, ship, steps

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words, and words cut where letters meet other characters, for models whose pieces never mix them.
WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
LETTER, OTHER = r"[^\W\d_¹²³]", r"(?:[\d_¹²³]|[^\w▁\n])"
RUN = re.compile(rf"{MARK}*{LETTER}+|{MARK}*{OTHER}+|{MARK}+|\n")
MIXED = re.compile(rf"{LETTER}{OTHER}|{OTHER}{LETTER}")
#: Strings whose suffixes are sorted together.
INDEXED = 8_000
PAIR_SLOTS = 1 << 20
BORDER = 0xFF

_VOCABULARIES: dict[str, Vocabulary] = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str) -> Vocabulary:
    """The model's pieces, prepared once per process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _keys(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; 0xFF past the end."""
    padded = np.concatenate([text, np.full(8, BORDER, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(text), np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + len(text)]
    return key


def _dense(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks from an order that sorts the values; equal values share one."""
    ranked = values[order]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    return rank


def suffix_order(key: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next ``depth`` bytes (a multiple of 8)."""
    n = len(key)
    order = np.argsort(key)
    first = rank = _dense(key, order)
    for done in range(8, depth, 8):
        after = np.zeros(n, np.int64)
        after[: max(0, n - done)] = first[done:] + 1
        both = rank << 32 | after
        order = np.argsort(both)
        rank = _dense(both, order)
    return order


def _words(text: str) -> list[str]:
    """Keys of a text's words. A plain key stands for a word after a space mark, one from a newline on
    for itself, and in texts with runs of spaces or odd characters a key can hold the marks (or, after
    0x01, none)."""
    if not text:
        return []
    if text[0] == " " or "  " in text or " \n" in text or MARK in text or "\x01" in text:
        units = WORD.findall(MARK + text.replace(" ", MARK))
        return [u if u[0] == MARK or u == "\n" else "\x01" + u for u in units]
    return text.replace("\n", " \n").split(" ")


def _spelled(key: str) -> str:
    first = key[:1]
    return key if first == "\n" or first == MARK else key[1:] if first == "\x01" else MARK + key


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        normal = [i for i in range(n) if not special[i] and not model.is_byte(i)]
        self.id_of = {names[i]: i for i in normal}
        self.score = {i: model.get_score(i) for i in normal}
        self.unknown = n  # a character without a piece; given out as bytes
        self.unk_id = model.unk_id()
        self.unit = WORD if any(MIXED.search(names[i]) for i in normal) else RUN
        self._decoding(names, special, model)
        self._merging(names, normal)
        self.words, self.runs = HashStore(), Store()
        self.pair_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_good = np.zeros(PAIR_SLOTS, bool)

    def _decoding(self, names: list[str], special: list[bool], model) -> None:
        surface = []
        byte_of = {i: b for b, i in self.byte_id.items()}
        for i, name in enumerate(names):
            if i in byte_of:
                surface.append(bytes([byte_of[i]]))
            elif i == model.unk_id():
                surface.append(" ⁇ ".encode())
            else:
                surface.append(b"" if special[i] else name.replace(MARK, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.spaced = np.array([names[i].startswith(MARK) and not special[i] for i in range(len(names))])

    def _merging(self, names: list[str], normal: list[int]) -> None:
        """Merge order, last merges, mergeable pairs, and the pieces that merging can give."""
        n = len(names)
        by_score = sorted((i for i in normal if len(names[i]) > 1), key=lambda i: (-self.score[i], i))
        self.order = np.full(n + 1, -1, np.int64)
        self.order[by_score] = np.arange(len(by_score))
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        use, pairs, made = [], [], []
        for i in normal:
            name = names[i]
            for cut in range(1, len(name)):
                a, b = self.id_of.get(name[:cut]), self.id_of.get(name[cut:])
                if a is not None and b is not None:
                    pairs.append(a * (n + 1) + b)
                    made.append(int(self.order[i]))
            if MARK * 2 in name:
                continue
            ids, last = self.merge(name)
            if len(ids) == 1:
                use.append(i)
                if last:
                    self.left[i], self.right[i] = last
        sort = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.made = np.array(pairs, np.int64)[sort], np.array(made, np.int64)[sort]
        raw = [names[i].encode() for i in use]
        self.piece = np.array(use, np.int64)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.depth = -(-max(self.size) // 8) * 8
        self.low = [np.array([int.from_bytes(r[d : d + 8].ljust(8, b"\0"), "big") for r in raw], np.uint64) for d in range(0, self.depth, 8)]
        self.high = [np.array([int.from_bytes(r[d : d + 8].ljust(8, b"\xff"), "big") for r in raw], np.uint64) for d in range(0, self.depth, 8)]

    def merge(self, word: str) -> tuple[list[int], tuple[int, int] | None]:
        """Pair by pair: the best score first, then the leftmost. Also the last merge's two parts."""
        parts, last = list(word), None
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = (self.score[i], k)
            if best is None:
                break
            k = best[1]
            last = (self.id_of.get(parts[k], self.unknown), self.id_of.get(parts[k + 1], self.unknown))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        ids = []
        for p in parts:
            ids += [self.id_of[p]] if p in self.id_of else self.fallback(p)
        return ids, last

    def fallback(self, text: str) -> list[int]:
        """A character without a piece: its bytes' pieces, or the unknown piece in a model without them."""
        return [self.byte_id[b] for b in text.encode()] if self.byte_id else [self.unk_id]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces gives these two pieces; pairs seen lately are kept."""
        key = a * (self.unknown + 1) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        good = self.pair_good[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            found = self._undo(a[new], b[new])
            good[new] = found
            self.pair_key[slot[new]] = key[new]
            # Of pairs that share a slot the last one stays, with its own verdict.
            own = self.pair_key[slot[new]] == key[new]
            self.pair_good[slot[new][own]] = found[own]
        return good

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), 1 << 60)
        while len(live):
            key = a * (self.unknown + 1) + b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            bad = (self.pairs[at] == key) & (self.made[at] < limit)
            good[live[bad]] = False
            oa, ob = self.order[a], self.order[b]
            go = ~bad & ((oa >= 0) | (ob >= 0))
            live, a, b, oa, ob = live[go], a[go], b[go], oa[go], ob[go]
            first = oa > ob
            limit = np.where(first, oa, ob + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of every occurrence of every piece."""
        key = _keys(text)
        order = suffix_order(key, self.depth)
        ahead = np.concatenate([key, np.full(self.depth, (1 << 64) - 1, np.uint64)])
        level = ahead[order]
        lo, hi = np.searchsorted(level, self.low[0], "left"), np.searchsorted(level, self.high[0], "right")
        for d in range(1, len(self.low)):
            long = np.flatnonzero((self.size > 8 * d) & (hi > lo))
            level = ahead[order + 8 * d]
            lo[long], hi[long] = _bisect(level, lo[long], hi[long], self.low[d][long], False), _bisect(level, lo[long], hi[long], self.high[d][long], True)
        count = hi - lo
        return order[ragged(lo, count)], np.repeat(self.size, count), np.repeat(self.piece, count)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of each word, all of them). Words are put together from their runs, and new runs
        are found with the suffix array."""
        runs = [self.unit.findall(_spelled(w)) for w in words]
        new = self.runs.missing(list(set().union(*runs)))
        if new:
            slow = [r for r in new if MARK * 2 in r]
            fast = [r for r in new if MARK * 2 not in r]
            for lo in range(0, len(fast), INDEXED):
                some = fast[lo : lo + INDEXED]
                self.runs.add(some, *self._encode(some))
            merged = [self.merge(r)[0] for r in slow]
            self.runs.add(slow, np.array([len(m) for m in merged], np.int64), np.array([i for m in merged for i in m], np.int32))
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        at = np.fromiter(map(self.runs.number.__getitem__, chain.from_iterable(runs)), np.int64, int(length.sum()))
        return self.runs.gather(length, at)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of each word, all of them). Words without runs of space marks."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(bytes([BORDER]).join(raw) + bytes([BORDER]), np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        start, length, piece = self._edges(text)

        # Characters that are no piece become edges of their own.
        lead = np.flatnonzero(((text & 0xC0) != 0x80) & (text != BORDER))
        width = np.select([text[lead] < 0x80, text[lead] < 0xE0, text[lead] < 0xF0], [1, 2, 3], 4)
        single = np.zeros(len(text) + 1, np.int64)
        np.maximum.at(single, start[length <= 4], np.where(self.order[piece[length <= 4]] < 0, length[length <= 4], 0))
        odd = single[lead] != width
        start, length = np.concatenate([start, lead[odd]]), np.concatenate([length, width[odd]])
        piece = np.concatenate([piece, np.full(int(odd.sum()), self.unknown)])

        end = start + length
        word = np.repeat(np.arange(len(raw)), size + 1)
        step = end - begin[word[start]]
        # By step, then end; the longest first.
        sort = np.argsort(step << 37 | end << 9 | 511 - length)
        start, length, piece, end, step = start[sort], length[sort], piece[sort], end[sort], step[sort]
        last, back = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        entry = np.zeros(len(text) + 1, bool)
        entry[begin] = True
        bounds = np.flatnonzero(np.diff(step, prepend=-1, append=step[-1] + 1 if len(step) else 0))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            left = np.arange(lo, hi)
            while len(left):
                turn = np.concatenate([[True], end[left[1:]] != end[left[:-1]]])  # the next edge of each end
                at = left[turn]
                before = last[start[at]]
                good = entry[start[at]].copy()
                ask = np.flatnonzero(~good & (before >= 0))
                good[ask] = self.may_follow(before[ask], piece[at[ask]])
                last[end[at[good]]], back[end[at[good]]] = piece[at[good]], length[at[good]]
                left = left[~turn]
                left = left[last[end[left]] < 0]

        # From each word's end back to its start.
        at, mark = begin + size, np.zeros(len(text) + 1, bool)
        while len(at):
            mark[at] = True
            at = at - back[at]
            at = at[~entry[at]]
        place = np.flatnonzero(mark)
        owner, found = word[place - 1], last[place]
        strange = np.flatnonzero(found == self.unknown)
        if len(strange):
            each = np.ones(len(found), np.int64)
            wide = back[place[strange]]
            codes = [self.fallback(bytes(text[p - w : p]).decode()) for p, w in zip(place[strange].tolist(), wide.tolist(), strict=True)]
            each[strange] = [len(c) for c in codes]
            at = np.cumsum(each) - each
            owner, found = np.repeat(owner, each), np.repeat(found, each)
            for p, c in zip(at[strange].tolist(), codes, strict=True):
                found[p : p + len(c)] = c
        return np.bincount(owner, minlength=len(raw)), found.astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of each text, all of them). Words are split and numbered by Arrow, so that only a
        step's distinct words are looked up; texts with odd spaces are split here."""
        texts = pc.fill_null(texts, "")
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # not UTF-8
            texts = pa.array([x.decode("utf-8", "replace") for x in as_bytes(texts)])
        odd = pc.or_(pc.equal(texts, ""), pc.starts_with(texts, " "))
        for sign in ("  ", " \n", MARK, "\x01"):
            odd = pc.or_(odd, pc.match_substring(texts, sign))
        plain = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), " ")
        odd = odd.to_numpy(zero_copy_only=False)
        slow = [_words(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        flat = plain.flatten()
        numbered = pa.concat_arrays([flat, pa.array(list(chain.from_iterable(slow)), flat.type)]).dictionary_encode()
        length = np.concatenate([plain.value_lengths().to_numpy(zero_copy_only=False), np.fromiter(map(len, slow), np.int64, len(slow))]).astype(np.int64)
        at = self.words.numbers(numbered.dictionary, self._learn)[numbered.indices.to_numpy(zero_copy_only=False)]
        # Back to the order of the rows.
        row = np.empty(len(texts), np.int64)
        row[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(texts))
        at = at[ragged((np.cumsum(length) - length)[row], length[row])]
        return self.words.gather(length[row], at)

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of piece lists: marks are spaces, the first one's is taken off, byte pieces are bytes."""
        size = self.surface_size[ids]
        raw = self.surface[ragged(self.surface_start[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])
        stop = np.cumsum(counts)
        first = stop - counts
        out = []
        for s, e in zip(first.tolist(), stop.tolist(), strict=True):
            text = raw[ends[s] : ends[e]].decode("utf-8", "replace")
            out.append(text[1:] if e > s and self.spaced[ids[s]] else text)
        return out


def _bisect(level: np.ndarray, lo: np.ndarray, hi: np.ndarray, target: np.ndarray, past: bool) -> np.ndarray:
    """Of each range, in which ``level`` is sorted, the first position not below (or past) its target."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        at = level[np.minimum(mid, len(level) - 1)]
        up = (lo < hi) & ((at <= target) if past else (at < target))
        lo, hi = np.where(up, mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
    return lo


def encode(docs: DataFrame, text: str = "text", model: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with one more column, array<int>, and its name: the ids of each whole text.

    A null text is empty, and an empty text has no ids. Repeated rows give repeated rows, no rows give
    none; all other columns pass through.
    """
    ship(docs.sparkSession)
    path = model or model_path()
    name, at = fresh(docs, "ids"), len(docs.columns)
    names = [*docs.columns, name]
    rows = docs.select(*[column(docs, c) for c in docs.columns], column(docs, text).alias(fresh(docs, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in steps(batches, at, 2 << 20):
            counts, ids = pieces.encode(batch.column(at))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names)

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])), name


def decode(rows: DataFrame, ids: str, model: str | None = None) -> tuple[DataFrame, str]:
    """``rows`` with one more column, string, and its name: the text of each list of ids. Null or
    empty lists give an empty text, control ids nothing, and bytes that form no character U+FFFD."""
    ship(rows.sparkSession)
    path = model or model_path()
    name, at = fresh(rows, "decoded"), len(rows.columns)
    names = [*rows.columns, name]
    given = rows.select(*[column(rows, c) for c in rows.columns], column(rows, ids).alias(fresh(rows, "list")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                lists = batch.column(at)
                counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                texts = pieces.decode(counts, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], names)

    return given.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])), name


def op2_sentencepiece(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_xxhash64 (Spark's xxhash64 of the ids), decoded_sha256."""
    tokens, ids = encode(docs.select("doc_id", "text"))
    back, text = decode(tokens.select("doc_id", ids), ids)
    return back.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.xxhash64(ids).alias("ids_xxhash64"), F.sha2(F.col(text).cast("binary"), 256).alias("decoded_sha256"))
