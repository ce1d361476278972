"""Secret scans: fixed patterns, and strings that a tokenizer can't shorten.

A byte-level vocabulary packs words of a language into few tokens; random strings stay near two
characters a token. A long run of letters and digits with a low ratio of characters to tokens is
reported, unless it is a known digest, an identifier, or touches what the patterns have found.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import column, ship, steps

#: The patterns of the base kinds, and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

#: The token-efficiency test: runs of so many characters, with so few characters a token.
RANDOM_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RATIO = 2.0
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Known digests and identifiers: hex of the usual lengths, UUIDs, and names of words joined by signs.
DIGEST = re.compile(r"(?:0x)?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{48}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
NAME_PART = re.compile(r"[A-Z]?[a-z]+\d{0,4}\Z|[A-Z]+\d{0,4}\Z|\d+\Z|\Z")

_ENCODINGS: dict[str, object] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoding(path: str):
    """The rank file's encoding, read once per process."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted. Offsets count code points."""
    found = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known(run: str) -> bool:
    """Whether a run is a digest, a UUID or a name made of words, or lacks letters or digits."""
    if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return True
    if DIGEST.match(run) or UUID.match(run):
        return True
    return all(NAME_PART.match(p) for p in re.split(r"[+/_=-]+|(?<=[a-z0-9])(?=[A-Z][a-z])", run))


def random_spans(text: str, base: list[tuple[int, int, int]], encode, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Spans of the token-efficiency test that don't touch a base span."""
    found = []
    for m in RANDOM_RUN.finditer(text):
        run = m[0]
        if known(run) or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if len(run) < ratio * len(encode(run)):
            found.append((m.start(), 3, m.end()))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """doc_id, kinds, starts, ends (arrays of all spans, by start, then kind as in KINDS), base
    (string of the pattern spans), one row per row. Whole texts are read; a null text is empty and
    gives empty arrays. Rows that repeat give repeated rows, null ids stay null, no rows give none.
    """
    ship(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in steps(batches, 1):
            all_spans, base = [], []
            for x in batch.column(1).to_pylist():
                fixed = base_spans(x or "")
                base.append(listed(fixed))
                all_spans.append(sorted(fixed + random_spans(x or "", fixed, encode, ratio)))
            lists = [pa.array([[f(s) for s in spans] for spans in all_spans], kind) for f, kind in ((lambda s: KINDS[s[1]], pa.list_(pa.string())), (lambda s: s[0], pa.list_(pa.int32())), (lambda s: s[2], pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(base, pa.string())], ["doc_id", "kinds", "starts", "ends", "base"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kinds array<string>, starts array<int>, ends array<int>, base string")


def op8_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = scan(docs)
    count = {k: F.expr(f"cast(size(filter(kinds, x -> x = '{k}')) as long)").alias(f"n_{k}") for k in KINDS}
    spans = F.array_join(F.zip_with("kinds", F.zip_with("starts", "ends", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))), lambda k, at: F.concat_ws(":", k, at)), ",")
    return found.select("doc_id", *[count[k] for k in KINDS[:3]], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), count["random"])

