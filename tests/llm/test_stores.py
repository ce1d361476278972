"""Stores of token lists: lookups, full stores, crowded tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from clauseloom.llm.common import HashStore


def learn(words):
    return np.array([len(w) % 4 for w in words], np.int64), np.array([ord(c) for w in words for c in (w * 4)[: len(w) % 4]], np.int32)


@pytest.mark.parametrize("limit,bits", [(1 << 19, 20), (40, 7), (300, 9)])
def test_numbers_and_tokens(limit, bits, monkeypatch):
    monkeypatch.setattr(HashStore, "BITS", bits)
    store, rng = HashStore(limit), random.Random(limit)
    for _ in range(20):
        words = sorted({"".join(rng.choice("abé ") for _ in range(rng.randrange(9))) for _ in range(rng.choice([5, 60]))})
        at = store.numbers(pa.array(words, pa.string()), learn)
        counts, flat = store.gather(np.ones(len(words), np.int64), at)
        want = learn(words)
        assert counts.tolist() == want[0].tolist() and flat.tolist() == want[1].tolist()
    assert len(store.count) <= max(limit, 60)


def test_hashes_tell_strings_apart():
    words = list({str(i) for i in range(3000)} | {"a" * i for i in range(500)} | {"é", "É", ""})
    first, second = HashStore().hashes(pa.array(words, pa.string()))
    assert len(set(zip(first.tolist(), second.tolist(), strict=True))) == len(words) == len(set(first.tolist()))
    assert (first != 0).all()
