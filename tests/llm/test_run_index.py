"""The run-length index against sorted suffixes and all substrings."""

import random
from collections import Counter

import numpy as np
import pytest

from panoquarry.llm import run_index


def joined(parts):
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def made(seed):
    rng = random.Random(seed)
    pool = [bytes(rng.choices(b"ab\0", k=rng.randrange(1, 40))) for _ in range(6)] + [b"ab" * 20, b"a" * 33, b"\0" * 21]
    return [b"".join(rng.choices(pool, k=rng.randrange(4))) for _ in range(rng.randrange(1, 25))]


@pytest.mark.parametrize("seed", range(60))
def test_against_all_substrings(seed):
    parts, length = made(seed), random.Random(seed).choice([1, 5, 8, 20])
    seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    want = [(k, i) for k, p in enumerate(parts) for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1]
    assert list(zip(*map(np.ndarray.tolist, run_index.long_matches(*joined(parts), length)), strict=True)) == want


@pytest.mark.parametrize("seed", range(20))
def test_order_and_samples(seed):
    """Suffixes in order, with end marks (negative) below all bytes; and fewer samples than places
    where strings repeat."""
    parts = made(seed)
    symbols = [[*p, k - len(parts)] for k, p in enumerate(parts)]
    flat = [x for s in symbols for x in s]
    want = sorted(range(len(flat)), key=lambda i: flat[i:])
    piece = np.repeat(np.arange(len(parts)), [len(s) for s in symbols])
    to_end = np.concatenate([np.arange(len(p), -1, -1) for p in parts])
    text = np.array([max(x, 0) for x in flat], dtype=np.uint8)
    assert run_index.suffix_order(text, to_end, piece).tolist() == want


def test_runs_are_fewer_than_places():
    base = bytes(random.Random(1).choices(range(32, 127), k=300))
    parts = [base] * 50
    place, *_ = run_index.samples(*joined(parts))
    assert len(place) < 300 + 3 * 50


def test_empty():
    for parts in ([], [b""], [b"", b""]):
        assert [x.tolist() for x in run_index.long_matches(*joined(parts), 5)] == [[], []]
