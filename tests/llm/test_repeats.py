"""Long repeats against a dictionary of all windows, over whole tables."""

import hashlib
import random
from collections import Counter

import pytest

from panoquarry.llm import repeats
from tests.llm.helpers import ODD, documents, table_rows


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(hash(t[i : i + length]) for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        end = 0
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                a = max(i, end)
                gone[a : i + length] = b"\1" * (i + length - a)
                end = i + length
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for p in bytes(gone).split(b"\0") if p)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def check(df, rows, length):
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, brute(rows, length)))


def test_whole_table(spark, sf_dir):
    check(repeats.remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")), table_rows(sf_dir, "documents", "doc_id, text"), 200)


def test_odd(spark):
    for rows in (ODD, []):
        check(repeats.remove_repeats(spark, documents(spark, rows)), [r[:2] for r in rows], 200)


@pytest.mark.parametrize(("seed", "shard", "key"), [(1, None, None), (2, None, None), (3, 1500, None), (4, None, 700)])
def test_random_repeats(spark, monkeypatch, seed, shard, key):
    """Periodic texts, repeats at odd places, within and across documents, of about LENGTH bytes."""
    if shard:  # many indexes
        monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    if key:  # most keys are too large for an index
        monkeypatch.setattr(repeats, "KEY_BYTES", key)
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choices("abcdé", k=n))
    pool = [noise(n) for n in (30, 60, 150, 199, 200, 201, 260, 500)] + ["ab" * 170, "x" * 230, "x" * 199]
    rows = [(i, "".join(rng.choice([rng.choice(pool), noise(rng.randrange(80))]) for _ in range(rng.randrange(9))), "en", "a", 0) for i in range(120)]
    check(repeats.remove_repeats(spark, documents(spark, rows)), [r[:2] for r in rows], 200)


def test_passage_with_many_neighbours(spark, monkeypatch):
    """A passage that thousands of different texts hold: its keys are too large for one index."""
    levels, narrowed = [], repeats._narrowed
    monkeypatch.setattr(repeats, "_narrowed", lambda *a: levels.append(1) or narrowed(*a))
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = noise(260)
    rows = [(i, noise(rng.randrange(90, 150)) + passage + noise(rng.randrange(90, 150)), "en", "a", 0) for i in range(6000)] + [(6000, passage[:230], "en", "a", 0), (6001, "y" * 700000 + passage, "en", "a", 0)]
    check(repeats.remove_repeats(spark, documents(spark, rows)), [r[:2] for r in rows], 200)
    assert 2 <= len(levels) <= 8
