"""Near-duplicates against all pairs on whole tables."""

import random
import re
from collections import defaultdict

from panoquarry.llm import near_dups
from tests.llm.helpers import ODD, WORDS, documents, table_rows


def shingles(text, n):
    words = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n):
    """doc_id -> component, by comparing all sets that share a shingle."""
    sets = defaultdict(set)
    for doc, text in rows:
        if doc is not None and (s := shingles(text, n)):
            sets[s].add(doc)
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    index = defaultdict(list)
    keys = list(sets)
    for i, s in enumerate(keys):
        for d in sets[s]:
            union(d, min(sets[s]))
        common = defaultdict(int)
        for g in s:
            for j in index[g]:
                common[j] += 1
            index[g].append(i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(keys[j]) - c):
                union(min(sets[s]), min(sets[keys[j]]))
    return {d: find(d) for d in parent}


def check(df, rows, n):
    want = brute(rows, n)
    got = df.collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted((repr(d), len(shingles(t, n)), want.get(d), want.get(d) == d) for d, t in rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = table_rows(sf_dir, "documents", "doc_id, text")
    for n in (2, 5):
        check(near_dups.near_duplicates(spark, docs, n_words=n), rows, n)


def test_odd(spark):
    for rows in (ODD, []):
        check(near_dups.near_digest(spark, documents(spark, rows)), [r[:2] for r in rows], 2)


def test_chains_and_large_groups(spark):
    """Chains whose ends are not linked themselves, a group of near copies, a shared passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, base = [], [word() for _ in range(120)]
    for i in range(40):  # each differs from the one before by a word
        base[i * 3] = word()
        rows.append((1000 - i, " ".join(base)))
    group = [word() for _ in range(80)]
    for i in range(300):
        own = list(group)
        own[rng.randrange(80)] = word()
        rows.append((2000 + i, " ".join(own)))
    passage = [word() for _ in range(60)]
    for i in range(200):
        rows.append((3000 + i, " ".join([*passage, *(word() for _ in range(30))])))
    rows += [(5000, "Two Words"), (5001, "two words"), (5001, "two words more of them"), (5002, "Two words more of THEM")]
    given = [(d, t, "en", "a", len(t)) for d, t in rows]
    got = near_dups.near_digest(spark, documents(spark, given)).collect()
    want = brute(rows, 2)
    # 5001 has two sets and joins both classes
    for d in (5000, 5001, 5002):
        want[d] = 5000
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, want[d]) for d, _ in rows}


def test_keep_one(spark):
    rows = [(1, "a b c d e f g", "en", "x", 1), (2, "A b c d e f g", "en", "x", 1), (2, "A b c d e f g", "en", "x", 1), (None, "a b c d e f g", "en", "x", 1), (3, None, "en", "x", 1)]
    docs = documents(spark, rows)
    got = near_dups.keep_one(spark, docs)
    assert got.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == ["1", "3", "None"]


def test_signature_distance_drops_no_pair(spark):
    """A pair of equal sizes and sketches may link however many symbols of its signatures differ."""
    own = {"n": 100} | {f"p{c}": 0 for c in range(near_dups.PARITY)}
    one, two = (spark.createDataFrame([own | {f"c{c}": c and value for c in range(near_dups.CHUNKS)}]) for value in (0, 0x0001000100010001))
    assert one.alias("x").crossJoin(two.alias("y")).filter(near_dups._may_link("x", "y", 80)).count() == 1


def test_key_in_slices(spark, monkeypatch):
    """Many classes that share most words but are not linked, and a few pairs that are: every slice of a
    key meets all its classes."""
    monkeypatch.setattr(near_dups, "COMPARISONS", 100)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    common = [word() for _ in range(70)]
    rows = []
    for i in range(150):
        own = [word() for _ in range(16)]
        rows.append((i, " ".join(common + own)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(common + own[:13] + [word() for _ in range(3)])))
    given = [(d, t, "en", "a", len(t)) for d, t in rows]
    check(near_dups.near_digest(spark, documents(spark, given)), rows, 2)


def test_planted_pairs_in_a_large_group(spark):
    """Pairs at a similarity of 0.80 to 0.85 among thousands that share a passage: all are found."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    passage, rows, pairs = [word() for _ in range(50)], [], set()
    for i in range(3000):
        own = [word() for _ in range(60)]
        rows.append((i, " ".join(passage + own)))
        if i % 6 == 0:
            # 109 shingles each; k words at the end differ
            k = rng.choice([9, 10, 11, 12])
            twin = own[:-k] + [word() for _ in range(k)]
            rows.append((10_000 + i, " ".join(passage + twin)))
            a, b = shingles(rows[-2][1], 2), shingles(rows[-1][1], 2)
            if 100 * len(a & b) >= 80 * len(a | b):
                pairs.add((i, 10_000 + i))
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_digest(spark, documents(spark, [(d, t, "en", "a", 0) for d, t in rows])).collect()}
    found = {(a, b) for a, b in pairs if got[b] == a}
    print("planted", len(pairs), "found", len(found))
    assert len(pairs) > 300 and found == pairs
    assert sum(d != c for d, c in got.items()) == len(pairs)
