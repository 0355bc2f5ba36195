"""Mixing and quality rules against brute force."""

import re
from collections import Counter

import numpy as np

from panoquarry.llm import mixing, quality
from tests.llm.helpers import ODD, WORDS, documents, table_rows


def check_mix(df, rows):
    got = df.collect()
    sizes = {}
    for _, text, source in rows:
        sizes.setdefault(source, []).append(len(re.findall(WORDS, text or "")))
    total = {s: sum(v) for s, v in sizes.items()}
    goal = mixing.targets(list(total.items()))
    assert len(got) == len(rows)
    assert abs(sum(goal.values()) - sum(total.values())) < 1e-6 * max(1, sum(total.values()))
    assert all(goal[s] <= 3 * total[s] for s in goal)
    assert Counter((r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter((n, total[s], round(goal[s], 6)) for s, v in sizes.items() for n in v)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    want = Counter()
    for s in total:
        want[total[s], round(goal[s], 6)] += min(round(goal[s]), 3 * total[s])
    assert taken == want


def test_mix_whole_table(spark, sf_dir):
    df = mixing.mix_digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    check_mix(df, table_rows(sf_dir, "documents", "doc_id, text, source"))
    again = mixing.mix_digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, again.collect()))


def test_mix_odd(spark):
    for rows in (ODD, []):
        check_mix(mixing.mix_digest(spark, documents(spark, rows)), [(r[0], r[1], r[3]) for r in rows])
    out = mixing.mixed_documents(spark, documents(spark, ODD))
    assert out.columns == documents(spark, ODD).columns and out.count() > 0


def test_targets_cap():
    assert mixing.targets([("a", 10), ("b", 1), (None, 1)]) == {"a": 6.0, "b": 3.0, None: 3.0}


def brute(text):
    text = text or ""
    words = re.findall(WORDS, text)
    lines = [x for x in text.split("\n") if re.search(WORDS, x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n)


def test_quality_counts(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for df, rows in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), table_rows(sf_dir, "documents", "doc_id, text")), (documents(spark, ODD), [r[:2] for r in ODD]), (documents(spark, []), [])):
        got = quality.quality_digest(spark, df, labels).collect()
        assert sorted((repr(r["doc_id"]), *r[1:7]) for r in got) == sorted((repr(d), *brute(t)) for d, t in rows)
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_rules_held_out(spark, sf_dir):
    """Fitted on the labels of even ids, judged on those of odd ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in quality.judge(spark, docs, labels.filter("doc_id % 2 = 0")).collect()}
    odd = [(got[d]["kept"], q) for d, q in table_rows(sf_dir, "labels", "doc_id, quality") if d % 2]
    good = [k for k, q in odd if q]
    bad = [not k for k, q in odd if not q]
    print("kept of good", np.mean(good), "rejected of bad", np.mean(bad))
    assert np.mean(good) > 0.9 and np.mean(bad) > 0.5


def test_learn_finds_planted_rule():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    rules = quality.learn(x, (x["a"] > 0.8) & (x["b"] < 0.5))
    assert rules and {c[0] for c in rules[0]} == {"a", "b"}
    assert quality.learn(x, np.zeros(600, dtype=bool)) == []


def test_keep_good_same_as_judge(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] for r in quality.judge(spark, docs, labels).collect() if r["kept"])
