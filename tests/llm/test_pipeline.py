"""The pipeline against a chain of brute-force stages."""

from collections import Counter

import corpus_pipeline
from panoquarry.llm import mixing, quality
from tests.llm.helpers import ODD, documents, table_rows
from tests.llm.test_mixing_quality import brute as stats
from tests.llm.test_near_dups import brute as groups
from tests.llm.test_spans import secrets_base
from tests.llm.test_tokens import check_pack


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = {d: (t, s) for d, t, s in table_rows(sf_dir, "documents", "doc_id, text, source")}
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        outs.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, unique, masked, mixed, packed = outs
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    judged = quality.judge(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept == {r["doc_id"] for r in judged.collect() if r["kept"]} <= {d for d, (t, _) in given.items() if not stats(t)[-1]}
    part = groups([(d, given[d][0]) for d in kept], 5)
    assert sorted(r["doc_id"] for r in unique.select("doc_id").collect()) == sorted(d for d in part if part[d] == d)
    for r in masked.collect():
        text, found = given[r["doc_id"]][0], secrets_base(given[r["doc_id"]][0])
        assert (r["text"] == text) if not found and r["text"] == text else "[SECRET]" in r["text"]
        assert all(text[a:b] not in r["text"] for _, a, b in found) and r["n_chars"] == len(r["text"])
    sizes = Counter()
    for r in masked.collect():
        sizes[r["source"]] += len(r["text"].split())
    goal = mixing.targets(list(sizes.items()))
    took = Counter()
    for r in mixed.collect():
        took[r["source"]] += len(r["text"].split())
    for s in goal:
        longest = max(len(r["text"].split()) for r in masked.collect() if r["source"] == s)
        assert abs(took[s] - goal[s]) <= longest, s
    used, least = check_pack(packed, [(r["doc_id"], r["text"]) for r in mixed.collect()])
    assert used <= least * 1.03 + 1


def test_odd(spark, sf_dir):
    for rows in (ODD, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            out.count()
