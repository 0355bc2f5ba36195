"""Ids, packing and token ledgers against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from panoquarry.llm import ledger, packing, tokens
from tests.llm.helpers import ODD, documents, table_rows

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def encode(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


HARD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \n b", "\n\n a\t\tb \tc", "it's 'll x's", "naïve  😀 1 2½ ³", "a b 　c", "x\x1c y", "a  b", "<|endoftext|> a", "a' s", "don 't \n\nz.  "]


def test_ids_same_as_tokenizer():
    own = tokens.Ids(tokens.VOCABULARY)
    for t in HARD + HARD:
        assert np.frombuffer(own.of([t])[0], dtype="<u4").tolist() == encode(t), repr(t)


def check_pack(df, rows):
    got = df.collect()
    want = []
    for doc, text in rows:
        x = [*encode(text), 2]
        n = len(x)
        starts = [0] if n <= 1024 else [0, *range(n % 1024 or 1024, n, 1024)]
        for k, a in enumerate(starts):
            b = starts[k + 1] if k + 1 < len(starts) else n
            want.append((doc, k, a, b - a, zlib.crc32(np.array(x[a:b], dtype="<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = sum(r["length"] for r in got)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by), -(-total // 1024)


def test_pack_whole_table(spark, sf_dir):
    used, least = check_pack(packing.pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")), table_rows(sf_dir, "documents", "doc_id, text"))
    print("sequences", used, "least", least)
    assert used <= least * 1.02 + 1


def test_pack_odd(spark):
    for rows in (ODD, []):
        check_pack(packing.pack(spark, documents(spark, rows)), [r[:2] for r in rows])


def test_plan_uses_all_and_is_full():
    rng = np.random.default_rng(1)
    count = np.zeros(1025, dtype=np.int64)
    for x in rng.integers(1, 1025, 5000):
        count[x] += 1
    used = np.zeros_like(count)
    n = 0
    for uses, times in packing.plan(count, 1024):
        assert sum(k * v for k, v in uses.items()) <= 1024
        for k, v in uses.items():
            used[k] += v * times
        n += times
    assert (used == count).all()
    assert n <= (count * np.arange(1025)).sum() / 1024 * 1.02 + 1


def test_ledger(spark, tmp_path):
    def at(rows, sign=1):
        return ledger.changes(documents(spark, rows), sign)

    books = ledger.Ledger(spark, f"file://{tmp_path}/books")
    assert books.totals().count() == 0
    assert books.commit(1, at(ODD)) and not books.commit(1, at(ODD))
    total = {(r["source"], r["lang"]): r["n_tokens"] for r in books.totals().collect()}
    want = {}
    for _, text, lang, source, _ in ODD:
        want[source, lang] = want.get((source, lang), 0) + len(encode(text))
    assert total == want
    # a revised count, then everything deleted
    assert books.commit(2, ledger.revision(at(ODD[3:4]), at([(4, "one two three", "en", "b", 13)])))
    now = {(r["source"], r["lang"]): r["n_tokens"] for r in books.totals().collect()}
    assert now["b", "en"] == want["b", "en"] + len(encode("one two three")) - len(encode("one"))
    books.commit(3, ledger.revision(at([(4, "one two three", "en", "b", 13)]), at(ODD[3:4])))
    books.commit(4, at(ODD, -1))
    assert books.totals().count() == 0


def test_ledger_is_compacted(spark, tmp_path):
    """The totals stay, numbers that are in the table are still known, and a gap ends it."""
    books = ledger.Ledger(spark, f"file://{tmp_path}/books")
    rows = [(i, "one two " * i, "en", "ab"[i % 2], 0) for i in range(1, 6)]
    for i, row in zip((1, 2, 3, 5, 6), rows, strict=True):
        assert books.commit(i, ledger.changes(documents(spark, [row])))
    want = sorted(map(tuple, books.totals().collect()))
    assert books.compact() == 3 == books.compact()
    assert sorted(p.name for p in (tmp_path / "books").iterdir()) == ["batch-000000000005", "batch-000000000006", "upto-000000000003"]
    assert sorted(map(tuple, books.totals().collect())) == want
    assert not books.commit(2, ledger.changes(documents(spark, rows))) and books.commit(4, ledger.changes(documents(spark, rows)))
    want = sorted(map(tuple, books.totals().collect()))
    assert books.compact() == 6 and sorted(map(tuple, books.totals().collect())) == want
    assert [p.name for p in (tmp_path / "books").iterdir()] == ["upto-000000000006"]


def test_two_writers_of_one_batch(spark, tmp_path):
    books = ledger.Ledger(spark, f"file://{tmp_path}/books")
    one, two = (ledger.changes(documents(spark, [(1, t, "en", "a", 0)])) for t in ("one", "one two three"))
    assert books._put(one, "batch-000000000001") and not books._put(two, "batch-000000000001")
    assert [r["n_tokens"] for r in books.totals().collect()] == [len(encode("one"))]
    assert [p.name for p in (tmp_path / "books").iterdir()] == ["batch-000000000001"]


def test_corpus_batches(spark, monkeypatch):
    """The query commits deletes and revisions, each batch once, and comes to the inserts' totals."""
    sent = []
    commit = ledger.Ledger.commit
    monkeypatch.setattr(ledger.Ledger, "commit", lambda self, number, delta: sent.append((number, commit(self, number, delta), delta.agg({"n_docs": "min"}).first()[0])) or sent[-1][1])
    got = {(r["source"], r["lang"]): r["n_tokens"] for r in ledger.corpus_totals(spark, documents(spark, ODD)).collect()}
    want = {}
    for _, text, lang, source, _ in ODD:
        want[source, lang] = want.get((source, lang), 0) + len(encode(text))
    assert got == want
    assert [x[:2] for x in sent] == [(n, first) for n in (1, 2, 3, 4) for first in (True, False)]
    assert min(x[2] for x in sent if x[0] == 2) < 0 and min(x[2] for x in sent if x[0] == 3) < 0


def test_corpus_totals(spark, sf_dir):
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in ledger.corpus_totals(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    want = {}
    for text, lang, source in table_rows(sf_dir, "documents", "text, lang, source"):
        a = want.get((source, lang), (0, 0, 0))
        want[source, lang] = (a[0] + 1, a[1] + len(encode(text)), a[2] + len(text or ""))
    assert got == want
