"""Token counts as delta-maintained rollups.

A ledger is a folder of committed batches. A batch holds signed changes, already summed by source,
language and tokenizer version, so its size follows the number of such groups and not of documents:
an insert adds, a delete subtracts, and a revised count is the difference of the new to the old.
A batch is written beside its place and then moved there in one step, so of two writers of one number one
succeeds and the other's is dropped; committing a number again changes nothing, so a number stands for one
content. Totals are the sums of all committed batches. Compaction replaces the batches from the first on,
as far as none is missing, by their totals.

Cases: a null or empty text has no tokens but counts as a document; null sources and languages are
groups of their own; repeated rows count as often as they come; an empty batch or ledger gives no
rows; groups whose sums are all zero are left out; other input columns may have any name.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquarry.llm.runtime import Scratch, shared_folder, small_batches
from panoquarry.llm.tokens import VOCABULARY, counted

GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
SCHEMA = ", ".join([f"{k} string" for k in GROUP] + [f"{k} long" for k in SUMS])


def counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """source, lang, n_chars, n_tokens and tokenizer of each document."""
    texts = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
    return counted(texts, ["source", "lang", "n_chars"], vocabulary).withColumn("tokenizer", F.lit(vocabulary.partition(".")[0]))


def changes(docs: DataFrame, sign: int = 1, vocabulary: str = VOCABULARY) -> DataFrame:
    """Signed changes of inserted (1) or deleted (-1) documents: a row for each group."""
    return signed(counts(docs, vocabulary), sign)


def signed(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Signed changes of documents whose counts are known."""
    return rows.groupBy(*GROUP).agg(*(F.sum(F.lit(sign) * c).cast("long").alias(k) for k, c in (("n_docs", F.lit(1)), ("n_tokens", F.col("n_tokens")), ("n_chars", F.col("n_chars")))))


def revision(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace counts: minus the old ones, plus the new ones."""
    flipped = old.select(*GROUP, *((-F.col(k)).alias(k) for k in SUMS))
    return flipped.unionByName(new).groupBy(*GROUP).agg(*(F.sum(k).alias(k) for k in SUMS))


class Ledger:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
        small_batches(spark)
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self, kind: str) -> dict[int, str]:
        """Paths of what was moved to its place, by number."""
        if not self._fs.exists(self._folder):
            return {}
        names = [x.getPath().getName() for x in self._fs.listStatus(self._folder)]
        return {int(n.removeprefix(f"{kind}-")): f"{self.path}/{n}" for n in names if n.startswith(f"{kind}-")}

    def _compacted(self) -> int:
        return max(self._done("upto"), default=0)

    def committed(self, number: int) -> bool:
        return number <= self._compacted() or number in self._done("batch")

    def _put(self, df: DataFrame, name: str) -> bool:
        """Whether df is at name now, where nothing was."""
        fresh = f"{self.path}/new-{uuid.uuid4().hex}"
        df.select(*GROUP, *SUMS).coalesce(1).write.parquet(fresh)
        hadoop, jvm = self.spark._jvm.org.apache.hadoop.fs, self.spark._jvm
        context = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(hadoop.Path(fresh), hadoop.Path(f"{self.path}/{name}"), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            self._fs.delete(hadoop.Path(fresh), True)
            if self._fs.exists(hadoop.Path(f"{self.path}/{name}")):
                return False  # another writer was first
            raise e

    def commit(self, number: int, delta: DataFrame) -> bool:
        """Whether the batch was new. Numbers begin at 1. What broke off before its move is not seen."""
        if number < 1:
            raise ValueError("numbers begin at 1")
        return not self.committed(number) and self._put(delta, f"batch-{number:012d}")

    def compact(self) -> int:
        """The number up to which batches are one table now. Readers see the batches or that table."""
        done, last = self._done("batch"), self._compacted()
        upto = last
        while upto + 1 in done:
            upto += 1
        if upto > last:
            self._put(self._sum([p for n, p in done.items() if last < n <= upto] + [p for n, p in self._done("upto").items() if n == last]), f"upto-{upto:012d}")
        for kind in ("batch", "upto"):
            for n, path in self._done(kind).items():
                if n <= upto - (kind == "upto"):
                    self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        return upto

    def _sum(self, paths: list[str]) -> DataFrame:
        df = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return df.groupBy(*GROUP).agg(*(F.sum(k).alias(k) for k in SUMS)).filter(" or ".join(f"{k} != 0" for k in SUMS))

    def totals(self) -> DataFrame:
        """GROUP and SUMS over all committed batches."""
        last, tables = self._compacted(), self._done("upto")
        return self._sum([p for n, p in tables.items() if n == last] + [p for n, p in sorted(self._done("batch").items()) if n > last])


def corpus_totals(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of query op7, by batches over the whole table: all documents are inserted without
    their language, which is then revised; half of the sources are deleted and inserted again; and
    every batch is sent twice. Each text is counted once, as all batches are about the same texts."""
    ledger = Ledger(spark)
    rows = Scratch(spark, "counts").keep(counts(docs), "rows")
    bare = signed(rows.withColumn("lang", F.lit(None).cast("string")))
    half = rows.filter(F.pmod(F.xxhash64("source"), F.lit(2)) == 0)
    batches = [bare, revision(bare, signed(rows)), signed(half, -1), signed(half)]
    for number, delta in enumerate(batches, 1):
        ledger.commit(number, delta)
        ledger.commit(number, delta)
    return ledger.totals()
