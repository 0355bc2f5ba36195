"""What the operators share: tables written to the shared folder, and session settings."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquarry.sources.files import shared_folder

#: Rows and bytes, whichever comes first, of an Arrow batch that goes to a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 2 << 20
#: Bytes up to which a table may be broadcast. Beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give memory that is free back to the system. Workers are reused and idle ones stay, so what
    they hold adds up on an executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(read: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """read, a function over batches for mapInArrow, that releases memory after its last batch."""

    @wraps(read)
    def run(batches: Iterator) -> Iterator:
        yield from read(batches)
        release()

    return run


class Scratch:
    """Intermediate tables in the shared folder. They cut the lineage: a lost executor costs no
    more than the step that it ran. Tables that a lazy result still reads stay in the folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        small_batches(spark)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables, and let Spark remove the shuffle files of plans that are done with."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        self.spark._jvm.System.gc()

    def size(self, name: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def sized(self, df: DataFrame, name: str) -> DataFrame:
        """df, as kept under name, to be broadcast if its files are small enough."""
        return F.broadcast(df) if self.size(name) <= BROADCAST_BYTES // 8 else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
