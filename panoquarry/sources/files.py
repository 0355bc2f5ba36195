"""Readers and writers of run files. Strict readers fail on the first bad line, tolerant ones keep it."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from datetime import UTC, datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from panoquarry import schemas

#: Blocks of files whose counts are broadcast, of some 250 bytes each. Beyond it the join shuffles the lines.
BLOCKS = 20_000
#: Rows of 4 KB, a bit for each of 32768 lines, that are broadcast. Beyond it the join shuffles the lines.
BITS = 2_000


@lru_cache(maxsize=1)
def _path(jvm):
    """Hadoop's paths: to find the class takes five calls, and each part of a submission makes some."""
    return jvm.org.apache.hadoop.fs.Path


def _store(spark: SparkSession, path: str):
    p = _path(spark._jvm)(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _store(spark, path)
    return store.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    p, store = _store(spark, path)
    return store.isFile(p)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str, beside: str | None = None) -> None:
    """Written beside, then moved to its place, so that no reader meets half a file. beside is only given where
    the place is known to be free."""
    fresh, store = _store(spark, beside or f"{path}.new")
    out = store.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    p = _path(spark._jvm)(path)
    if not beside:
        store.delete(p, False)
    if not store.rename(fresh, p):
        raise OSError(f"{path} could not be written")


def add_lines(spark: SparkSession, lines: list[str], folder: str) -> None:
    """Add few lines to a folder of lines, as one file and without a job. Readers pass over hidden names."""
    if lines:
        name = uuid.uuid4().hex
        write_text(spark, f"{folder}/part-{name}.txt", "\n".join(lines) + "\n", f"{folder}/_{name}")


def parts(spark: SparkSession, path: str) -> list[str]:
    """Where the rows of path are: the file or folder itself, and the folder of what was added to a file."""
    return [p for p in (path, f"{path}.d") if exists(spark, p)]


def append_lines(lines: DataFrame | list[str], path: str) -> None:
    """Add the one string column of a table, or a few lines, as lines. A single file can't be added to by
    many writers: beside one, a folder takes the new lines."""
    spark = lines.sparkSession if isinstance(lines, DataFrame) else SparkSession.active()
    to = f"{path}.d" if is_file(spark, path) else path
    if isinstance(lines, DataFrame):
        lines.write.mode("append").text(to)
    else:
        add_lines(spark, lines, to)


def _most_blocks(spark: SparkSession, paths: list[str]) -> int:
    """No more blocks than these are read of the files."""
    found = [store.getContentSummary(p) for p, store in (_store(spark, path) for path in paths)]
    conf = spark._jsparkSession.sessionState().conf()
    least = max(1, min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()))
    return sum(f.getFileCount() + f.getLength() // least for f in found)


def numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, line_number (from 1, blank lines count) and value of all lines, and ``placed``, which
    orders them over files, oldest first. Lines are counted by block of a file; one row for each
    block is summed and joined back, so no file is numbered in one task."""
    place = {"file": "file_path", "changed": "file_modification_time", "block": "file_block_start"}
    lines = spark.read.text(paths).select("value", *(F.col(f"_metadata.{v}").alias(k) for k, v in place.items()), F.monotonically_increasing_id().alias("at"))
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if _most_blocks(spark, paths) <= BLOCKS:
        blocks = F.broadcast(blocks)
    first = F.coalesce("first", F.raise_error(F.lit("the blocks of the files changed while they were read")))
    df = lines.join(blocks, ["file", "block"], "left").withColumn("line_number", F.col("at") - first + F.col("before") + 1)
    return df.select("file", "line_number", F.struct("changed", "file", "line_number").alias("placed"), "value")


def marked(lines: DataFrame, sent: DataFrame) -> DataFrame:
    """lines (line_number, name and others) with ``sent``: whether that table (line_number, name) has them. It
    becomes a bit for each line, so that lines need not be moved to be looked up."""
    bits = sent.groupBy("name", F.bitmap_bucket_number("line_number").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("line_number")).alias("_bits"))
    if bits.count() <= BITS:
        bits = F.broadcast(bits)
    at = "cast(bitmap_bit_position(line_number) as int)"
    found = F.expr(f"getbit(cast(conv(hex(substring(_bits, {at} div 8 + 1, 1)), 16, 10) as int), {at} % 8) = 1")
    df = lines.withColumn("_bucket", F.bitmap_bucket_number("line_number")).join(bits, ["name", "_bucket"], "left")
    return df.withColumn("sent", F.coalesce(found, F.lit(False))).drop("_bucket", "_bits")


def parsed(lines: DataFrame, schema: str = schemas.RESULT, strict: bool = True, carry: tuple[str, ...] = (), unless: str | None = None) -> DataFrame:
    """numbered lines that are not blank, with the columns of schema. Strict: a bad line raises;
    else ``bad`` says which lines are no records. carry: further columns of lines; unless: one of these,
    where it is true a line is not parsed and its record is null."""
    lines = lines.filter(F.length(F.trim("value")) > 0)
    if unless:
        lines = lines.withColumn("value", F.when(~F.col(unless), F.col("value")))
    if strict:
        return lines.withColumn("r", F.from_json("value", schema, {"mode": "FAILFAST"})).select("file", "line_number", "placed", *carry, "r.*")
    kept = f"{schema}, _corrupt_record string"
    df = lines.withColumn("r", F.from_json("value", kept, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return df.select("file", "line_number", "placed", *carry, "r.*").withColumn("bad", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result records; blank lines are skipped, a bad line raises."""
    return spark.read.schema(schemas.RESULT).option("mode", "FAILFAST").json(path)


def results_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Result records with ``_corrupt_record``: the text of a line that is no record, else null."""
    return spark.read.schema(f"{schemas.RESULT}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def processed_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of a cache file; none if it isn't there."""
    found = parts(spark, path)
    if not found:
        return spark.createDataFrame([], "panorama_id string")
    return spark.read.text(found).select(F.trim("value").alias("panorama_id")).distinct()


def submitted_lines(spark: SparkSession, path: str) -> DataFrame:
    """The distinct (line_number, name) of a sidecar file; blank lines are skipped, others must begin
    with an integer. name is that of a file in a folder of results, empty for a single file."""
    found = parts(spark, path)
    if not found:
        return spark.createDataFrame([], "line_number long, name string")
    line = F.split(F.trim("value"), "\t")
    return spark.read.text(found).filter(F.length(F.trim("value")) > 0).select(line[0].cast("long").alias("line_number"), F.coalesce(F.get(line, F.lit(1)), F.lit("")).alias("name")).distinct()


def geometry(spark: SparkSession, path: str) -> dict:
    """A bare Polygon or MultiPolygon."""
    return json.loads(read_text(spark, path))


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def open_run(spark: SparkSession, run: str, source: str, area: dict, area_hash: str, about: dict[str, str]) -> dict:
    """The manifest of a run; a new one, with a copy of the area, if there is none. A run stays bound
    to its area: another one raises."""
    path = f"{run}/manifest.json"
    if exists(spark, path):
        found = json.loads(read_text(spark, path))
        if found.get("area_hash") != area_hash:
            raise ValueError(f"{run} belongs to another area ({str(found.get('area_hash'))[:12]}, not {area_hash[:12]}); its own is in {run}/area.geojson")
        return found
    made = {"run_name": run.rstrip("/").rsplit("/", 1)[-1], "created_at": now(), "source_geojson": source, "area_hash": area_hash, **about, "runs": []}
    write_text(spark, f"{run}/area.geojson", json.dumps(area))
    write_text(spark, path, json.dumps(made, indent=2))
    return made


def record_run(spark: SparkSession, run: str, found: dict, started_at: str, in_area: int, processed: int, skipped: int, failed: int) -> None:
    """Add an entry to the run history of the manifest found."""
    found["runs"].append({"started_at": started_at, "finished_at": now(), "panos_found_in_area": in_area, "processed": processed, "skipped": skipped, "failed": failed})
    write_text(spark, f"{run}/manifest.json", json.dumps(found, indent=2))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """pid, group, dets, missed, no_missed, seen of each reviewed panorama, and the file's run_key.
    no_missed is null only where the key is absent; a null under the key is false."""
    raw = spark.read.schema("run_key string, panos map<string,string>").option("multiLine", True).json(path).select("run_key", F.explode("panos").alias("pid", "raw"))
    df = raw.withColumn("e", F.from_json("raw", schemas.ENTRY)).withColumn("said", F.array_contains(F.json_object_keys("raw"), "no_missed"))
    return df.select("run_key", "pid", "e.group", "e.dets", "e.missed", F.when(F.col("said"), F.coalesce("e.no_missed", F.lit(False))).alias("no_missed"), "e.seen")


def verdict_path(spark: SparkSession, run: str) -> str:
    """<run>/<name>_verdicts.json, else <run>/verdicts.json."""
    name = run.rstrip("/").rsplit("/", 1)[-1]
    for found in (f"{run}/{name}_verdicts.json", f"{run}/verdicts.json"):
        if exists(spark, found):
            return found
    raise FileNotFoundError(f"no verdicts in {run}")


def results_path(run: str) -> str:
    return run if run.endswith((".jsonl", ".json")) else f"{run.rstrip('/')}/results.jsonl"


def run_key(spark: SparkSession, run: str) -> str:
    """The area's hash from the run's manifest, else its path."""
    path = f"{run.rstrip('/')}/manifest.json"
    row = manifest(spark, path).select("area_hash").first() if exists(spark, path) else None
    return row[0] if row and row[0] else run


def append_results(df: DataFrame, path: str) -> None:
    """Records with their nulls, so that a key is never missing."""
    append_lines(df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")), path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one if all runs on this machine;
    on a cluster that would be a folder of the driver alone, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="panoquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def with_ordinal(df: DataFrame, path: str, *order: str) -> DataFrame:
    """A contiguous line number from 1, by order. Rows are written to path in ranges; the ranges are
    counted, and rows are numbered within theirs, so nothing is sorted in one task."""
    from pyspark.sql import Window

    spark = df.sparkSession
    df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    kept = spark.read.schema(StructType([*df.schema.fields, StructField("_p", IntegerType())])).parquet(path)
    # one row for each range
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_before")
    return kept.join(F.broadcast(starts), "_p").withColumn("ordinal", at.cast("long")).drop("_p", "_before")


def counted_off(df: DataFrame) -> DataFrame:
    """df, as read from files, with a contiguous ``ordinal`` from 1 in the order in which they are read. The
    rows of each task are counted, and one row for each is joined back, so no row is moved."""
    from pyspark.sql import Window

    rows = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33))
    # one row for each task
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_p").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    first = F.coalesce("_first", F.raise_error(F.lit("the files changed while they were read")))
    return rows.join(F.broadcast(starts), "_p", "left").withColumn("ordinal", F.col("_at") - first + F.col("_before") + 1).drop("_at", "_p", "_first", "_before", "_n")
