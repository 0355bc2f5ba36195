"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths is planned on the driver: as many rows as a sequence has tokens,
whatever the corpus. Pieces that fill a sequence are one each and need no plan. For each bin, the longest length that is left is fixed, and a
bitset subset-sum over the lengths that are left finds the fullest combination with it; that
combination is applied as often as the histogram allows before the next is sought, so the number of
searches follows the number of lengths, not of pieces. Each piece then gets a rank among those of
its length (by salted windows, as many as the pieces need, so that a hot length is spread) and the plan
turns the rank into a sequence and an offset.

Cases: a null or empty text is one piece that holds only the end id; repeated rows are packed as
often as they come; an empty table gives no rows; other input columns may have any name; pieces with
all columns equal are interchangeable. Sequence numbers depend on ranks, which reruns reproduce.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panoquarry.llm.runtime import Scratch, partitions, released
from panoquarry.llm.tokens import VOCABULARY, pieces

CAPACITY = 1024
#: A length is dealt into so many windows that even if all pieces had it, each would get about so many.
WINDOW_ROWS = 1_000_000


def fullest(count: np.ndarray, room: int) -> dict[int, int]:
    """How often each length is used in the fullest combination of at most room tokens.
    count[l]: how many of length l there are."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in range(room, 0, -1):
        most = min(int(count[length]), room // length)
        take = 1
        while most > 0:
            now = min(take, most)
            steps.append((reach, length, now))
            reach |= (reach << (length * now)) & mask
            most -= now
            take *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for before, length, times in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            out[length] = out.get(length, 0) + times
    return out


def plan(count: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how many sequences each fills, until nothing is left."""
    left, out = count.astype(np.int64).copy(), []
    longest = capacity
    while longest:
        if not left[longest]:
            longest -= 1
            continue
        left[longest] -= 1
        uses = fullest(left, capacity - longest)
        left[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        times = min(int(left[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * times
        out.append((uses, times))
    return out


def slots(combinations: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, uses in a sequence, offset), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for uses, times in combinations:
        offset = 0
        for length in sorted(uses, reverse=True):
            n = uses[length]
            out.setdefault(length, []).append((ranks.get(length, 0), sequence, n, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in out.items()}


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, capacity, vocabulary), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.filter(F.col("length") == capacity)
    salts = max(partitions(spark), cut.count() // WINDOW_ROWS + 1)
    rest = cut.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = scratch.keep(rest.groupBy("length", "salt").count(), "counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most capacity rows
        histogram[r["length"]] = r["n"]
    places = slots(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = rest.withColumn("number", number).join(before, ["length", "salt"]).select(*names, (F.col("number") + F.col("before")).cast("long").alias("rank"))

    @released
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                row = places[int(x)]
                at = row[np.searchsorted(row[:, 0], ranks[own], "right") - 1]
                beyond = ranks[own] - at[:, 0]
                sequence[own] = at[:, 1] + beyond // at[:, 2]
                offset[own] = at[:, 3] + beyond % at[:, 2] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    packed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # each of a sequence of its own, numbered below zero
    alone = full.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
