"""Long repeats: every byte that a string of LENGTH bytes covers which starts elsewhere as well.

Every string of LENGTH bytes ("window") is keyed by the least hash among its GRAM-byte substrings,
so equal windows have equal keys, wherever they are. Neighbouring windows mostly share a key; a
maximal run of them is a segment, about one for every 70 bytes. Then, without comparing windows one
by one:

1. Keys are counted over all segments. A segment whose key is alone repeats nowhere and goes.
2. Segments that are equal as a whole repeat as a whole. All inner segments of a repeat are such,
   because keys depend on nothing but the bytes around.
3. Only segments under one key that differ (the two ends of a repeat) are opened: the bytes of one
   of each kind meet by key. Keys are gathered into shards, and each shard gets a run-length index
   (run_index): its samples give the matching statistics of all opened segments against each other,
   and windows that match elsewhere for LENGTH bytes are marked. Equal windows have equal keys, so
   no match lies between shards, and no index is larger than a shard.
4. Keys whose kinds exceed KEY_BYTES are narrowed until an index can hold them. All windows of a key hold
   the string of the least hash, at a distance from their start. Parted by that distance in two halves,
   the windows of a half share a longer string, whose hash is their new key; equal windows stay
   together. Parts that are equal or alone are done, as in 1 and 2; the rest goes to an index or is
   halved again, at most about log2(LENGTH) times.

Keys and segments are counted by partial aggregates, so a passage in a third of all
documents is one key like any other. A segment where the least hash stands at two places (as in
periodic text) may repeat within itself and is always opened. All counts cover all rows.

Whole segments and the parts of step 4 are told apart by their key and a hash of their own, 64 bits
each; the index compares bytes.

Cases: a null text counts as empty; texts under LENGTH bytes have no window and lose nothing, but
count; repeated rows repeat each other as any two rows do; a null doc_id is a row like any other; an
empty table gives no rows; other input columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquarry.llm.arrays import U, Ranges, buffers, mix, slices
from panoquarry.llm.run_index import long_matches
from panoquarry.llm.runtime import ARROW_BYTES, Scratch, released

LENGTH = 200
GRAM = 56
#: Bytes of the opened segments that one index holds, and of a key that goes into an index as it is.
SHARD_BYTES = 1 << 20
KEY_BYTES = 1 << 19
#: What a narrower key's hash is of, besides its bytes: the key that it was, and the distances.
_PERSON = "<qii"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row, by block-wise running minima from both sides."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=x.dtype)
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _segments(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, key, hash of the whole segment, first and last window start (within the slice), and
    whether the least hash stands at two places of the segment, so that it may repeat within itself."""
    ranges, w = Ranges(data), length - gram + 1
    grams = ranges.all_of(gram)
    least = _sliding_min(grams, w)
    n = len(least)
    valid = np.zeros(n + 1, dtype=np.int32)
    lengths = np.diff(at)
    long_ = lengths >= length
    np.add.at(valid, at[:-1][long_], 1)
    np.add.at(valid, at[1:][long_] - length + 1, -1)
    valid = np.cumsum(valid[:n]) > 0
    goes_on = np.zeros(n, dtype=bool)
    goes_on[1:] = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    first = np.flatnonzero(valid & ~goes_on)
    stops = valid.copy()
    stops[:-1] &= ~goes_on[1:]
    last = np.flatnonzero(stops)
    document = np.searchsorted(at, first, "right") - 1
    several = np.zeros(len(first), dtype=bool)
    for i in range(0, len(first), 4096):
        part = slice(i, i + 4096)
        value = least[first[part]][:, None]
        views = np.lib.stride_tricks.sliding_window_view(grams, w)
        leftmost = first[part] + (views[first[part]] == value).argmax(axis=1)
        rightmost = last[part] + w - 1 - (views[last[part]] == value)[:, ::-1].argmax(axis=1)
        several[part] = leftmost != rightmost
    return document, mix(least[first] ^ U(0x5851F42D4C957F2D)), ranges.of(first, last + length), first, last, several


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, h (a hash of the text), key, seg, s, e (first and last window start), self."""

    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, at in slices(batch.column(2)):
                    document, key, seg, first, last, several = _segments(data, at, length, gram)
                    row = pa.array(document + lo)
                    base = at[document]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), batch.column(1).take(row), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array(several)],
                        ["doc_id", "h", "key", "seg", "s", "e", "self"],
                    )

    return _input(docs).mapInArrow(find, "doc_id long, h long, key long, seg long, s int, e int, self boolean")


def _pieces(docs: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """key, seg, piece: the bytes of the opened segments (doc_id, h, runs of s, e, key, seg)."""

    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, _ = buffers(batch.column(0).slice(row, 1))
                whole, runs = data.tobytes(), batch.column(1)[row].values
                first, last, key, seg = (runs.field(i) for i in range(4))
                parts = [whole[s : e + length] for s, e in zip(first.to_pylist(), last.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([key, seg, pa.array(parts, pa.binary())], ["key", "seg", "piece"])

    d, o = _input(docs).alias("d"), opened.alias("o")
    met = d.join(o, F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.h") == F.col("o.h"))).select("d.text", "runs")
    return met.mapInArrow(find, "key long, seg long, piece binary").dropDuplicates(["key", "seg"])


def _as_runs(own: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first and last place of each run of places; both are in order."""
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return own[first], place[first], place[np.concatenate([first[1:] - 1, [len(own) - 1]]).astype(np.int64)] if len(own) else place


_RUNS = "key long, seg long, a int, b int"


def _within_keys(pieces: DataFrame, length: int) -> DataFrame:
    """Runs (_RUNS) of windows that stand twice among the pieces of a key, by an index of each shard."""

    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(1)
            values = groups.flatten()
            own = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(groups).to_numpy()))
            data, at = buffers(values.field(1))
            # of each key, its first piece, and that piece's first byte
            head = np.searchsorted(own.to_numpy(), np.arange(batch.num_rows + 1))
            byte = at[head]
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(byte, byte[first] + SHARD_BYTES, "right")) - 1)
                lo, hi = head[first], head[last]
                piece, a, b = _as_runs(*long_matches(data[byte[first] : byte[last]], at[lo : hi + 1] - at[lo], length))
                piece = pa.array(piece + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own.take(piece)), values.field(0).take(piece), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["key", "seg", "a", "b"])
                first = last

    grouped = pieces.groupBy("key").agg(F.collect_list(F.struct("seg", "piece")).alias("group"))
    return grouped.mapInArrow(find, _RUNS)


def _merged(runs: DataFrame) -> DataFrame:
    """Runs (_RUNS) with those of a kind that touch or overlap put together, one number for each meanwhile."""

    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
            both = batch.column(2).flatten().to_numpy()
            first, low = both >> 32, (1 << 32) - 1
            reach = np.maximum.accumulate((own << 32) | (both & low))
            new = np.ones(len(both), dtype=bool)
            new[1:] = (own[1:] != own[:-1]) | (first[1:] > (reach[:-1] & low) + 1)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(both)) - 1
            row = pa.array(own[begin])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(first[begin].astype(np.int32)), pa.array((reach[end] & low).astype(np.int32))], ["key", "seg", "a", "b"])

    both = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    return runs.groupBy("key", "seg").agg(F.sort_array(F.collect_list(both)).alias("runs")).mapInArrow(find, _RUNS)


def _anchors(piece: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """First and last window start and anchor: the first place in these windows of their least hash."""
    with np.errstate(over="ignore"):
        grams = Ranges(np.frombuffer(piece, dtype=np.uint8)).all_of(gram)
    first, last = 0, len(piece) - length
    for place in np.flatnonzero(grams == grams.min()).tolist():
        if first > last:
            return
        yield first, min(place, last), place
        first = place + 1


def _halves(first: int, last: int, at: int, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """Windows from first to last, whose anchor at is lo to hi bytes behind their start, in two parts by
    that distance: first and last window, and the part's lo and hi."""
    middle = (lo + hi + 1) // 2
    for low, high in ((lo, middle - 1), (middle, hi)):
        begin, end = max(first, at - high), min(last, at - low)
        if begin <= end:
            yield begin, end, low, high


def _number(data: bytes, person: bytes = b"") -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, person=person).digest(), "little", signed=True)


_KIND = "key long, seg long, piece binary, n int, at int, lo int, hi int"


def _narrowed(kinds: DataFrame, length: int, gram: int) -> DataFrame:
    """The windows of kinds (_KIND), dealt to narrower keys: okey, oseg and shift tell where a part was cut.
    All windows of a part hold the same bytes from lo before the anchor to length - hi behind it, and equal
    windows have equal anchors, so these bytes are a key that equal windows share. Bytes come once a batch."""
    schema = pa.schema([(k, pa.int64()) for k in ("okey", "oseg")] + [("shift", pa.int32())] + [(k, pa.int64()) for k in ("key", "seg")] + [("piece", pa.binary())] + [(k, pa.int32()) for k in ("n", "at", "lo", "hi")])

    def parts(key: int, piece: bytes, at: int | None, lo: int, hi: int) -> Iterator[tuple]:
        anchored = _anchors(piece, length, gram) if at is None else [(0, len(piece) - length, at)]
        for first, last, place in anchored:
            for begin, end, low, high in _halves(first, last, place, lo, hi):
                own = piece[begin : end + length]
                core = piece[place - low : place + length - high]
                yield begin, _number(core, struct.pack(_PERSON, key, low, high)), _number(own), own, place - begin, low, high

    def write(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, rows, size = set(), [], 0
            for i in range(batch.num_rows):
                okey, oseg, piece, at, lo, hi = (batch.column(k)[i].as_py() for k in range(6))
                for shift, key, seg, own, place, low, high in parts(okey, piece, at, lo, hi):
                    new = (key, seg) not in told
                    told.add((key, seg))
                    rows.append((okey, oseg, shift, key, seg, own if new else None, len(own), place, low, high))
                    size += 100 + new * len(own)
                    if size > ARROW_BYTES:
                        yield write(rows)
                        rows, size = [], 0
            if rows:
                yield write(rows)

    return kinds.select("key", "seg", "piece", "at", "lo", "hi").mapInArrow(find, f"okey long, oseg long, shift int, {_KIND}")


def _repeated(kinds: DataFrame, length: int, gram: int, scratch: Scratch, level: int = 0) -> DataFrame:
    """Runs (_RUNS) of the windows of kinds (_KIND, each once) that stand elsewhere in kinds as well. Keys
    that an index can hold get one; the others are narrowed until it can, which halves what is not told
    apart at each level: after log2(length) of them a key holds one window."""
    large = kinds.groupBy("key").agg(F.sum("n").alias("bytes")).filter(F.col("bytes") > KEY_BYTES).select("key")
    large = scratch.keep(large, f"large{level}")
    if large.isEmpty():
        return _within_keys(kinds, length)
    large = scratch.sized(large, f"large{level}")
    within = _within_keys(kinds.join(large, "key", "left_anti"), length)
    dealt = scratch.keep(_narrowed(kinds.join(large, "key", "left_semi"), length, gram), f"dealt{level}")
    place = dealt.select("okey", "oseg", "shift", "key", "seg")
    whole = dealt.groupBy("key", "seg").agg(F.count("*").alias("times"), F.max("n").alias("n")).filter("times > 1").select("key", "seg", F.lit(0).alias("a"), (F.col("n") - length).alias("b"))
    mixed = dealt.groupBy("key").agg(F.min("seg").alias("least"), F.max("seg").alias("most")).filter("least != most").select("key")
    finer = dealt.filter("piece is not null").select("key", "seg", "piece", "n", "at", "lo", "hi").join(mixed, "key", "left_semi").dropDuplicates(["key", "seg"])
    finer = scratch.keep(finer, f"kinds{level + 1}")
    found = scratch.keep(whole.unionByName(_repeated(finer, length, gram, scratch, level + 1)), f"found{level}")
    back = place.join(found, ["key", "seg"]).select(F.col("okey").alias("key"), F.col("oseg").alias("seg"), (F.col("shift") + F.col("a")).alias("a"), (F.col("shift") + F.col("b")).alias("b"))
    return within.unionByName(_merged(back))


def _cut(docs: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """The result, from marks: doc_id, h, runs (of window starts)."""

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for row in range(batch.num_rows):
                data, _ = buffers(batch.column(1).slice(row, 1))
                runs = batch.column(2)[row]
                size.append(len(data))
                if not runs.is_valid:
                    removed.append(0)
                    spans.append(0)
                    kept.append(hashlib.sha256(data).hexdigest())
                    continue
                first, last = (runs.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                depth = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(depth, first, 1)
                np.add.at(depth, last + length, -1)
                gone = np.cumsum(depth)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0]))
                kept.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    d, m = _input(docs).alias("d"), marks.alias("m")
    met = d.join(m, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.h") == F.col("m.h")), "left").select("d.doc_id", "text", "runs")
    return met.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (query op8)."""
    scratch = Scratch(spark, "repeats")
    all_segments = scratch.keep(segments(docs, length, gram), "segments")
    keys = all_segments.groupBy("key").agg(F.count("*").alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi"), F.max("self").alias("any_self")).filter("n > 1 or any_self")
    hits = scratch.keep(all_segments.join(keys.select("key", ((F.col("lo") != F.col("hi")) | F.col("any_self")).alias("mixed")), "key"), "hits")
    scratch.drop("segments")
    kinds = hits.groupBy("key", "seg").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), F.min(F.struct("doc_id", "h", "s", "e")).alias("one"))
    kinds = scratch.keep(kinds, "kinds")
    whole = kinds.filter("n > 1").select("key", "seg", F.lit(0).alias("a"), (F.col("one.e") - F.col("one.s")).alias("b"))
    opened = kinds.filter("mixed").select("one.*", "key", "seg")
    opened = scratch.keep(opened.groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "e", "key", "seg")).alias("runs")), "opened")
    pieces = scratch.keep(_pieces(docs, opened, length), "pieces")
    anew = {"at": F.lit(None).cast("int"), "lo": F.lit(0), "hi": F.lit(length - gram)}
    parts = _repeated(pieces.withColumns({"n": F.length("piece"), **anew}), length, gram, scratch)
    # a row for each kind of segment, so that a hit meets one; a whole one needs no parts
    both = whole.withColumn("whole", F.lit(True)).unionByName(parts.withColumn("whole", F.lit(False)))
    span = F.struct("a", "b")
    runs = both.groupBy("key", "seg").agg(F.max(F.when(F.col("whole"), span)).alias("all"), F.collect_list(F.when(~F.col("whole"), span)).alias("some"))
    runs = scratch.keep(runs.select("key", "seg", F.when(F.col("all").isNotNull(), F.array("all")).otherwise(F.col("some")).alias("of")), "runs")
    scratch.drop("kinds", "opened", "pieces")
    placed = F.transform("of", lambda x: F.struct((F.col("s") + x["a"]).alias("s"), (F.col("s") + x["b"]).alias("e")))
    marks = hits.join(runs, ["key", "seg"]).select("doc_id", "h", placed.alias("of"))
    marks = scratch.keep(marks.groupBy("doc_id", "h").agg(F.array_distinct(F.flatten(F.collect_set("of"))).alias("runs")), "marks")
    scratch.drop("hits", "runs")
    return _cut(docs, marks, length)
