"""Media payloads in content-defined chunks.

A payload is stored as a WAV file of 8-bit samples. A gear hash rolls over the file; where its top
bits are zero, and the least chunk length is kept, the file is cut. Chunk digests are deduplicated by Spark
joins: equal files are stored once, and of equal chunks in different files the one in the smallest
(doc_id, place) owns the bytes. The store keeps, for each file, its manifest (the ordered digests)
and the bytes that it owns, compressed. Reading goes the other way: a file that owns all its chunks
is rebuilt where its row is read; the others get the bytes that they refer to by a join on digests.
Every rebuilt file is verified against its digests before anything is computed from it.

Bytes move between executors only where chunks are shared, and are written once.

Cases: a null text counts as empty, and is stored as one block of padding; equal texts share one
stored file and give equal values; rows with one doc_id and different texts are stored apart; a null
doc_id is stored and read like any other; an empty table gives no rows; other input columns may have
any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquarry.llm.arrays import U, byte_values
from panoquarry.llm.runtime import Scratch, released
from panoquarry.llm.tokens import parts as text_parts

BLOCK = 192
RATE = 8000
#: Bits of the gear hash that are zero at a cut, and the least and most bytes of a chunk.
CUT_BITS, LEAST, MOST = 11, 512, 16384
#: Bytes that the gear hash is taken of at once; it takes eight times as much itself.
GEAR_BLOCK = 1 << 20
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload(text: str) -> bytes:
    data = text.encode()
    return data + b" " * (-len(data) % BLOCK or (BLOCK if not data else 0))


def stored_form(data: bytes) -> bytes:
    """A mono WAV file whose samples are the bytes of data, of which there must be an even number."""
    return _HEADER.pack(b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(data)) + data


def samples(media: bytes) -> bytes:
    """The samples of a stored file, by its own header."""
    riff, _, wave, fmt, _, kind, channels, *_, bits, mark, n = _HEADER.unpack_from(media)
    if (riff, wave, fmt, mark, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) != _HEADER.size + n:
        raise ValueError("not a stored file")
    return media[_HEADER.size :]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: a sum of 64 byte values, each shifted by its distance."""
    h = byte_values()[data]
    for k in range(6):
        d = 1 << k
        if d < len(h):
            h[d:] = h[d:] + (h[:-d] << U(d))
    return h


def places(data: np.ndarray) -> Iterator[int]:
    """Where the gear hash allows a cut, a block at a time: each begins with the 63 bytes before it, which the
    hash after its first byte still holds, so that a long file costs no more memory than a block."""
    for first in range(0, len(data), GEAR_BLOCK):
        start = max(first - 63, 0)
        zero = gear(data[start : first + GEAR_BLOCK])[first - start :] >> U(64 - CUT_BITS) == 0
        yield from (np.flatnonzero(zero) + first + 1).tolist()


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks of a file."""
    n = len(media)
    out, last = [], 0
    for at in chain(places(np.frombuffer(media, dtype=np.uint8)), [n]):
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST and at < n:
            out.append(at)
            last = at
    if last < n:
        out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _split(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _plain(text: pa.Scalar) -> str:
    return text.as_py() or ""


def _input(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


_MANIFEST = "doc_id long, n_bytes long, media_sha string, digests array<binary>"


def manifests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_sha and the ordered digests of each document's file."""

    @released
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_parts(batch.column(1)):
                n, sha, found = [], [], []
                for text in map(_plain, texts):
                    media = stored_form(payload(text))
                    n.append(len(text.encode()))
                    sha.append(hashlib.sha256(media).hexdigest())
                    found.append([digest(c) for c in _split(media)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media_sha", "digests"])

    return _input(docs).mapInArrow(make, _MANIFEST)


_STORE = "media_sha string, digests array<binary>, lacks boolean, own array<binary>"


def store(docs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """The store's rows: the files that are to be kept, with the compressed chunks that they own.
    exceptions: doc_id, of: array of (media_sha, lack: places of chunks that others own; null: the
    file is kept by another document)."""

    @released
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rules = batch.column(2)
            for first, texts in text_parts(batch.column(1)):
                out: list[tuple] = []
                for row, text in enumerate(map(_plain, texts), first):
                    media = stored_form(payload(text))
                    sha, lack = "", set()
                    if rules[row].is_valid:
                        sha = hashlib.sha256(media).hexdigest()
                        rule = {x["media_sha"]: x["lack"] for x in rules[row].as_py()}
                        if sha in rule and rule[sha] is None:
                            continue
                        lack = set(rule.get(sha, ()))
                    chunks = _split(media)
                    own = [None if i in lack else press.compress(c) for i, c in enumerate(chunks)]
                    out.append((sha or hashlib.sha256(media).hexdigest(), [digest(c) for c in chunks], bool(lack), own))
                columns = list(zip(*out, strict=True)) or [[], [], [], []]
                kinds = (pa.string(), pa.list_(pa.binary()), pa.bool_(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["media_sha", "digests", "lacks", "own"])

    return _input(docs).join(exceptions, "doc_id", "left").select("doc_id", "text", "of").mapInArrow(make, _STORE)


_READ = "media_sha string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def feature(data: bytes) -> str:
    """Mean, root mean square and crossings of the middle of the samples, and their most common value."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64) - 128
    crossed = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    common = int(np.bincount(x + 128, minlength=256).argmax())
    return f"mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={crossed};mode={common}"


@released
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuild, verify, measure."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for sha, digests, own in zip(*(batch.column(i) for i in range(3)), strict=True):
            chunks = [unpress.decompress(c.as_buffer()) for c in own.values]
            if [digest(c) for c in chunks] != digests.as_py():
                raise ValueError(f"a chunk of {sha} differs from its digest")
            media = b"".join(chunks)
            if hashlib.sha256(media).hexdigest() != sha.as_py():
                raise ValueError(f"{sha} differs from its digest")
            data = samples(media)
            out.append((sha.as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), feature(data)))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["media_sha", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])


def media_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and what was read back from the store for each row of docs."""
    scratch = Scratch(spark, "media")
    told = scratch.keep(manifests(docs), "manifests")
    files = told.groupBy("media_sha").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"), F.first("digests").alias("digests"))
    chunks = files.select("media_sha", "owner", F.posexplode("digests").alias("place", "digest"))
    first = chunks.groupBy("digest").agg(F.min(F.struct("owner", "media_sha", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    is_owner = (F.col("first.media_sha") == F.col("media_sha")) & (F.col("first.place") == F.col("place"))
    borrowed = scratch.keep(chunks.join(first, "digest").filter(~is_owner).select("media_sha", "owner", "place", "digest"), "borrowed")
    copies = told.select("doc_id", "media_sha").distinct().join(files.filter("n > 1").select("media_sha", "owner"), "media_sha").filter("doc_id != owner")
    kept_elsewhere = copies.select("doc_id", "media_sha", F.lit(None).cast("array<int>").alias("lack"))
    lacking = borrowed.filter("owner is not null").groupBy(F.col("owner").alias("doc_id"), "media_sha").agg(F.collect_list("place").alias("lack"))
    exceptions = kept_elsewhere.unionByName(lacking).groupBy("doc_id").agg(F.collect_list(F.struct("media_sha", "lack")).alias("of"))
    exceptions = scratch.sized(scratch.keep(exceptions, "exceptions"), "exceptions")
    kept = scratch.keep(store(docs, exceptions), "store")
    whole = kept.filter("not lacks").select("media_sha", "digests", "own").mapInArrow(_read, _READ)
    # files that lack chunks: their own, and those that they refer to, in order
    places = kept.filter("lacks").dropDuplicates(["media_sha"]).select("media_sha", "digests", F.posexplode(F.arrays_zip("digests", "own")).alias("place", "c"))
    there = places.filter("c.own is not null").select("media_sha", "place", F.col("c.own").alias("bytes"))
    wanted = borrowed.select("digest").distinct()
    found = kept.select(F.explode(F.arrays_zip("digests", "own")).alias("c")).filter("c.own is not null").select(F.col("c.digests").alias("digest"), F.col("c.own").alias("bytes"))
    found = found.join(scratch.sized(scratch.keep(wanted, "wanted"), "wanted"), "digest").dropDuplicates(["digest"])
    lent = borrowed.filter("owner is not null").select("media_sha", "place", "digest").join(found, "digest").select("media_sha", "place", "bytes")
    parts = there.unionByName(lent).groupBy("media_sha").agg(F.array_sort(F.collect_list(F.struct("place", "bytes"))).alias("parts"))
    joined = kept.filter("lacks").select("media_sha", "digests").dropDuplicates(["media_sha"]).join(parts, "media_sha")
    rebuilt = joined.select("media_sha", "digests", F.col("parts.bytes").alias("own")).mapInArrow(_read, _READ)
    results = scratch.keep(whole.unionByName(rebuilt).dropDuplicates(["media_sha"]), "results")
    return told.select("doc_id", "n_bytes", "media_sha").join(results, "media_sha")


def media_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of query op10."""
    out = media_table(spark, docs)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("media_sha").alias("media_sha256"), "feature")
