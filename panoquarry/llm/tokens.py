"""Token ids of whole texts, by a public byte-level BPE vocabulary.

Texts whose characters every edition of Unicode tells alike (Latin letters, digits, common marks) go
to the vocabulary's rank table, which gives the ids of a text as one buffer; all others go to the
tokenizer itself. The tests hold the former's ids against the latter's. Texts are worked on TEXT_BYTES
at a time and nothing is kept between them, so memory does not follow the batch or the partition.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panoquarry.llm.arrays import buffers
from panoquarry.llm.runtime import released

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Bytes of text that are worked on at once.
TEXT_BYTES = 1 << 20
#: What a text must not hold to go to the rank table.
_SLOW = re.compile("[^\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u2027]")


class Ids:
    """Ids of texts as bytes, four for each."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.encode_special_tokens = True
        self.plain = None
        name = vocabulary.removesuffix(".json") + ".tiktoken"
        if os.path.exists(public_tokenizers.path(name)):
            import tiktoken

            with open(public_tokenizers.path(name), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer

    def of(self, texts: list[str]) -> list[bytes]:
        quick = [self.plain is not None and not _SLOW.search(x) for x in texts]
        slow = [x for x, q in zip(texts, quick, strict=True) if not q]
        rest = iter(self.tokenizer.encode_batch_fast(slow, add_special_tokens=False))
        return [bytes(self.plain(x, set())) if q else np.array(next(rest).ids, dtype="<u4").tobytes() for x, q in zip(texts, quick, strict=True)]

    def of_array(self, texts: pa.Array) -> pa.Array:
        """Ids of each text, as binary. Null: none."""
        return pa.array(self.of([x or "" for x in texts.to_pylist()]), pa.binary())


@lru_cache(maxsize=2)
def ids(vocabulary: str) -> Ids:
    """One for each worker process."""
    return Ids(vocabulary)


def parts(column: pa.Array, most: int = TEXT_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """A column of texts, about most bytes at a time, each part with the row that it starts at."""
    at = buffers(column)[1]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, column.slice(first, last - first)
        first = last


def pieces(docs: DataFrame, longest: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. A document's ids end with END_ID; one with more than
    longest ids is cut so that only its first piece may be shorter."""

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for first, texts in parts(batch.column(1)):
                data, at = buffers(ids(vocabulary).of_array(texts))
                n = np.diff(at) // 4 + 1
                pieces_ = -(-n // longest)
                row = np.repeat(np.arange(len(n)), pieces_)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces_) - pieces_, pieces_)
                # the first piece has what the others leave
                head = (n - (pieces_ - 1) * longest)[row]
                start = np.where(piece > 0, head + (piece - 1) * longest, 0)
                length = np.where(piece > 0, longest, head)
                last = piece == pieces_[row] - 1
                a = at[row] + 4 * start
                b = a + 4 * (length - last)
                crc = [zlib.crc32(end, zlib.crc32(data[x:y])) if z else zlib.crc32(data[x:y]) for x, y, z in zip(a.tolist(), b.tolist(), last.tolist(), strict=True)]
                columns = [pa.array(piece.astype(np.int32)), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return df.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def counted(docs: DataFrame, keys: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """keys of docs and n_tokens, the number of ids of each text."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in parts(batch.column(0)):
                n = np.diff(buffers(ids(vocabulary).of_array(texts))[1]) // 4
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[1:]), pa.array(n, pa.int64())], [*batch.schema.names[1:], "n_tokens"])

    df = docs.select(F.col("text").cast("string").alias("_0"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keys, 1)))
    kinds = [df.schema[f"_{i}"].dataType.simpleString() for i in range(1, len(keys) + 1)]
    out = df.mapInArrow(count, ", ".join([f"_{i} {k}" for i, k in enumerate(kinds, 1)] + ["n_tokens long"]))
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keys, 1)), "n_tokens")
