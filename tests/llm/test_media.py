"""Exact round trips of the chunk store."""

import hashlib
import io
import random
import wave
import zlib

import numpy as np

from panoquarry.llm import media
from tests.llm.helpers import ODD, documents, table_rows


def check(df, rows):
    want = []
    for doc, text in rows:
        data = (text or "").encode()
        n = len(data)
        data += b" " * (-n % 192) if n else b" " * 192
        form = media.stored_form(data)
        want.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(form), hashlib.sha256(form).hexdigest(), media.feature(data)))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_whole_table(spark, sf_dir):
    check(media.media_digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")), table_rows(sf_dir, "documents", "doc_id, text"))


def test_odd_and_shared_chunks(spark):
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdefghij ", k=60000))
    rows = [*ODD, *((10 + i, shared[: 40000 + 1000 * i] + str(i) + shared, "en", "a", 1) for i in range(5)), (20, shared, "en", "a", 1), (20, shared + "x", "en", "a", 1), (None, shared + "y", "en", "a", 1)]
    for given in (rows, []):
        check(media.media_digest(spark, documents(spark, given)), [r[:2] for r in given])


def test_stored_form_is_a_wav_file():
    data = bytes(range(256)) * 3
    with wave.open(io.BytesIO(media.stored_form(data))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, data)
    assert media.samples(media.stored_form(data)) == data


def test_cuts_follow_content():
    rng = random.Random(4)
    a = bytes(rng.choices(range(97, 110), k=50000))
    b = b"something else in front" + a
    one, two = ({media.digest(x[i:j]) for i, j in zip([0, *media.cuts(x)], media.cuts(x))} for x in (a, b))
    assert len(one & two) >= len(one) - 3
    assert all(j - i <= media.MOST for i, j in zip([0, *media.cuts(a)], media.cuts(a)))


def test_cuts_do_not_follow_blocks(monkeypatch):
    """The same chunks, however many bytes the hash is taken of at once."""
    rng = np.random.default_rng(3)
    files = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 700, 50_000)] + [b"a" * 40_000]
    whole = [media.cuts(f) for f in files]
    assert len(whole[6]) > 10
    for block in (1, 64, 1000, 4099):
        monkeypatch.setattr(media, "GEAR_BLOCK", block)
        some = files if block > 1 else files[:6]
        assert [media.cuts(f) for f in some] == whole[: len(some)]
