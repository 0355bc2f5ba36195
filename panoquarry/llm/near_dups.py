"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct shingles. Documents with the same set are one class, of which
one row goes on. A signature has SYMBOLS minhashes of 16 bits each (512 bits), dealt into CHUNKS
chunks. If two signatures differ in at most ``2 * CHUNKS - 1`` symbols, by pigeonhole some chunk
differs in one symbol at most; every chunk is therefore indexed once for each symbol left out, which
enumerates the allowed chunk errors, so that the join on these keys finds all pairs within that
distance, and those beyond it of which some chunk differs in one symbol at most. The keys miss a pair
only if all chunks differ in two symbols or more (about 1e-6 at a similarity of 0.8); no pair that they
find is dropped for its distance.

Groups are not expanded into pairs. First the smallest class under each key is compared with the
others under it (a star), then the class with most links with those in other components. Links are
confirmed on full sets and give components. Only classes under a key that are not in one component
even then are paired with each other, where sizes and parity sketches allow a link. Both are bounds
that never fail, so no link between different components that a key found is lost, and a group of
thousands costs about as many comparisons as it has members. A key that leaves more than COMPARISONS
such pairs to look at is dealt into as many slices as they need, each of which meets the key's classes.

Cases: a null text, an empty one, or one without words has an empty set, linked with nothing; a text
with fewer words than a shingle has its whole word sequence as its one shingle; rows with one doc_id
are one node, each with its own n_shingles; a null doc_id is linked with nothing, has a null
component and is kept; an empty table gives no rows; other input columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquarry.llm.arrays import U, Words, mix, order_by_group, slices
from panoquarry.llm.components import components
from panoquarry.llm.runtime import Scratch, released

SYMBOLS = 32
#: Bits of the parity sketch of a set, in words of 64.
PARITY = 16
CHUNK = 4
CHUNKS = SYMBOLS // CHUNK
#: Pairs of classes under a key that one task looks at.
COMPARISONS = 4_000_000
_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def _sets(data: np.ndarray, at: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and where each document's begin."""
    words = Words(data, at, lower=True)
    hashes = words.hashes()
    grams, of = words.grams(n_words, hashes)
    keep = of >= 0
    values, owner = grams[keep], of[keep]
    few = np.flatnonzero((words.count > 0) & (words.count < n_words))
    if len(few):
        short = np.empty(len(few), dtype=U)
        for i, d in enumerate(few):
            x = hashes[words.first[d] : words.first[d + 1]]
            out = U(len(x))
            for h in x:
                out = mix(np.array([out * U(0xA0761D6478BD642F) + h]))[0]
            short[i] = out
        values, owner = np.concatenate([values, short]), np.concatenate([owner, few])
    order = order_by_group(values, owner)
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(at)))


def _signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each non-empty set, SYMBOLS numbers of 16 bits, packed as CHUNKS words of 64."""
    full = first[:-1][first[1:] > first[:-1]]
    out = np.zeros((len(full), CHUNKS), dtype=U)
    if not len(full):
        return out
    for s in range(SYMBOLS):
        seed = _SEEDS[s]
        x = (values ^ (seed >> U(7))) * seed
        x ^= x >> U(32)
        least = np.minimum.reduceat(x, full)
        out[:, s // CHUNK] |= (mix(least) >> U(48)) << U(16 * (s % CHUNK))
    return out


def _parities(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set, which of 64 * PARITY buckets hold an odd number of its hashes. Sketches of two
    sets differ in no more bits than the sets differ in members."""
    bit = (mix(values ^ U(0x2545F4914F6CDD1D)) & U(64 * PARITY - 1)).astype(np.int64)
    word, one = bit >> 6, U(1) << (bit & 63).astype(U)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros(((len(first) - 1) * PARITY), dtype=U)
    np.bitwise_xor.at(out, owner * PARITY + word, one)
    return out.reshape(-1, PARITY)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def described(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (128 bits that stand for the set), c0.. (signature), p0.. (parity
    sketch)."""
    names = [f"c{c}" for c in range(CHUNKS)] + [f"p{c}" for c in range(PARITY)]

    @released
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, at in slices(batch.column(1)):
                    values, first = _sets(data, at, n_words)
                    n = np.diff(first)
                    some = np.flatnonzero(n > 0)
                    sums = []
                    for salt in (0x1234567, 0x89ABCDE):
                        x = np.zeros(len(values) + 1, dtype=U)
                        np.cumsum(mix(values ^ U(salt)), out=x[1:])
                        sums.append(x[first[1:]] - x[first[:-1]])
                    signature = np.zeros((hi - lo, CHUNKS), dtype=U)
                    signature[some] = _signatures(values, first)
                    sketch = np.concatenate([signature, _parities(values, first)], axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *map(_long, sums), *(_long(np.ascontiguousarray(sketch[:, c])) for c in range(len(names)))], ["doc_id", "n_shingles", "s1", "s2", *names])

    return _input(docs).mapInArrow(describe, "doc_id long, n_shingles long, s1 long, s2 long, " + ", ".join(f"{c} long" for c in names))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def full_sets(docs: DataFrame, n_words: int) -> DataFrame:
    """id, n, hashes (sorted, 8 bytes each)."""

    @released
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, at in slices(batch.column(1)):
                    values, first = _sets(data, at, n_words)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array([values[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], ["id", "n", "hashes"])

    return _input(docs).mapInArrow(collect, "id long, n long, hashes binary")


def _keys() -> Column:
    """For each chunk and each of its symbols left out: 48 bits of the others, 5 bits of which."""
    out = []
    for c in range(CHUNKS):
        x = F.col(f"c{c}")
        for j in range(CHUNK):
            low = x.bitwiseAND(F.lit((1 << (16 * j)) - 1)) if j else F.lit(0).cast("long")
            high = F.shiftleft(F.shiftrightunsigned(x, 16 * (j + 1)), 16 * j) if j < CHUNK - 1 else F.lit(0).cast("long")
            out.append(low.bitwiseOR(high).bitwiseOR(F.lit((c * CHUNK + j) << 48)))
    return F.array(*out)


def _may_link(a: str, b: str, percent: int) -> Column:
    """What holds for all links between classes a and b (n, p0..): sizes, and the distance of the
    parity sketches, which is at most that of the sets."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.lit(0)
    for c in range(PARITY):
        apart = apart + F.bit_count(F.col(f"{a}.p{c}").bitwiseXOR(F.col(f"{b}.p{c}")))
    # |A ^ B| = |A| + |B| - 2 |A & B|, and a link has |A & B| >= percent / (100 + percent) * (|A| + |B|)
    return _similar_sizes(n, m, percent) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _confirmed(pairs: DataFrame, docs: DataFrame, n_words: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that are linked on full sets."""
    wanted = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-wanted")
    texts = _input(docs).join(scratch.sized(wanted, f"{name}-wanted"), "doc_id", "left_semi")
    sets = scratch.keep(full_sets(texts, n_words).dropDuplicates(["id", "n", "hashes"]), f"{name}-sets")

    @released
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), dtype=U) for z in (x, y))
                small, large = (u, v) if len(u) < len(v) else (v, u)
                if not len(small):
                    good.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                good.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").filter(_similar_sizes(F.col("na"), F.col("nb"), percent))
    links = scratch.keep(met.select("a", "b", "ha", "hb").mapInArrow(confirm, "a long, b long").distinct(), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-wanted")
    return links


def near_duplicates(spark: SparkSession, docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs, where documents are linked if
    100 * intersection >= percent * union of their shingle sets. percent must be 80 or more."""
    scratch = Scratch(spark, "near")
    told = scratch.keep(described(docs, n_words), "told")
    some = told.filter("n_shingles > 0 and doc_id is not null")
    sketch = [f"c{c}" for c in range(CHUNKS)] + [f"p{c}" for c in range(PARITY)]
    # a row for each different set, and the smallest doc_id that has it
    classes = scratch.keep(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in sketch)), "classes")
    keyed = scratch.keep(classes.select("id", F.explode(_keys()).alias("key")), "keyed")
    least = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a != last").select("key", "a")
    shared = scratch.keep(keyed.join(least, "key"), "shared")
    scratch.drop("keyed")
    described_ = classes.select("id", "n", *(f"p{c}" for c in range(PARITY)))

    def test(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that may link, and are then confirmed or not."""
        x, y = described_.alias("x"), described_.alias("y")
        met = pairs.alias("p").join(x, F.col("p.a") == F.col("x.id")).join(y, F.col("p.b") == F.col("y.id")).filter(_may_link("x", "y", percent))
        return _confirmed(scratch.keep(met.select("a", "b"), f"{name}-pairs"), docs, n_words, percent, scratch, name)

    # stars: the smallest class under a key with each other one
    links = test(shared.filter("a != id").select("a", F.col("id").alias("b")).distinct(), "first")
    labels = components(links, scratch, "first")
    # once more from the best linked class under each key, to those in other components
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    open_ = shared.join(labels.join(degree, "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))
    hubs = open_.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("id"), "label")).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi and hub.degree > 0")
    hubs = open_.join(hubs.select("key", "hub"), "key").filter(F.col("label") != F.col("hub.label"))
    more = test(hubs.select((-F.col("hub.id")).alias("a"), F.col("id").alias("b")).distinct(), "second")
    if more.take(1):
        links = links.unionByName(more)
        labels = components(links, scratch, "second")
    # classes under a key that are in different components even so, with each other
    open_ = shared.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    sizes = open_.groupBy("key", "label").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("major"), F.sum("n").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    slices = F.ceil((F.col("all") - F.col("major.n")) * F.col("all") / COMPARISONS)
    rest = open_.join(split.select("key", F.col("major.label").alias("major"), slices.cast("int").alias("slices")), "key").join(described_, "id")
    # one side has those outside the largest component under the key, so its members never meet
    x = rest.filter("label != major").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).alias("x")
    y = rest.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("y")
    apart = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.major")) | (F.col("x.id") < F.col("y.id")))
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.slice") == F.col("y.slice")) & apart & _may_link("x", "y", percent))
    cross = cross.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    tested = scratch.read("first-pairs", "a long, b long").unionByName(scratch.read("second-pairs", "a long, b long"))
    tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = scratch.keep(cross.join(tested, ["a", "b"], "left_anti"), "cross")
    scratch.drop("shared")
    if cross.take(1):
        links = links.unionByName(_confirmed(cross, docs, n_words, percent, scratch, "third"))
        labels = components(links, scratch, "third")
    # members: a class's doc_ids are all linked with its smallest; then components of classes
    member = some.select("s1", "s2", "doc_id").distinct().join(classes.select("s1", "s2", "id"), ["s1", "s2"])
    class_label = member.join(labels, "id", "left").select("doc_id", F.coalesce("label", "id").alias("label"))
    # a doc_id with several sets joins their components
    per_doc = class_label.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    merged = scratch.keep(class_label.join(per_doc.filter("label != other").select("doc_id", F.col("label").alias("a")), "doc_id").select("a", F.col("label").alias("b")).distinct(), "merged")
    if merged.take(1):
        tops = components(merged, scratch, "fourth").select(F.col("id").alias("label"), F.col("label").alias("top"))
        per_doc = per_doc.join(tops, "label", "left").select("doc_id", F.coalesce("top", "label").alias("label"))
    # the smallest doc_id of a component is the smallest id of its classes, or of their labels
    out = told.select("doc_id", "n_shingles").join(per_doc.select("doc_id", "label"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return near_duplicates(spark, docs, n_words=2)


def keep_one(spark: SparkSession, docs: DataFrame, n_words: int = 5) -> DataFrame:
    """docs without the rows of documents that another one of their component stands for. Of rows
    with one doc_id one stays, as they are one node."""
    out = near_duplicates(spark, docs, n_words).filter("kept").select("doc_id").distinct()
    row = docs.select(F.col("doc_id").alias("k"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = row.join(out.filter("doc_id is not null").withColumnRenamed("doc_id", "k"), "k", "left_semi").dropDuplicates(["k"])
    return kept.unionByName(row.filter("k is null")).select("row.*")
