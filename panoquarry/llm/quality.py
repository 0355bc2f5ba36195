"""Quality rules: fixed gates, then a decision list that is learned from labelled statistics.

Statistics of whole texts come from vectorised kernels over Arrow batches. The learner is sequential
covering: on a growing part of the labelled rows it adds threshold conditions to a rule while its
precision for bad documents rises, on a pruning part it drops the last conditions while that does
not hurt, and a rule that reaches MIN_PRECISION there joins the list; the rows that it covers go, and
the next rule is grown. The list becomes one ordered Spark ``when`` chain.

The learner sees at most ``SAMPLE`` labelled documents, those with the lowest hash of doc_id; statistics
and verdicts cover every document. The sample is chosen by ids alone, so no text moves for it.

Cases: a null or empty text has no words and fails the base gate; a table without labels, or with
labels of one class, gives an empty list; repeated doc_ids of labels count once each; an empty table
gives no rows; other columns of the input may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panoquarry.llm.arrays import Ranges, Words, order_by_group, per_document, slices, starts_ends
from panoquarry.llm.runtime import Scratch, released

SAMPLE = 20_000
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
MIN_COVER = 5
MAX_RULES = 12
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_lines")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), range(65, 91))
_DIGIT = np.isin(np.arange(256), range(48, 58))


def _distinct(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """How many different values each of n groups has."""
    order = order_by_group(values, group)
    v, g = values[order], group[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    return np.bincount(g[new], minlength=n)


def _counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    n = len(at) - 1
    words = Words(data, at)
    document = np.repeat(np.arange(n), words.count)
    hashes = words.hashes()
    out = {"n_words": words.count, "word_chars": per_document(~words.space & ((data & 0xC0) != 0x80), at)}
    out |= {k: per_document(t[data], at) for k, t in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT))}
    out["n_distinct_words"] = _distinct(hashes, document, n)
    # lines: what lies between line feeds; those with a word count
    start, end = starts_ends(data != 10, at)
    filled = np.concatenate([[0], np.cumsum(~words.space)])
    real = filled[end] > filled[start]
    start, end = start[real], end[real]
    line_of = np.searchsorted(at, start, "right") - 1
    out["n_lines"] = np.bincount(line_of, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(Ranges(data).of(start, end), line_of, n)
    # words in windows of three that occur twice in the document
    grams, of = words.grams(3, hashes)
    keep = np.flatnonzero(of >= 0)
    order = keep[order_by_group(grams[keep], of[keep])]
    g, d = grams[order], of[order]
    same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(g), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = order[twice]
    marks = np.zeros(len(hashes), dtype=bool)
    for j in range(3):
        marks[hit + j] = True
    out["n_repeat_words"] = np.bincount(document[marks], minlength=n)
    return out


@released
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for first, last, data, at in slices(batch.column(1)):
                counts = _counts(data, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(counts[k], pa.int64()) for k in COUNTS)], ["doc_id", *COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each text."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return df.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


#: Features: a name, and its ratio of counts. SQL, so that rules read as they run.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "n_words": "cast(n_words as double)",
}
Condition = tuple[str, str, float]
Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for name, op, t in rule:
        out &= x[name] <= t if op == "<=" else x[name] >= t
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions that raise the information gain of the rows that stay, best first."""
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), inside.sum()
        best, found = 1e-9, None
        for name in sorted(x):
            v, b = x[name][inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, up = v[order], np.cumsum(b[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            for op, pos, all_, at in (("<=", up[cuts], cuts + 1, cuts), (">=", up[-1] - up[cuts], len(v) - cuts - 1, cuts + 1)):
                gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1) / all_) - np.log2(p / n)), -1.0)
                if len(gain) and gain.max() > best:
                    i = int(gain.argmax())
                    # half way between neighbours, so that equal rows elsewhere fall on the same side
                    best, found = gain.max(), (name, op, float((v[cuts[i]] + v[cuts[i] + 1]) / 2))
        if found is None:
            break
        rule += (found,)
        inside = _covers(rule, x)
    return rule


def _precision(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    inside = _covers(rule, x)
    return (bad[inside].sum() + 1) / (inside.sum() + 2)


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Rules for bad rows, in order. Every third row is for pruning."""
    prune = np.arange(len(bad)) % 3 == 2
    gx, px, gb, pb = {k: v[~prune] for k, v in x.items()}, {k: v[prune] for k, v in x.items()}, bad[~prune], bad[prune]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and gb.any() and not gb.all():
        rule = _grow(gx, gb)
        while len(rule) > 1 and _precision(rule[:-1], px, pb) >= _precision(rule, px, pb):
            rule = rule[:-1]
        if not rule:
            break
        both = {k: np.concatenate([gx[k], px[k]]) for k in gx}
        inside = _covers(rule, both)
        all_bad = np.concatenate([gb, pb])
        seen = _covers(rule, px)
        if inside.sum() < MIN_COVER or all_bad[inside].mean() < MIN_PRECISION or (seen.any() and pb[seen].mean() < MIN_PRECISION):
            break
        rules.append(rule)
        keep, keep_p = ~_covers(rule, gx), ~seen
        gx, gb, px, pb = {k: v[keep] for k, v in gx.items()}, gb[keep], {k: v[keep_p] for k, v in px.items()}, pb[keep_p]
    return rules


def sampled(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality of at most sample labelled documents of docs, to be broadcast."""
    label = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    there = label.join(docs.select("doc_id"), "doc_id", "left_semi")
    return F.broadcast(scratch.keep(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample"))


def fit(stats: DataFrame, sample: DataFrame) -> list[Rule]:
    """Rules from the sampled documents (quality 0 is bad) that pass the base gate."""
    rows = (
        stats.filter(~base_failed()).join(sample, "doc_id")
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality", *(F.expr(e).alias(k) for k, e in FEATURES.items()))
        .orderBy("h", "doc_id", *FEATURES).limit(SAMPLE).collect()
    )
    if not rows:
        return []
    return learn({k: np.array([r[f"{k}"] for r in rows], dtype=float) for k in FEATURES}, np.array([r["quality"] == 0 for r in rows]))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        text = " and ".join(f"({FEATURES[name]}) {op} cast({t!r} as double)" for name, op, t in rule)
        out = F.when(F.expr(text), i) if out is None else out.when(F.expr(text), i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule (0: none) and kept of each row of docs."""
    scratch = Scratch(spark, "quality")
    stats = scratch.keep(measure(docs), "stats")
    rules = fit(stats, sampled(docs, labels, scratch))
    df = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op6."""
    return judge(spark, docs, labels).select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns. Rules are fitted in a pass of its own;
    the statistics are then carried along with each row, so that rows need no key."""
    scratch = Scratch(spark, "quality")
    sample = sampled(docs, labels, scratch)
    rules = fit(scratch.keep(measure(docs.join(sample, "doc_id", "left_semi")), "labelled"), sample)
    names, schema = docs.columns, docs.schema
    text = names.index("text")
    flat = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)))

    @released
    def with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for first, last, data, at in slices(batch.column(text)):
                    counts, part = _counts(data, at), batch.slice(first, last - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(counts[k], pa.int64()) for k in COUNTS)], [*part.schema.names, *COUNTS])

    out = flat.mapInArrow(with_counts, ", ".join([f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(schema)] + [f"{k} long" for k in COUNTS]))
    return out.filter(~base_failed() & (verdict(rules) == 0)).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
