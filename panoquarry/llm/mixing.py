"""Mixing sources to target weights.

Every document gets a random key by hash. Documents are range-sorted by source and key, so a hot source
is spread over many ranges; word counts are summed by (source, range), and a running sum over the ranges
of a source tells in which one its budget ends. Only there are documents looked at one by one: a running
sum over its keys gives the key of the cut. Whole epochs are repeated as often as the budget holds them,
and the cut is exact. What a document is taken then follows from its own key and one row of its source,
so texts need not move.

Sources are ranked and filled up to their targets without being collected: a round of the filling is one
sum over the table of sources, and rounds end when no source is above its limit.

Cases: a null text has size 0 and is never taken; a null source is a source of its own, the last;
an empty table gives no rows; a source of size 0 has target 0; equal rows are interchangeable, and
keys that tie are ordered by size; other input columns may have any name. Reruns agree, as keys are
hashes of doc_id and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panoquarry.llm.runtime import Scratch, partitions

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
#: The weights that sources get in turn.
WEIGHTS = (1, 2, 3)


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Shares of the total by weight, each at most repeats times its source's size; what is above
    goes to the others by weight, until none is above. For a list in hand; target_table is for tables."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(sizes), {}
    left, free = float(sum(size.values())), [s for s, _ in order]
    while free:
        share = left / sum(weight[s] for s in free)
        above = [s for s in free if share * weight[s] > repeats * size[s]]
        if not above:
            return out | {s: share * weight[s] for s in free}
        out |= {s: float(repeats * size[s]) for s in above}
        left -= sum(out[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def _key() -> Column:
    return F.xxhash64("doc_id", "source")


def _sorted(df: DataFrame, scratch: Scratch, name: str, *order: str) -> DataFrame:
    """df, kept in ranges of order, with each row's range as p."""
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("p", F.spark_partition_id())
    return scratch.keep(ranged.sortWithinPartitions(*order), name)


def _before(value: str, *by: str, within: str) -> Column:
    """The sum of value over the rows before, in the order of by."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def target_table(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size) with target: shares of the total by weight, each at most repeats times
    its source's size; what is above goes to the others by weight, until none is above."""
    ranged = _sorted(sizes.withColumn("last", F.col("source").isNull()), scratch, "ranged", "last", "source")
    # a row for each range: ranks are numbers within a range, and the counts of the ranges before
    ranges = ranged.groupBy("p").count().withColumn("all", F.lit(0))
    ranges = ranges.select("p", _before("count", "p", within="all").alias("earlier"))
    number = F.row_number().over(Window.partitionBy("p").orderBy("last", "source")) - 1
    ranked = ranged.withColumn("n", number).join(ranges, "p").withColumn("n", F.col("n") + F.col("earlier"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    weighted = scratch.keep(ranked.select("source", "source_size", weight.alias("weight")), "weighted")
    limit = F.lit(repeats) * F.col("source_size")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    share, n_above = float("inf"), 0
    while True:
        # those above at the last round's share stay above, as shares only grow
        above = F.lit(share) * F.col("weight") > limit if share != float("inf") else F.lit(False)
        r = weighted.agg(F.sum(F.when(above, limit)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("free"), F.count_if(above).alias("n")).first()
        if share != float("inf") and r["n"] == n_above or not r["free"]:
            break
        share, n_above = (float(total) - (r["taken"] or 0)) / r["free"], r["n"]
    aim = F.when(F.lit(share) * F.col("weight") > limit, limit.cast("double")).otherwise(F.lit(share) * F.col("weight")) if share != float("inf") else limit.cast("double")
    return weighted.select("source", "source_size", aim.alias("target"))


def plan(spark: SparkSession, sized: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each source: source_size, target, epochs (whole ones), and where the rest is cut: the
    documents before (cut_key, cut_size) are taken once more, and those there, n of them, have rest_here
    words of the rest together. sized: doc_id, source, size, key."""
    ranged = _sorted(sized, scratch, "sorted", "source", "key", "size")
    sums = scratch.keep(ranged.groupBy("source", "p").agg(F.sum("size").alias("range_size")), "sums")
    goal = target_table(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), scratch)
    budget = F.least(F.rint("target").cast("long"), F.lit(REPEATS) * F.col("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("budget", budget).withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).drop("budget")
    goal = scratch.keep(goal, "goal")
    need = goal.select("source", "rest").filter("rest > 0").alias("g")
    same = F.col("g.source").eqNullSafe(F.col("s.source"))
    ends = sums.withColumn("before", _before("range_size", "p", within="source")).alias("s").join(need, same)
    ends = ends.filter("before < rest and before + range_size >= rest").select("s.source", "s.p", "before", "rest").alias("g")
    # the one range of each source where its budget ends, by key
    keys = ranged.groupBy("source", "p", "key", "size").agg(F.count("*").alias("n")).alias("s").join(ends, same & (F.col("s.p") == F.col("g.p")))
    keys = keys.select("s.source", "s.key", "s.size", "n", "before", "rest").withColumn("words", F.col("n") * F.col("size"))
    keys = keys.withColumn("before", F.col("before") + _before("words", "key", "size", within="source"))
    cuts = keys.filter("before < rest and before + words >= rest").select("source", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), "n", (F.col("rest") - F.col("before")).alias("rest_here")).alias("s")
    out = goal.alias("g").join(cuts, same, "left").select("g.source", "source_size", "target", "epochs", "cut_key", "cut_size", "n", "rest_here")
    return scratch.sized(scratch.keep(out, "plan"), "plan")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key().alias("key"))


def _earlier() -> Column:
    """Whether a document stands before its source's cut."""
    return F.struct("key", "size") < F.struct("cut_key", "cut_size")


def _at_cut() -> Column:
    return (F.col("key") == F.col("cut_key")) & (F.col("size") == F.col("cut_size"))


def mix_sources(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, taken."""
    scratch = Scratch(spark, "mixing")
    sized = scratch.keep(_sized(docs), "sized")
    made = plan(spark, sized, scratch).alias("b")
    rows = sized.alias("s").join(made, F.col("s.source").eqNullSafe(F.col("b.source"))).select("s.*", *(f"b.{c}" for c in made.columns if c != "source"))
    out = ["doc_id", "size", "source", "source_size", "target"]
    whole = F.col("epochs") * F.col("size")
    # equal rows at a cut are told apart by number; there are as many as a document has copies
    several = F.coalesce(_at_cut() & (F.col("n") > 1), F.lit(False))
    one = F.when(_at_cut(), F.col("rest_here")).when(_earlier(), F.col("size")).otherwise(0)
    alone = rows.filter(~several).select(*out, (whole + one).alias("taken"))
    number = F.row_number().over(Window.partitionBy("source", "key", "size").orderBy("doc_id")) - 1
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest_here") - number * F.col("size")))
    copies = rows.filter(several).select(*out, (whole + part).alias("taken"))
    return alone.unionByName(copies)


def mix_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of query op4."""
    return mix_sources(spark, docs).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs, each as many times as the mix takes it: whole epochs, and once more if at least half
    of it, or of its copies, is taken besides. Columns as in docs."""
    scratch = Scratch(spark, "mixed")
    made = plan(spark, scratch.keep(_sized(docs), "sized"), scratch).withColumnRenamed("source", "of")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", n_words(F.col("text")).alias("size"), _key().alias("key"))
    met = row.filter("size > 0").join(made, F.col("source").eqNullSafe(F.col("of")))
    more = F.when(_at_cut(), (2 * F.col("rest_here") >= F.col("n") * F.col("size")).cast("int")).when(_earlier(), 1).otherwise(0)
    times = (F.col("epochs") + more).cast("int")
    return met.filter(times > 0).select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")
