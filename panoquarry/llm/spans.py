"""Native span search: the places of regular-expression matches, in code points.

Spark has no function for the place of each match. ``regexp_extract_all`` gives the matches and
``split`` by the same pattern gives what lies between them, so running sums of lengths give the
places. Running sums are taken by doubling: round k adds what stands 2**k before, so n numbers take
log2(n) rounds and nothing grows one by one. Contexts are cut from a form of the text with four bytes
for each code point, where any place is found at once. All run in the JVM; all but the first only on
texts that have a match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,near:string>>"


@dataclass(frozen=True)
class Kind:
    """A kind of span. pattern: its matches are the proposals; only those that valid holds for stay.
    needs: a literal without which a text has no match."""

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    needs: str | None = None


def scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's values, what join makes of it and all before it. join must not depend on
    how values are grouped."""
    rounds = F.when(F.size(values) > 1, F.sequence(F.lit(0), (F.ceil(F.log2(F.size(values))) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def double(acc: Column, k: Column) -> Column:
        apart = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda v, i: F.when(i >= apart, join(F.get(acc, i - apart), v)).otherwise(v))

    return F.aggregate(rounds, values, double)


def widened(text: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of the text with four bytes for each code point. It is bound to a variable, as each
    read of a binary column would copy it."""
    return F.element_at(F.transform(F.array(F.encode(text, "UTF-32")), use), 1)


def cut(wide_: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a wide text."""
    return F.decode(F.substr(wide_, (4 * start + 1).cast("int"), (4 * F.greatest(end - start, F.lit(0))).cast("int")), "UTF-32")


def _ends(hits: Column, gaps: Column) -> Column:
    """Where each match ends: matches, and what is before each, run through the text."""
    return scan(F.transform(hits, lambda x, i: (F.length(x) + F.length(gaps[i])).cast("long")), lambda a, b: a + b)


def _valid_spans(text: Column, hits: Column, ends: Column, kind: Kind, context: int) -> Column:
    places = F.sequence(F.lit(0), F.size(hits) - 1)
    if kind.valid is not None:
        places = F.filter(places, lambda i: kind.valid(hits[i]))

    def span(i: Column, near: Callable[[Column, Column], Column]) -> Column:
        start, end = ends[i] - F.length(hits[i]), ends[i]
        return F.struct(start.alias("start"), end.alias("end"), near(start, end).alias("near"))

    if not context:
        return F.transform(places, lambda i: span(i, lambda start, end: F.lit("")))
    around = lambda w: lambda start, end: F.lower(F.concat(cut(w, F.greatest(start - context, F.lit(0)), start), F.lit(" "), cut(w, end, end + context // 2)))
    some = F.when(F.size(places) > 0, widened(text, lambda w: F.transform(places, lambda i: span(i, around(w)))))
    return F.coalesce(some.cast(SPAN), F.array().cast(SPAN))


def with_spans(df: DataFrame, text: str, kinds: list[Kind], context: int = 0) -> DataFrame:
    """df with a column ``_<name>`` of SPAN for each kind, by start. near: the lower-case text up to
    ``context`` code points before and half as many after, other matches among them; empty without."""
    hits, gaps, ends, out = {}, {}, {}, {}
    for k in kinds:
        all_hits = F.regexp_extract_all(F.col(text), F.lit(k.pattern), F.lit(0))
        if k.needs:
            all_hits = F.when(F.contains(F.col(text), F.lit(k.needs)), all_hits)
        hits[f"_h_{k.name}"] = F.coalesce(all_hits, F.array().cast("array<string>"))
    df = df.withColumns(hits)
    for k in kinds:
        gaps[f"_g_{k.name}"] = F.when(F.size(f"_h_{k.name}") > 0, F.split(F.col(text), k.pattern, -1))
    df = df.withColumns(gaps)
    for k in kinds:
        ends[f"_e_{k.name}"] = F.when(F.size(f"_h_{k.name}") > 0, _ends(F.col(f"_h_{k.name}"), F.col(f"_g_{k.name}")))
    df = df.withColumns(ends)
    for k in kinds:
        h = F.col(f"_h_{k.name}")
        out[f"_{k.name}"] = F.when(F.size(h) > 0, _valid_spans(F.col(text), h, F.col(f"_e_{k.name}"), k, context)).otherwise(F.array().cast(SPAN)).cast(SPAN)
    return df.withColumns(out).drop(*hits, *gaps, *ends)


def joined(parts: Column) -> Column:
    """kind:start:end of an array of structs with these fields, comma-joined."""
    return F.concat_ws(",", F.transform(parts, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
