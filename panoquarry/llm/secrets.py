"""Secrets in text, and credentials whose parts stand apart.

Base kinds (assign, access, hex) follow fixed expressions. Parts too weak to report alone are
proposed as well: short access identifiers, unlabelled high-entropy tokens, and endpoints. They
are joined by interval: sorted by place, running maxima of the ends before and running minima of the
starts behind give each part the nearest part of either complementary kind, and a part is reported
only if such a part lies within ``SCOPE`` code points in the same document. Running values are taken by
doubling (spans.scan), so n parts cost n log n. All of it is column expressions: no Python on the
executors and no shuffle.

Cases: a null text counts as empty; empty texts give zero counts and empty strings; repeated rows
give repeated results; an empty table gives no rows; other input columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquarry.llm.spans import Kind, cut, joined, scan, widened, with_spans

BASE = ("assign", "access", "hex")
WEAK = ("weak_id", "weak_secret", "endpoint")
SCOPE = 200
_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = [
    Kind("assign", r"(?=[pPsStTaA])" + _ASSIGN, lambda h: F.length(F.regexp_extract(h, _ASSIGN, 2)) >= 6),
    Kind("access", r"AKIA[A-Z0-9]++", lambda h: F.length(h) >= 20, needs="AKIA"),
    Kind("hex", r"[0-9a-f]{24,}+"),
    Kind("weak_id", r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}+(?![A-Za-z0-9])", lambda h: ~(h.startswith("AKIA") & (F.length(h) >= 20))),
    Kind("weak_secret", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,64}+(?![A-Za-z0-9+/=_-])", lambda h: h.rlike("[0-9]") & h.rlike("[A-Z]") & h.rlike("[a-z]")),
    Kind("endpoint", r"https?://[A-Za-z0-9.-]++(?::[0-9]++)?", needs="http"),
]
#: The sides of the join: what counts as an identifier, a secret and an endpoint.
SIDE = {"access": 0, "weak_id": 0, "assign": 1, "hex": 1, "weak_secret": 1, "endpoint": 2}
_PART = "array<struct<start:bigint,rank:int,end:bigint,side:int>>"
#: Further than any place of a text.
_FAR = 1 << 40


def _parts(kinds: tuple[str, ...]) -> Column:
    """All spans of the kinds as (start, rank of the kind, end, side), in order."""
    one = lambda k, i: F.transform(F.col(f"_{k}"), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(SIDE[k]).alias("side")))
    return F.array_sort(F.concat(*(one(k, i) for i, k in enumerate(kinds))).cast(_PART))


def _reach(side: int) -> Column:
    """For each part, where the part of the side ends that ends furthest up to there: a short part may lie
    within a long one."""
    ends = F.transform("_parts", lambda p: F.when(p["side"] == side, p["end"]).otherwise(F.lit(-_FAR)))
    return scan(ends, F.greatest)


def _ahead(side: int) -> Column:
    """For each part, where the first part of the side starts from there on."""
    starts = F.transform(F.reverse("_parts"), lambda p: F.when(p["side"] == side, p["start"]).otherwise(F.lit(_FAR)))
    return F.reverse(scan(starts, F.least))


def find_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with ``_text`` (null: empty) and ``_spans``: array of (kind, start, end), by start, then
    kind as listed: base spans, and weak parts near a complementary one. An identifier needs a
    secret, a secret an identifier or an endpoint, an endpoint both others."""
    kinds = (*BASE, *WEAK)
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = with_spans(df, "_text", KINDS)
    df = df.withColumn("_parts", _parts(kinds)).drop(*(f"_{k}" for k in kinds))
    # without a weak part there is nothing to link
    weak = F.exists("_parts", lambda p: p["rank"] >= len(BASE))
    df = df.withColumns({f"_{n}{i}": F.when(weak, f(i)) for i in range(3) for n, f in (("reach", _reach), ("ahead", _ahead))})

    def linked(p: Column, i: Column) -> Column:
        # before the first part and behind the last one there is none
        near = [F.coalesce(p["start"] - F.get(f"_reach{k}", i - 1) <= scope, F.lit(False)) | F.coalesce(F.get(f"_ahead{k}", i + 1) - p["end"] <= scope, F.lit(False)) for k in range(3)]
        return F.when(p["side"] == 0, near[1]).when(p["side"] == 1, near[0] | near[2]).otherwise(near[0] & near[1])

    stays = F.when(F.col("_reach0").isNull(), F.col("_parts")).otherwise(F.filter("_parts", lambda p, i: (p["rank"] < len(BASE)) | linked(p, i)))
    name = F.array(*map(F.lit, kinds))
    spans = F.transform(stays, lambda p: F.struct(F.element_at(name, p["rank"] + 1).alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    return df.withColumn("_spans", spans).drop("_parts", *(f"_{n}{i}" for i in range(3) for n in ("reach", "ahead")))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op9."""
    df = find_secrets(docs.select("doc_id", "text")).select("doc_id", F.col("_spans").alias("spans"))
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return df.select(
        "doc_id",
        *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of(BASE)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(of(WEAK)).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each found span of the text replaced by mask; overlapping spans become one. Rows
    without a span, and null texts, stay as they are. A column n_chars follows the new text."""
    col = lambda c: F.col(f"`{c}`")
    row = docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(text).alias("text"))
    df = find_secrets(row)
    dirty = F.size("_spans") > 0
    # how far spans reach up to each; one that starts beyond what is before it begins a mask
    df = df.withColumn("_reach", F.when(dirty, scan(F.transform("_spans", lambda s: s["end"]), F.greatest)))
    before = lambda i: F.coalesce(F.get("_reach", i - 1), F.lit(0).cast("long"))
    places = F.filter(F.sequence(F.lit(0), F.size("_spans") - 1), lambda i: (i == 0) | (F.col("_spans")[i]["start"] >= before(i)))
    df = df.withColumn("_first", F.when(dirty, places))

    def masked(w: Column) -> Column:
        pieces = F.transform("_first", lambda i: F.concat(cut(w, before(i), F.col("_spans")[i]["start"]), F.lit(mask)))
        return F.concat(F.array_join(pieces, ""), cut(w, F.element_at("_reach", -1), F.length("_text").cast("long")))

    df = df.withColumn("_clean", F.when(dirty, widened(F.col("_text"), masked)).otherwise(F.col("text")))
    swap = {text: F.col("_clean")}
    if "n_chars" in docs.columns:
        swap["n_chars"] = F.when(dirty, F.length("_clean").cast("long")).otherwise(F.col("row").getField("n_chars"))
    return df.select(*(swap[c].alias(c) if c in swap else F.col("row").getField(c).alias(c) for c in docs.columns))
