"""Personal data: expressions propose, checksums confirm, nearby words adjust a score.

Seven kinds. The base kinds (email, ip, card, phone) follow fixed expressions and stay whatever
their score. The added kinds are an IBAN (mod-97), a short payment card of 13 to 15 digits (Luhn),
and a national number ``ddd-dd-dddd``; an added span stays if its score reaches ``KEEP_SCORE``,
where the prior of its kind rises if a word of its context is near. Everything is a Spark column
expression; there is no shuffle and no Python on the executors.

Cases: a null text counts as empty; empty texts give zero counts and empty strings; repeated rows
give repeated results; an empty table gives no rows; other columns of the input are ignored, so
their names may clash with anything. doc_id is passed through, null or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panoquarry.llm.spans import Kind, joined, with_spans

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_short", "national")
KEEP_SCORE = 0.6
#: Code points before a span, and half as many after, whose words adjust its score.
CONTEXT_POINTS = 40
#: The score of a confirmed proposal, and the words that raise it by CONTEXT_BONUS.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "card_short": 0.4, "national": 0.4}
CONTEXT_BONUS = 0.3
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "ip|server|host|address|adresse|client",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|handy",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "card_short": "card|amex|credit|karte|carte|tarjeta|payment",
    "national": "ssn|social|security|national|passport",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(hit: Column) -> Column:
    return F.translate(hit, " -().+", "")


def _luhn(hit: Column) -> Column:
    return F.call_function("luhn_check", _digits(hit))


def _mod97(hit: Column) -> Column:
    """Whether the number that an IBAN stands for is 1 modulo 97."""
    bare = F.translate(hit, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


#: Every expression gives the matches of the plain one: a lookbehind starts only where a run starts,
#: (or \\G, where the last match ended), possessive repeats cannot change what follows them, and the
#: domain of an e-mail is a repeat of single characters, which ends before two dots or a last one: a
#: repeated group would take a frame of the stack for each label.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]*?(?<=[A-Za-z0-9-])(?=\.\.|\.?[^A-Za-z0-9.-]|\.?\z)", needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda h: h.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), needs="."),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", _luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: F.length(_digits(h)).between(8, 15), needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda h: F.length(F.translate(h, " ", "")).between(15, 34) & _mod97(h)),
    Kind("card_short", r"(?<![0-9])(?<![0-9][\x20-])[3-6](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", _luhn),
    Kind("national", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
]


def _scored(kind: str) -> Column:
    near = rf"(?<![\p{{L}}])(?:{CONTEXT[kind]})"

    def one(s: Column) -> Column:
        score = F.lit(PRIOR[kind]) + F.when(s["near"].rlike(near), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    scored = F.transform(F.col(f"_{kind}"), one)
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= KEEP_SCORE)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text, and ``spans``: array of (kind, start, end, score), by kind as listed, then start."""
    df = docs.select(F.col("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = with_spans(df, "text", KINDS, CONTEXT_POINTS)
    df = df.withColumns({f"_s_{k}": _scored(k) for k in (*BASE, *ADDED)})
    return df.select("doc_id", "text", F.concat(*(F.col(f"_s_{k}") for k in (*BASE, *ADDED))).alias("spans"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op1: counts and digests of the spans of each row of documents."""
    df = find_pii(docs).drop("text")
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return df.select(
        "doc_id",
        *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of(BASE)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(of(ADDED)).cast("long").alias("n_added"),
        F.concat_ws(",", F.transform("spans", lambda s: F.format_number(s["score"], 2))).alias("scores"),
    )
