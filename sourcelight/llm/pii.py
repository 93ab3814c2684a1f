"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a Column expression. A span's place follows from the pieces
between the matches (``split``) and the matches themselves
(``regexp_extract_all``), both counted in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelight.llm.common import whole_text

#: A match may start at the end of the one before it, or where no run of the class is under way; runs are possessive.
#: Both leave the leftmost, non-overlapping matches as they are, without retries inside a long run.
_EMAIL_RUN = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_EMAIL_RUN}]))[{_EMAIL_RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an account number by country: the IBAN registry, and countries that use the form without an entry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(
    rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()
)
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BY_COUNTRY})(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: object  #: match -> boolean Column
    base: bool
    score: float  #: of a confirmed span
    context: str  #: words near a span that raise its score


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for a digit string whose Luhn sum is a multiple of ten."""
    n = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 0, F.substring(number, i, F.lit(1)).cast("int")).otherwise(
            F.substring(number, i, F.lit(1)).cast("int") * 2
            - F.when(F.substring(number, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def mod97(account: Column) -> Column:
    """True if the account number (country, check digits, rest) leaves 1 modulo 97."""
    bare = F.regexp_replace(account, r"\x20", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    left = F.aggregate(
        F.split(turned, "(?<=.)(?=.)"),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return left == 1


def _ip_parts(match: Column) -> Column:
    part = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(part, lambda p: (F.length(p) <= 3) & (F.coalesce(p.cast("int"), F.lit(999)) <= 255))


def _card(match: Column) -> Column:
    d = digits(match)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


KINDS = (
    Kind("email", EMAIL, lambda m: F.lit(True), True, 0.9, "e?-?mail|write|contact"),
    Kind("ip", IP, _ip_parts, True, 0.6, "ip|address|host|server"),
    Kind("card", CARD, _card, True, 0.8, "card|visa|credit|payment"),
    Kind("phone", PHONE, lambda m: F.length(digits(m)).between(9, 15), True, 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", IBAN, mod97, False, 0.9, "iban|account|bank"),
    Kind("ssn", SSN, lambda m: ~m.rlike("^(000|666|9)|-00-|0000$"), False, 0.4, "ssn|social|security"),
)


def _proposed(number: int) -> Column:
    """Array of (kind, at, gap, match, near) of one kind: the code points before a match since the last one, and both contexts.

    Reads the columns _pieces<n> and _found<n>; used more than once each, they are not copied into the lambda.
    """
    pieces = F.col(f"_pieces{number}")
    return F.transform(
        F.col(f"_found{number}"),
        lambda m, i: F.struct(
            F.lit(number).alias("kind"),
            i.alias("at"),
            F.length(pieces[i]).alias("gap"),
            m.alias("match"),
            F.concat(
                F.substring(pieces[i], F.greatest(F.length(pieces[i]) - 39, F.lit(1)), F.lit(40)),
                F.lit(" "),
                F.substring(pieces[i + 1], 1, 40),
            ).alias("near"),
        ),
    )


def pii_spans(docs: DataFrame, threshold: float = 0.5, context_bonus: float = 0.3) -> DataFrame:
    """One row per confirmed span of every whole text: doc_id, kind, start, end, match, score.

    start and end count code points, end exclusive. Spans of the base kinds
    (email, ip, card, phone) always stay; the score of the others, raised by a
    context word within 40 code points, must reach ``threshold``. Null and
    empty texts give no row. Equal rows (same doc_id and text) count once; other
    columns are ignored.
    """
    texts = docs.select("doc_id", whole_text().alias("text")).where(
        F.col("text").rlike("[0-9]|@")  # every kind needs one of them
    )
    cut = texts.select(
        "doc_id",
        F.xxhash64("text").alias("_text"),
        *[F.split("text", k.pattern, -1).alias(f"_pieces{n}") for n, k in enumerate(KINDS)],
        *[F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"_found{n}") for n, k in enumerate(KINDS)],
    )
    held = cut.select(
        "doc_id", "_text", F.explode(F.concat(*[_proposed(n) for n in range(len(KINDS))])).alias("p")
    ).select("doc_id", "_text", "p.*")
    order = Window.partitionBy("doc_id", "_text", "kind").orderBy("at")
    before = F.sum(F.col("gap") + F.length("match")).over(order)
    placed = held.dropDuplicates(["doc_id", "_text", "kind", "at"]).withColumn("end", before)
    m = F.col("match")
    valid, score = F.lit(False), F.lit(0.0)
    for n, k in enumerate(KINDS):
        here = F.col("kind") == n
        raised = F.col("near").rlike(rf"(?i)\b(?:{k.context})\b")
        valid = F.when(here, k.valid(m)).otherwise(valid)
        score = F.when(here, F.lit(k.score) + F.when(raised, context_bonus).otherwise(0.0)).otherwise(score)
    base = F.col("kind").isin([n for n, k in enumerate(KINDS) if k.base])
    return (
        placed.withColumn("score", F.least(score, F.lit(1.0)))
        .where(valid & (base | (F.col("score") >= threshold)))
        .select(
            "doc_id",
            F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1).alias("kind"),
            F.col("kind").alias("rank"),
            (F.col("end") - F.length("match")).cast("bigint").alias("start"),
            F.col("end").cast("bigint").alias("end"),
            F.col("match"),
            "score",
        )
    )


def _joined(spans: Column) -> Column:
    told = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(told, ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Spans of each document as counts and lists, one row per doc_id: doc_id, n_<base kind>, base_sha256, spans, max_score.

    Documents without personal data have zero counts and empty lists. Rows that
    repeat a doc_id are one document with the spans of all its distinct texts.
    """
    spans = pii_spans(docs)
    one = F.struct(F.col("start"), F.col("rank"), F.col("end"), F.col("kind"))
    base = F.col("rank").isin([n for n, k in enumerate(KINDS) if k.base])
    per = spans.groupBy("doc_id").agg(
        *[
            F.sum((F.col("rank") == n).cast("bigint")).alias(f"n_{k.name}")
            for n, k in enumerate(KINDS)
            if k.base
        ],
        F.collect_list(F.when(base, one)).alias("_base"),
        F.collect_list(one).alias("_all"),
        F.max("score").alias("max_score"),
    )
    ids = docs.select("doc_id").distinct()
    per = per.withColumnRenamed("doc_id", "_id")
    both = ids.join(per, ids["doc_id"].eqNullSafe(per["_id"]), "left")
    return both.select(
        "doc_id",
        *[F.coalesce(f"n_{k.name}", F.lit(0)).cast("bigint").alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(F.coalesce(_joined(F.col("_base")), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("_all")), F.lit("")).alias("spans"),
        F.coalesce("max_score", F.lit(0.0)).alias("max_score"),
    )
