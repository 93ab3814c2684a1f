"""Evidence gate: which retrieved document, if any, supports the question.

All functions work on one row per question holding its ranked chunks as an
array (at most ``top_k``), so gating and answering add no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.rules import evidence_rules as R
from sourcelight.rules import vocabulary as V
from sourcelight.session import fenced

GATE_RESULTS = 10


def meets(c: Column, condition: Sequence[Sequence[str]]) -> Column:
    """Every group of the condition has a term inside ``c``."""
    out = F.lit(True)
    for group in condition:
        out = out & X.contains_any(c, group)
    return out


CONDITION = "array<array<string>>"


def rule_table(rows: Sequence, schema: str) -> Column:
    """Rule objects as one folded array literal, so plans stay small."""
    return F.from_json(F.lit(json.dumps([asdict(r) for r in rows], ensure_ascii=False)), f"array<struct<{schema}>>")


def holds_any(c: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: c.contains(t))


def holds(c: Column, condition: Column) -> Column:
    """``meets`` for a condition taken from a rule table."""
    return F.forall(condition, lambda group: F.exists(group, lambda t: c.contains(t)))


def holds_one(c: Column, alternatives: Column) -> Column:
    return F.exists(alternatives, lambda condition: holds(c, condition))


def current_question(q: Column) -> Column:
    """Text after the last follow-up mark."""
    return F.when(
        q.contains(V.FOLLOW_UP_MARK), X.strip(F.substring_index(q, V.FOLLOW_UP_MARK, -1))
    ).otherwise(q)


def is_drafting_question(q: Column) -> Column:
    asks = X.contains_any(q, ("调查", "了解", "核查", "考察", "哪些方面", "哪几方面"))
    drafting = X.contains_any(q, ("起草", "草案", "草拟"))
    before_signing = X.contains_any(q, ("签署前", "签约前")) & X.contains_any(q, ("调查", "相对方", "相关方"))
    return q.contains("合同") & asks & (drafting | before_signing)


def expanded_tokens(q: Column, adaptations: bool = True) -> Column:
    """Distinct question tokens plus stage vocabulary and transport aliases."""
    out = F.array_distinct(X.tokens(X.normalize_text(q)))
    out = F.when(
        is_drafting_question(current_question(q)), F.array_union(out, X.literal_array(V.DRAFTING_EXTRA_TOKENS))
    ).otherwise(out)
    if adaptations:
        squeezed = X.no_spaces(q)
        for term, aliases in V.TRANSPORT_ALIASES.items():
            out = F.when(squeezed.contains(term), F.array_union(out, X.literal_array(aliases))).otherwise(out)
    return out


def phrase_rules(question: Column) -> Column:
    """The wording rules that a question, as displayed, calls for."""
    rules = rule_table(
        R.PHRASE_RULES, f"question:{CONDITION},sentence:{CONDITION},weight:int,raw:boolean"
    )
    return X.once(X.no_spaces(question), lambda q: F.filter(rules, lambda r: holds(q, r["question"])))


def rules_bonus(rules: Column, sentence: Column) -> Column:
    """Sum of the given wording rules that a sentence, as displayed, meets."""

    def total(s: Column) -> Column:
        hits = F.filter(rules, lambda r: holds(F.when(r["raw"], sentence).otherwise(s), r["sentence"]))
        return F.aggregate(hits, F.lit(0), lambda total, r: total + r["weight"])

    return X.once(X.no_spaces(sentence), total)


def phrase_bonus(question: Column, sentence: Column) -> Column:
    """Sum of the wording rules; ``question`` and ``sentence`` as displayed."""
    return rules_bonus(phrase_rules(question), sentence)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def add_question_features(
    df: DataFrame, vocabulary: V.Vocabulary = V.DEFAULT_VOCABULARY, adaptations: bool = True
) -> DataFrame:
    """Columns the gate and the composers share, from ``question``."""
    q = F.col("question")
    current = F.col("current")
    pay = F.col("current_ns").contains("事假") & X.contains_any(F.col("current_ns"), V.PAY_TERMS)
    onboarding = F.col("current_ns").contains("入职") & X.contains_any(F.col("current_ns"), V.ONBOARDING_ACTIONS)
    ascii_token = r"^[\x00-\x7f]*$"
    subjects = F.filter(
        X.literal_array(vocabulary.subjects),
        lambda s: F.col("current").contains(s),
    )
    out = (
        df.withColumn("current", current_question(q))
        .withColumn("current_ns", X.no_spaces(current))
        .withColumn("question_ns", X.no_spaces(q))
        .withColumn("all_tokens", expanded_tokens(q, adaptations))
        .withColumn(
            "query_tokens",
            F.filter(
                F.array_except("all_tokens", X.literal_array(vocabulary.weak)),
                lambda t: t.rlike(ascii_token) | (F.length(t) > 1),
            ),
        )
        .withColumn("topic_tokens", F.array_except("query_tokens", X.literal_array(vocabulary.generic)))
        .withColumn("onboarding", onboarding)
        .withColumn("drafting", is_drafting_question(current))
        .withColumn(
            "personal_follow_up",
            F.col("question_ns").contains("事假")
            & X.contains_any(F.col("current_ns"), V.PERSONAL_LEAVE_ACTIONS),
        )
        .withColumn(
            "relaxed", F.col("current_ns").contains("婚假") | F.col("personal_follow_up") | pay | F.col("onboarding")
        )
        .withColumn("threshold", F.when((F.size("query_tokens") <= 1) | F.col("relaxed"), 1).otherwise(2))
        .withColumn(
            "needed_topics", F.when(F.col("relaxed"), 1).otherwise(F.least(F.lit(2), F.size("topic_tokens")))
        )
        .withColumn(
            "subjects",
            F.when(X.contains_any(current, V.MAINTENANCE_TERMS), subjects).otherwise(F.slice(subjects, 1, 0)),
        )
    )
    return out


def _result_score(r: Column, adaptations: bool, rules: Column) -> Column:
    """Best sentence score of one chunk with its document bonuses; ``rules`` are the question's ``phrase_rules``."""
    names = F.struct(
        X.no_spaces(r["content"]).alias("content"), X.no_spaces(r["title"]).alias("title"), F.lower(r["source_path"]).alias("source")
    )
    return X.once(names, lambda plain: _plain_score(r, plain, adaptations, rules))


def _plain_score(r: Column, plain: Column, adaptations: bool, rules: Column) -> Column:
    def scored(read: Column) -> Column:
        lexical, bonus = overlap(F.col("query_tokens"), read["tokens"]), read["bonus"]
        topics = overlap(F.col("topic_tokens"), read["tokens"]) + F.greatest(F.lit(0), bonus)
        return F.when(topics >= F.col("needed_topics"), lexical + bonus).otherwise(0)

    def sentence_score(s: Column) -> Column:
        bonus = rules_bonus(rules, s) if adaptations else F.lit(0)
        return X.once(F.struct(X.tokens(s).alias("tokens"), bonus.alias("bonus")), scored)

    content, content_ns = r["content"], plain["content"]
    base = F.coalesce(F.array_max(F.transform(X.sentences(content), sentence_score)), F.lit(0))
    base = F.greatest(base, F.lit(0))
    reporting = content.contains("报到") & content.contains("材料")
    base = F.when(F.col("onboarding") & reporting, F.greatest(base, F.lit(1))).otherwise(base)
    base = base + F.when(
        F.col("personal_follow_up") & X.contains_any(content_ns, V.PERSONAL_LEAVE_CONTENT_TERMS), 8
    ).otherwise(0)
    if adaptations:
        q_ns, cur = F.col("question_ns"), F.col("current_ns")
        title_ns, source = plain["title"], plain["source"]
        base = base + F.when(
            X.contains_any(q_ns, V.ANNUAL_LEAVE_TERMS)
            & X.contains_any(q_ns, V.NEW_HIRE_TERMS)
            & content_ns.contains("年休假")
            & X.contains_any(content_ns, ("新入职", "新员工")),
            4,
        ).otherwise(0)
        base = base + F.when(
            cur.contains("发票") & (title_ns.contains("发票") | source.contains("invoice")), 5
        ).otherwise(0)
        base = base + F.when(
            X.contains_any(cur, V.TRAVEL_QUERY_TERMS) & (title_ns.contains("差旅") | source.contains("travel")), 5
        ).otherwise(0)
    return base


def _eligible(r: Column) -> Column:
    """Chunks the gate may look at for this question."""
    content = r["content"]
    stage = ~F.col("drafting") | X.contains_any(content, V.DRAFTING_CONTENT_TERMS)
    joining = (
        ~F.col("onboarding")
        | X.contains_any(content, V.ONBOARDING_CONTENT_TERMS)
        | (content.contains("报到") & content.contains("材料"))
    )
    return ~X.is_catalog(content) & stage & joining


def gate(
    df: DataFrame, vocabulary: V.Vocabulary = V.DEFAULT_VOCABULARY, adaptations: bool = True
) -> DataFrame:
    """Add ``best_document`` (null when evidence is insufficient) and ``evidence_score``.

    Input: one row per question with ``query_id``, ``question`` and ``results``.
    """
    featured = fenced(add_question_features(df, vocabulary, adaptations), "query_id")
    pooled = F.lower(X.compact(F.array_join(F.transform("results", lambda r: r["content"]), "\n")))
    subjects_found = F.forall("subjects", lambda s: pooled.contains(F.lower(s)))
    leave_phrase = X.contains_any(F.col("question"), V.ANNUAL_LEAVE_TERMS)
    answerable = subjects_found & ((F.size("topic_tokens") > 0) | leave_phrase)
    eligible = F.filter(F.slice(F.array_sort("results"), 1, GATE_RESULTS), _eligible)
    scored = X.once(
        phrase_rules(F.col("question")),
        lambda rules: F.transform(
            eligible,
            lambda r: F.struct(
                _result_score(r, adaptations, rules).alias("score"),
                F.least(overlap(F.col("query_tokens"), X.tokens(r["title"])), F.lit(2)).alias("title"),
                r["rank"].alias("rank"),
                r["document_id"].alias("document_id"),
            ),
        ),
    )
    kept = F.transform(
        F.filter(scored, lambda s: s["score"] >= F.col("threshold")),
        lambda s: F.struct(
            (s["score"] + s["title"] * 2).alias("score"),
            (-s["rank"]).alias("order"),
            s["document_id"].alias("document_id"),
        ),
    )
    return (
        featured.withColumn("_best", F.when(answerable, F.array_max(kept)))
        .withColumn("best_document", F.col("_best.document_id"))
        .withColumn("evidence_score", F.col("_best.score"))
        .drop("_best")
    )


def filter_sources(df: DataFrame) -> DataFrame:
    """Keep the result chunks that fit the question's intent; all if none fits.

    The first matching rule decides. Input is a gated row; ``results`` is
    replaced by the kept chunks in rank order.
    """
    cur = F.col("current_ns")
    personal = cur.contains("事假") | (
        F.col("question_ns").contains("事假") & X.contains_any(cur, V.PERSONAL_LEAVE_ACTIONS)
    )

    rules = rule_table(
        R.SOURCE_RULES,
        f"question:{CONDITION},keep:array<{CONDITION}>,absent:array<string>,special:string",
    )
    special = F.array(
        F.lit(""),
        F.when(is_drafting_question(cur), F.lit("drafting")),
        F.when(personal, F.lit("personal_leave")),
    )
    rule = F.get(
        F.filter(
            rules,
            lambda r: holds(cur, r["question"]) & F.exists(special, lambda s: s.eqNullSafe(r["special"])),
        ),
        F.lit(0),
    )
    df = df.withColumn("_rule", rule)

    def keep(r: Column) -> Column:
        content = X.compact(r["content"])
        fits = holds_one(content, F.col("_rule.keep")) & ~holds_any(content, F.col("_rule.absent"))
        return F.col("_rule").isNull() | fits

    kept = F.array_sort(F.filter("results", keep))
    return df.withColumn("_kept", kept).withColumn(
        "results", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("results"))
    ).drop("_kept", "_rule")
