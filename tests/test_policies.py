"""The rendered policy cases reach every worded answer, source rule, bonus and question feature."""

from pyspark.sql import functions as F

from sourcelight.operators import evidence
from sourcelight.plans import policies as P
from sourcelight.rules import evidence_rules as R

FOLDER = "/root/testdata/sf0.001"


def test_every_answer_occurs(spark):
    answers = [r["answer"] for r in P.policy_answers(spark, FOLDER).collect()]
    heads = {c.header for c in R.COMPOSERS} | {R.PERSONAL_LEAVE_HEADER, R.PERSONAL_LEAVE_PAY_TEXT, R.LEAVE_HEADER, R.HANDBOOK_HEADER}
    heads |= {R.GENERIC_ANSWER_PREFIX, P.REFUSED}
    assert not [h for h in heads if not any(a.startswith(h) for a in answers)]
    assert all(any(text in a for a in answers) for _, text in R.TRANSPORT_TEXTS)


def test_every_source_rule_decides_once(spark):
    asked = P._picked(spark, FOLDER, P.SOURCES).select(F.col("c0").alias("question")).distinct()
    rows = evidence.add_question_features(asked).select("question", "current_ns", "drafting").collect()
    first = set()
    for r in rows:
        for i, rule in enumerate(R.SOURCE_RULES):
            said = all(any(t in r["current_ns"] for t in group) for group in rule.question)
            special = {"drafting": r["drafting"], "personal_leave": "事假" in r["current_ns"], "": True}[rule.special]
            if said and special:
                first.add(i)
                break
    assert first == set(range(len(R.SOURCE_RULES)))
    assert {r["kept"] for r in P.policy_sources(spark, FOLDER).collect()} == {"1", "1,3", "1,2,3"}


def test_every_bonus_and_feature_occurs(spark):
    met = {
        i for q, s, _ in P.BONUSES for i, rule in enumerate(R.PHRASE_RULES)
        if all(any(t in q.replace(" ", "") for t in g) for g in rule.question)
        and all(any(t in s.replace(" ", "") for t in g) for g in rule.sentence)
    }
    assert met == set(range(len(R.PHRASE_RULES)))
    rows = P.policy_features(spark, FOLDER).collect()
    for column in ("drafting", "stage", "alias_added"):
        assert {r[column] for r in rows} == {True, False}
    assert {r["subjects"] for r in rows} == {"", "打印机", "扫描仪,投影仪"}


def test_cases_are_dealt_out(spark):
    """One row group of ``part`` does not leave all rules to one task."""
    assert P._picked(spark, FOLDER, P.CASES).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
