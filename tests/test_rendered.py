"""Every branch of the policy and contract rules occurs in the registered rows."""

from collections import Counter

from sourcelight.plans import rendered
from sourcelight.rules import clauses as C
from sourcelight.rules import vocabulary as V

FOLDER = "/root/testdata/sf0.001"


def test_all_clause_states(spark):
    rows = rendered.contract_status(spark, FOLDER).collect()
    seen = Counter((r["field"], r["status"]) for r in rows)
    assert set(seen) == {(c.key, s) for c in C.CONTRACT_CLAUSES for s in C.STATUS_NAMES}
    assert set(C.ISSUES.values()) | {C.DEFAULT_ISSUE} <= {r["issue"] for r in rows}
    kinds = {(r["message"] or "")[:5] for r in rows}
    assert {"待确认条款", "审阅提示：", ""} <= kinds and any("含糊表述" in (r["message"] or "") for r in rows)


def test_all_routes_and_followups(spark):
    assert {r["route"] for r in rendered.route_policy(spark, FOLDER).collect()} == {"invalid", "catalog", "project_meta", "retrieval"}
    asked = [r["question"] for r in rendered.followup_policy(spark, FOLDER).collect()]
    assert 0 < sum(V.FOLLOW_UP_MARK in q for q in asked) < len(asked)


def test_all_document_labels(spark):
    rows = rendered.policy_metadata(spark, FOLDER).collect()
    assert {r["is_catalog"] for r in rows} == {True, False}
    assert {k for k, _ in V.CATEGORY_HINTS} | {V.DEFAULT_CATEGORY} <= {r["category"] for r in rows}
    for column in ("title", "sections", "version", "effective_date", "department", "owner"):
        assert any(r[column] for r in rows) and any(not r[column] for r in rows)
    assert any("分类" in r["category"] for r in rows)


def test_all_news_phases_occur(spark):
    rows = rendered.news_latest(spark, "/root/testdata/sf0.01").collect()
    assert {r["phase"] for r in rows} == {1, 2, 3, 4} and len(rows) == 9
    assert {r["image_kind"] for r in rows} == {"photo", "logo"} and {"DeepSeek 官方", "GitHub"} <= {r["source"] for r in rows}
