"""Rendered contracts reach every status through the anchors, every override, place and decision."""

from sourcelight.plans import agreements as A
from sourcelight.rules import clauses as C

FOLDER = "/root/testdata/sf0.001"


def test_every_status_is_located(spark):
    rows = A.contract_located(spark, FOLDER).collect()
    seen = {(r["field"], r["status"]) for r in rows}
    whole = {(f, s) for f in A.FIELDS for s in C.STATUS_NAMES}
    assert whole - seen == {("termination_renewal", "incomplete")}  # its anchors are what it requires
    assert any(r["evidence"].endswith("天") for r in rows if r["field"] == "term")  # the schedule block
    assert any("\n\n" in r["evidence"] for r in rows if r["field"] == "parties")
    assert any("\n\n" in r["evidence"] for r in rows if r["field"] == "amount")


def test_every_part_of_a_record_occurs(spark):
    reports = [r["report"] for r in A.contract_records(spark, FOLDER).collect()]
    for part in ("人工复核：" + d for d in C.DECISIONS):
        assert any(part in r for r in reports)
    for part in ("人工备注：\n> 备注", "第 1 页", "第 2 页", "未取得可靠页码或章节"):
        assert any(part in r for r in reports)
