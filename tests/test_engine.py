"""The whole service surface on a small folder."""

import base64
import json
import tempfile
from pathlib import Path

import pytest

from sourcelight import cli
from sourcelight.engine import Engine
from sourcelight.operators import evaluation


@pytest.fixture(scope="module")
def folder():
    root = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    (root / "docs").mkdir()
    (root / "docs" / "leave.md").write_text("# 假期制度\n## 年假\n年假满一年为5天，年假须提前申请。\n## 婚假\n婚假为3个工作日。", encoding="utf-8")
    (root / "docs" / "travel.md").write_text("# 差旅制度\n## 报销\n差旅费用在返程后10个工作日内提交报销。", encoding="utf-8")
    (root / "contracts").mkdir()
    (root / "contracts" / "c.md").write_text("# 劳务合同\n## 条款\n付款节点：验收后30日内支付。", encoding="utf-8")
    (root / "cases").mkdir()
    (root / "cases" / "x.json").write_text(json.dumps([
        {"case_id": "1", "question": "年假多少天", "expected_source": "leave.md", "expected_keywords": ["5天"]},
        {"case_id": "2", "question": "差旅费多久提交报销", "expected_source": "travel.md"},
        {"case_id": "3", "question": "火星探测登陆", "should_refuse": True},
    ], ensure_ascii=False), encoding="utf-8")
    return root


def test_service(spark, folder):
    engine = Engine(spark, str(folder / "store"))
    assert engine.rebuild(str(folder / "docs"))["chunk_count"] == 3
    assert {r["document_id"]: r["chunk_count"] for r in engine.documents().collect()} == {"leave": 2, "travel": 1}
    assert engine.status().first()["health"] == "ok"
    asked = spark.createDataFrame([("1", "差旅费多久提交报销")], "query_id string, question string")
    assert "10个工作日" in engine.ask(asked).first()["answer"]
    from sourcelight.sources import cases

    rows = engine.evaluate(cases.evaluation_cases(spark, str(folder / "cases")))
    figures = evaluation.summarize(rows).first()
    assert (figures["passed_count"], figures["hit_at_3"], figures["refusal_accuracy"]) == (3, 1.0, 1.0)
    engine.upload_contracts(str(folder / "contracts"), "admin", ["business"])
    with pytest.raises(ValueError, match="exists"):
        engine.upload_contracts(str(folder / "contracts"), "admin", ["business"])
    assert engine.list_contracts("business").count() == 1 and engine.list_contracts("legal").count() == 0
    assert engine.review_contract("c", "business").first()["located"] >= 1
    for document, role in (("c", "legal"), ("none", "admin")):
        with pytest.raises(KeyError):
            engine.review_contract(document, role)
    assert engine.contract_sources("c", "admin").count() == 1
    assert engine.contract_sources("c", "admin", "付款").first()["document_id"] == "c"
    assert engine.related_policy("差旅费多久提交报销").count() >= 1
    assert engine.related_policy("火星探测登陆").count() == 0


def test_command_line(spark, folder, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    cli.main(["--folder", str(folder / "cli"), "rebuild", str(folder / "docs")])
    assert json.loads(capsys.readouterr().out)["document_count"] == 2
    cli.main(["--folder", str(folder / "cli"), "ask", "婚假为几个工作日"])
    assert json.loads(capsys.readouterr().out)["evidence_sufficient"] is True


def test_permissions_decide_what_is_visible(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "kb"))
    content = base64.b64encode("# 合同\n甲方：某公司".encode()).decode()
    uploads = spark.createDataFrame([("c.md", content)], "filename string, content_base64 string")
    engine.upload_files(uploads, "legal", ["business"])
    assert [r["document_id"] for r in engine.list_contracts("business").collect()] == ["c"]
    engine.permissions.grant(["c.md"], ["legal"])
    assert engine.list_contracts("business").count() == 0 and engine.list_contracts("legal").count() == 1
    with pytest.raises(Exception, match="合同文件内容编码无效"):
        engine.upload_files(spark.createDataFrame([("d.md", "***")], uploads.schema), "legal", ["legal"])
    with pytest.raises(ValueError):
        engine.upload_files(uploads, "legal", ["legal"])


def test_plugged_embedding_is_stored(spark, folder, tmp_path):
    """Each chunk is embedded once, at the build; searches embed their question only; a failing plug-in leaves hash vectors."""
    log = tmp_path / "calls"

    def embed(texts):
        with log.open("a") as out:
            out.write("".join(f"{len(t)}\n" for t in texts))
        return [[float(t.count("假") + 1), float(t.count("差") + 1)] for t in texts]

    engine = Engine(spark, str(tmp_path / "kb"), embed=embed)
    meta = engine.rebuild(str(folder / "docs"))
    built = len(log.read_text().split())
    assert meta["effective_embedding_provider"] == "plugged" and meta["dimension"] == 2
    assert built == meta["chunk_count"] == engine.index.vectors().count()
    asked = spark.createDataFrame([("q", "婚假为几个工作日")], "query_id string, question string")
    assert engine.search(asked, 2).where("vector_score is not null").count() > 0
    assert len(log.read_text().split()) == built + 1

    def broken(texts):
        raise RuntimeError("no service")

    other = Engine(spark, str(tmp_path / "kb2"), embed=broken)
    assert other.rebuild(str(folder / "docs"))["effective_embedding_provider"] == "local"
    rows = other.search(asked, 2).collect()
    assert rows and all(r["vector_error"] == "" for r in rows) and any(r["vector_score"] is not None for r in rows)
