"""Whole contracts rendered from ``customer``: located, judged, decided on and exported.

Each contract holds, per clause, a complete wording, a lacking one or none, by
its key. The SQL twins state evidence, status and place of every wording by
hand and write the record again; labels, focus and issue texts come from the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.operators import clauses
from sourcelight.plans import corpus
from sourcelight.rules import clauses as C

#: field -> (complete text, its evidence), (other text, its evidence), status of the other;
#: {k} is the customer's key, {n} a small number. No evidence stated: the text itself.
WORDINGS = {
    "term": (
        ("计划开工日期：2026年3月1日，计划竣工日期：2026年9月1日，合同工期总日历天数：{n}天。2.质量标准 优良。",
         "计划开工日期：2026年3月1日，计划竣工日期：2026年9月1日，合同工期总日历天数：{n}天"),
        ("合同期限由双方商定，共{n}次。", ""), "incomplete"),
    "payment": (("付款节点为验货后{n}日内支付。", ""), ("付款尽快办理，编号{k}。", ""), "incomplete"),
    "parties": (
        ("甲方：海河建设公司\n乙方：云山劳务公司{k}", "甲方：海河建设公司\n\n乙方：云山劳务公司{k}"),
        ("甲方：待填写。", ""), "incomplete"),
    "amount": (
        ("签约合同价（含增值税）：{k}元。\n签约合同价（不含增值税）：{n}元。", "签约合同价（含增值税）：{k}元。\n\n签约合同价（不含增值税）：{n}元。"),
        ("不含税价{n}元，税率另计。", ""), "incomplete"),
    "banking": (("开户银行：建设银行，账号：622200{k}。", ""), ("开户银行待补，编号{k}。", ""), "incomplete"),
    "insurance": (("承包商应投保工程险{n}项。", ""), ("保险由双方协商，编号{k}。", ""), "incomplete"),
    "performance_bond": (("履约保证金为{n}万元。", ""), ("履约保证金另行约定，编号{k}。", ""), "incomplete"),
    "termination_renewal": (("任一方可提前{n}日提出解除。", ""), ("届满可以及时续签，编号{k}。", ""), "found"),
    "variation_claims": (("现场签证须经书面确认{n}次。", ""), ("现场签证须经确认，编号{k}。", ""), "incomplete"),
    "retention_warranty": (("质保金按{n}%返还。", ""), ("质保金按规定返还，编号{k}。", ""), "incomplete"),
    "acceptance": (("验收标准为合格，编号{k}。", ""), ("验收程序另行约定，编号{k}。", ""), "incomplete"),
    "liability": (("违约责任方赔偿损失{n}元。", ""), ("违约责任由双方商定，编号{k}。", ""), "incomplete"),
}
FIELDS = tuple(c.key for c in C.CONTRACT_CLAUSES)
PAGE = 6  # clauses of a page


def _filled(text: str, values: dict[str, Column]) -> Column:
    out = F.lit(text)
    for mark, value in values.items():
        out = F.replace(out, F.lit(f"{{{mark}}}"), value)
    return out


def contracts(spark, sf: str) -> DataFrame:
    """document_id, c_custkey, title, content: a contract of two pages per customer."""
    key = F.col("c_custkey")
    values = {"k": key.cast("string"), "n": (key % 60 + 1).cast("string")}
    lines = []
    for i, field in enumerate(FIELDS):
        full, other, _ = WORDINGS[field]
        kind = (key + i) % 3
        line = F.when(kind == 0, _filled(full[0] + "\n", values)).when(kind == 1, _filled(other[0] + "\n", values)).otherwise("")
        lines += [F.lit(f"## 第 {i // PAGE + 1} 页\n"), line] if i % PAGE == 0 else [line]
    title = F.concat(F.lit("施工合同"), values["k"])
    content = F.concat(F.lit("# "), title, F.lit("\n"), *lines)
    return corpus.spread(corpus.table(spark, sf, "customer").select("c_custkey")).select(
        values["k"].alias("document_id"), "c_custkey", title.alias("title"), content.alias("content")
    )


def decisions(docs: DataFrame) -> DataFrame:
    """One decided field for every second contract, with a note of two lines for every fourth."""
    key = F.col("c_custkey")
    note = F.when(key % 4 == 0, F.concat(F.lit("备注"), F.col("document_id"), F.lit("\n已核对"))).otherwise("")
    return docs.where(key % 2 == 0).select(
        "document_id", F.get(X.literal_array(FIELDS), (key % len(FIELDS)).cast("int")).alias("field"),
        F.when(key % 3 == 0, "需补充").otherwise("已确认").alias("decision"), note.alias("note"),
    )


def contract_located(spark, sf: str) -> DataFrame:
    """Evidence, status and issue of every clause of every contract, through the real anchors."""
    return clauses.extract_fields(contracts(spark, sf)).select("document_id", "field", "evidence", "status", "issue")


def contract_reviews(spark, sf: str) -> DataFrame:
    """Counts and prompts of every review."""
    reviews = clauses.review(contracts(spark, sf))
    prompts = F.transform("risk_prompts", lambda p: F.concat(p["field"], F.lit(":"), p["severity"]))
    return reviews.select(
        "document_id", "checked", "located", "incomplete", "pending", "summary", F.array_join(prompts, ",").alias("prompts")
    )


def contract_records(spark, sf: str) -> DataFrame:
    """The exported record of every review with the decisions taken."""
    docs = contracts(spark, sf)
    return clauses.export_review(clauses.review(docs), decisions(docs))


QUERIES = {
    "contract_located": contract_located,
    "contract_reviews": contract_reviews,
    "contract_records": contract_records,
}


# --- SQL twins --------------------------------------------------------------------------


def _sql(text: str) -> str:
    quoted = text.replace("'", "''").replace("{k}", "' || c_custkey || '").replace("{n}", "' || (c_custkey % 60 + 1) || '")
    return f"'{quoted}'"


def _rows_sql() -> str:
    """Common tables ``c`` (contracts) and ``f`` (one row per contract and clause)."""
    content, rows = [], []
    for i, clause in enumerate(C.CONTRACT_CLAUSES):
        full, other, state = WORDINGS[clause.key]
        kind = f"(c_custkey + {i}) % 3"
        if i % PAGE == 0:
            content.append(_sql(f"## 第 {i // PAGE + 1} 页\n"))
        content.append(f"CASE {kind} WHEN 0 THEN {_sql(full[0] + chr(10))} WHEN 1 THEN {_sql(other[0] + chr(10))} ELSE '' END")
        lacking = C.ISSUES.get(clause.key, C.DEFAULT_ISSUE) if state == "incomplete" else ""
        rows.append(
            f"""SELECT c_custkey, {i} AS i, '{clause.key}' AS field, '{clause.label}' AS label, '{clause.review_focus}' AS focus,
              CASE {kind} WHEN 0 THEN {_sql(full[1] or full[0])} WHEN 1 THEN {_sql(other[1] or other[0])} ELSE '' END AS evidence,
              CASE {kind} WHEN 0 THEN 'found' WHEN 1 THEN '{state}' ELSE 'missing' END AS status,
              CASE {kind} WHEN 1 THEN '{lacking}' ELSE '' END AS issue,
              CASE WHEN {kind} < 2 AND NOT ('{clause.key}' = 'parties' AND {kind} = 1) THEN '第 {i // PAGE + 1} 页' END AS page FROM customer"""
        )
    return f"""c AS (SELECT c_custkey, '施工合同' || c_custkey AS title,
        '# 施工合同' || c_custkey || chr(10) || {' || '.join(content)} AS content FROM customer),
      f AS ({' UNION ALL '.join(rows)})"""


def oracle_sql() -> dict[str, str]:
    # The wordings above that hold a vague term.
    vague = "regexp_matches(evidence, '尽快|及时|另行约定')"
    quoted = lambda x: f"'> ' || replace({x}, chr(10), chr(10) || '> ')"
    numbered = ", ".join(f"'{x}'" for x in FIELDS)
    return {
        "contract_located": f"WITH {_rows_sql()} SELECT c_custkey::VARCHAR AS document_id, field, evidence, status, issue FROM f",
        "contract_reviews": f"""WITH {_rows_sql()} SELECT c_custkey::VARCHAR AS document_id, count(*) AS checked,
            count(*) FILTER (status = 'found') AS located, count(*) FILTER (status = 'incomplete') AS incomplete,
            count(*) FILTER (status <> 'found') AS pending,
            '本次按 12 类常见条款进行定位：已定位 ' || located || ' 项，信息不完整或待确认 ' || pending || ' 项。定位到原文不代表条款已经充分或无需人工复核。' AS summary,
            coalesce(string_agg(field || CASE WHEN status = 'found' THEN ':low' ELSE ':medium' END, ',' ORDER BY i)
              FILTER (status <> 'found' OR {vague}), '') AS prompts FROM f GROUP BY c_custkey""",
        "contract_records": f"""WITH {_rows_sql()}, d AS (SELECT *, c_custkey % 2 = 0 AND field = [{numbered}][c_custkey % 12 + 1] AS decided FROM f),
          s AS (SELECT c_custkey, i, '## ' || label || chr(10) || chr(10) || '系统定位：'
              || CASE status WHEN 'found' THEN '已定位' WHEN 'missing' THEN '未定位' ELSE '信息不完整' END || '；人工复核：'
              || CASE WHEN NOT decided THEN '待复核' WHEN c_custkey % 3 = 0 THEN '需补充' ELSE '已确认' END
              || chr(10) || chr(10) || '核对要点：' || focus || chr(10) || chr(10)
              || coalesce('原文位置：' || page, '原文位置：未取得可靠页码或章节，需打开完整文件核对') || chr(10)
              || CASE WHEN evidence <> '' THEN chr(10) || {quoted('evidence')} ELSE '' END
              || CASE WHEN decided AND c_custkey % 4 = 0 THEN chr(10) || chr(10) || '人工备注：' || chr(10)
                || '> 备注' || c_custkey || chr(10) || '> 已核对' ELSE '' END || chr(10) AS part FROM d)
          SELECT c_custkey::VARCHAR AS document_id, '# 合同条款核对记录' || chr(10) || chr(10) || '合同：' || any_value(title) || chr(10) || chr(10)
            || '文本版本（SHA-256）：' || any_value(sha256(content)) || chr(10) || chr(10)
            || '本记录用于人工复核与交接，不代表签署批准。人工结论由当前操作者填写，未进行身份签名。' || chr(10) || chr(10)
            || string_agg(part, chr(10) ORDER BY i) AS report FROM s JOIN c USING (c_custkey) GROUP BY c_custkey""",
    }
