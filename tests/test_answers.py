"""Gate, source filter, composers, conversations and the question path."""

import pytest
from pyspark.sql import functions as F

from sourcelight.functions.dedupe import select_distinct
from sourcelight.operators import compose, conversation, evidence
from sourcelight.operators.chunking import split_documents
from sourcelight.rules import evidence_rules as R
from sourcelight.rules import vocabulary as V
from sourcelight.settings import Settings

SCHEMA = (
    "query_id int, question string, results array<struct<rank:int,chunk_id:string,document_id:string,chunk_index:int,"
    "title:string,section:string,source_path:string,content:string,knowledge_base_id:string,score:double>>"
)


def chunk(rank, doc, title, content, index=0):
    return (rank, f"{doc}-{index:03d}", doc, index, title, "正文", f"{doc}.md", content, "policy", 1.0)


# question, chunks, best document, parts the adapted answer must hold
CASES = [
    ("婚假多久休完？", [chunk(1, "leave", "假期制度", "1. 婚假基础标准为3个工作日。\n2. 员工应在领取结婚证后12个月内休完婚假。")],
     "leave", ["婚假规定：", "3个工作日", "12个月"]),
    ("火星探测怎么申请？", [chunk(1, "leave", "假期制度", "1. 婚假基础标准为3个工作日。")], None, ["依据不足"]),
    ("事假扣工资吗", [chunk(1, "hr", "员工管理", "事假为无薪事假，事假不计发请假期间工资。\n事假原则上应提前1个工作日申请。")],
     "hr", ["事假属于无薪事假", "如果你准备申请，原则上应提前1个工作日申请。"]),
    ("高铁可以报销吗", [chunk(1, "travel", "差旅报销", "高铁报销：员工级可报销飞机经济舱、动车组二等座、轮船三等舱。\n机票、火车票、船票须从指定渠道购买。")],
     "travel", ["交通费用报销：", "高铁按制度对应动车组", "指定渠道"]),
    ("采购报价需要几家供应商？", [chunk(1, "proc", "采购制度", "采购门槛以上需三家供应商报价。\n采购报价由采购部汇总，供应商需签字。")],
     "proc", ["根据《采购制度》中的相关规定：", "三家供应商报价"]),
    ("驳船准入的注册资金和保险要求？",
     [chunk(1, "ship", "驳船准入", "驳船准入注册资金不得少于 200 万元。\n驳船准入须持有水路运输许可证。\n驳船准入须投保船舶险和承运人责任险。")],
     "ship", ["驳船供应商准入要求：", "200 万元", "水路运输许可证", "承运人责任险"]),
    ("打印机维修怎么报销", [chunk(1, "fee", "费用报销", "电脑维修费用凭发票报销，维修报销需审批。")], None, ["依据不足"]),
    ("新员工年假有多少天",
     [chunk(1, "leave", "年休假制度", "新入职员工的可用额度按规则折算，以平台核定余额为准。累计工作已满1年不满10年的，年度年休假为5天。"
                                 "累计工作已满10年不满20年的，年度年休假为10天。累计工作已满20年的，年度年休假为15天。")],
     "leave", ["累计工作满 1 年不满 10 年：5 天", "累计工作满 20 年：15 天"]),
    ("年假怎么申请，连续请5个工作日",
     [chunk(1, "leave", "年休假制度", "员工在平台查询余额并选择假别提交年假申请。\n连续请假超过 3 个工作日的，年假至少提前 5 个工作日申请。\n连续请假不超过 3 个工作日的，年假至少提前 2 个工作日申请。")],
     "leave", ["年休假申请要点：", "查询余额并选择假别", "超过 3 个工作日"]),
    ("住宿标准是多少", [chunk(1, "travel", "差旅住宿", "住宿标准：员工级住宿上限每晚500元。\n一线城市指北京、上海。")],
     "travel", ["住宿标准：", "住宿上限", "一线城市指"]),
]


@pytest.fixture(scope="module")
def gated(spark):
    rows = [(i, q, chunks) for i, (q, chunks, _, _) in enumerate(CASES)]
    return evidence.gate(spark.createDataFrame(rows, SCHEMA))


def test_gate_picks_documents(gated):
    got = {r["query_id"]: r["best_document"] for r in gated.select("query_id", "best_document").collect()}
    assert got == {i: doc for i, (_, _, doc, _) in enumerate(CASES)}


def test_worded_answers(gated):
    rows = compose.compose_local(evidence.filter_sources(gated)).select("query_id", "local_answer").collect()
    for r in rows:
        for part in CASES[r["query_id"]][3]:
            assert part in r["local_answer"], r["local_answer"]


def test_switch_off_uses_generic_answer(spark):
    rows = spark.createDataFrame([(i, q, c) for i, (q, c, _, _) in enumerate(CASES[:1])], SCHEMA)
    out = compose.compose_local(evidence.gate(rows, adaptations=False), adaptations=False).first()
    assert out["composer"] == "generic" and out["local_answer"].startswith("根据《假期制度》")


def test_best_document_prefers_rank_then_id(spark):
    text = "采购报价由采购部汇总，供应商需签字。"
    rows = [(1, "采购报价供应商", [chunk(2, "x", "无", text), chunk(1, "y", "无", text)])]
    assert evidence.gate(spark.createDataFrame(rows, SCHEMA)).first()["best_document"] == "y"


def test_source_filter_keeps_all_when_none_fits(spark):
    rows = [
        (1, "婚假几天", [chunk(1, "a", "t", "婚假三天"), chunk(2, "a", "t", "其他内容")]),
        (2, "婚假几天", [chunk(1, "a", "t", "其他内容")]),
        (3, "什么都不匹配", [chunk(1, "a", "t", "其他内容"), chunk(2, "a", "t", "更多")]),
    ]
    featured = evidence.add_question_features(spark.createDataFrame(rows, SCHEMA))
    got = {r["query_id"]: r["n"] for r in evidence.filter_sources(featured).select("query_id", F.size("results").alias("n")).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_phrase_rules(spark):
    df = spark.createDataFrame(
        [("上海住宿标准", "一线城市500元", 4), ("发票抬头", "发票抬头见 XQ-FIN-002", 2), ("打车费", "出租车凭票", 3), ("无", "无", 0)],
        "q string, s string, w int")
    rows = df.select("w", evidence.phrase_bonus(F.col("q"), F.col("s")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["w"] for r in rows]


def test_near_duplicates():
    facts = ["1. 员工出差返程后十个工作日内提交报销", "员工出差返程后十个工作日内提交报销单", "短句", "短句", "完全不同的另外一条规则内容说明"]
    assert select_distinct(facts, 0) == [0, 2, 3, 4]
    assert select_distinct(facts, 0, exact=True) == [0, 2, 4]
    assert select_distinct(facts, 2) == [0, 2]


def test_every_composer_has_a_way_to_answer():
    assert len(R.COMPOSERS) == len({id(c) for c in R.COMPOSERS})
    assert all(c.slots or c.collect for c in R.COMPOSERS)


TALK = [
    (1, 0, "system", "hi"), (1, 1, "user", "年假怎么休"), (1, 2, "assistant", "五天"), (1, 3, "user", "那需要多久"),
    (1, 4, "user", "发票怎么弄"), (1, 5, "assistant", "附票"), (1, 6, "assistant", "再附"), (1, 7, "user", "入职2个月"),
]


def talk(spark):
    return spark.createDataFrame(TALK, "conv_id int, turn int, role string, text string")


def test_follow_ups(spark):
    seen = conversation.previous_question(talk(spark)).where("role = 'user'")
    rows = seen.select("turn", conversation.contextualize(F.col("text"), F.col("previous")).alias("q")).orderBy("turn").collect()
    assert [r["q"] for r in rows] == [
        "年假怎么休", "上一问：年假怎么休\n当前追问：那需要多久", "发票怎么弄", "上一问：发票怎么弄\n当前追问：入职2个月"]


def test_pairs_and_history(spark):
    pairs = conversation.turn_pairs(talk(spark)).orderBy("turn").collect()
    assert [(r["turn"], r["reply"]) for r in pairs] == [(0, None), (1, "五天"), (3, None), (4, "附票"), (6, None), (7, None)]
    assert [r["turn"] for r in conversation.recent_history(talk(spark), 8).orderBy("turn").collect()] == [1, 2, 3, 4, 5, 6, 7]


def test_long_conversation_is_cut_into_stretches(spark, monkeypatch):
    rows = [(c, t, ("user", "assistant", "user", "system")[t % 4 if c else t % 2], f"{c}-{t}" if t % 5 else " ")
            for c in (0, 1) for t in range(0, 60, 1 + c)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")

    def run():
        pairs = [tuple(r) for r in conversation.turn_pairs(df).orderBy("conv_id", "turn").collect()]
        prev = [tuple(r) for r in conversation.previous_question(df).orderBy("conv_id", "turn").collect()]
        return pairs, prev

    whole = run()
    monkeypatch.setattr(conversation, "STRETCH", 4)
    assert run() == whole


def test_routes(spark):
    rows = spark.createDataFrame([("知识库 里有哪些 文档",), ("这个项目是做什么的",), ("年假",), (" ",)], "q string")
    assert [r[0] for r in rows.select(conversation.route(F.col("q"))).collect()] == ["catalog", "project_meta", "retrieval", "invalid"]


@pytest.fixture(scope="module")
def library(spark):
    docs = spark.createDataFrame(
        [("leave", "假期制度", "hr", "leave.md", "年假满一年为5天。婚假基础标准为3个工作日，婚假须附结婚证。", "ready", "policy"),
         ("travel", "差旅制度", "fin", "travel.md", "出差返程后10个工作日内提交报销。", "ready", "policy")],
        "document_id string, title string, category string, source_path string, content string, status string, knowledge_base_id string")
    return split_documents(docs), docs


def test_ask(spark, library):
    chunks, docs = library
    asked = spark.createDataFrame(
        [(1, "婚假几天", None), (2, "有哪些制度", None), (3, "项目架构", None), (4, "", None), (5, "火星探测登陆", None), (6, "那具体多久", "年假几天")],
        "query_id int, question string, previous string")
    rows = {r["query_id"]: r for r in conversation.ask(chunks, docs, asked).collect()}
    assert [rows[i]["answer_mode"] for i in range(1, 7)] == ["extractive", "direct", "direct", "direct", "refusal", "extractive"]
    assert rows[2]["answer"] == "知识库当前收录 2 份文档：1. 假期制度；2. 差旅制度。"
    assert rows[3]["answer"] == V.PROJECT_META_ANSWER and rows[4]["answer"] == V.EMPTY_QUESTION_ANSWER
    assert rows[1]["best_document"] == "leave" and all(s["document_id"] == "leave" for s in rows[1]["results"])
    assert rows[5]["retrieved_count"] == 0


def test_ask_with_model(spark, library):
    chunks, docs = library
    asked = spark.createDataFrame([(1, "婚假几天"), (2, "火星探测登陆")], "query_id int, question string")

    def mode(generate):
        rows = {r["query_id"]: r for r in conversation.ask(chunks, docs, asked, generate=generate).collect()}
        return rows[1]["answer_mode"], rows[1]["answer"], rows[2]["answer_mode"]

    assert mode(lambda p: "三个工作日") == ("model", "三个工作日", "refusal")
    assert mode(lambda p: "原则上三天")[0] == "source_facts"
    assert mode(lambda p: "")[0] == "unavailable"
    off = conversation.ask(chunks, docs, asked, Settings(), extractive=False).where("query_id = 1").first()
    assert off["answer_mode"] == "unavailable"


def test_generated_leave_wording(spark):
    text = "员工自入职后的第二个日历年起享受年休假。"
    rows = spark.createDataFrame(
        [(1, "上一问：年假几天\n当前追问：入职2个月", [chunk(1, "a", "t", text)]), (2, "年假几天", [chunk(1, "a", "t", text)]),
         (3, "年假全部分档", [chunk(1, "a", "t", text)]), (4, "年假几天", [chunk(1, "a", "t", "其他")])], SCHEMA)
    df = evidence.add_question_features(rows).withColumn("g", F.lit("入职满一年后有年假"))
    got = {r["query_id"]: r["a"] for r in df.select("query_id", conversation.keep_leave_wording(F.col("g")).alias("a")).collect()}
    assert "仅凭入职 2个月 不能完整核定年假" in got[1] and got[2] == R.SECOND_YEAR_SHORT
    assert got[3] == "自入职后的第二个日历年起有年假" and got[4] == "入职满一年后有年假"


def test_request_limits(spark):
    ok = spark.createDataFrame([(1, "x" * 1000)], "query_id int, question string")
    assert conversation.check_requests(ok).count() == 1
    with pytest.raises(Exception, match="1000"):
        conversation.check_requests(ok.withColumn("question", F.concat("question", F.lit("y")))).collect()
    with pytest.raises(Exception, match="history"):
        conversation.check_history(spark.createDataFrame([("system", "x")], "role string, text string")).collect()
