"""Questions and policies rendered from ``part``, with the answers they must get stated by hand.

Every row takes one of the cases by its key and puts its size into the policy,
so the expected results follow from the table. The SQL twins hold no rule: they
state the outcome of each case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.operators import compose, evidence
from sourcelight.plans import corpus

REFUSED = "依据不足：现有制度中未检索到能确认该问题的条款，请联系对应责任部门核实。"
TIERS = (
    "新员工的年假不是统一固定天数。制度先按经核验的累计社会工作年限确定全年标准，"
    "入职当年再由人力资源部折算，最终以平台核定余额为准：\n"
)
HANDBOOK = "新员工的年假不是统一固定天数。员工自入职后的第二个日历年起享受，全年标准按实际工作年限确定；"
APPLY = "员工在平台查询余额并选择假别提交年假申请。"
OVER_3 = "连续请假超过 3 个工作日的，年假至少提前 {n} 个工作日申请。"
UP_TO_3 = "连续请假不超过 3 个工作日的，年假至少提前 {n} 个工作日申请。"
BOOKING = "机票、火车票、船票须从指定渠道购买。"
PAY = (
    "按现行员工管理制度，事假属于无薪事假，请假期间不计发工资；考勤和薪资处理还要按公司当月规则执行。"
    "也就是说，具体应发金额要结合当月薪资规则核算，不能只按‘扣多少钱’一概而论。"
)
OBJECTION = (
    "承办人应向公司法律顾问详细说明情况；法律顾问提出合理化建议后，"
    "由承办人在法定、约定或合理期限内以书面方式向对方提出异议。"
)

#: question, title, policy, composer, answer; {n} stands for the size of the part
CASES = (
    ("入职前账号开通和试用期目标由谁负责？", "报到职责", "信息技术部在收到账号开通申请后{n}小时内开通账号。用人部门负责制定试用期目标并在{n}日内确认。",
     "worded", "报到前职责分工：\n- 信息技术部在收到账号开通申请后{n}小时内开通账号。\n- 用人部门负责制定试用期目标并在{n}日内确认。"),
    ("新员工年假有多少天？", "年休假制度",
     "新入职员工的可用额度按规则折算，以平台核定余额为准。累计工作已满1年不满10年的，年度年休假为{n}天。"
     "累计工作已满10年不满20年的，年度年休假为10天。累计工作已满20年的，年度年休假为15天。",
     "worded", TIERS + "- 累计工作满 1 年不满 10 年：{n} 天\n- 累计工作满 10 年不满 20 年：10 天\n- 累计工作满 20 年：15 天"),
    ("新员工年休假有几天？", "员工手册",
     "员工自入职后的第二个日历年起享受年休假。实际工作1~6年（含）之间，可享有{n}天年休假。"
     "工作满6年后，每服务一年增加一天，至可享有10天年休假止。实际工作10~16年（含）之间，可享受12天年休假。实际工作满20年，可享有15天年休假。",
     "worded", HANDBOOK + "入职第一年的具体额度需由人力资源部按适用规则核定：\n- 实际工作 1~6 年（含）：{n} 天\n"
     "- 工作满 6 年后：每服务 1 年增加 1 天，最高 10 天\n- 实际工作 10~16 年（含）：12 天\n- 实际工作满 20 年：15 天"),
    ("入职当年的年休假怎么折算？", "员工手册",
     "新入职员工的年休假可用额度由人力资源部折算，以员工服务平台核定余额为准。实际工作1~6年（含）之间，可享有5天年休假。"
     "实际工作10~16年（含）之间，可享有{n}天年休假。实际工作满20年，可享有15天年休假。",
     "worded", HANDBOOK + "入职当年由人力资源部折算，最终以员工服务平台核定余额为准：\n- 实际工作 1~6 年（含）：5 天\n"
     "- 实际工作 10~16 年（含）：{n} 天\n- 实际工作满 20 年：15 天"),
    ("年假怎么申请，连续请5个工作日？", "年休假制度", f"{APPLY}\n{OVER_3}\n{UP_TO_3}", "worded", f"年休假申请要点：\n- {APPLY}\n- {OVER_3}"),
    ("年假怎么申请，连续请2个工作日？", "年休假制度", f"{APPLY}\n{OVER_3}\n{UP_TO_3}", "worded", f"年休假申请要点：\n- {APPLY}\n- {UP_TO_3}"),
    ("年假怎么申请？", "年休假制度", "年假申请由直属经理在{n}日内批准。员工应提前提出年假申请。年假申请从速。",
     "worded", "年休假申请要点：\n- 年假申请由直属经理在{n}日内批准。\n- 员工应提前提出年假申请。"),
    ("入职的非关键材料可以补交吗？", "报到材料", "入职的非关键材料应在报到后{n}个工作日内补交，须经人事同意。",
     "worded", "新员工材料补交：\n- 入职的非关键材料应在报到后{n}个工作日内补交，须经人事同意。"),
    ("境外使用VPN要申请吗？", "远程接入", "员工在境外使用VPN须提前 3 个工作日申请，期限{n}天。",
     "worded", "境外使用 VPN：\n- 员工在境外使用VPN须提前 3 个工作日申请，期限{n}天。"),
    ("婚假有几天，多久休完？", "假期制度", "1. 婚假应在领取结婚证后{n}个月内休完。\n2. 婚假基础标准为3个工作日。\n3. 婚假期间照发薪资。",
     "worded", "婚假规定：\n- 婚假基础标准为3个工作日。\n- 婚假应在领取结婚证后{n}个月内休完。"),
    ("新员工入职办理流程是什么？", "入职制度", "录用确认后{n}日内向新员工发放入职通知。报到材料由人事核对。退休人员转正不适用。账号、设备与门禁在报到前备好。",
     "worded", "新员工入职流程：\n- 录用确认后{n}日内向新员工发放入职通知。\n- 报到材料由人事核对。\n- 账号、设备与门禁在报到前备好。"),
    ("事假怎么申请？", "员工管理", "事假为无薪事假，全年不超过{n}日。事假原则上应提前1个工作日申请。事假由直属负责人审批。事假遇紧急情况应及时通知主管。",
     "worded", "事假申请可以这样办理：\n- 事假为无薪事假，全年不超过{n}日。\n- 事假原则上应提前1个工作日申请。\n- 事假由直属负责人审批。"),
    ("请事假扣工资吗？", "员工管理", "事假不计发请假期间工资，每月核算{n}次。事假原则上应提前1个工作日申请。",
     "worded", PAY + "如果你准备申请，原则上应提前1个工作日申请。"),
    ("出差住宿标准和报销提交时限是什么？", "差旅制度", "出差的员工级住宿标准为一线城市每晚{n}00元。出差员工应在返程后提交报销，不迟于10个工作日。",
     "worded", "差旅住宿与报销时限：\n- 出差的员工级住宿标准为一线城市每晚{n}00元。\n- 出差员工应在返程后提交报销，不迟于10个工作日。"),
    ("行程单和发票抬头有什么要求？", "票据制度", "报销单须附行程单与发票{n}份。缺件的，财务部门可退回补充。发票抬头须写公司全称与统一社会信用代码。",
     "worded", "差旅票据与附件：\n- 报销单须附行程单与发票{n}份。\n- 缺件的，财务部门可退回补充。\n- 发票抬头须写公司全称与统一社会信用代码。"),
    ("合同起草前要对相对方调查哪些方面？", "合同制度", "签署合同前应调查相对方的主体资格、资信状况、履行能力，不少于{n}日。",
     "worded", "合同相对方调查：\n- 签署合同前应调查相对方的主体资格、资信状况、履行能力，不少于{n}日。"),
    ("合同不履行怎么办？", "合同制度", "合同不履行时，承办人将情况向公司法律顾问作出详细说明。承办人应在{n}日内以书面方式提出异议。",
     "worded", "合同履约异常处理：\n- " + OBJECTION),
    ("驳船供应商的注册资金和保险有什么要求？", "驳船准入", "驳船供应商注册资金不得少于 200 万元。驳船供应商须持有水路运输许可证{n}份。驳船供应商须投保船舶险和承运人责任险。",
     "worded", "驳船供应商准入要求：\n- 驳船供应商注册资金不得少于 200 万元。\n- 驳船供应商须持有水路运输许可证{n}份。\n- 驳船供应商须投保船舶险和承运人责任险。"),
    ("新增驳船供应商要提交什么材料？", "驳船准入", "业务部门按采购需求、预算提出新增申请。驳船供应商应同步提供相关资料，含水路运输许可证{n}份。资料还包括船舶配置与服务航线、船舶保单。",
     "worded", "新增驳船供应商：\n- 业务部门按采购需求、预算提出新增申请。\n- 驳船供应商应同步提供相关资料，含水路运输许可证{n}份。\n- 资料还包括船舶配置与服务航线、船舶保单。"),
    ("差旅费报销需要什么材料？", "差旅制度", "差旅报销单须附票据材料{n}份。差旅行程另作说明。", "worded", "差旅费报销材料：\n- 差旅报销单须附票据材料{n}份。"),
    ("差旅费多久提交报销？", "差旅制度", "差旅员工返程后{n}日内提交报销。差旅逾期未交的顺延至次月。差旅出差前须提交报销预算。",
     "worded", "差旅报销提交时限：\n- 差旅员工返程后{n}日内提交报销。\n- 差旅逾期未交的顺延至次月。"),
    ("发票抬头怎么写？", "发票制度", "发票抬头应为公司全称，共{n}字。同一发票只能报销一次。",
     "worded", "发票抬头：\n- 发票抬头应为公司全称，共{n}字。\n- 同一发票只能报销一次。"),
    ("住宿标准是多少？", "差旅制度", "住宿标准为员工级住宿上限每晚{n}元。一线城市指北京、上海。",
     "worded", "住宿标准：\n- 住宿标准为员工级住宿上限每晚{n}元。\n- 一线城市指北京、上海。"),
    ("上海的住宿标准是多少？", "差旅制度", "住宿标准为员工级住宿上限每晚{n}元。上海属于一线城市，一线城市指北京、上海。",
     "worded", "住宿标准：\n- 住宿标准为员工级住宿上限每晚{n}元。"),
    ("火车超过6小时可以换飞机吗？", "差旅制度", "员工级交通可报销飞机经济舱、火车硬卧。火车连续乘车超过6小时的，可选飞机经济舱{n}次。低于上述条件的乘坐高铁。",
     "worded", "长途交通选择：\n- 火车连续乘车超过6小时的，可选飞机经济舱{n}次。\n- 低于上述条件的乘坐高铁。"),
    ("高铁可以报销吗？", "差旅制度", "员工级可报销高铁、动车组二等座{n}次。" + BOOKING,
     "worded", "交通费用报销：\n- 高铁按制度对应动车组，可按动车组座位等级报销：员工级、专业及主管级原则上可报销动车组二等座；经理及以上可报销动车组一等座。\n- " + BOOKING),
    ("动车可以报销吗？", "差旅制度", "员工级可报销动车、动车组二等座{n}次。" + BOOKING,
     "worded", "交通费用报销：\n- 员工级、专业及主管级原则上可报销动车组二等座；经理及以上可报销动车组一等座。\n- " + BOOKING),
    ("飞机可以报销吗？", "差旅制度", "员工级可报销飞机，限飞机经济舱{n}次。" + BOOKING,
     "worded", "交通费用报销：\n- 员工级、专业及主管级和经理及以上均可按飞机经济舱标准报销；超出规定等级需按制度说明并审批。\n- " + BOOKING),
    ("轮船可以报销吗？", "差旅制度", "员工级可报销轮船，限轮船三等舱{n}次。" + BOOKING,
     "worded", "交通费用报销：\n- 员工级、专业及主管级原则上可报销轮船三等舱；经理及以上可报销轮船二等舱。\n- " + BOOKING),
    ("火车座位可以报销吗？", "差旅制度", "员工级火车座位可报销动车组二等座{n}次。" + BOOKING,
     "worded", "交通费用报销：\n- 员工级火车座位可报销动车组二等座{n}次。\n- " + BOOKING),
    ("差旅费报销流程是什么？", "差旅制度", "员工提交出差申请并经审批。行政预订差旅行程{n}次。返程后填写报销单。材料包括行程单与支付记录。财务部审核单据。审批通过后付款。",
     "worded", "差旅费报销流程：\n- 员工提交出差申请并经审批。\n- 行政预订差旅行程{n}次。\n- 返程后填写报销单。\n- 材料包括行程单与支付记录。\n- 财务部审核单据。\n- 审批通过后付款。"),
    ("差旅费报销的发票怎么弄？", "发票管理制度", "电子发票须保存原始电子文件。发票抬头须为公司全称。销售方应提供真实业务凭据{n}份。同一发票只能报销一次。差旅费用在返程后提交。",
     "worded", "差旅报销发票要求：\n- 发票抬头须为公司全称。\n- 销售方应提供真实业务凭据{n}份。\n- 电子发票须保存原始电子文件。\n- 同一发票只能报销一次。\n- 差旅费用在返程后提交。"),
    ("上一问：差旅费报销流程\n当前追问：那发票怎么弄？", "差旅制度", "返程后{n}日内提交报销。报销材料包括发票与行程单。发票须载明发票抬头与税号。",
     "worded", "差旅费报销材料：\n- 返程后{n}日内提交报销。\n- 报销材料包括发票与行程单。\n- 发票须载明发票抬头与税号。"),
    ("发票怎么报销？", "费用制度", "员工取得真实、有效发票{n}张。发票报销时创建报销单并上传附件。财务部执行验真。",
     "worded", "发票报销流程：\n- 员工取得真实、有效发票{n}张。\n- 发票报销时创建报销单并上传附件。\n- 财务部执行验真。"),
    ("采购报价需要几家供应商？", "采购制度", "食堂周一开放。采购门槛以上需{n}家供应商报价。采购由采购部汇总。采购档案保存五年。",
     "generic", "根据《采购制度》中的相关规定：\n- 采购门槛以上需{n}家供应商报价。\n- 采购由采购部汇总。\n- 采购档案保存五年。"
     "\n\n请以页面下方展示的原文来源为准。"),
    ("火星探测怎么立项？", "食堂制度", "食堂{n}点开放。", "refusal", REFUSED),
    ("打印机维修怎么报销？", "费用制度", "电脑维修费用凭发票报销，维修报销审批{n}级。", "refusal", REFUSED),
    ("年假有几天？", "目录", "目录\n第1章\n第2章\n第3章\n第4章\n年假{n}天", "refusal", REFUSED),
)

#: question, content of the first and the third source, places kept; the second source fits nothing
SOURCES = (
    ("账号与试用期目标", "账号开通申请", "用人部门制定试用期目标", "1,3"),
    ("转正审批要提前吗", "转正须知", "其他", "1"),
    ("住宿报销多久", "跨月费用须说明", "报销流程与时限", "1,3"),
    ("驳船准入与保险", "驳船供应商须有水路运输许可证", "驳船供应商须投保承运人责任险", "1,3"),
    ("合同起草前要调查相对方的哪些方面", "签署合同前核查主体资格", "合同谈判", "1"),
    ("合同未履行怎么处理", "不履行或不完全履行的", "向法律顾问说明后提出异议", "1,3"),
    ("新增驳船供应商申请", "申请新增供应商流程", "按采购需求、预算办理，同步提供相关资料", "1,3"),
    ("入职办理手续", "报到材料", "入职登记", "1,3"),
    ("事假怎么请", "事假原则上应提前", "返岗后1个工作日内补办，退休人员除外", "1"),
    ("年假几天", "年休假五天", "婚假三天", "1"),
    ("行程单和发票抬头", "报销单须附行程单", "发票抬头", "1,3"),
    ("婚假几天", "婚假三天", "结婚证", "1,3"),
    ("差旅费材料", "报销单须附票据", "票据与附件", "1,3"),
    ("差旅费多久", "跨月费用", "返程后提交报销", "1,3"),
    ("发票抬头怎么写", "发票抬头", "发票税号", "1"),
    ("连续乘车几小时", "800公里以上", "连续乘车", "1,3"),
    ("高铁能坐吗", "动车组二等座", "从指定渠道购买", "1,3"),
    ("住宿标准", "住宿标准如下", "一线城市每人每天五百元", "1,3"),
    ("晋升怎么评审", "晋升与调薪评审", "晋升公示", "1"),
    ("食堂几点开", "食堂", "其他", "1,2,3"),
)

#: question, sentence, bonus of their wording
BONUSES = (
    ("年假几天", "年休假五天", 2), ("新员工培训", "新入职员工", 4), ("新员工年假", "新员工的年休假按月折算", 6),
    ("上海住宿", "一线城市五百元", 4), ("采购几万元", "供应商三家", 3), ("收到钓鱼邮件", "请保留截图", 3),
    ("电脑被盗", "15分钟内报告", 3), ("发票抬头", "发票抬头为全称", 4), ("发票抬头", "发票抬头见XQ-FIN-002", 2),
    ("发票 抬头", "发票见 XQ-FIN-002", -2), ("客户来访登记", "外部访客须登记", 4), ("差旅费", "返程后提交", 3),
    ("差旅 报销", "住 宿凭票", 3), ("打车", "网约车凭票", 3), ("打车", "地铁凭票", 0), ("差旅费打车", "市内交通凭票", 6),
)

#: question, its current part, drafting?, stage words added?, alias added?, subjects
FEATURES = (
    ("上一问：年假\n当前追问： 那高铁{n}元呢", "那高铁{n}元呢", False, False, True, ""),
    ("合同起草要了解哪些方面，第{n}条", "合同起草要了解哪些方面，第{n}条", True, True, False, ""),
    ("合同签署前对相对方核查{n}次", "合同签署前对相对方核查{n}次", True, True, False, ""),
    ("合同起草{n}份", "合同起草{n}份", False, False, False, ""),
    ("打印机维修{n}元", "打印机维修{n}元", False, False, False, "打印机"),
    ("打印机在{n}楼", "打印机在{n}楼", False, False, False, ""),
    ("投影仪和扫描仪保养{n}次", "投影仪和扫描仪保养{n}次", False, False, False, "扫描仪,投影仪"),
)


def _picked(spark, sf: str, cases: tuple) -> DataFrame:
    """Rows of ``part`` with their case: p_partkey, no, c0, c1, ... with the size filled in."""
    parts = corpus.dealt(corpus.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("n")))
    columns = [f"c{i}" for i in range(len(cases[0]))]
    held = [(i, *(str(v) for v in case)) for i, case in enumerate(cases)]
    table = F.broadcast(spark.createDataFrame(held, "no int, " + ", ".join(f"{c} string" for c in columns)))  # the cases above
    joined = parts.withColumn("no", (F.col("p_partkey") % len(cases)).cast("int")).join(table, "no")
    return joined.select("p_partkey", *[F.replace(c, F.lit("{n}"), F.col("n")).alias(c) for c in columns])


def _source(rank: int, document: str, title: Column, content: Column) -> Column:
    return F.struct(
        F.lit(rank).alias("rank"), F.lit(f"{document}-0").alias("chunk_id"), F.lit(document).alias("document_id"),
        F.lit(0).alias("chunk_index"), title.alias("title"), F.lit("正文").alias("section"),
        F.lit(f"{document}.md").alias("source_path"), X.normalize_text(content).alias("content"),
        F.lit("policy").alias("knowledge_base_id"), F.lit(1.0).alias("score"),
    )


def policy_answers(spark, sf: str) -> DataFrame:
    """Gate and composed answer of every case: the rules in the order of their precedence, refusals included."""
    cases = _picked(spark, sf, tuple(c[:3] for c in CASES))
    other = _source(1, "other", F.lit("食堂管理"), F.lit("食堂凭卡就餐，周末不开放。"))
    asked = cases.select(
        F.col("p_partkey").alias("query_id"), F.col("c0").alias("question"),
        F.array(other, _source(2, "policy", F.col("c1"), F.col("c2"))).alias("results"),
    )
    answered = compose.compose_local(evidence.gate(asked))
    return answered.select(
        F.col("query_id").alias("p_partkey"), "best_document", "composer", F.col("local_answer").alias("answer")
    )


def policy_sources(spark, sf: str) -> DataFrame:
    """Places of the sources kept for every kind of question; all of them where none fits (odd keys of the upper half)."""
    cases = _picked(spark, sf, SOURCES)
    bare = F.floor(F.col("p_partkey") / len(SOURCES)) % 2 == 1
    spaced = F.concat(F.substring("c1", 1, 2), F.lit(" "), F.substring("c1", 3, 100))
    text = [F.when(~bare, spaced).otherwise("其他"), F.lit("无"), F.when(~bare, F.col("c2")).otherwise("其他")]
    asked = cases.select(
        F.col("p_partkey").alias("query_id"), F.col("c0").alias("question"),
        F.array(*[_source(i + 1, f"d{i}", F.lit("制度"), t) for i, t in enumerate(text)]).alias("results"),
    )
    kept = evidence.filter_sources(evidence.add_question_features(asked))
    places = F.array_join(F.transform("results", lambda r: r["rank"].cast("string")), ",")
    return kept.select(F.col("query_id").alias("p_partkey"), places.alias("kept"))


def policy_bonus(spark, sf: str) -> DataFrame:
    """Bonus of every question and sentence wording."""
    cases = _picked(spark, sf, tuple((q, s + "，第{n}条") for q, s, _ in BONUSES))
    return cases.select("p_partkey", evidence.phrase_bonus(F.col("c0"), F.col("c1")).alias("bonus"))


def policy_features(spark, sf: str) -> DataFrame:
    """What the gate reads off a question: its current part, the drafting stage, added tokens, subjects."""
    asked = _picked(spark, sf, tuple(f[:1] for f in FEATURES)).withColumnRenamed("c0", "question")
    plain = evidence.expanded_tokens(F.col("question"), adaptations=False)
    return evidence.add_question_features(asked).select(
        "p_partkey", "current", "drafting",
        F.array_contains("all_tokens", "实地调查").alias("stage"),
        (F.array_contains("all_tokens", "动车组") & ~F.array_contains(plain, "动车组")).alias("alias_added"),
        F.array_join("subjects", ",").alias("subjects"),
    )


QUERIES = {
    "policy_answers": policy_answers,
    "policy_sources": policy_sources,
    "policy_bonus": policy_bonus,
    "policy_features": policy_features,
}


def _told(text: str) -> str:
    """SQL text with the size filled in."""
    return "'" + text.replace("'", "''").replace("{n}", "' || p_size || '") + "'"


def _by_case(values: list[str], n: int) -> str:
    return f"CASE p_partkey % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def oracle_sql() -> dict[str, str]:
    n = len(CASES)
    best = ["NULL" if c[3] == "refusal" else "'policy'" for c in CASES]
    flag = lambda i: [str(f[i]).upper() for f in FEATURES]
    return {
        "policy_answers": f"""SELECT p_partkey, {_by_case(best, n)} AS best_document,
            {_by_case([_told(c[3]) for c in CASES], n)} AS composer, {_by_case([_told(c[4]) for c in CASES], n)} AS answer FROM part""",
        "policy_sources": f"""SELECT p_partkey, CASE WHEN p_partkey // {len(SOURCES)} % 2 = 1 THEN '1,2,3'
            ELSE {_by_case([_told(s[3]) for s in SOURCES], len(SOURCES))} END AS kept FROM part""",
        "policy_bonus": f"SELECT p_partkey, {_by_case([str(b[2]) for b in BONUSES], len(BONUSES))} AS bonus FROM part",
        "policy_features": f"""SELECT p_partkey, {_by_case([_told(f[1]) for f in FEATURES], len(FEATURES))} AS current,
            {_by_case(flag(2), len(FEATURES))} AS drafting, {_by_case(flag(3), len(FEATURES))} AS stage,
            {_by_case(flag(4), len(FEATURES))} AS alias_added, {_by_case([_told(f[5]) for f in FEATURES], len(FEATURES))} AS subjects FROM part""",
    }
