"""Question/sentence wording rules, source filters and answer slots as data.

All terms are fixed values: they must equal the published behaviour. A condition
is a tuple of groups; every group needs at least one of its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from sourcelight.rules import vocabulary as V

Condition = tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class PhraseRule:
    question: Condition
    sentence: Condition
    weight: int
    raw: bool = False  # look at the sentence with its spaces


PHRASE_RULES = (
    PhraseRule((V.ANNUAL_LEAVE_TERMS,), (V.ANNUAL_LEAVE_TERMS,), 2),
    PhraseRule((V.NEW_HIRE_TERMS,), (("新入职", "新员工"),), 4),
    PhraseRule((("上海",), ("住宿",)), (("一线城市",),), 4),
    PhraseRule((("采购",), ("报价", "供应商", "万元")), (("报价", "供应商", "采购门槛"),), 3),
    PhraseRule((("钓鱼",),), (("IT-SERVICE", "保留截图", "事件报告"),), 3),
    PhraseRule((("被盗", "遗失", "丢失"),), (("15分钟", "P1", "设备遗失", "被盗"),), 3),
    PhraseRule((("发票",), ("抬头",)), (("发票抬头",),), 4),
    PhraseRule((("发票",), ("抬头",)), (("XQ-FIN-002",),), -2, raw=True),
    PhraseRule((("访客", "来访", "客户"), ("登记",)), (("外部访客",), ("登记",)), 4),
    PhraseRule((V.TRAVEL_QUERY_TERMS,), (V.TRAVEL_POLICY_TERMS,), 3),
    PhraseRule((("打车",),), (("出租车", "网约车", "市内交通"),), 3),
)


@dataclass(frozen=True)
class SourceRule:
    """First rule whose question matches decides which chunks stay as sources.

    ``keep`` is a list of alternative conditions on white-space-free content.
    """

    question: Condition
    keep: tuple[Condition, ...]
    absent: tuple[str, ...] = ()
    special: str = ""  # "drafting" or "personal_leave" add a computed condition


SOURCE_RULES = (
    SourceRule((("账号",), ("试用期目标",)), ((("账号开通申请",),), (("用人部门",), ("试用期目标",)))),
    SourceRule((("转正",), ("审核", "审批", "提前", "工作日")), ((("转正",),),)),
    SourceRule((("住宿",), ("时限", "期限", "多久", "报销单")), ((("住宿标准", "跨月费用", "报销流程与时限"),),)),
    SourceRule(
        (("驳船",), ("准入", "注册资金", "许可", "保险")),
        ((("驳船供应商",), ("注册资金", "水路运输许可证", "承运人责任险")),),
    ),
    SourceRule(
        (("调查", "相对方", "相关方", "哪些方面"),), ((("签署合同前",), ("主体资格",)),), special="drafting"
    ),
    SourceRule(
        (("合同",), ("不履行", "未履行", "不完全履行")),
        ((("不履行或不完全履行",),), (("提出异议",), ("法律顾问",))),
    ),
    SourceRule(
        (("驳船供应商",), ("新增",), ("申请", "材料", "提交")),
        ((("申请新增供应商流程",),), (("采购需求、预算",), ("同步提供相关资料",))),
    ),
    SourceRule(
        (("入职",), V.ONBOARDING_ACTIONS),
        ((("录用确认", "报到前准备", "报到材料", "入职登记", "新员工入职办理流程"),),),
    ),
    SourceRule(
        (),
        ((("无薪事假", "事假原则上", "返岗后1个工作日", "事假年度累计"),),),
        absent=("退休",),
        special="personal_leave",
    ),
    SourceRule((V.ANNUAL_LEAVE_TERMS,), ((("带薪年休假", "年休假"),),)),
    SourceRule((("行程单",), ("发票抬头",)), ((("报销单须附", "发票抬头"),),)),
    SourceRule((("婚假",),), ((("婚假", "结婚证"),),)),
    SourceRule((V.TRAVEL_QUERY_TERMS, ("材料", "凭证")), ((("报销单须附", "票据与附件"),),)),
    SourceRule(
        (V.TRAVEL_QUERY_TERMS, ("多久", "时限", "提交")), ((("提交报销", "跨月费用", "报销流程与时限"),),)
    ),
    SourceRule((("发票",), ("抬头",)), ((("发票抬头",),),)),
    SourceRule((("800公里", "连续乘车", "超过6小时"),), ((("800公里", "连续乘车"),),)),
    SourceRule((V.TRANSPORT_TERMS,), ((("飞机经济舱", "动车组二等座", "轮船三等舱", "指定渠道"),),)),
    SourceRule((("住宿",), ("标准",)), ((("住宿标准",),), (("一线城市",), ("每人每天",)))),
    SourceRule((("晋升", "调薪"), ("评审", "怎么", "如何")), ((("晋升与调薪评审",),),)),
)


@dataclass(frozen=True)
class Slot:
    """First sentence that meets ``needs`` or, if given, ``otherwise``."""

    needs: Condition
    required: bool = False
    otherwise: Condition = ()
    compact: bool = False  # ignore the sentence's spaces
    say: str = ""  # shown instead of the sentence
    hidden: bool = False  # must be present but is not shown
    unless: tuple[str, ...] = ()  # question terms that leave the slot out


@dataclass(frozen=True)
class Composer:
    """A worded answer: trigger on the question, then slots or a collected list."""

    header: str
    when: Condition
    slots: tuple[Slot, ...] = ()
    collect: tuple[Condition, ...] = ()  # alternatives a collected sentence must meet
    without: tuple[str, ...] = ()  # terms a collected sentence must not hold
    unless: tuple[str, ...] = ()  # question terms that switch the composer off
    guard: str = ""  # name of a computed condition on the question
    fixed: str = ""  # text shown once all required slots are found
    policy_only: bool = False
    reading_order: bool = False
    distinct: bool = False
    limit: int = 0
    first: tuple[tuple[Condition, ...], ...] = ()  # sort keys, matching sentences first


ONBOARDING_STEPS = (
    "录用确认", "报到前准备", "报到材料", "入职登记", "劳动合同", "账号、设备与门禁", "入职培训", "试用期", "转正",
)

ONBOARDING_RESPONSIBILITY = Composer(
    "报到前职责分工：", (("账号",), ("试用期目标",)),
    slots=(Slot((("账号开通申请",),), True), Slot((("用人部门",), ("试用期目标",)), True)),
)
NEW_HIRE_MATERIAL = Composer(
    "新员工材料补交：", (("非关键材料",), ("补交",)),
    slots=(Slot((("非关键材料",), ("工作日内补交",)), True),),
)
OVERSEAS_VPN = Composer(
    "境外使用 VPN：", (("境外",),), guard="vpn",
    slots=(Slot((("境外",), ("提前 3 个工作日申请",)), True),),
)
MARRIAGE_LEAVE = Composer(
    "婚假规定：", (("婚假",), ("多久", "几天", "休完", "期限", "时间")),
    collect=((("婚假",),), (("基础标准",), ("工作日",)), (("结婚证",), ("个月", "登记证明"))),
    distinct=True, limit=2,
    first=(((("基础标准",),), (("工作日",), ("婚假",))), ((("个月",), ("结婚证",)),)),
)
ONBOARDING_PROCESS = Composer(
    "新员工入职流程：", (("入职",), ("流程", "手续", "办理", "需要")),
    collect=((ONBOARDING_STEPS,),), without=("退休", "养老金"),
    policy_only=True, reading_order=True, distinct=True, limit=8,
)
LODGING_AND_DEADLINE = Composer(
    "差旅住宿与报销时限：",
    (("住宿",), ("出差", "差旅"), ("时限", "期限", "提交", "什么时候", "多久")),
    slots=(Slot((("员工级住宿标准",), ("一线城市",)), True), Slot((("提交报销",), ("10个工作日",)), True)),
)
ATTACHMENT_AND_TITLE = Composer(
    "差旅票据与附件：", (("行程单",), ("发票抬头",)),
    slots=(
        Slot((("报销单须附",),), True), Slot((("财务部门可退回补充",),), True),
        Slot((("发票抬头",), ("统一社会信用代码",)), True),
    ),
)
COUNTERPARTY_INVESTIGATION = Composer(
    "合同相对方调查：", (("调查", "相对方", "相关方", "哪些方面"),),
    guard="drafting",
    slots=(Slot((("签署合同前",), ("主体资格",), ("资信状况",), ("履行能力",)), True),),
)
NONPERFORMANCE_TEXT = (
    "承办人应向公司法律顾问详细说明情况；法律顾问提出合理化建议后，"
    "由承办人在法定、约定或合理期限内以书面方式向对方提出异议。"
)
CONTRACT_NONPERFORMANCE = Composer(
    "合同履约异常处理：", (("合同",), ("不履行", "未履行", "不完全履行")),
    slots=(Slot((("承办人将情况向公司法律顾问作出详细说明",),), True), Slot((("书面方式",), ("提出异议",)), True)),
    fixed=NONPERFORMANCE_TEXT,
)
SUPPLIER_ADMISSION = Composer(
    "驳船供应商准入要求：", (("驳船",), ("注册资金", "许可证", "许可", "保险")),
    slots=(
        Slot((("注册资金不得少于200万元",),), True, compact=True), Slot((("水路运输许可证",),), True),
        Slot((("船舶险",), ("承运人责任险",)), True),
    ),
)
SUPPLIER_APPLICATION = Composer(
    "新增驳船供应商：", (("驳船供应商",), ("新增",), ("申请", "材料", "提交")),
    slots=(
        Slot((("采购需求、预算",), ("新增",)), True), Slot((("同步提供相关资料",), ("水路运输许可证",)), True),
        Slot((("船舶配置与服务航线",), ("船舶保单",)), True),
    ),
)
TRAVEL_MATERIAL = Composer(
    "差旅费报销材料：", (V.TRAVEL_QUERY_TERMS, ("材料", "凭证")),
    collect=((("报销单",), ("材料", "附件", "票据", "凭证")),), without=("退改签", "公共交通停运", "不可抗力"),
    policy_only=True, distinct=True, limit=3,
)
TRAVEL_DEADLINE = Composer(
    "差旅报销提交时限：", (V.TRAVEL_QUERY_TERMS, ("多久", "时限", "提交", "几天")),
    collect=((("提交报销", "次月", "逾期"),),), without=("出差前", "出差申请"),
    policy_only=True, distinct=True, limit=3,
)
INVOICE_TITLE = Composer(
    "发票抬头：", (("发票",), ("抬头",)),
    slots=(
        Slot((("发票抬头",), ("样例主体全称", "公司全称", "统一社会信用代码")), True),
        Slot((("同一发票",), ("报销一次",))),
    ),
)
LODGING_STANDARD = Composer(
    "住宿标准：", (("住宿",), ("标准",)),
    slots=(Slot((("住宿上限",),), True), Slot((("一线城市",), ("指",)), unless=("上海",))), policy_only=True,
)
INVOICE_EXPENSE = Composer(
    "发票报销流程：", (("发票",), ("怎么", "如何", "流程", "报销", "弄")),
    slots=(
        Slot((("取得真实、有效发票",),)), Slot((("创建报销单",), ("上传",))), Slot((("财务部执行验真",),)),
    ),
    unless=("抬头",), guard="not_travel", policy_only=True, distinct=True,
)
TRAVEL_PROCESS = Composer(
    "差旅费报销流程：", (), guard="travel",
    slots=(
        Slot((("出差申请",), ("提交", "审批"))),
        Slot((("预订",), ("行程",))),
        Slot((("返程",), ("报销",))),
        Slot((("材料",), ("发票", "行程单", "支付记录", "凭证"))),
        Slot((("直属经理", "预算负责人", "财务部"), ("核验", "审核"))),
        Slot((("审批通过",), ("付款",))),
    ),
    policy_only=True, reading_order=True, distinct=True,
)
TRAVEL_INVOICE_POLICY = Composer(
    "差旅报销发票要求：", (("发票",),), guard="travel_invoice_policy",
    slots=(
        Slot((("发票抬头",),)),
        Slot((("销售方",), ("真实业务", "支付记录"))),
        Slot((("电子发票",), ("原始电子文件",))),
        Slot((("同一发票",), ("报销一次",))),
        Slot((("差旅费用",), ("返程",), ("提交",))),
    ),
    policy_only=True, reading_order=True, distinct=True,
)
# The third slot takes "发票抬头", or "发票" with "税号": both hold "发票".
TRAVEL_INVOICE = Composer(
    "差旅费报销材料：", (("发票",),), guard="travel",
    slots=(
        Slot((("返程",), ("提交报销",))), Slot((("材料",), ("发票",))), Slot((("发票",), ("发票抬头", "税号"))),
    ),
    policy_only=True, reading_order=True, distinct=True,
)
TRANSPORT_STANDARD = (("员工级",), ("飞机经济舱", "动车组二等座", "轮船三等舱"))
TRANSPORT_BOOKING = Slot((("机票",), ("火车票",), ("船票",), ("指定渠道",)))
LONG_DISTANCE = Composer(
    "长途交通选择：", (V.TRANSPORT_TERMS, ("800公里", "连续乘车", "超过6小时")),
    slots=(
        Slot(TRANSPORT_STANDARD, True, hidden=True),
        Slot((("800公里", "连续乘车"), ("飞机经济舱",)), True),
        Slot((("低于上述条件",), ("高铁", "动车"))),
    ),
    policy_only=True,
)
TRANSPORT_TEXTS = (
    (("高铁",), "高铁按制度对应动车组，可按动车组座位等级报销：员工级、专业及主管级原则上可报销动车组二等座；经理及以上可报销动车组一等座。"),
    (("动车组", "动车"), "员工级、专业及主管级原则上可报销动车组二等座；经理及以上可报销动车组一等座。"),
    (("飞机",), "员工级、专业及主管级和经理及以上均可按飞机经济舱标准报销；超出规定等级需按制度说明并审批。"),
    (("轮船",), "员工级、专业及主管级原则上可报销轮船三等舱；经理及以上可报销轮船二等舱。"),
    (V.TRANSPORT_TERMS, ""),
)
TRANSPORT_CLASSES = tuple(
    Composer(
        "交通费用报销：", (terms,), slots=(Slot(TRANSPORT_STANDARD, True, say=text), TRANSPORT_BOOKING),
        policy_only=True,
    )
    for terms, text in TRANSPORT_TEXTS
)

# Annual leave of new employees: label, pattern on white-space-free text.
LEAVE_TIERS = (
    ("累计工作满 1 年不满 10 年", r"累计工作已满1年不满10年的，年度年休假为(\d+)天"),
    ("累计工作满 10 年不满 20 年", r"累计工作已满10年不满20年的，年度年休假为(\d+)天"),
    ("累计工作满 20 年", r"累计工作已满20年的，年度年休假为(\d+)天"),
)
LEAVE_PRORATION = (r"新入职(?:或当年离职)?员工的可用额度.*?折算", r"平台(?:核定|展示)余额")
LEAVE_HEADER = (
    "新员工的年假不是统一固定天数。制度先按经核验的累计社会工作年限确定全年标准，"
    "入职当年再由人力资源部折算，最终以平台核定余额为准：\n"
)
HANDBOOK_TIERS = (
    ("实际工作 1~6 年（含）", r"实际工作1~6年（含）之间，可享(?:有|受)(\d+)天年休假"),
    ("实际工作 10~16 年（含）", r"实际工作10~16年（含）之间，可享(?:有|受)(\d+)天年休假"),
    ("实际工作满 20 年", r"实际工作满20年，可享(?:有|受)(\d+)天年休假"),
)
HANDBOOK_PRORATION = (r"新入职员工的年休假可用额度.*?折算", r"员工服务平台核定余额")
HANDBOOK_SECOND_YEAR = "员工自入职后的第二个日历年起"
HANDBOOK_PROGRESSION = r"工作满6年后，每服务一年增加一天，至可享有(\d+)天年休假止"
HANDBOOK_HEADER = "新员工的年假不是统一固定天数。员工自入职后的第二个日历年起享受，全年标准按实际工作年限确定；"
HANDBOOK_PRORATED = "入职当年由人力资源部折算，最终以员工服务平台核定余额为准"
HANDBOOK_FIRST_YEAR = "入职第一年的具体额度需由人力资源部按适用规则核定"

LEAVE_APPLICATION_HEADER = "年休假申请要点："
LEAVE_PROCESS = Slot((("查询余额并选择假别",),))
LEAVE_OVER_3 = Slot(
    (("连续请假超过 3 个工作日",),), otherwise=(("连续请假超过3个工作日",), ("至少提前 5 个工作日",))
)
LEAVE_UP_TO_3 = Slot(
    (("连续请假不超过 3 个工作日",),), otherwise=(("连续请假不超过3个工作日",), ("至少提前 2 个工作日",))
)
LEAVE_APPLICATION = (
    Composer(LEAVE_APPLICATION_HEADER, (), (LEAVE_PROCESS, LEAVE_OVER_3), guard="long_leave", policy_only=True),
    Composer(LEAVE_APPLICATION_HEADER, (), (LEAVE_PROCESS, LEAVE_UP_TO_3), guard="short_leave", policy_only=True),
    Composer(
        LEAVE_APPLICATION_HEADER, (), collect=((("选择假别", "提前", "直属经理"),),), guard="leave",
        policy_only=True, limit=2,
    ),
)

PERSONAL_LEAVE_TRIGGERS = ("怎么", "如何", "申请", "流程", "办理", "提前", "累计", "最多", "多少")
PERSONAL_LEAVE_ALTERNATIVES = ("提前1个工作日", "返岗后1个工作日")
PERSONAL_LEAVE_SLOTS = (
    Slot((("事假",), ("无薪", "不计发请假期间工资"))),
    Slot((("提前1个工作日", "返岗后1个工作日"),)),
    Slot((("事假年度累计",), ("10个工作日",))),
    Slot((("直属负责人",), ("审批",))),
    Slot((("紧急情况",), ("通知",))),
)
PERSONAL_LEAVE_HEADER = "事假申请可以这样办理："
PERSONAL_LEAVE_PAY_CLAUSE = "事假不计发请假期间"
PERSONAL_LEAVE_PAY_TEXT = (
    "按现行员工管理制度，事假属于无薪事假，请假期间不计发工资；考勤和薪资处理还要按公司当月规则执行。"
    "也就是说，具体应发金额要结合当月薪资规则核算，不能只按‘扣多少钱’一概而论。"
)
PERSONAL_LEAVE_DEADLINE_TEXT = "如果你准备申请，"

# Call order. The leave tiers come right after the first entry, personal leave
# right after the onboarding process.
COMPOSERS = (
    ONBOARDING_RESPONSIBILITY, *LEAVE_APPLICATION, NEW_HIRE_MATERIAL, OVERSEAS_VPN, MARRIAGE_LEAVE,
    ONBOARDING_PROCESS, LODGING_AND_DEADLINE, ATTACHMENT_AND_TITLE, COUNTERPARTY_INVESTIGATION,
    CONTRACT_NONPERFORMANCE, SUPPLIER_ADMISSION, SUPPLIER_APPLICATION, TRAVEL_MATERIAL, TRAVEL_DEADLINE,
    INVOICE_TITLE, LODGING_STANDARD, LONG_DISTANCE, *TRANSPORT_CLASSES, TRAVEL_INVOICE_POLICY, TRAVEL_INVOICE,
    TRAVEL_PROCESS, INVOICE_EXPENSE,
)
BEFORE_PERSONAL_LEAVE = COMPOSERS.index(ONBOARDING_PROCESS)

GENERIC_ANSWER_PREFIX = "根据《"
GENERIC_ANSWER_INFIX = "》中的相关规定：\n"
GENERIC_ANSWER_SUFFIX = "\n\n请以页面下方展示的原文来源为准。"
# Sentence preference when the question asks how to apply: first match counts.
APPLICATION_BONUS = (
    (("选择假别", "办理流程"), 20),
    (("查询余额",), 14),
    (("提交申请", "申请", "提交报销", "创建报销单", "上传原始"), 8),
)

# Wording that a generated leave answer must keep.
SECOND_YEAR_CLAUSE = "自入职后的第二个日历年起"
SECOND_YEAR_REWRITES = (
    (r"(?:自)?入职满一年后", "自入职后的第二个日历年起"),
    (r"如果您工龄刚满一年", "如果您刚进入入职后的第二个日历年"),
)
SECOND_YEAR_SHORT = (
    "年假从入职后的第二个日历年起开始计算，具体天数要看累计工作年限，而不只看当前入职时间。"
    "你把累计工龄告诉我，我可以继续帮你核对对应天数。"
)
SECOND_YEAR_DURATION = (
    "现有制度写的是‘自入职后的第二个日历年起’，不是‘入职满一年’。仅凭入职 ",
    " 不能完整核定年假；请补充入职日期、拟休假日期和累计工作年限，并核对平台核定余额。",
)
DETAIL_TERMS = ("具体案例", "举例", "明细", "完整流程", "全部", "分别", "各档", "不同工龄")
EMPLOYMENT_DURATION = r"\A(?:(?:我)?(?:刚)?入职\s*)?(\d+\s*(?:个)?(?:天|周|星期|月|个月|年|年半))\z"
