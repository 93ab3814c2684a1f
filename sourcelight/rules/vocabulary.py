"""Word lists and thresholds used by routing, gating and answer selection.

The tuples below are fixed values: they must equal the published behaviour for
results to agree, and are listed in natural order. A deployment with another
corpus or language passes its own :class:`Vocabulary`.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: messages -------------------------------------------------
INSUFFICIENT_ANSWER = "依据不足：现有制度中未检索到能确认该问题的条款，请联系对应责任部门核实。"
MODEL_UNAVAILABLE_ANSWER = "暂时无法生成服务答复，请稍后重试；系统不会在模型不可用时直接拼接制度原文。"
EMPTY_QUESTION_ANSWER = "请输入要查询的问题。"
PROJECT_META_ANSWER = (
    "这个窗口目前用于查询已入库的员工制度和办事流程，不负责讲解软件项目，"
    "如果要了解项目，请直接查看项目说明文档或向项目负责人咨询。"
)
SOURCE_FACTS_PREFIX = "本次生成答复未通过限定条件校验，以下为原文要点整理，请结合来源核对：\n\n"
REFUSAL_MARK = "依据不足"
FOLLOW_UP_MARK = "当前追问："
PREVIOUS_MARK = "上一问："
BODY_SECTION = "正文"
QUALIFIER = "原则上"
PROMPT_VERSION = "policy-answer-v2"

# --- Fixed values: query tokens ---------------------------------------------
WEAK_TOKENS = (
    "什么", "怎么", "怎么办", "如何", "多少", "多久", "几天", "时候", "为什么", "是否", "可以", "能否", "需要",
    "公司", "员工", "请问", "一下", "的", "了", "吗", "呢", "有", "要", "是", "内", "前", "后",
)
GENERIC_TOKENS = (
    "报销", "费用", "制度", "政策", "规定", "流程", "标准", "材料", "要求", "申请", "办理", "提交", "处理", "支持",
    "使用", "维修", "个人", "相关", "信息", "情况", "方式", "规则", "金额", "上限", "下限", "额度", "期限",
)
FOLLOW_UP_PREFIXES = ("那", "然后", "这个", "上面", "刚才", "它", "该", "还需要", "具体")
APPLICATION_TERMS = (
    "怎么申请", "如何申请", "申请流程", "办理流程", "提交申请", "怎么办理", "怎么报销", "如何报销", "报销流程",
)
TRAVEL_QUERY_TERMS = ("差旅费", "差旅费用", "差旅报销")
TRAVEL_POLICY_TERMS = ("差旅", "出差", "返程", "行程", "住宿", "交通", "补助", "机票", "车票")
TRANSPORT_TERMS = ("高铁", "动车", "动车组", "飞机", "轮船", "火车")
TRANSPORT_ALIASES = {
    "高铁": ("动车组", "动车"),
    "动车": ("动车组", "高铁"),
    "动车组": ("动车", "高铁"),
}
NEW_HIRE_TERMS = ("新员工", "新入职", "入职第一年", "入职当年")
ANNUAL_LEAVE_TERMS = ("年假", "年休假")
PAY_TERMS = ("扣钱", "工资", "薪资", "薪水", "扣薪", "无薪")
ONBOARDING_ACTIONS = ("手续", "流程", "办理")
PERSONAL_LEAVE_ACTIONS = ("流程", "具体", "怎么", "如何", "申请", "办理")
MAINTENANCE_TERMS = ("维修", "修理", "保养", "报销")
DRAFTING_QUERY = "合同起草 签署合同前 对合同相关方调查"
DRAFTING_EXTRA_TOKENS = ("合同", "起草", "相对方", "相关方", "调查", "实地", "实地调查")
DRAFTING_CONTENT_TERMS = ("合同谈判", "合同起草", "起草合同", "合同草案", "签署合同前")
ONBOARDING_CONTENT_TERMS = (
    "录用确认", "报到前准备", "报到材料", "入职登记", "劳动合同", "入职培训", "试用期", "转正",
)
PERSONAL_LEAVE_CONTENT_TERMS = ("无薪事假", "事假原则上", "返岗后1个工作日", "请假审批、备案与销假流程")

# --- Fixed values: routing ---------------------------------------------------
CATALOG_PATTERNS = (
    "知识库里有哪些", "知识库有哪些", "有哪些制度", "有哪些文档", "收录了什么", "收录多少", "文档数量",
)
PROJECT_META_PATTERNS = (
    "讲解项目", "介绍项目", "这个项目是做什么", "项目是做什么", "项目目标", "项目架构", "项目功能",
)

# --- Fixed values: sentence filters -------------------------------------------
METADATA_PREFIXES = (
    "文档名称：", "文档编号：", "版本：", "适用范围：", "责任部门：", "发布部门：", "负责人：",
)
SAMPLE_NOTICES = ("企业制度知识库样例文件", "样例制度")
SAMPLE_PREFIXES = ("本文仅用于", "本节为样例内容")
DANGLING_ENDINGS = ("为", "的", "和", "或", "按", "并", "及", "在", "与", "于", "至", "：", ":")
METADATA_SECTIONS = ("文档信息", "文档元数据", "基本信息")
POLICY_CODE_PATTERN = r"\b(?:XQ|KK|XB)-[A-Z0-9]+(?:-[A-Z0-9]+)+\b"
POLICY_CODE_REPLACEMENT = "对应制度"

# --- Fixed values: file name -> category hints, in match order -----------------
CATEGORY_HINTS = (
    ("人力资源", ("onboarding", "probation", "attendance", "leave", "offboarding", "hr")),
    ("财务采购", ("travel", "reimbursement", "invoice", "expense", "procurement", "finance")),
    ("IT 服务", ("account", "password", "vpn", "software", "it_")),
    ("信息安全", ("security", "information_security")),
    ("行政服务", ("equipment", "meeting", "access", "admin")),
)
DEFAULT_CATEGORY = "企业制度"

# --- Fixed values: roles and feedback ---------------------------------------
ROLES = ("admin", "legal", "business", "employee")
UPLOAD_ROLES = ("admin", "legal")
DEFAULT_CONTRACT_ROLES = ("legal",)
RATINGS = ("up", "down")
FEEDBACK_REASONS = ("答非所问", "没有依据", "制度过期", "未解决")
UNRESOLVED_REASON = "未解决"

# --- Fixed values: request limits ---------------------------------------------
QUESTION_LIMIT, ANSWER_LIMIT, MESSAGE_LIMIT, REASON_LIMIT = 1000, 5000, 5000, 20

# Equipment nouns bound by the subject guard. There is no part-of-speech tagger
# in Spark, so the guard works from this lexicon (ours) instead of a tagger.
SUBJECT_LEXICON = (
    "打印机", "复印机", "扫描仪", "投影仪", "碎纸机", "咖啡机", "饮水机", "热水器", "显示器", "路由器", "服务器",
    "示波器", "测距仪", "打卡机", "考勤机", "无人机", "照相机", "摄像机", "传真机", "洗衣机", "起重机", "发电机",
)


@dataclass(frozen=True)
class Vocabulary:
    """Word lists a deployment may replace, for example for Latin-script text."""

    weak: tuple[str, ...] = WEAK_TOKENS
    generic: tuple[str, ...] = GENERIC_TOKENS
    subjects: tuple[str, ...] = SUBJECT_LEXICON
    follow_up_prefixes: tuple[str, ...] = FOLLOW_UP_PREFIXES
    catalog: tuple[str, ...] = CATALOG_PATTERNS
    project_meta: tuple[str, ...] = PROJECT_META_PATTERNS
    duration_pattern: str = r"(?:(?:我)?(?:刚)?入职\s*)?\d+\s*(?:个)?(?:天|周|星期|月|个月|年|年半)"
    short_question: int = 14


DEFAULT_VOCABULARY = Vocabulary()

# A small Latin-script set for corpora in European languages (ours).
LATIN_VOCABULARY = Vocabulary(
    weak=(
        "the", "of", "and", "to", "in", "a", "is", "it", "on", "for", "that", "with", "as", "by", "an", "at", "are",
        "le", "la", "les", "de", "du", "un", "une", "et", "der", "die", "das", "und", "zu", "el", "los", "y", "en",
    ),
    generic=("was", "be", "from", "this", "que", "qui", "pour", "ist", "mit", "von", "para", "por"),
    subjects=(),
    follow_up_prefixes=("and", "then", "that", "la", "und"),
    catalog=("whichdocuments", "quelsdocuments", "welchedokumente"),
    project_meta=("thisproject", "ceprojet", "diesesprojekt"),
    duration_pattern=r"\d+\s*(?:days?|weeks?|months?|years?)",
    short_question=40,
)
