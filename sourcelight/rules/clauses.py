"""Clause specifications: what to locate, where to anchor, what completes it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Clause:
    key: str
    label: str
    review_focus: str
    anchors: tuple[str, ...]
    required: tuple[str, ...]
    limit: int = 1  # excerpts kept
    pattern: str = ""  # must match the evidence
    compact_patterns: tuple[str, ...] = ()  # all must match the white-space-free evidence
    named_parties: bool = False  # both roles of one pair carry a name
    schedule: bool = False  # a calendar date with schedule or validity words


# --- Fixed values: contract clauses -------------------------------------------
_AMOUNT = r"[）)]?[：:为]?(?:人民币)?[￥¥]?\d[\d,，]*(?:\.\d+)?(?:万元|元)"
CONTRACT_CLAUSES = (
    Clause(
        "term", "合同期限/工期/到期日", "计划开工、完工/竣工日期，合同工期，以及到期后的处理和自动续期",
        ("计划开工日期", "计划完工日期", "计划竣工日期", "合同工期", "合同生、失效日期", "合同生效", "有效期至", "合同期限", "履行期限"),
        ("生效", "有效期", "期限", "到期"), limit=4, schedule=True,
    ),
    Clause(
        "payment", "付款与结算", "付款触发条件、比例或金额、付款期限及结算凭证",
        ("工程款支付比例", "工程进度款支付", "工程款支付周期", "款项的支付", "支付比例", "付款信息及支付比例", "付款节点", "付款"),
        ("支付", "付款", "结算"),
        pattern=r"(?:\d+(?:\.\d+)?|[一二三四五六七八九十百]+)\s*(?:%|％|万元|元|个?月|日|天)",
    ),
    Clause(
        "parties", "甲乙方公司信息", "甲方/乙方或承包人/分包人的公司名称、统一社会信用代码及主体身份",
        ("承包人", "分包人", "采购方", "供应方", "甲方", "乙方"),
        (), limit=2,
        named_parties=True,
    ),
    Clause(
        "amount", "合同金额（含税/不含税）", "含税金额、不含税金额、税额和税率是否写明且相互对应",
        ("签约合同价（含增值税）", "签约合同价（不含增值税）", "含增值税", "不含增值税", "含税", "不含税", "合同金额", "合同价款"),
        (), limit=2,
        compact_patterns=(rf"(?<!不)含(?:增值)?税{_AMOUNT}", rf"不含(?:增值)?税{_AMOUNT}"),
    ),
    Clause(
        "banking", "银行账户及纳税信息", "收款账户、开户行、账户名称、纳税人识别号、地址和电话",
        ("开户银行", "开户行", "账号", "帐号", "纳税人识别号", "纳税人身份"),
        (), limit=6,
        compact_patterns=(r"开户(?:银行|行)[：:][\x{4e00}-\x{9fff}A-Za-z]{2,}", r"(?:账号|帐号)[：:]\d{6,}"),
    ),
    Clause(
        "insurance", "保险", "是否投保、保险范围、保险期限、保险费承担方及相关凭证",
        ("保险责任", "保险费", "投保", "保险", "保险范围"), ("投保", "保单", "保险责任", "保险范围"), limit=2,
    ),
    Clause(
        "performance_bond", "履约保证金", "保证金/保函金额、提交时间、扣除条件和返还时间",
        ("履约保证金", "履约保函", "保证金"), ("履约保证金", "履约保函"), limit=2,
        pattern=r"\d+(?:\.\d+)?\s*(?:%|％|万元|元|个?月|日|天)",
    ),
    Clause(
        "termination_renewal", "终止和续约", "解除条件、通知期限、交接安排和续约规则",
        ("终止", "解除", "续约", "续签"), ("终止", "解除", "续约", "续签"),
    ),
    Clause(
        "variation_claims", "变更、签证与索赔", "提出时限、通知对象、书面确认、计价方式及证明材料",
        ("变更签证", "工程变更", "现场签证", "索赔通知", "索赔期限"), ("确认", "审批", "通知", "提交"),
        pattern=r"书面|\d+\s*(?:日|天)",
    ),
    Clause(
        "retention_warranty", "质保金与保修", "扣留比例、返还触发条件、返还期限及保修责任",
        ("质保金", "质量保证金", "保修期"), ("返还", "扣留", "保修", "退还"),
        pattern=r"\d+(?:\.\d+)?\s*(?:%|％|年|个?月|日|天)",
    ),
    Clause(
        "acceptance", "交付与验收", "交付材料、验收标准、负责人员、时限及不合格处理",
        ("验收标准", "验收程序", "验收期限", "验收要求", "交付与验收"), ("标准", "合格", "验收记录", "日内", "天内"),
    ),
    Clause(
        "liability", "违约与赔偿", "责任触发条件、计算基数、比例或上限及双方责任是否对应",
        ("违约责任", "违约金", "逾期赔偿", "赔偿责任"), ("赔偿", "损失", "承担", "支付"),
        pattern=r"损失|\d+(?:\.\d+)?\s*(?:%|％|元)",
    ),
)
VAGUE_TERMS = ("及时", "尽快", "另行约定", "适时", "合理期限", "按需")
MONEY_TERMS = ("%", "元", "付款", "支付比例", "支付周期")
IDENTITY_TERMS = ("名称", "统一社会信用代码", "纳税人识别号", "开户银行", "开户行", "账号", "帐号")
DOT_LEADERS = ("......", "……")
CALENDAR_DATE = r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日|\d{4}[./-]\d{1,2}[./-]\d{1,2}"
SCHEDULE_WORDS = ("开工", "完工", "竣工", "工期", "有效期", "期限", "到期")
SENTENCE_MARKS = ("。", "；")
EXCERPT_LIMIT, AMOUNT_EXCERPT_LIMIT, EXCERPT_LEAD = 420, 280, 96
PARTY_NAME = r"(?:名称|公司名称)?[：:]([\x{4e00}-\x{9fff}A-Za-z0-9（）()]+)"
BLANK_NAMES = ("待填", "待填写", "待定")
PARTY_PAIRS = (("甲方", "乙方"), ("承包人", "分包人"), ("采购方", "供应方"))
INFO_TABLE = r"双\s*方\s*基\s*本\s*信\s*息"
INFO_TABLE_END = r"\s(?:14\.2|15\.|十五、|十六、|合同附件)"
INFO_TABLE_LIMIT = 1800
AMOUNT_MARKERS = ("签约合同价（含增值税）", "签约合同价（不含增值税）", "含增值税", "不含增值税", "含税", "不含税")
SCHEDULE_START, SCHEDULE_END = "计划开工日期", "合同工期"
SCHEDULE_CUTS = ("2.质量标准", "2．质量标准", "五、签约合同价")
ISSUES = {
    "term": "已定位期限相关表述，但当前提取片段不足以确认具体签订日期、计划开工/竣工日期或明确到期日；请在签署页、补充协议或盖章日期处确认。",
    "amount": "已找到合同价款相关表述，但未能同时确认含税金额和不含税金额；请核对价款页及税率。",
    "banking": "已找到账户相关表述，但开户行、账户名称、账号或纳税信息不完整，请以双方基本信息页为准。",
    "insurance": "合同中出现保险相关表述，但未能确认投保范围、保险期限或保单要求。",
    "performance_bond": "已找到履约保证金相关表述，但未能确认金额、提交时间、扣除条件或返还时间。",
}
DEFAULT_ISSUE = "已定位到相关表述，但用于本项核对的关键信息仍不完整，请结合完整合同确认。"
DECISIONS = ("待复核", "已确认", "需补充")
STATUS_NAMES = {"found": "已定位", "incomplete": "信息不完整", "missing": "未定位"}

# A small Latin-script set (ours) for texts in European languages.
LATIN_CLAUSES = (
    Clause("origin", "Origin", "where it is from", ("from", "von"), ("the", "der"), limit=2),
    Clause("purpose", "Purpose", "what it is for", ("for ", "pour "), ("that", "que"), pattern=r"[a-z]+ing\b"),
    Clause("number", "Number", "figures", ("#", "no."), (), compact_patterns=(r"\d{2,}",)),
)
