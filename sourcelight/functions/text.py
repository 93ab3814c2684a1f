"""String scalars as Column expressions (all JVM-side)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcelight.rules import vocabulary as V

# Unicode white space; Java and RE2 ``\s`` alone cover ASCII only.
WS_CHARS = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_RARE_WS = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: No letter, digit or sign at this place: one or two comparisons spare most places the many of a class of rare characters.
_ODD = r"(?![!-~\x{A1}-\x{167F}\x{3001}-\x{FFFF}])"
CJK = "\\x{4e00}-\\x{9fff}"
LATIN_TOKEN = r"[a-z]+|\p{Nd}+(?:\.\p{Nd}+)?"
SENTENCE_END = "。！？!?；;"
LIST_ITEM = r"(?:[-*•]|\p{Nd}+[.、)]|[一二三四五六七八九十]+[、.])"
POLICY_CODE = V.POLICY_CODE_PATTERN


def once(value: Column, read: Callable[[Column], Column]) -> Column:
    """``read(value)`` with the value worked out once, however often it is asked for; a lambda would copy its expression."""
    return F.get(F.transform(F.array(value), read), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def compact(c: Column) -> Column:
    """Remove every white-space character."""
    return F.regexp_replace(c, _ODD + WS, "")


def no_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def normalize_text(c: Column) -> Column:
    """One LF per line break, single spaces, no control characters or blank lines.

    Most stored text is already in this form, so one search decides whether the
    replacements run at all.
    """
    t = F.regexp_replace(c, "\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b-\x1f\x7f]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, rf"\n{WS}+", "\n")
    t = F.regexp_replace(t, rf"{WS}+\n", "\n")
    untidy = c.rlike(rf"{_ODD}(?:[\t\r\x00-\x08\x0b-\x1f\x7f{_RARE_WS}]|  |\n[ \n]| \n)")
    return strip(F.when(untidy, t).otherwise(c))


def squeezed(c: Column) -> Column:
    """Lower-cased normalised text without white space."""
    low = F.lower(c)
    plain = F.replace(F.replace(low, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(c.rlike(f"{_ODD}[{_RARE_WS}]"), compact(low)).otherwise(plain)


def has_text(c: Column) -> Column:
    """True where normalising leaves something; cheaper than normalising."""
    return c.rlike(r"[^\x00-\x20\x7f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """True where ``c`` contains at least one literal term."""
    if not terms:
        return F.lit(False)
    out = c.contains(terms[0])
    for term in terms[1:]:
        out = out | c.contains(term)
    return out


def starts_with_any(c: Column, terms: Sequence[str]) -> Column:
    if not terms:
        return F.lit(False)
    out = c.startswith(terms[0])
    for term in terms[1:]:
        out = out | c.startswith(term)
    return out


def ends_with_any(c: Column, terms: Sequence[str]) -> Column:
    out = c.endswith(terms[0])
    for term in terms[1:]:
        out = out | c.endswith(term)
    return out


def literal_array(values: Sequence[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


# --- tokens -----------------------------------------------------------------

# Words that stay whole inside a run of CJK characters. Other runs become
# overlapping character pairs, so no dictionary segmenter is needed at run time.
DEFAULT_LEXICON: tuple[str, ...] = tuple(
    dict.fromkeys(
        V.WEAK_TOKENS
        + V.GENERIC_TOKENS
        + V.TRAVEL_POLICY_TERMS
        + V.TRANSPORT_TERMS
        + V.ANNUAL_LEAVE_TERMS
        + V.DRAFTING_EXTRA_TOKENS
        + V.SUBJECT_LEXICON
        + ("事假", "婚假", "发票", "抬头", "入职", "转正", "合同", "供应商", "密码", "账号", "审批", "提前", "工作日", "补助")
    )
)


def _longest_of(words: Sequence[str]) -> str:
    """Pattern of the longest of the words at a place.

    Words share their common beginnings, and first characters are told apart by
    halves, so a place costs a few comparisons instead of one per word.
    """
    heads: dict[str, set[str]] = {}
    for word in words:
        heads.setdefault(word[0], set()).add(word[1:])

    def branch(head: str) -> str:
        rest = [tail for tail in heads[head] if tail]
        shorter = "?" if "" in heads[head] else ""
        return re.escape(head) + (f"(?:{_longest_of(rest)}){shorter}" if rest else "")

    def among(firsts: list[str]) -> str:
        if len(firsts) <= 3:
            return "|".join(branch(head) for head in firsts)
        middle = len(firsts) // 2
        halves = firsts[:middle], firsts[middle:]
        return "|".join(rf"(?=[\x{{{ord(h[0]):x}}}-\x{{{ord(h[-1]):x}}}])(?:{among(h)})" for h in halves)

    return among(sorted(heads))


def tokens(c: Column, lexicon: Sequence[str] = DEFAULT_LEXICON) -> Column:
    """Search tokens of normalised text: letter runs, numbers, CJK words or pairs."""
    low = F.lower(c)
    plain = F.regexp_extract_all(low, F.lit(LATIN_TOKEN), F.lit(0))
    if lexicon:
        words = _longest_of(lexicon)
        pattern = f"{LATIN_TOKEN}|{words}|(?:(?!{words})[{CJK}])+"
    else:
        pattern = f"{LATIN_TOKEN}|[{CJK}]+"
    long_words = sorted({w for w in lexicon if len(w) > 2})
    mixed = F.flatten(
        F.transform(
            F.regexp_extract_all(low, F.lit(pattern), F.lit(0)),
            lambda t: F.when(
                (F.length(t) > 2) & t.rlike(f"^[{CJK}]{{3,}}$") & ~t.isin(*long_words),
                F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))),
            ).otherwise(F.array(t)),
        )
    )
    return F.when(c.rlike(f"[{CJK}]"), mixed).otherwise(plain)


def bigrams(c: Column) -> Column:
    """Character pairs of lower-cased, white-space-free text."""
    squeezed = compact(F.lower(c))
    return F.when(
        F.length(squeezed) > 1,
        F.transform(
            F.sequence(F.lit(1), F.length(squeezed) - 1),
            lambda i: F.substring(squeezed, i, F.lit(2)),
        ),
    ).otherwise(F.array().cast("array<string>"))


# --- sentences --------------------------------------------------------------


def sentences(c: Column) -> Column:
    """Answer candidates of normalised text.

    A wrapped line continues the one before it unless that one ends a sentence
    or the new one starts a list item; both are local to the line break, so one
    look-around replacement re-joins all lines.
    """
    joined = F.regexp_replace(c, rf"(?<![{SENTENCE_END}])\n(?!{LIST_ITEM})", "")
    parts = F.split(joined, rf"(?<=[{SENTENCE_END}]){WS}*|\n+", -1)
    trimmed = F.transform(parts, lambda p: F.btrim(p, F.lit(" -\t")))
    return F.filter(trimmed, lambda p: p != "")


def non_policy_sentence(c: Column) -> Column:
    """Headers, metadata and dangling fragments that never become facts."""
    return once(
        no_spaces(c),
        lambda s: (s == "")
        | starts_with_any(s, V.METADATA_PREFIXES)
        | (s.startswith("第") & s.endswith("页"))
        | contains_any(s, V.SAMPLE_NOTICES)
        | starts_with_any(s, V.SAMPLE_PREFIXES)
        | ((F.length(s) < 20) & s.rlike(r"^[一二三四五六七八九十]+[、.]"))
        | ((F.length(s) < 20) & ends_with_any(s, V.DANGLING_ENDINGS)),
    )


def strip_item_number(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"^\p{Nd}+[.、)]\s*", ""))


def clean_sentence(c: Column) -> Column:
    """Drop leading numbering and replace internal policy codes."""
    t = F.regexp_replace(c, r"^\s*\p{Nd}+(?:[.．]\p{Nd}+)*[.．、)]?\s*", "")
    return F.regexp_replace(t, V.POLICY_CODE_PATTERN, V.POLICY_CODE_REPLACEMENT)


def fact_key(c: Column) -> Column:
    """Exact de-duplication key: number-stripped, space-free text."""
    return no_spaces(F.regexp_replace(c, r"^\p{Nd}+[.、]\s*", ""))


# --- document metadata ------------------------------------------------------


def _labelled(c: Column, label: str) -> Column:
    value = F.regexp_extract(c, rf"(?i){label}\s*[：:]\s*([^\n]+)", 1)
    return F.btrim(value, F.lit(" -*"))


def heading_title(c: Column) -> Column:
    labelled = F.when(
        c.contains("文档名称"), F.regexp_extract(c, r"文档名称\s*[：:]\s*([^\n]+)", 1)
    ).otherwise("")
    heading = F.when(c.contains("# "), strip(F.regexp_extract(c, r"(?m)^#\s+(.+?)\s*$", 1))).otherwise("")
    return F.when(labelled != "", F.btrim(labelled, F.lit(" -*"))).otherwise(heading)


def section_titles(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?m)^#{2,4}\s+(.+?)\s*$"), F.lit(1))
    return F.transform(found, strip)


def infer_category(filename: Column) -> Column:
    low = F.lower(filename)
    out = F.lit(V.DEFAULT_CATEGORY)
    for category, hints in reversed(V.CATEGORY_HINTS):
        out = F.when(contains_any(low, hints), F.lit(category)).otherwise(out)
    return out


def category(content: Column, filename: Column) -> Column:
    label = r"(?:知识分类|业务分类|所属分类|分类)"
    present = content.rlike(rf"(?i){label}\s*[：:]\s*[^\n]+")
    return F.when(present, _labelled(content, label)).otherwise(infer_category(filename))


def policy_metadata(c: Column) -> dict[str, Column]:
    """Version, effective date, department and owner as separate columns."""
    return {
        "version": _labelled(c, "版本"),
        "effective_date": _labelled(c, "生效日期"),
        "department": _labelled(c, "(?:发布部门|责任部门|归口部门)"),
        "owner": _labelled(c, r"(?:\A|\n)\s*(?:[-*]\s*)?负责人"),
    }


def is_catalog(c: Column) -> Column:
    """A stand-alone table of contents, not a page that merely mentions one."""
    lines = F.filter(F.transform(F.split(c, r"\n", -1), compact), lambda x: x != "")
    numbered = F.filter(lines, lambda x: x.rlike(r"^(?:第[一二三四五六七八九十百\p{Nd}]+章|\p{Nd}+$)"))
    prose = F.exists(lines, lambda x: (F.length(x) > 45) | x.contains("。") | x.contains("；"))
    return (
        c.contains("目")
        & F.exists(F.slice(lines, 1, 3), lambda x: x == "目录")
        & (F.size(numbered) >= 4)
        & ~prose
    )


# --- presentation -----------------------------------------------------------


def compact_clause_text(c: Column) -> Column:
    """Drop heading lines and collapse white space other than line breaks."""
    no_headings = F.regexp_replace(c, r"(?m)^#{1,6}[^\n]*(?:\n|\z)", "\n")
    t = F.when(c.contains("#"), no_headings).otherwise(c)
    inline = rf"[ \t\x0b\f\r{_RARE_WS}]"
    runs = c.rlike(rf"{_ODD}(?:{inline}{{2}}|[\t\x0b\f\r{_RARE_WS}])")
    return strip(F.when(runs, F.regexp_replace(t, f"{inline}+", " ")).otherwise(t))


def source_type(path: Column) -> Column:
    suffix = F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)\z", 1)
    return F.when(suffix != "", suffix).otherwise(F.lit("text"))


def preview(c: Column, limit: int = 80) -> Column:
    return F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, limit)


def content_version(c: Column) -> Column:
    return F.sha2(c, 256)


def employee_answer(c: Column) -> Column:
    """Answer text without citation boilerplate, dangling headings and emphasis."""
    lines = F.transform(F.split(c, r"\r?\n", -1), strip)
    kept = F.filter(
        lines,
        lambda x: (x != "")
        & ~x.rlike(r"^根据《.+》中的相关规定：?$")
        & (x != "请以页面下方展示的原文来源为准。")
        & ~x.rlike(rf"\A(?:[-•]\s*)?(?:[{CJK}A-Za-z0-9（）()、·]|{WS}){{1,24}}[：:]\z"),
    )
    tidy = F.transform(
        kept,
        lambda x: F.regexp_replace(
            F.regexp_replace(x, r"^(-\s*)\p{Nd}+[.、)]\s*", "$1"), r"\*\*(.+?)\*\*", "$1"
        ),
    )
    return strip(F.array_join(tidy, "\n"))


def escape_html(c: Column) -> Column:
    t = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return t


def answer_html(c: Column, show_overline: bool = True) -> Column:
    """Escaped paragraphs; consecutive ``- `` lines share one list."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n", -1), strip), lambda x: x != "")
    tagged = F.transform(
        lines,
        lambda x: F.when(
            x.startswith("- "),
            F.concat(F.lit("<ul><li>"), escape_html(F.substring(x, F.lit(3), F.length(x))), F.lit("</li></ul>")),
        ).otherwise(F.concat(F.lit("<p>"), escape_html(x), F.lit("</p>"))),
    )
    body = F.replace(F.array_join(tagged, ""), F.lit("</ul><ul>"), F.lit(""))
    overline = '<p class="answer-overline">制度依据</p>' if show_overline else ""
    return F.concat(F.lit('<section class="answer-panel">' + overline), body, F.lit("</section>"))


def degradation_warning(model_error: Column, vector_error: Column) -> Column:
    return (
        F.when(F.coalesce(model_error, F.lit("")) != "", F.lit("大模型服务本次不可用，未生成答复，请稍后重试。"))
        .when(
            F.coalesce(vector_error, F.lit("")) != "",
            F.lit("向量检索本次不可用，已降级为关键词检索；结果仍须核对原文。"),
        )
        .otherwise(F.lit(""))
    )


def reranker_label(enabled: Column, effective: Column, error: Column) -> Column:
    return (
        F.when(effective, F.lit("已启用"))
        .when(~enabled, F.lit("未启用"))
        .when(F.coalesce(error, F.lit("")) != "", F.lit("加载失败，已回退"))
        .otherwise(F.lit("已配置，首次问答时加载"))
    )


def role_label(label: Column, name: Column) -> Column:
    return F.concat(label, F.lit("（"), name, F.lit("）"))
