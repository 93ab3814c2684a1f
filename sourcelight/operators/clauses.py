"""Contract clause location, status, prompts and review export."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.functions.batches import runs
from sourcelight.operators.chunking import section_bodies, sections_holding
from sourcelight.rules import clauses as C

SLICE_BYTES = 4_000_000  # of the texts that a task holds as Python strings at once


def _sliced(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    for start, rows in runs(texts, limit):
        yield texts.slice(start, rows)


def _excerpt_at(text: str, at: int, limit: int = C.EXCERPT_LIMIT) -> str:
    """``excerpt`` of one position."""
    marks = C.SENTENCE_MARKS
    first = max(at - C.EXCERPT_LEAD, 0)
    start = max(first, *(text.rfind(m, first, at) + 1 for m in (*marks, "\n")))
    ends = [e for e in (text.find(m, at, at + limit + 1) for m in marks) if e >= 0]
    # A mark at the very start does not end it.
    closed = bool(ends) and min(ends) > at
    body = text[start : min(ends) + 1 if closed else at + limit].strip(X.WS_CHARS)
    complete = not closed and len(text) - at <= limit
    return body if complete or body.endswith(marks) else body + "…"


def _scanned(read: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """``read`` of every text, a slice of a batch at a time; null is an empty text."""

    @F.arrow_udf("array<string>")
    def scan(texts: pa.Array) -> pa.Array:
        parts = [pa.array([read(body or "") for body in part.to_pylist()], pa.list_(pa.string())) for part in _sliced(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return scan


def _rank(priority: int, body: str) -> int:
    """Order of an excerpt among those of its clause, the best first."""
    score = 10_000 - priority * 1_000 + min(len(body), C.EXCERPT_LIMIT)
    for terms, points in ((C.DOT_LEADERS, -2_000), (C.MONEY_TERMS, 300), (C.IDENTITY_TERMS, 450)):
        if any(t in body for t in terms):
            score += points
    return -score


def anchored_excerpts(text: Column, clauses: Sequence[C.Clause]) -> Column:
    """Per clause, the best excerpts around its anchors, joined by blank lines.

    Spark has no function for the positions of all matches of a substring, and
    its substrings count characters from the start of the text, so this one
    step is an Arrow-batched scan in linear time. Only the kept excerpts leave
    it; of the ordered ones, the first ``limit`` of which none contains another.
    """

    def pick(body: str, clause: C.Clause) -> str:
        hits = []
        for priority, anchor in enumerate(clause.anchors):
            at = body.find(anchor)
            while at >= 0:
                found = _excerpt_at(body, at)
                hits.append((_rank(priority, found), at, found))
                at = body.find(anchor, at + len(anchor))
        kept: list[str] = []
        for *_, found in sorted(hits):
            if not any(found in k or k in found for k in kept):
                kept.append(found)
                if len(kept) == clause.limit:
                    break
        return "\n\n".join(kept)

    return _scanned(lambda body: [pick(body, c) for c in clauses])(text)


def first_excerpts(text: Column, markers: Sequence[str], limit: int) -> Column:
    """The excerpts around the first place of each marker that the text holds."""
    return _scanned(lambda body: [_excerpt_at(body, body.find(m), limit) for m in markers if m in body])(text)


def excerpt(text: Column, offset: Column, limit: int = C.EXCERPT_LIMIT) -> Column:
    """Clause-sized context of a zero-based position of a text."""
    first = F.greatest(offset - C.EXCERPT_LEAD, F.lit(0))
    return trim_excerpt(
        F.substring(text, first + 1, offset - first), F.substring(text, offset + 1, F.lit(limit + 1)), limit
    )


def trim_excerpt(lead: Column, tail: Column, limit: int = C.EXCERPT_LIMIT) -> Column:
    """Cut the surroundings of a position to one clause.

    Starts after the last sentence mark or line break of ``lead`` and ends with
    the first mark inside ``tail``, else after ``limit`` characters. ``tail``
    holds one character more than the limit unless the text ends before.
    """
    marks = "".join(C.SENTENCE_MARKS)
    start = F.regexp_replace(lead, rf"(?s)\A.*[{marks}\n]", "")
    # A mark at the very start of the tail does not end it.
    closed = F.regexp_extract(tail, rf"\A[^{marks}]++[{marks}]", 0)
    body = X.strip(F.concat(start, F.when(closed != "", closed).otherwise(F.substring(tail, 1, limit))))
    complete = ((closed == "") & (F.length(tail) <= limit)) | body.rlike(rf"[{marks}]\z")
    return F.when(complete, body).otherwise(F.concat(body, F.lit("…")))


def _distinct_excerpts(ordered: Column, limit: Column) -> Column:
    """First ``limit`` excerpts of which none contains another."""
    return F.aggregate(
        ordered,
        F.array().cast("array<string>"),
        lambda kept, e: F.when(
            (F.size(kept) < limit) & ~F.exists(kept, lambda k: k.contains(e) | e.contains(k)),
            F.concat(kept, F.array(e)),
        ).otherwise(kept),
    )


def locate(docs: DataFrame, clauses: Sequence[C.Clause] = C.CONTRACT_CLAUSES, carry: Sequence[str] = ()) -> DataFrame:
    """(document_id, *carry, clause_no, field, evidence) for every document and clause.

    Narrow. What belongs to a document is computed once in its row; the explode
    comes last, and texts do not go through it.
    """
    compact = docs.select("document_id", *carry, X.compact_clause_text(F.col("content")).alias("_text"))
    special = any(c.key in ("parties", "banking", "amount", "term") for c in clauses)
    blocks = _blocks(compact) if special else compact
    held = [c for c in blocks.columns if c != "_text"]
    # The outer form keeps the optimizer from scanning again in a size filter; a row has one element per clause.
    rows = blocks.withColumn("_picked", anchored_excerpts(F.col("_text"), clauses)).select(
        *held, F.posexplode_outer("_picked").alias("clause_no", "evidence")
    )
    keyed = rows.withColumn("field", F.get(X.literal_array([c.key for c in clauses]), F.col("clause_no")))
    return (_override(keyed) if special else keyed).select("document_id", *carry, "clause_no", "field", "evidence")


def _blocks(compact: DataFrame) -> DataFrame:
    """Add a document's table, row, price and schedule blocks: _table, _held, _parties, _prices, _schedule.

    Steps are columns of their own where a later step reads them more than once.
    """
    text = F.col("_text")
    # Named parties: both roles of the first complete pair.
    roles = {
        f"_role{i}{side}": X.strip(F.regexp_extract(text, rf"{role}(?:名称|公司名称)?\s*[:：]\s*[^\n。；]+", 0))
        for i, pair in enumerate(C.PARTY_PAIRS)
        for side, role in enumerate(pair)
    }
    parties = F.lit(None).cast("string")
    for i in reversed(range(len(C.PARTY_PAIRS))):
        both = [F.col(f"_role{i}{side}") for side in (0, 1)]
        parties = F.when((both[0] != "") & (both[1] != ""), F.concat_ws("\n\n", *both)).otherwise(parties)
    # The information table of both parties, up to the next numbered heading.
    plain = "双方基本信息"
    body = F.when(
        text.contains(plain), F.concat(F.lit(plain), F.substring_index(text, plain, -1))
    ).otherwise(F.regexp_extract(text, rf"(?s){C.INFO_TABLE}.*\z", 0))
    heading = F.regexp_extract(F.col("_body"), rf"\A{C.INFO_TABLE}", 0)
    rest = F.substring(F.col("_body"), F.length("_heading") + 1, F.length("_body"))
    upto = F.get(F.split(rest, C.INFO_TABLE_END, 2), F.lit(0))
    table = F.when(F.col("_body") != "", X.strip(F.substring(F.concat("_heading", upto), 1, C.INFO_TABLE_LIMIT)))
    squeezed = X.compact(F.col("_table"))
    holds = F.struct(
        X.contains_any(F.col("_squeezed"), ("承包人", "甲方")).alias("parties"),
        X.contains_any(F.col("_squeezed"), ("开户", "账号")).alias("banking"),
    )
    # Both tax prices, when at least two markers give different excerpts.
    shown = first_excerpts(text, C.AMOUNT_MARKERS, C.AMOUNT_EXCERPT_LIMIT)
    # The schedule block from the start date to the total duration.
    start = F.when(
        text.contains(C.SCHEDULE_START),
        F.concat(F.lit(C.SCHEDULE_START), F.substring(text, F.instr(text, C.SCHEDULE_START) + len(C.SCHEDULE_START), F.length(text))),
    )
    until = F.instr(F.col("_start"), C.SCHEDULE_END)
    total = F.regexp_extract(
        F.substring("_start", F.col("_until"), F.length("_start")), rf"\A(?s:.*?){C.SCHEDULE_END}.{{0,100}}?\d+\s*天", 0
    )
    closing = F.when(F.col("_total") != "", F.length("_total")).otherwise(120)
    schedule = F.when(F.col("_until") > 0, F.substring("_start", F.lit(1), F.col("_until") - 1 + closing))
    return (
        compact.withColumns(roles | {"_body": body, "_start": start, "_shown": shown})
        .withColumns({"_heading": heading, "_until": until, "_parties": parties})
        .withColumns({"_table": table, "_total": F.when(F.col("_until") > 0, total)})
        .withColumn("_squeezed", squeezed)
        .select(
            *compact.columns, "_table", holds.alias("_held"), "_parties",
            _distinct_excerpts(F.col("_shown"), F.lit(len(C.AMOUNT_MARKERS))).alias("_prices"), schedule.alias("_schedule"),
        )
    )


def _override(rows: DataFrame) -> DataFrame:
    """Replace the scored excerpts by the blocks of ``_blocks`` where these apply."""
    key, evidence = F.col("field"), F.col("evidence")
    scheduled = (key == "term") & evidence.contains(C.SCHEDULE_START)
    block = F.coalesce("_schedule", F.regexp_extract(evidence, rf"(?s){C.SCHEDULE_START}.*\z", 0))
    rows = rows.withColumn("_block", F.when(scheduled, block))
    for cut in C.SCHEDULE_CUTS:
        block = F.col("_block")
        rows = rows.withColumn(
            "_block", F.when(block.contains(cut), F.rtrim(F.substring_index(block, cut, 1))).otherwise(block)
        )
    return rows.withColumn(
        "evidence",
        F.when((key == "parties") & F.col("_held.parties"), F.col("_table"))
        .when(key == "parties", F.coalesce("_parties", evidence))
        .when((key == "banking") & F.col("_held.banking"), F.col("_table"))
        .when((key == "amount") & (F.size("_prices") >= 2), F.array_join(F.slice("_prices", 1, 4), "\n\n"))
        .when(scheduled, F.col("_block"))
        .otherwise(evidence),
    )


def _complete(clause: C.Clause, evidence: Column, squeezed: Column) -> Column:
    if clause.schedule:
        return evidence.rlike(C.CALENDAR_DATE) & X.contains_any(evidence, C.SCHEDULE_WORDS)
    if clause.named_parties:
        out = F.lit(False)
        for pair in C.PARTY_PAIRS:
            names = [F.regexp_extract(squeezed, role + C.PARTY_NAME, 1) for role in pair]
            both = F.lit(True)
            for name in names:
                both = both & (F.length(name) >= 2) & ~name.isin(*C.BLANK_NAMES)
            out = out | both
        return out
    out = X.contains_any(evidence, clause.required) if clause.required else F.lit(True)
    if clause.pattern:
        out = out & evidence.rlike(clause.pattern)
    for p in clause.compact_patterns:
        out = out & squeezed.rlike(p)
    return out


def status(key: Column, evidence: Column, clauses: Sequence[C.Clause] = C.CONTRACT_CLAUSES) -> Column:
    """missing, incomplete or found."""
    squeezed = X.compact(evidence)
    complete = F.lit(False)
    for clause in clauses:
        complete = F.when(key == clause.key, _complete(clause, evidence, squeezed)).otherwise(complete)
    return F.when(evidence == "", F.lit("missing")).when(complete, F.lit("found")).otherwise(F.lit("incomplete"))


def issue(key: Column, state: Column) -> Column:
    text = F.lit(C.DEFAULT_ISSUE)
    for name, message in C.ISSUES.items():
        text = F.when(key == name, F.lit(message)).otherwise(text)
    return F.when(state == "incomplete", text).otherwise(F.lit(""))


def extract_fields(
    docs: DataFrame, clauses: Sequence[C.Clause] = C.CONTRACT_CLAUSES, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per document and clause: evidence, status and issue."""

    def spec(values: list[str]) -> Column:
        return F.get(X.literal_array(values), F.col("clause_no"))

    return (
        locate(docs, clauses, carry)
        .withColumn("label", spec([c.label for c in clauses]))
        .withColumn("review_focus", spec([c.review_focus for c in clauses]))
        .withColumn("status", status(F.col("field"), F.col("evidence"), clauses))
        .withColumn("issue", issue(F.col("field"), F.col("status")))
    )


def _prompt_message(vague_terms: Sequence[str]) -> Column:
    """Prompt text of one clause row; null where there is nothing to ask."""
    vague = F.filter(X.literal_array(vague_terms), lambda t: F.col("evidence").contains(t))
    words = F.array_join(vague, "、")
    has_vague = F.size(vague) > 0
    suffix = F.when(has_vague, F.concat(F.lit("；其中包含“"), words, F.lit("”等含糊表述"))).otherwise("")
    spare = F.concat(
        F.lit("已找到与"), F.col("label"), F.lit("相关的表述，但未能确认"), F.col("review_focus"), F.lit("是否完整明确")
    )
    return (
        F.when(F.col("status") == "missing", F.concat(F.lit("待确认条款：未检出"), F.col("label"), F.lit("。")))
        .when(
            F.col("status") == "incomplete",
            F.concat(F.lit("待确认条款："), F.when(F.col("issue") != "", F.col("issue")).otherwise(spare), suffix),
        )
        .when(
            has_vague,
            F.concat(F.lit("审阅提示："), F.col("label"), F.lit("包含表述“"), words, F.lit("”，建议确认具体条件或期限。")),
        )
    )


def _severity() -> Column:
    return F.when(F.col("status").isin("missing", "incomplete"), "medium").otherwise("low")


def review_prompts(fields: DataFrame, vague_terms: Sequence[str] = C.VAGUE_TERMS) -> DataFrame:
    """Prompts for missing, incomplete or vaguely worded clauses."""
    return (
        fields.withColumn("message", _prompt_message(vague_terms))
        .where(F.col("message").isNotNull())
        .select("document_id", "clause_no", "field", _severity().alias("severity"), "message")
    )


def review_counts(fields: DataFrame, *keys: str) -> DataFrame:
    found = F.sum((F.col("status") == "found").cast("int"))
    return fields.groupBy(*(keys or ("document_id",))).agg(
        F.count("*").alias("checked"),
        found.alias("located"),
        F.sum((F.col("status") == "incomplete").cast("int")).alias("incomplete"),
        (F.count("*") - found).alias("pending"),
    )


def review(docs: DataFrame, clauses: Sequence[C.Clause] = C.CONTRACT_CLAUSES) -> DataFrame:
    """Full review: one row per document with fields, prompts, counts and hash.

    Always inspects the whole text. Sections are found before the grouping, so
    the one shuffle moves excerpts, not texts; a group has one row per clause.
    """
    content = F.col("content")
    hashed = docs.select(
        "document_id", "title", "content", X.content_version(content).alias("document_version"),
        section_bodies(content).alias("_bodies"),
    )
    rows = (
        extract_fields(hashed, clauses, ["title", "document_version", "_bodies"])
        .withColumn("evidence_sections", sections_holding(F.col("_bodies"), F.col("evidence")))
        .withColumn("message", _prompt_message(C.VAGUE_TERMS))
    )
    prompt = F.when(
        F.col("message").isNotNull(), F.struct("clause_no", "field", _severity().alias("severity"), "message")
    )
    found = F.sum((F.col("status") == "found").cast("int"))
    gathered = rows.groupBy("document_id", "title", "document_version").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "clause_no", "field", "label", "review_focus", "evidence", "status", "issue", "evidence_sections"
                )
            )
        ).alias("fields"),
        F.array_sort(F.collect_list(prompt)).alias("risk_prompts"),
        F.count("*").alias("checked"),
        found.alias("located"),
        F.sum((F.col("status") == "incomplete").cast("int")).alias("incomplete"),
        (F.count("*") - found).alias("pending"),
    )
    return gathered.withColumn(
        "summary",
        F.format_string(
            "本次按 %d 类常见条款进行定位：已定位 %d 项，信息不完整或待确认 %d 项。定位到原文不代表条款已经充分或无需人工复核。",
            "checked", "located", "pending",
        ),
    )


def _quoted(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("> "), x)), "\n")


def export_review(reviews: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(document_id, report): Markdown hand-off record.

    ``decisions`` has (document_id, field, decision, note); an unknown decision
    is an error, a missing one reads as not yet reviewed.
    """
    rows = reviews.select("document_id", "title", "document_version", F.explode("fields").alias("f"))
    rows = rows.select("document_id", "title", "document_version", "f.*")
    if decisions is None:
        rows = rows.withColumn("decision", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string"))
    else:
        rows = rows.join(decisions, ["document_id", "field"], "left")
    state = F.coalesce("decision", F.lit(C.DECISIONS[0]))
    state = F.when(state.isin(*C.DECISIONS), state).otherwise(F.raise_error(F.lit("不支持的人工复核状态")))
    name = F.lit("待确认")
    for key, label in C.STATUS_NAMES.items():
        name = F.when(F.col("status") == key, F.lit(label)).otherwise(name)
    where = F.when(
        F.size("evidence_sections") > 0,
        F.concat(F.lit("原文位置："), F.array_join("evidence_sections", "、")),
    ).otherwise(F.lit("原文位置：未取得可靠页码或章节，需打开完整文件核对"))
    note = F.when(
        F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n\n人工备注：\n"), _quoted(F.col("note")))
    ).otherwise("")
    section = F.concat(
        F.lit("## "), F.col("label"), F.lit("\n\n系统定位："), name, F.lit("；人工复核："), state,
        F.lit("\n\n核对要点："), F.col("review_focus"), F.lit("\n\n"), where, F.lit("\n"),
        F.when(F.col("evidence") != "", F.concat(F.lit("\n"), _quoted(F.col("evidence")))).otherwise(""), note, F.lit("\n"),
    )
    head = F.concat(
        F.lit("# 合同条款核对记录\n\n合同："), F.any_value("title"), F.lit("\n\n文本版本（SHA-256）："),
        F.any_value("document_version"),
        F.lit("\n\n本记录用于人工复核与交接，不代表签署批准。人工结论由当前操作者填写，未进行身份签名。\n\n"),
    )
    parts = F.array_sort(F.collect_list(F.struct("clause_no", section.alias("s"))))
    return rows.groupBy("document_id").agg(
        F.concat(head, F.array_join(F.transform(parts, lambda p: p["s"]), "\n")).alias("report")
    )
