"""Extractive answers: worded composers first, then the generic selection.

A composer is a row of data: a trigger on the question and slots filled by the
first sentence that meets a condition. All composers are compiled to one CASE
over the question's sentence array; only near-duplicate checks leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.functions.dedupe import distinct_fact_positions, pick
from sourcelight.operators.evidence import CONDITION, holds, holds_any, holds_one, meets, overlap, phrase_rules, rule_table, rules_bonus
from sourcelight.rules import evidence_rules as R
from sourcelight.rules import vocabulary as V
from sourcelight.session import fenced

BULLETS = "\n- "


def _tidy(s: Column) -> Column:
    return X.clean_sentence(X.strip_item_number(s))


def _bullets(lines: Column) -> Column:
    return F.concat(F.lit("- "), F.array_join(lines, BULLETS))


def add_sentences(df: DataFrame) -> DataFrame:
    """``facts``: sentences of the best document with their reading position."""
    own = F.filter(F.array_sort("results"), lambda r: r["document_id"] == F.col("best_document"))

    def explode(r: Column) -> Column:
        return F.transform(
            X.sentences(r["content"]),
            lambda s, i: F.struct(
                r["chunk_index"].alias("chunk_index"),
                i.alias("position"),
                r["rank"].alias("rank"),
                s.alias("text"),
                X.non_policy_sentence(s).alias("noise"),
                r["title"].alias("title"),
            ),
        )

    return fenced(
        fenced(df, "query_id").withColumn("evidence", F.array_join(F.transform(own, lambda r: r["content"]), "\n"))
        .withColumn("invoice_policy", F.exists(own, lambda r: r["title"].contains("发票")
                                               | F.lower(r["source_path"]).contains("invoice")))
        .withColumn("facts", F.flatten(F.transform(own, explode)))
        .withColumn("in_order", F.array_sort("facts")),
        "query_id",
    )


SLOT = (
    f"needs:{CONDITION},required:boolean,otherwise:{CONDITION},compact:boolean,say:string,hidden:boolean,"
    "unless:array<string>"
)
COMPOSER = (
    f"header:string,when:{CONDITION},slots:array<struct<{SLOT}>>,collect:array<{CONDITION}>,without:array<string>,"
    "unless:array<string>,guard:string,fixed:string,policy_only:boolean,reading_order:boolean,distinct:boolean,"
    f"limit:int,first:array<array<{CONDITION}>>"
)


def _guards() -> Column:
    """Names of the computed question conditions that hold."""
    cur, full = F.col("current_ns"), F.col("question_ns")
    travel = full.contains("报销") & X.contains_any(full, V.TRAVEL_QUERY_TERMS)
    leave = X.contains_any(full, V.ANNUAL_LEAVE_TERMS) & (
        X.contains_any(cur, V.APPLICATION_TERMS) | cur.rlike(r"连续请.*\d+个工作日")
    )
    days = F.regexp_extract(cur, r"0*(\d*)个工作日", 1)
    over_3 = (F.length(days) > 1) | days.isin(*"456789")
    flags = {
        "vpn": F.upper(cur).contains("VPN"),
        "drafting": F.col("drafting"),
        "travel": travel,
        "not_travel": ~travel,
        "travel_invoice_policy": travel & F.col("invoice_policy"),
        "leave": leave,
        "long_leave": leave & over_3,
        "short_leave": leave & ~over_3,
    }
    return F.array(F.lit(""), *[F.when(flag, F.lit(name)) for name, flag in flags.items()])


def _slot_lines(pool: Column, rule: Column) -> Column:
    """Shown lines of all slots; null when a required slot stays empty."""
    cur = F.col("current_ns")

    def fill(slot: Column) -> Column:
        def fits(f: Column) -> Column:
            return X.once(
                F.when(slot["compact"], X.no_spaces(f["text"])).otherwise(f["text"]),
                lambda text: holds(text, slot["needs"]) | ((F.size(slot["otherwise"]) > 0) & holds(text, slot["otherwise"])),
            )

        text = F.get(F.filter(pool, fits), F.lit(0))["text"]
        said = F.when(text.isNotNull() & (slot["say"] != ""), slot["say"]).otherwise(text)
        return F.struct(
            F.when(~holds_any(cur, slot["unless"]), said).alias("text"),
            slot["required"].alias("required"),
            slot["hidden"].alias("hidden"),
        )

    filled = F.transform(rule["slots"], fill)
    shown = F.transform(
        F.filter(filled, lambda x: x["text"].isNotNull() & ~x["hidden"]), lambda x: x["text"]
    )
    complete = F.forall(filled, lambda x: ~x["required"] | x["text"].isNotNull())
    return F.when(complete, F.when(rule["fixed"] != "", F.array(rule["fixed"])).otherwise(shown))


def _collected(pool: Column, rule: Column) -> Column:
    hits = F.filter(
        pool, lambda f: holds_one(f["text"], rule["collect"]) & ~holds_any(f["text"], rule["without"])
    )
    keyed = F.transform(
        hits,
        lambda f, i: F.struct(
            F.transform(rule["first"], lambda key: F.when(holds_one(f["text"], key), 0).otherwise(1)).alias("keys"),
            i.alias("i"),
            f["text"].alias("text"),
        ),
    )
    texts = F.transform(F.array_sort(keyed), lambda k: k["text"])
    cut = (rule["limit"] > 0) & ~rule["distinct"]
    return F.when(cut, F.slice(texts, F.lit(1), F.greatest(rule["limit"], F.lit(1)))).otherwise(texts)


def _worded() -> Column:
    """Outcome of the first composer that fires and finds lines, else null."""
    cur = F.col("current_ns")
    table = F.transform(
        rule_table(R.COMPOSERS, COMPOSER), lambda r, i: F.struct(r.alias("rule"), i.alias("no"))
    )
    fired = F.filter(
        table,
        lambda c: holds(cur, c["rule"]["when"])
        & ~holds_any(cur, c["rule"]["unless"])
        & F.exists("guards", lambda g: g.eqNullSafe(c["rule"]["guard"])),
    )

    def outcome(c: Column) -> Column:
        rule = c["rule"]
        pool = F.filter(
            F.when(rule["reading_order"], F.col("in_order")).otherwise(F.col("facts")),
            lambda f: ~(rule["policy_only"] & f["noise"]),
        )
        lines = F.when(F.size(rule["slots"]) > 0, _slot_lines(pool, rule)).otherwise(_collected(pool, rule))
        return F.struct(
            c["no"].alias("no"),
            rule["header"].alias("header"),
            F.transform(lines, _tidy).alias("lines"),
            rule["limit"].alias("limit"),
            rule["distinct"].alias("distinct"),
        )

    found = F.filter(F.transform(fired, outcome), lambda o: o["lines"].isNotNull() & (F.size(o["lines"]) > 0))
    return F.get(found, F.lit(0))


def _new_employee_leave() -> Column:
    """Leave tiers read from the evidence by pattern, in two known wordings."""
    text = X.compact(F.col("evidence"))
    asks = (
        X.contains_any(F.col("question_ns"), V.ANNUAL_LEAVE_TERMS)
        & X.contains_any(F.col("question_ns"), V.NEW_HIRE_TERMS)
        & ~X.contains_any(F.col("current_ns"), V.APPLICATION_TERMS)
    )

    def tiers(spec):
        days = [F.regexp_extract(text, pattern, 1) for _, pattern in spec]
        complete = F.lit(True)
        for d in days:
            complete = complete & (d != "")
        return complete, [F.concat(F.lit(f"{label}："), d, F.lit(" 天")) for (label, _), d in zip(spec, days)]

    def all_match(patterns):
        out = F.lit(True)
        for p in patterns:
            out = out & text.rlike(p)
        return out

    first_ok, first_lines = tiers(R.LEAVE_TIERS)
    first = F.when(
        first_ok & all_match(R.LEAVE_PRORATION), F.concat(F.lit(R.LEAVE_HEADER), _bullets(F.array(*first_lines)))
    )
    book_ok, book_lines = tiers(R.HANDBOOK_TIERS)
    prorated = all_match(R.HANDBOOK_PRORATION)
    steps = F.regexp_extract(text, R.HANDBOOK_PROGRESSION, 1)
    step_line = F.when(steps != "", F.concat(F.lit("工作满 6 年后：每服务 1 年增加 1 天，最高 "), steps, F.lit(" 天")))
    lines = F.filter(F.array(book_lines[0], step_line, *book_lines[1:]), lambda x: x.isNotNull())
    qualifier = F.when(prorated, F.lit(R.HANDBOOK_PRORATED)).otherwise(F.lit(R.HANDBOOK_FIRST_YEAR))
    second = F.when(
        book_ok & (prorated | text.contains(R.HANDBOOK_SECOND_YEAR)),
        F.concat(F.lit(R.HANDBOOK_HEADER), qualifier, F.lit("：\n"), _bullets(lines)),
    )
    return F.when(asks, F.coalesce(first, second))


def _personal_leave_candidates() -> Column:
    hits = F.filter(
        "facts",
        lambda f: ~f["noise"]
        & ~X.contains_any(f["text"], V.ANNUAL_LEAVE_TERMS)
        & (f["text"].contains("事假") | X.contains_any(f["text"], R.PERSONAL_LEAVE_ALTERNATIVES)),
    )
    return F.transform(hits, lambda f: _tidy(f["text"]))


def _asks_pay() -> Column:
    return X.contains_any(F.col("current_ns"), V.PAY_TERMS)


def _personal_leave() -> Column:
    """Needs ``leave_facts``: the candidates after near-duplicate removal."""
    cur = F.col("current_ns")
    asks = cur.contains("事假") & (_asks_pay() | X.contains_any(cur, R.PERSONAL_LEAVE_TRIGGERS))
    picked = F.array_distinct(
        F.filter(
            F.array(
                *[
                    _first_line(F.col("leave_facts"), slot.needs)
                    for slot in R.PERSONAL_LEAVE_SLOTS
                ]
            ),
            lambda x: x.isNotNull(),
        )
    )
    pay_clause = F.col("evidence").contains(R.PERSONAL_LEAVE_PAY_CLAUSE)
    deadline = F.get(F.filter(picked, lambda s: s.contains("提前1个工作日")), F.lit(0))
    deadline = F.regexp_replace(deadline, r"^（?\d+[）.、]\s*", "")
    # The first mention only.
    deadline = F.regexp_replace(deadline, r"\A(.*?)事假原则上应", "$1原则上应")
    pay = F.concat(
        F.lit(R.PERSONAL_LEAVE_PAY_TEXT),
        F.coalesce(F.concat(F.lit(R.PERSONAL_LEAVE_DEADLINE_TEXT), deadline), F.lit("")),
    )
    plain = F.concat(F.lit(R.PERSONAL_LEAVE_HEADER + "\n"), _bullets(F.slice(picked, 1, 3)))
    return F.when(
        asks,
        F.when(_asks_pay() & ((F.size(picked) > 0) | pay_clause), pay).when(F.size(picked) > 0, plain),
    )


def _first_line(lines: Column, needs: R.Condition) -> Column:
    return F.get(F.filter(lines, lambda s: meets(s, needs)), F.lit(0))


def _generic(df: DataFrame, adaptations: bool, limit: int) -> DataFrame:
    """Rank sentences of the best document, drop noise and repeats, cite titles."""
    cur = F.col("current_ns")
    asks_application = X.contains_any(cur, V.APPLICATION_TERMS)
    new_hire = X.contains_any(cur, V.ANNUAL_LEAVE_TERMS) & X.contains_any(cur, V.NEW_HIRE_TERMS)

    def score(f: Column, rules: Column) -> Column:
        s = f["text"]
        codes = X.once(
            F.lower(s),
            lambda low: F.size(F.filter("answer_tokens", lambda t: t.rlike(r"^[\x00-\x7f]*$") & low.contains(t))),
        )
        total = (
            overlap(F.col("answer_tokens"), X.tokens(s))
            + codes * 2
            + F.lit(1.0) / (f["rank"] + f["position"] + 1)
        )
        if adaptations:
            total = total + rules_bonus(rules, s)
            intent = F.lit(0)
            for terms, weight in reversed(R.APPLICATION_BONUS):
                intent = F.when(X.contains_any(X.no_spaces(s), terms), weight).otherwise(intent)
            total = total + F.when(asks_application, intent).otherwise(0)
            prorated = X.contains_any(s, ("新入职", "新员工")) & X.contains_any(s, ("折算", "平台"))
            total = total + F.when(new_hire & prorated, 8).otherwise(0)
        return total

    ordered = F.array_sort(
        X.once(
            phrase_rules(F.col("question")),
            lambda rules: F.transform(
                F.filter("facts", lambda f: ~f["noise"]),
                lambda f: F.struct(
                    (-score(f, rules)).alias("order"),
                    f["rank"].alias("rank"),
                    f["position"].alias("position"),
                    f["title"].alias("title"),
                    f["text"].alias("text"),
                ),
            ),
        )
    )
    allowed = F.lit(limit)
    if adaptations:
        title_question = F.col("question_ns").contains("发票") & F.col("question_ns").contains("抬头")
        allowed = F.when(title_question, 2).otherwise(allowed)
    ranked = df.withColumn("answer_tokens", F.col("all_tokens")).withColumn("ordered", ordered)
    chosen = distinct_fact_positions(F.transform("ordered", lambda f: f["text"]), allowed, exact=True)
    picked = ranked.withColumn("_chosen", chosen).withColumn("selected", pick(F.col("ordered"), F.col("_chosen")))
    titles = F.array_distinct(F.transform("selected", lambda f: f["title"]))
    answer = F.concat(
        F.lit(R.GENERIC_ANSWER_PREFIX),
        F.array_join(titles, "、"),
        F.lit(R.GENERIC_ANSWER_INFIX),
        _bullets(F.transform("selected", lambda f: X.clean_sentence(f["text"]))),
        F.lit(R.GENERIC_ANSWER_SUFFIX),
    )
    return picked.withColumn(
        "generic_answer", F.when(F.size("selected") > 0, answer).otherwise(F.lit(V.INSUFFICIENT_ANSWER))
    )


def compose_local(df: DataFrame, adaptations: bool = True, max_sentences: int = 3) -> DataFrame:
    """Add ``local_answer`` and ``composer`` to gated rows.

    Rows without a best document get the refusal text. With adaptations off
    only the generic selection is used.
    """
    facts = add_sentences(df)
    out = _generic(facts, adaptations, max_sentences)
    if adaptations:
        candidates = out.withColumn("_leave", _personal_leave_candidates())
        out = candidates.withColumn("_leave_pos", distinct_fact_positions(F.col("_leave"), F.lit(0))).withColumn(
            "leave_facts", pick(F.col("_leave"), F.col("_leave_pos"))
        )
        first, early = F.lit(0), F.lit(R.BEFORE_PERSONAL_LEAVE)
        late = F.coalesce(F.col("_w.no"), F.lit(len(R.COMPOSERS)))
        out = (
            out.withColumn("guards", _guards())
            .withColumn("_w", _worded())
            .withColumn("_t1", F.when(late > first, _new_employee_leave()))
            .withColumn("_t2", F.coalesce("_t1", F.when(late > early, _personal_leave())))
            .withColumn(
                "_pos", distinct_fact_positions(F.col("_w.lines"), F.coalesce(F.col("_w.limit"), F.lit(0)))
            )
        )
        lines = F.when(F.col("_w.distinct"), pick(F.col("_w.lines"), F.col("_pos"))).otherwise(F.col("_w.lines"))
        worded = F.coalesce(
            F.col("_t2"), F.concat(F.col("_w.header"), F.lit("\n"), _bullets(lines))
        )
    else:
        worded = F.lit(None).cast("string")
    refused = F.col("best_document").isNull()
    return (
        out.withColumn("_worded", worded)
        .withColumn(
            "local_answer",
            F.when(refused, F.lit(V.INSUFFICIENT_ANSWER)).otherwise(F.coalesce("_worded", "generic_answer")),
        )
        .withColumn(
            "composer",
            F.when(refused, F.lit("refusal"))
            .when(F.col("_worded").isNotNull(), F.lit("worded"))
            .otherwise(F.lit("generic")),
        )
        .drop(
            "_worded", "_w", "guards", "_t1", "_t2", "_pos", "_leave", "_leave_pos", "leave_facts",
            "generic_answer", "ordered", "_chosen", "answer_tokens", "in_order", "invoice_policy",
        )
    )
