"""Conversation context, routing and batch answering."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight.functions import text as X
from sourcelight.operators.compose import compose_local
from sourcelight.operators.evidence import current_question, filter_sources, gate, is_drafting_question
from sourcelight.operators.retrieval import collect_results, hybrid
from sourcelight.rules import evidence_rules as R
from sourcelight.rules import vocabulary as V
from sourcelight.session import stored
from sourcelight.settings import DEFAULT_SETTINGS, Settings

STRETCH = 1024  # turns per stretch of a conversation

# --- history ----------------------------------------------------------------


def recent_history(messages: DataFrame, limit: int = 8) -> DataFrame:
    """Last ``limit`` messages of a conversation, then visible non-blank ones.

    The cut comes before the filter. Input: (conv_id, turn, role, text).
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return last.where(F.col("role").isin("user", "assistant") & (X.strip(F.col("text")) != "")).drop("_n")


def _stretches(messages: DataFrame) -> DataFrame:
    """Cut conversations into stretches of turns, so a long one is not one task.

    Neighbours are found inside a stretch; one summary row per stretch (see
    ``_edges``) supplies those across its ends.
    """
    return messages.withColumn("_s", F.floor(F.col("turn") / STRETCH))


def _asked() -> Column:
    return F.when((F.col("role") == "user") & (X.strip(F.col("text")) != ""), X.strip(F.col("text")))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """User turns beside the assistant turn right after them, oldest first.

    A message that is not part of a pair stands alone.
    """
    rows = _stretches(messages.select("conv_id", "turn", "role", "text"))
    inside = Window.partitionBy("conv_id", "_s").orderBy("turn")
    across = Window.partitionBy("conv_id").orderBy("_s")
    edges = (
        rows.groupBy("conv_id", "_s")
        .agg(F.min_by(F.struct("role", "text"), "turn").alias("_first"), F.max_by("role", "turn").alias("_last"))
        .select(
            "conv_id",
            "_s",
            F.lead("_first").over(across).alias("_after"),
            F.lag("_last").over(across).alias("_prior"),
        )
    )
    seen = (
        rows.withColumn("_next", F.lead(F.struct("role", "text")).over(inside))
        .withColumn("_before", F.lag("role").over(inside))
        .join(edges, ["conv_id", "_s"])
        .withColumn("_next", F.coalesce("_next", "_after"))
        .withColumn("_before", F.coalesce("_before", "_prior"))
    )
    answers = (F.col("role") == "assistant") & F.col("_before").eqNullSafe("user")
    paired = (F.col("role") == "user") & F.col("_next.role").eqNullSafe("assistant")
    return seen.where(~answers).select(
        "conv_id", "turn", "role", F.col("text").alias("message"), F.when(paired, F.col("_next.text")).alias("reply")
    )


def previous_question(messages: DataFrame) -> DataFrame:
    """Add ``previous``: the latest earlier non-blank user message."""
    rows = _stretches(messages).withColumn("_asked", _asked())
    inside = Window.partitionBy("conv_id", "_s").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.where(F.col("_asked").isNotNull())
        .groupBy("conv_id", "_s")
        .agg(F.max_by("_asked", "turn").alias("_latest"))
    )
    # Stretches without a question still need the one carried into them.
    edges = (
        rows.groupBy("conv_id", "_s")
        .agg(F.max(F.lit(1)).alias("_one"))
        .join(carried, ["conv_id", "_s"], "left")
        .select("conv_id", "_s", F.last("_latest", ignorenulls=True).over(across).alias("_carry"))
    )
    return (
        rows.withColumn("_own", F.last("_asked", ignorenulls=True).over(inside))
        .join(edges, ["conv_id", "_s"])
        .withColumn("previous", F.coalesce("_own", "_carry"))
        .drop("_s", "_asked", "_own", "_carry")
    )


def is_follow_up(q: Column, vocabulary: V.Vocabulary = V.DEFAULT_VOCABULARY) -> Column:
    """Explicit follow-up wording, a bare duration, or a short topic-free text."""
    plain = F.replace(F.replace(q, F.lit("，"), F.lit("")), F.lit("。"), F.lit(""))
    duration = plain.rlike(rf"\A(?:{vocabulary.duration_pattern})\z")
    topics = F.array_except(
        X.tokens(X.normalize_text(q)), X.literal_array(vocabulary.weak + vocabulary.generic)
    )
    short = (F.length(q) <= vocabulary.short_question) & (F.size(topics) == 0)
    return X.starts_with_any(q, vocabulary.follow_up_prefixes) | short | duration


def contextualize(
    q: Column, previous: Column, vocabulary: V.Vocabulary = V.DEFAULT_VOCABULARY
) -> Column:
    """Prefix the previous question where the current one depends on it."""
    clean = X.strip(q)
    inherits = (
        (clean != "")
        & (F.coalesce(previous, F.lit("")) != "")
        & (previous != clean)
        & is_follow_up(clean, vocabulary)
    )
    joined = F.concat(F.lit(V.PREVIOUS_MARK), previous, F.lit("\n" + V.FOLLOW_UP_MARK), clean)
    return F.when(inherits, joined).otherwise(clean)


# --- routing ----------------------------------------------------------------


def route(q: Column, vocabulary: V.Vocabulary = V.DEFAULT_VOCABULARY) -> Column:
    squeezed = X.compact(F.lower(q))
    return (
        F.when(X.strip(q) == "", F.lit("invalid"))
        .when(X.contains_any(squeezed, vocabulary.catalog), F.lit("catalog"))
        .when(X.contains_any(squeezed, vocabulary.project_meta), F.lit("project_meta"))
        .otherwise(F.lit("retrieval"))
    )


def retrieval_question(q: Column) -> Column:
    """Query text for search: drafting-stage questions use a fixed wording."""
    return F.when(is_drafting_question(current_question(q)), F.lit(V.DRAFTING_QUERY)).otherwise(q)


def adaptive_top_k(q: Column, settings: Settings = DEFAULT_SETTINGS) -> Column:
    deep = max(settings.answer_top_k, settings.follow_up_top_k)
    base = max(settings.answer_top_k, 10)
    return F.when(q.contains(V.FOLLOW_UP_MARK), F.lit(deep)).otherwise(F.lit(base))


# --- answering ----------------------------------------------------------------


def catalog_titles(documents: DataFrame) -> DataFrame:
    """Distinct titles of ready documents with the first file that has each."""
    ready = documents.where((F.col("status") == "ready") & (F.col("title") != ""))
    return ready.groupBy("title").agg(F.min("source_path").alias("first"))


def catalog_lines(documents: DataFrame) -> DataFrame:
    """The catalogue as rows (number, line) in corpus order; number 0 is the heading.

    Titles are sorted in ranges and numbered by the ranges' sizes, one row per
    range, so no list of all titles is ever held in one place.
    """
    titles = stored(
        catalog_titles(documents).repartitionByRange("first", "title").sortWithinPartitions("first", "title")
        .withColumn("_row", F.monotonically_increasing_id()),
        label="titles",
    )
    part = F.shiftright("_row", 33)
    sizes = titles.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    line = Window.orderBy("_part")  # one row per range
    shift = (F.sum("_n").over(line) - F.col("_n") - F.col("_first") + 1).alias("_shift")
    offsets = sizes.select("_part", shift)
    numbered = titles.join(offsets, part == F.col("_part")).withColumn("number", F.col("_row") + F.col("_shift"))
    lines = numbered.select("number", F.concat(F.col("number").cast("string"), F.lit(". "), "title").alias("line"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    heading = F.concat(F.lit("知识库当前收录 "), F.col("n").cast("string"), F.lit(" 份文档："))
    empty = F.lit("知识库当前还没有可用文档。")
    head = total.select(
        F.lit(0).cast("bigint").alias("number"), F.when(F.col("n") > 0, heading).otherwise(empty).alias("line")
    )
    return head.unionByName(lines)


def catalog_answer(documents: DataFrame) -> DataFrame:
    """The catalogue as the one text that a person who asks for it reads."""
    listed = catalog_titles(documents).agg(F.array_sort(F.collect_list(F.struct("first", "title"))).alias("t"))
    numbered = F.transform("t", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["title"]))
    text = F.concat(
        F.lit("知识库当前收录 "), F.size("t").cast("string"), F.lit(" 份文档："), F.array_join(numbered, "；"), F.lit("。")
    )
    return listed.select(F.when(F.size("t") > 0, text).otherwise(F.lit("知识库当前还没有可用文档。")).alias("answer"))


def ask(
    chunks: DataFrame,
    documents: DataFrame,
    questions: DataFrame,
    settings: Settings = DEFAULT_SETTINGS,
    vocabulary: V.Vocabulary = V.DEFAULT_VOCABULARY,
    generate: Callable[[str], str] | None = None,
    extractive: bool = True,
    embed: Callable | None = None,
    rerank: Callable | None = None,
) -> DataFrame:
    """Answer a batch of questions (query_id, question[, previous]).

    Output: query_id, question, route, answer, answer_mode, evidence flags and
    the source chunks. ``generate`` is an optional model called per question
    with a prompt; without it, ``extractive`` answers come from the sources, or
    the service is reported unavailable.
    """
    previous = F.col("previous") if "previous" in questions.columns else F.lit(None).cast("string")
    asked = questions.select(
        "query_id", contextualize(F.col("question"), previous, vocabulary).alias("question")
    ).withColumn("route", route(F.col("question"), vocabulary))
    searched = asked.where(F.col("route") == "retrieval").select(
        "query_id",
        retrieval_question(F.col("question")).alias("question"),
        adaptive_top_k(F.col("question"), settings).alias("top_k"),
    )
    rows = hybrid(chunks, searched, settings, embed=embed, rerank=rerank)
    results = collect_results(rows).join(
        rows.groupBy("query_id").agg(
            F.max("vector_error").alias("vector_error"), F.max("rerank_error").alias("rerank_error")
        ),
        "query_id",
    )
    joined = asked.join(results, "query_id", "left").withColumn(
        "results", F.coalesce("results", F.array().cast(results.schema["results"].dataType))
    )
    gated = gate(joined, vocabulary, settings.adaptations)
    sufficient = F.col("best_document").isNotNull()
    own = F.filter("results", lambda r: r["document_id"] == F.col("best_document"))
    scoped = filter_sources(
        gated.withColumn("results", F.when(sufficient, own).otherwise(F.slice("results", 1, 0)))
    )
    composed = compose_local(scoped, settings.adaptations)
    if generate is not None:
        composed = _generated(composed, generate)
        mode = F.col("_g.mode")
        text = F.when(mode == "model", keep_leave_wording(F.col("_g.text"))).otherwise(F.col("_g.text"))
    elif extractive:
        mode, text = F.lit("extractive"), F.col("local_answer")
    else:
        mode, text = F.lit("unavailable"), F.lit(V.MODEL_UNAVAILABLE_ANSWER)
    # The listing is one long text, so it is only built when somebody asks for it.
    if asked.where(F.col("route") == "catalog").take(1):
        catalog = catalog_answer(documents).select(F.col("answer").alias("_catalog"), F.lit("catalog").alias("route"))
        composed = composed.join(catalog, "route", "left")
    else:
        composed = composed.withColumn("_catalog", F.lit(None).cast("string"))
    answer = (
        F.when(F.col("route") == "invalid", F.lit(V.EMPTY_QUESTION_ANSWER))
        .when(F.col("route") == "project_meta", F.lit(V.PROJECT_META_ANSWER))
        .when(F.col("route") == "catalog", F.col("_catalog"))
        .when(~sufficient, F.lit(V.INSUFFICIENT_ANSWER))
        .otherwise(text)
    )
    return composed.select(
        "query_id",
        "question",
        "route",
        answer.alias("answer"),
        F.when(F.col("route") != "retrieval", F.lit("direct"))
        .when(~sufficient, F.lit("refusal"))
        .otherwise(mode)
        .alias("answer_mode"),
        sufficient.alias("evidence_sufficient"),
        "best_document",
        "composer",
        F.size("results").alias("retrieved_count"),
        "results",
        F.coalesce("vector_error", F.lit("")).alias("vector_error"),
        F.coalesce("rerank_error", F.lit("")).alias("rerank_error"),
        F.lit(V.PROMPT_VERSION).alias("prompt_version"),
    )


def keep_leave_wording(answer: Column) -> Column:
    """Restore the second-calendar-year rule in a generated leave answer.

    Reads ``question``, ``current`` and ``results`` of a gated row.
    """
    source = F.array_join(F.transform("results", lambda r: r["content"]), "\n")
    ruled = source.contains(R.SECOND_YEAR_CLAUSE)
    current = F.replace(F.replace(F.col("current"), F.lit("，"), F.lit("")), F.lit("。"), F.lit(""))
    duration = F.regexp_extract(current, R.EMPLOYMENT_DURATION, 1)
    fixed = answer
    for pattern, wording in R.SECOND_YEAR_REWRITES:
        fixed = F.regexp_replace(fixed, pattern, wording)
    before, after = R.SECOND_YEAR_DURATION
    plain = ~X.contains_any(F.col("current"), R.DETAIL_TERMS) & X.contains_any(F.col("current"), V.ANNUAL_LEAVE_TERMS)
    return (
        F.when(
            ruled & (duration != "") & X.contains_any(F.col("question"), V.ANNUAL_LEAVE_TERMS),
            F.concat(F.lit(before), duration, F.lit(after)),
        )
        .when(ruled & plain, F.lit(R.SECOND_YEAR_SHORT))
        .when(ruled, fixed)
        .otherwise(answer)
    )


def check_requests(questions: DataFrame) -> DataFrame:
    """Questions with the length limit enforced; a longer one is an error."""
    too_long = F.raise_error(F.lit(f"a question has at most {V.QUESTION_LIMIT} characters")).cast("string")
    return questions.withColumn(
        "question", F.when(F.length("question") <= V.QUESTION_LIMIT, F.col("question")).otherwise(too_long)
    )


def check_history(messages: DataFrame) -> DataFrame:
    """History messages with a known role and 1 to ``MESSAGE_LIMIT`` characters."""
    valid = F.col("role").isin("user", "assistant") & F.length("text").between(1, V.MESSAGE_LIMIT)
    return messages.withColumn(
        "text",
        F.when(valid, F.col("text")).otherwise(F.raise_error(F.lit("invalid history message")).cast("string")),
    )


def _generated(df: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """Call the model once per answerable question and check its qualifiers.

    A worded composer is the only fact scope of the prompt. An answer that
    changes how often the scope's qualifier occurs is replaced by the facts; a
    failing model reports the service as unavailable.
    """
    strict = F.col("composer") == "worded"
    context = F.array_join(
        F.transform(
            "results",
            lambda r, i: F.concat(
                F.lit("[来源 "), (i + 1).cast("string"), F.lit("] 文档："), r["title"],
                F.lit("\n章节："), r["section"], F.lit("\n原文："), r["content"],
            ),
        ),
        "\n\n",
    )
    prompt = F.when(
        strict, F.concat(F.lit("员工问题："), F.col("question"), F.lit("\n\n事实范围：\n"), F.col("local_answer"))
    ).otherwise(F.concat(F.lit("员工问题："), F.col("question"), F.lit("\n\n制度原文：\n"), context))
    schema = T.StructType([T.StructField("mode", T.StringType()), T.StructField("text", T.StringType())])

    @F.pandas_udf(schema)
    def call(wanted: pd.Series, prompts: pd.Series, strict: pd.Series, facts: pd.Series) -> pd.DataFrame:
        out = []
        for ask_model, text, scoped, fact in zip(wanted, prompts, strict, facts):
            if not ask_model:
                out.append(("refusal", ""))
                continue
            try:
                reply = (generate(text) or "").strip()
                if not reply:
                    raise RuntimeError("the model returned no answer")
            except Exception:
                out.append(("unavailable", V.MODEL_UNAVAILABLE_ANSWER))
                continue
            if scoped and reply.count(V.QUALIFIER) != fact.count(V.QUALIFIER):
                out.append(("source_facts", V.SOURCE_FACTS_PREFIX + fact))
            else:
                out.append(("model", reply))
        return pd.DataFrame(out, columns=["mode", "text"])

    return df.withColumn(
        "_g", call(F.col("best_document").isNotNull(), prompt, strict, F.coalesce("local_answer", F.lit("")))
    )
