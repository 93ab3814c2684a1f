"""Registered queries over the given tables, one per operator or chain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelight.functions import html
from sourcelight.functions import text as X
from sourcelight.functions.hashing import feature_positions, hash_vectors
from sourcelight.operators import (
    access, catalog, cells, chunking, clauses, compose, conversation, evaluation, evidence, feedback, lexical, news,
    postings, retrieval, vectors,
)
from sourcelight.plans import agreements, corpus, policies, rendered
from sourcelight.rules import clauses as CL
from sourcelight.rules.vocabulary import LATIN_VOCABULARY
from sourcelight.settings import Settings
from sourcelight.sources.files import fingerprint

Query = Callable[[SparkSession, str], DataFrame]
TOP_K = 10
LATIN = Settings(adaptations=False)
VAGUE_LATIN = ("and", "que")

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- text and chunks ----------------------------------------------------------------


@query
def normalize_docs(spark, sf):
    docs = corpus.documents(spark, sf)
    return docs.select(
        "document_id",
        X.content_version(F.col("content")).alias("version"),
        F.length("content").alias("n_chars"),
        F.size(F.split("content", "\n", -1)).alias("n_lines"),
    )


@query
def doc_metadata(spark, sf):
    docs = corpus.documents(spark, sf)
    return docs.select(
        "document_id",
        "title",
        X.infer_category(F.col("source_path")).alias("category"),
        X.source_type(F.col("source_path")).alias("source_type"),
        F.size(X.section_titles(F.col("content"))).alias("section_count"),
        X.is_catalog(F.col("content")).alias("is_catalog"),
        X.preview(F.col("content")).alias("preview"),
        *[v.alias(k) for k, v in X.policy_metadata(F.col("content")).items()],
    )


@query
def token_counts(spark, sf):
    docs = lexical.with_tokens(corpus.documents(spark, sf))
    return docs.select(
        "document_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_terms")
    )


@query
def term_frequencies(spark, sf):
    return lexical.term_frequencies(lexical.with_tokens(corpus.documents(spark, sf)), "document_id")


@query
def term_df_idf(spark, sf):
    docs = lexical.with_tokens(corpus.documents(spark, sf)).select("tokens")
    n = corpus.table(spark, sf, "documents").count()
    return lexical.document_frequencies(docs).select(
        "term", "df", F.round(lexical.idf(F.lit(float(n)), F.col("df")), 6).alias("idf")
    )


@query
def doc_lengths(spark, sf):
    size = lexical.corpus_size(lexical.with_tokens(corpus.documents(spark, sf)))
    return size.select("n", F.round("avg_len", 6).alias("avg_len"))


@query
def sentences(spark, sf):
    docs = corpus.documents(spark, sf).select("document_id", "content")
    return chunking.explode_sentences(docs)


@query
def sentence_features(spark, sf):
    docs = corpus.documents(spark, sf).select("document_id", "content")
    s = F.col("sentence")
    return chunking.explode_sentences(docs).select(
        "document_id",
        "position",
        X.clean_sentence(s).alias("cleaned"),
        X.fact_key(s).alias("fact_key"),
        X.non_policy_sentence(s).alias("noise"),
    )


@query
def chunks(spark, sf):
    return corpus.chunks(spark, sf).select("chunk_id", "document_id", "chunk_index", "section", "content")


@query
def chunk_counts(spark, sf):
    return catalog.chunk_counts(corpus.chunks(spark, sf))


@query
def doc_catalog(spark, sf):
    docs = corpus.documents(spark, sf)
    return catalog.document_summaries(docs, chunking.split_documents(docs)).select(
        "document_id", "title", "category", "source_path", "status", "section_count", "chunk_count"
    )


@query
def catalog_answer(spark, sf):
    """Lists distinct titles; here the sources stand in for document titles."""
    docs = corpus.documents(spark, sf).withColumn("title", F.col("department"))
    return conversation.catalog_lines(docs)


@query
def corpus_status(spark, sf):
    docs = corpus.documents(spark, sf).withColumn("error", F.when(F.col("status") != "ready", "empty").otherwise(""))
    return catalog.status(docs, chunking.split_documents(docs))


@query
def corpus_fingerprint(spark, sf):
    files = corpus.table(spark, sf, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    return fingerprint(files, "1:500:80:hash:384")


# --- retrieval ------------------------------------------------------------------------


def _legs(spark, sf, settings=LATIN):
    asked = retrieval.prepare_questions(corpus.questions(spark, sf))
    return retrieval.search_legs(corpus.chunks(spark, sf), asked, TOP_K, settings)[0]


@query
def bm25_topk(spark, sf):
    found = _legs(spark, sf, Settings(vector_mode="none"))
    return found.select("query_id", "rank", "chunk_id", "score")


@query
def bm25_join_topk(spark, sf):
    """The same ranking with every list of the question terms opened."""
    index = retrieval.build_search_index(corpus.chunks(spark, sf))
    asked = retrieval.prepare_questions(corpus.questions(spark, sf))
    return postings.bm25_join(index.lexical, asked, TOP_K).select("query_id", "rank", "chunk_id", "score")


@query
def hash_embed(spark, sf):
    """Figures of the feature-hash vectors that fix their values."""
    docs = corpus.documents(spark, sf).select("document_id", "content")
    vectors_ = hash_vectors(docs, LATIN.hash_dim)
    value = lambda x: x.cast("double")
    return vectors_.select(
        "document_id",
        F.size(F.filter("vector", lambda x: x != 0)).alias("nonzero"),
        F.round(
            F.aggregate(
                F.transform("vector", lambda x, i: value(x) * (i + 1)), F.lit(0.0), lambda a, x: a + x
            ),
            2,
        ).alias("weighted"),
    )


@query
def hash_features(spark, sf):
    """Position and sign of every distinct term, with built-in functions only."""
    terms = (
        lexical.with_tokens(corpus.documents(spark, sf))
        .select(F.explode(F.array_distinct("tokens")).alias("term"))
        .distinct()
    )
    position, sign = feature_positions(F.col("term"), LATIN.hash_dim)
    return terms.select("term", position.alias("position"), sign.alias("sign"))


def _centroids(vecs: DataFrame) -> DataFrame:
    """Mean vector per label; partial sums per (label, position) before the shuffle."""
    return (
        vecs.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
    )


def _vector_table(spark, sf):
    vecs = corpus.table(spark, sf, "embeddings")
    return vecs.select(
        F.format_string("%012d", "vec_id").alias("document_id"),
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.lit(0).alias("chunk_index"),
        vectors.checked(F.col("embedding"), 64).alias("vector"),
        "label",
    )


@query
def vector_topk(spark, sf):
    """Nearest vectors to each label's mean vector."""
    table = _vector_table(spark, sf)
    asked = _centroids(corpus.table(spark, sf, "embeddings")).withColumnRenamed("label", "query_id")
    return vectors.block_top_k(table, asked, TOP_K, LATIN).select("query_id", "rank", "chunk_id", "score")


@query
def vector_grid_topk(spark, sf):
    """The same search over stored cells, those out of reach skipped."""
    table = _vector_table(spark, sf).drop("label")
    asked = _centroids(corpus.table(spark, sf, "embeddings")).withColumnRenamed("label", "query_id")
    found = cells.cell_search(cells.build_cells(table), asked, TOP_K).rows
    return found.select("query_id", "rank", "chunk_id", "score")


@query
def vector_norms(spark, sf):
    vecs = corpus.table(spark, sf, "embeddings").withColumn("unit", vectors.normalize(F.col("embedding")))
    return vecs.select(
        "vec_id",
        vectors.finite(F.col("embedding")).alias("finite"),
        F.round(vectors.inner_product(F.col("unit"), F.col("unit")), 6).alias("norm2"),
        F.round(F.get("unit", F.lit(0)), 6).alias("first"),
    )


@query
def rrf_fusion(spark, sf):
    """Fusion of three rankings of the documents per language: length, quality (labelled ones), id."""
    docs = corpus.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    quality = corpus.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    rated = docs.join(quality, "doc_id")

    def ranking(list_id: int, rows: DataFrame, *order):
        w = Window.partitionBy("lang").orderBy(*order)
        return rows.select(
            F.col("lang").alias("query_id"),
            F.lit(list_id).alias("list_id"),
            F.format_string("%012d", "doc_id").alias("item_id"),
            F.row_number().over(w).alias("rank"),
        )

    lists = (
        ranking(1, docs, F.desc("n_chars"), "doc_id")
        .unionByName(ranking(2, rated, F.desc("quality"), F.asc("toxic"), "doc_id"))
        .unionByName(ranking(3, docs, "doc_id"))
    )
    return retrieval.reciprocal_rank_fusion(lists, 60)


def _hybrid(spark, sf, k=TOP_K):
    return retrieval.hybrid(corpus.chunks(spark, sf), corpus.questions(spark, sf), LATIN, top_k=k)


@query
def hybrid_topk(spark, sf):
    return _hybrid(spark, sf).select(
        "query_id", "rank", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), "vector_score", "bm25_score"
    )


@query
def answer_sources(spark, sf):
    shown = retrieval.format_sources(_hybrid(spark, sf, 5))
    return shown.select("query_id", "rank", "title", "section", "source_path", "source_type", "content_preview")


@query
def unique_sources(spark, sf):
    return evaluation.unique_sources(_hybrid(spark, sf))


# --- evidence and answers -----------------------------------------------------------------


def _gated(spark, sf):
    rows = _hybrid(spark, sf)
    results = retrieval.collect_results(rows)
    asked = corpus.questions(spark, sf).join(results, "query_id", "left")
    empty = F.array().cast(results.schema["results"].dataType)
    return rows, evidence.gate(
        asked.withColumn("results", F.coalesce("results", empty)), LATIN_VOCABULARY, adaptations=False
    )


@query
def evidence_gate(spark, sf):
    _, gated = _gated(spark, sf)
    return gated.select(
        "query_id",
        F.size("query_tokens").alias("n_tokens"),
        F.size("topic_tokens").alias("n_topics"),
        "threshold",
        "needed_topics",
        "best_document",
        "evidence_score",
    )


@query
def answer_facts(spark, sf):
    """Ranked candidate sentences of the best document behind each answer."""
    _, gated = _gated(spark, sf)
    # The outer form keeps the optimizer from repeating the facts in a size filter.
    facts = compose.add_sentences(gated).select(
        "query_id", "all_tokens", F.explode_outer("facts").alias("f")
    )
    s = F.col("f.text")
    low = F.lower(s)
    codes = F.size(F.filter("all_tokens", lambda t: low.contains(t)))
    score = (
        evidence.overlap(F.col("all_tokens"), X.tokens(s)) + codes * 2
        + F.lit(1.0) / (F.col("f.rank") + F.col("f.position") + 1)
    )
    return facts.where(~F.col("f.noise")).select(
        "query_id", F.col("f.rank").alias("rank"), F.col("f.position").alias("position"), s.alias("sentence"),
        F.round(score, 6).alias("score"),
    )


@query
def extractive_answer(spark, sf):
    """Composed answers; the near-duplicate ratio has no SQL form."""
    _, gated = _gated(spark, sf)
    return compose.compose_local(gated, adaptations=False).select("query_id", "composer", "local_answer")


@query
def assistant_answers(spark, sf):
    """The whole question path: context, route, search, gate, sources, answer."""
    docs = corpus.documents(spark, sf)
    return conversation.ask(
        chunking.split_documents(docs), docs, corpus.questions(spark, sf), LATIN, LATIN_VOCABULARY
    ).select("query_id", "route", "answer_mode", "answer", "retrieved_count")


@query
def repeated_facts(spark, sf):
    """Sentences whose exact fact key occurs in several documents."""
    docs = corpus.documents(spark, sf).select("document_id", "content")
    return (
        chunking.explode_sentences(docs)
        .select("document_id", X.fact_key(F.col("sentence")).alias("fact_key"))
        .groupBy("fact_key")
        .agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("n_docs"))
        .where(F.col("n_docs") > 1)
    )


# --- evaluation --------------------------------------------------------------------------------


def _cases(spark, sf):
    """Benchmark passages as cases: answerable where a document holds the passage."""
    held = evaluation.containing_documents(corpus.documents(spark, sf), corpus.questions(spark, sf))
    first = held.groupBy("query_id").agg(F.min("source_path").alias("expected_source"))
    return (
        corpus.questions(spark, sf)
        .join(first, "query_id", "left")
        .select(
            F.col("query_id").alias("case_id"),
            "question",
            F.coalesce("expected_source", F.lit("")).alias("expected_source"),
            F.array_distinct(X.tokens(X.normalize_text(F.col("question")))).alias("expected_keywords"),
            F.col("expected_source").isNull().alias("should_refuse"),
        )
    )


def _case_rows(spark, sf):
    rows, gated = _gated(spark, sf)
    return evaluation.evaluate_cases(_cases(spark, sf), rows, corpus.documents(spark, sf), gated)


@query
def expected_documents(spark, sf):
    return evaluation.containing_documents(corpus.documents(spark, sf), corpus.questions(spark, sf))


@query
def eval_rank(spark, sf):
    return _case_rows(spark, sf).select(
        "case_id", "expected_source", "should_refuse", "refusal_correct", "rank", "hit_at_1", "hit_at_3",
        F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "failure_type",
        F.size("keyword_hits").alias("n_keyword_hits"), F.size("ranked_sources").alias("n_sources"),
    )


@query
def eval_metrics(spark, sf):
    return evaluation.summarize(_case_rows(spark, sf))


@query
def latency_percentiles(spark, sf):
    return evaluation.latency_percentiles(corpus.table(spark, sf, "events"), "value", "event_type")


def _quality_rows(spark, sf, adaptations):
    """Assistant turns as answers to judge: the short words of the user's message are the keywords."""
    pairs = conversation.turn_pairs(corpus.table(spark, sf, "conversations")).where(F.col("role") == "user")
    key = F.format_string("%d-%d", "conv_id", "turn")
    words = X.tokens(X.normalize_text(F.col("message")))
    expected = F.when(F.col("turn") % 4 == 0, "answer").otherwise("refusal")

    def side(n, vary):
        return F.struct(expected.alias("expected"), F.filter(words, lambda w: F.length(w) <= n).alias("keywords"), vary.alias("may_vary"))

    cases = pairs.select(
        key.alias("case_id"),
        F.col("message").alias("question"),
        side(2, F.lit(False)).alias("with_adaptation"),
        side(3, F.col("reply").isNull()).alias("without_adaptation"),
        F.lit("").alias("notes"),
        F.coalesce("reply", F.lit("依据不足")).alias("answer"),
    )
    # The answers come from the same rows, so they are scored without a join.
    scored = evaluation.answer_quality_rows(cases.drop("answer"), cases.select("case_id", "answer"), adaptations)
    return scored


@query
def answer_quality_summary(spark, sf):
    both = _quality_rows(spark, sf, True).unionByName(_quality_rows(spark, sf, False))
    return evaluation.answer_quality_summary(both, "adaptation_enabled")


@query
def ablation_diff(spark, sf):
    return evaluation.ablation_diff(_quality_rows(spark, sf, True), _quality_rows(spark, sf, False), ["passed"])


# --- conversations ------------------------------------------------------------------------------


@query
def followup_context(spark, sf):
    seen = conversation.previous_question(corpus.table(spark, sf, "conversations")).where(F.col("role") == "user")
    return seen.select(
        "conv_id", "turn", conversation.contextualize(F.col("text"), F.col("previous"), LATIN_VOCABULARY).alias("question")
    )


@query
def turn_pairs(spark, sf):
    return conversation.turn_pairs(corpus.table(spark, sf, "conversations"))


@query
def recent_history(spark, sf):
    rows = conversation.recent_history(corpus.table(spark, sf, "conversations"), LATIN.history_limit)
    return rows.select("conv_id", "turn", "role", "text")


@query
def route_questions(spark, sf):
    asked = corpus.table(spark, sf, "conversations").where(F.col("role") == "user")
    words = replace(LATIN_VOCABULARY, catalog=("une", "the"), project_meta=("ion", "ung"))
    return asked.groupBy(conversation.route(F.col("text"), words).alias("route")).agg(
        F.count("*").alias("n")
    )


@query
def answer_display(spark, sf):
    replies = corpus.table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return replies.select(
        "conv_id", "turn", X.employee_answer(F.col("text")).alias("shown"),
        F.length(X.answer_html(F.col("text"))).alias("html_length"),
    )


# --- clauses ------------------------------------------------------------------------------------


def _contracts(spark, sf):
    return corpus.documents(spark, sf).select("document_id", "title", "content")


@query
def clause_locate(spark, sf):
    return clauses.extract_fields(_contracts(spark, sf), CL.LATIN_CLAUSES).select(
        "document_id", "field", "evidence", "status"
    )


@query
def review_counts(spark, sf):
    return clauses.review_counts(clauses.extract_fields(_contracts(spark, sf), CL.LATIN_CLAUSES))


@query
def review_prompts(spark, sf):
    fields = clauses.extract_fields(_contracts(spark, sf), CL.LATIN_CLAUSES)
    prompts = clauses.review_prompts(fields, VAGUE_LATIN)
    return prompts.groupBy("field", "severity").agg(F.count("*").alias("n"))


@query
def contract_fields(spark, sf):
    """The contract clause set over the whole table, counted per field and status."""
    fields = clauses.extract_fields(_contracts(spark, sf))
    return fields.groupBy("field", "status").agg(F.count("*").alias("n"))


@query
def review_reports(spark, sf):
    reviews = clauses.review(_contracts(spark, sf), CL.LATIN_CLAUSES)
    return clauses.export_review(reviews).select("document_id", X.content_version(F.col("report")).alias("report_hash"))


# --- access, feedback -----------------------------------------------------------------------------


def _acl(spark, sf):
    """One entry per source: its number decides the roles, some have none."""
    sources = corpus.table(spark, sf, "documents").select("source").distinct()
    n = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    roles = F.when(n % 3 == 0, F.array(F.lit("business"), F.lit("legal"))).when(
        n % 3 == 1, F.array(F.lit("employee"))
    )
    return sources.select(F.col("source").alias("department"), roles.alias("allowed_roles")).where(
        F.col("allowed_roles").isNotNull()
    )


def _restricted(spark, sf):
    acl = _acl(spark, sf).withColumnRenamed("department", "source_path")
    docs = corpus.documents(spark, sf)
    granted = access.attach_roles(
        docs.withColumn("_path", F.col("source_path")).withColumn("source_path", F.col("department")), acl
    )
    return granted.withColumn("source_path", F.col("_path")).drop("_path")


@query
def acl_visible(spark, sf):
    return access.list_contracts(_restricted(spark, sf), "business").select(
        "document_id", "status", F.array_join("allowed_roles", ",").alias("roles"), "document_version"
    )


@query
def acl_bm25(spark, sf):
    """Ranking over the documents one role may see; statistics come from them alone."""
    docs = access.visible_documents(_restricted(spark, sf), "business")
    own = chunking.split_documents(docs.drop("allowed_roles"))
    asked = retrieval.prepare_questions(corpus.questions(spark, sf))
    found, _ = retrieval.search_legs(own, asked, 5, Settings(vector_mode="none"))
    return found.select("query_id", "rank", "chunk_id", "score")


@query
def feedback_summary(spark, sf):
    """Quality labels as ratings, toxicity as the reason."""
    rows = corpus.table(spark, sf, "labels").select(
        F.when(F.col("quality") == 1, "up").otherwise("down").alias("rating"),
        F.when(F.col("quality") == 1, "").when(F.col("toxic") == 1, "未解决").otherwise("没有依据").alias("reason"),
    )
    return feedback.summarize_feedback(rows).select(
        "total", "up", "down", "unresolved", F.to_json("reasons").alias("reasons")
    )


# --- pages --------------------------------------------------------------------------------------


def _pages(spark, sf):
    return corpus.spread(corpus.table(spark, sf, "pages"))


@query
def page_text(spark, sf):
    plain = _pages(spark, sf).select("page_id", html.plain_text(F.col("html"), 0).alias("text"))
    return plain.select("page_id", "text", html.summary_of_plain(F.col("text")).alias("summary"))


@query
def page_host(spark, sf):
    return _pages(spark, sf).select(
        "page_id",
        html.host(F.col("url")).alias("host"),
        html.allowed_publisher(F.col("url")).alias("allowed"),
        html.source_type(F.col("url"), F.lit("")).alias("source_type"),
    )


def _page_title(c):
    return html.plain_text(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1), 150)


@query
def page_category(spark, sf):
    titled = _pages(spark, sf).select("page_id", _page_title(F.col("html")).alias("title"), html.summary(F.col("html")).alias("summary"))
    return titled.select(
        "page_id", "title", html.news_category(F.col("title"), F.col("summary"), F.lit("公司动态")).alias("category")
    )


@query
def page_links(spark, sf):
    links = news.page_links(_pages(spark, sf).select("page_id", "html"))
    return links.select("page_id", "link_no", "href", F.length("block").alias("n_chars"))


@query
def page_meta(spark, sf):
    return _pages(spark, sf).select(
        "page_id",
        F.size(html.meta_tags(F.col("html"))).alias("n_meta"),
        F.size(html.images(F.col("html"))).alias("n_images"),
    )


@query
def news_selection(spark, sf):
    """Pages as news: host is the source, the address suffix the region."""
    host = html.host(F.col("url"))
    items = _pages(spark, sf).select(
        F.col("page_id").alias("item_id"),
        _page_title(F.col("html")).alias("title"),
        F.format_string("2026-%02d-01", (F.col("page_id") % 12 + 1).cast("int")).alias("published"),
        host.alias("source"),
        F.when(host.endswith(".org"), "国内").otherwise("国际").alias("region"),
    )
    return news.select_news(items, reserved=("ththnt.example.com",)).select(
        "item_id", "position", "phase", "source"
    )


REGISTRY.update(rendered.QUERIES)
REGISTRY.update(policies.QUERIES)
REGISTRY.update(agreements.QUERIES)
