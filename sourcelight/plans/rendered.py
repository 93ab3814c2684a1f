"""Policy and contract texts rendered from the given tables, and their SQL twins.

The given texts hold no Chinese, so the rules for policy wording would never
leave their default branches on them. Here every row of a table becomes a short
text, its key choosing among a few wordings; the queries apply the real rules to
all of them, and the SQL states both the wording and the rules again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.functions import text as X
from sourcelight.operators import clauses, conversation, news
from sourcelight.plans import corpus
from sourcelight.rules import clauses as C
from sourcelight.rules import news as N
from sourcelight.rules import vocabulary as V

#: field -> wording that completes it, wording that does not; $x stands for a value of the order
EVIDENCE = {
    "term": ("计划开工日期：$y年$m月$d日，合同工期$n天", "合同期限按双方约定执行，编号$k"),
    "payment": ("付款节点：验收后$n日内支付$p元", "按第$n条付款，尽快办理"),
    "parties": ("甲方：$c\n乙方：供应商$k", "甲方：待填写；乙方：供应商$k"),
    "amount": ("含增值税：人民币$p元，不含增值税：$p元", "不含税价$p元，税率另计"),
    "banking": ("开户银行：建设银行第$n支行\n账号：622200$k", "开户银行：\n账号："),
    "insurance": ("承包人应投保工程险，保单号$k", "保险费由双方协商，编号$k"),
    "performance_bond": ("履约保证金为$p元，及时返还", "履约保证金另行约定"),
    "termination_renewal": ("任一方可提前$n日通知解除", "本条不适用，编号$k"),
    "variation_claims": ("变更须经书面确认，编号$k", "变更须经确认，编号$k"),
    "retention_warranty": ("质保金$n%在保修期满后返还", "质保金按规定返还"),
    "acceptance": ("验收标准为$n日内合格", "验收由甲方组织"),
    "liability": ("违约方赔偿损失$p元", "违约责任由双方承担"),
}
NUMBER = {c.key: i for i, c in enumerate(C.CONTRACT_CLAUSES)}
#: Questions besides those with a catalogue or project wording.
PLAIN_QUESTIONS = ("", "  ", "差旅费用在返程之后多久之内必须提交报销申请")


def _wording(template: str, values: dict[str, Column]) -> Column:
    parts = [template]
    for mark, value in values.items():
        parts = [q for p in parts for q in ([p] if not isinstance(p, str) else _cut(p, f"${mark}", value))]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _cut(text: str, mark: str, value: Column) -> list:
    pieces = text.split(mark)
    out: list = [pieces[0]]
    for piece in pieces[1:]:
        out += [value, piece]
    return out


def _chosen(number: Column, options: list[Column]) -> Column:
    out = options[-1]
    for i, option in enumerate(options[:-1]):
        out = F.when(number == i, option).otherwise(out)
    return out


def contract_evidence(spark, sf) -> DataFrame:
    """One row per order and clause: document_id, clause_no, field, evidence."""
    orders = corpus.table(spark, sf, "orders")
    names = corpus.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = orders.join(names, "o_custkey")
    text = lambda c: c.cast("string")
    values = {
        "y": text(F.year("o_orderdate")), "m": text(F.month("o_orderdate")), "d": text(F.dayofmonth("o_orderdate")),
        "n": text(F.col("o_custkey") % 90 + 1), "k": text(F.col("o_orderkey")),
        "p": text(F.floor("o_totalprice").cast("bigint")), "c": F.col("c_name"),
    }
    fields = F.array(
        *[
            F.struct(
                F.lit(i).alias("clause_no"), F.lit(field).alias("field"),
                _chosen((F.col("o_orderkey") + i) % 3, [_wording(t, values) for t in EVIDENCE[field]] + [F.lit("")]).alias("evidence"),
            )
            for field, i in NUMBER.items()
        ]
    )
    return rows.select(text(F.col("o_orderkey")).alias("document_id"), F.explode(fields).alias("f")).select("document_id", "f.*")


def contract_status(spark, sf) -> DataFrame:
    """Status, issue and prompt of every clause of every rendered contract."""
    label, focus = (X.literal_array([getattr(c, a) for c in C.CONTRACT_CLAUSES]) for a in ("label", "review_focus"))
    judged = (
        contract_evidence(spark, sf)
        .withColumn("status", clauses.status(F.col("field"), F.col("evidence")))
        .withColumn("issue", clauses.issue(F.col("field"), F.col("status")))
        .withColumn("label", F.get(label, F.col("clause_no")))
        .withColumn("review_focus", F.get(focus, F.col("clause_no")))
    )
    return judged.select(
        "document_id", "field", "status", "issue", clauses._prompt_message(C.VAGUE_TERMS).alias("message")
    )


def policy_questions(spark, sf) -> DataFrame:
    """A question per customer: c_custkey, question."""
    words = [*V.DEFAULT_VOCABULARY.catalog, *V.DEFAULT_VOCABULARY.project_meta]
    texts = [F.concat(F.lit("请问 "), F.lit(w), F.lit("，客户 "), "c_name") for w in words] + [F.lit(p) for p in PLAIN_QUESTIONS]
    number = (F.col("c_custkey") % len(texts)).cast("int")
    return corpus.table(spark, sf, "customer").select("c_custkey", _chosen(number, texts).alias("question"))


def route_policy(spark, sf) -> DataFrame:
    return policy_questions(spark, sf).select("c_custkey", conversation.route(F.col("question")).alias("route"))


def followup_policy(spark, sf) -> DataFrame:
    """Follow-up wording and durations inherit the previous question, a full question does not."""
    prefixes = V.DEFAULT_VOCABULARY.follow_up_prefixes
    texts = [F.concat(F.lit(p), F.lit("这一项制度的具体要求，客户"), "c_name") for p in prefixes]
    texts += [F.concat(F.lit("我刚入职"), (F.col("c_custkey") % 30 + 1).cast("string"), F.lit("个月")), F.lit(PLAIN_QUESTIONS[2])]
    asked = corpus.table(spark, sf, "customer").select(
        "c_custkey", _chosen((F.col("c_custkey") % len(texts)).cast("int"), texts).alias("q"),
        F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("客户"), "c_name", F.lit("的年假有多少天"))).alias("previous"),
    )
    return asked.select("c_custkey", conversation.contextualize(F.col("q"), F.col("previous")).alias("question"))


def policy_documents(spark, sf) -> DataFrame:
    """A Markdown policy, labelled policy or table of contents per part: p_partkey, source_path, content."""
    hints = [h for _, words in V.CATEGORY_HINTS for h in words] + ["其他"]
    key = F.col("p_partkey").cast("string")
    plain = F.concat(
        F.lit("# "), "p_name", F.lit("制度 \n版本：V"), F.col("p_size").cast("string"), F.lit("\n生效日期：2026-01-01\n责任部门：- "),
        "p_brand", F.lit("\n- 负责人：第"), key, F.lit("号\n## 适用范围\n正文。\n### 流程\n正文。\n##### 附则\n正文。"),
    )
    labelled = F.concat(F.lit("文档名称：* "), "p_name", F.lit(" *\n业务分类：分类"), key, F.lit("\n## 条款\n正文。"))
    catalog = F.concat(F.lit("目录\n第一章 总则\n第二章\n第三章\n1\n2\n"), F.when(F.col("p_size") > 25, "本页为目录。").otherwise("附则"))
    content = _chosen((F.col("p_partkey") % 3).cast("int"), [plain, labelled, catalog])
    name = F.get(X.literal_array(hints), (F.col("p_partkey") % len(hints)).cast("int"))
    return corpus.table(spark, sf, "part").select("p_partkey", F.concat(name, key, F.lit(".md")).alias("source_path"), content.alias("content"))


def policy_metadata(spark, sf) -> DataFrame:
    c = F.col("content")
    return policy_documents(spark, sf).select(
        "p_partkey", X.heading_title(c).alias("title"), F.array_join(X.section_titles(c), "|").alias("sections"),
        X.category(c, F.col("source_path")).alias("category"), X.is_catalog(c).alias("is_catalog"),
        *[v.alias(k) for k, v in X.policy_metadata(c).items()],
    )


def news_pages(spark, sf) -> DataFrame:
    """A publisher's page per page: page_id, url, html with four kinds of metadata."""
    pid = F.col("page_id").cast("string")
    sites = [*N.PUBLISHERS, "other.example"]
    site = F.get(X.literal_array(sites), (F.col("page_id") % len(sites)).cast("int"))
    kinds = [
        F.concat(
            F.lit('<meta property="og:image" content="/img/'), pid, F.lit('.png?a=1&amp;b=2"><META name="description" content="later">'),
            F.lit("<meta property='og:description' content='Text "), pid, F.lit(" &amp; more 阅读原文'>"),
        ),
        F.concat(
            F.lit("<meta name='twitter:image' content='https://cdn.example.com/logo.png'><img data-src='https://i.qbitai.com/wp-content/uploads/"),
            pid, F.lit(".jpg' src='x.gif'>"),
        ),
        F.concat(F.lit('<meta name="description" content="Plain '), pid, F.lit('">')),
        F.lit("<p>no metadata</p>"),
    ]
    html = F.concat(F.lit("<html><head>"), _chosen((F.col("page_id") % 4).cast("int"), kinds), F.lit("</head></html>"))
    return corpus.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("https://www."), site, F.lit("/post/"), pid).alias("url"), html.alias("html")
    )


def news_enriched(spark, sf) -> DataFrame:
    """Items of all publishers with the photos and summaries that their pages supply."""
    pages = news_pages(spark, sf)
    pid, own = F.col("page_id").cast("string"), F.col("page_id") % 5 == 0
    items = pages.select(
        "page_id", F.col("url").alias("link"),
        _chosen((F.col("page_id") % 3).cast("int"), [F.lit(""), F.concat(F.lit("Own "), pid), F.lit(N.EMPTY_SUMMARIES[0])]).alias("summary"),
        F.when(own, F.concat(F.lit("https://own.example/"), pid)).otherwise("").alias("image"),
        F.when(own, "photo").otherwise("mark").alias("image_kind"),
    )
    return news.enrich(items, news.page_metadata(pages)).select("page_id", "summary", "image", "image_kind")


#: name, region and site of the feeds; every page stands for one feed, release list or list page
FEEDS = (
    ("OpenAI", "国际", "openai.com"), ("Anthropic", "国际", "anthropic.com"), ("Google AI", "国际", "blog.google"), ("量子位", "国内", "qbitai.com"),
    ("InfoQ 中文", "国内", "infoq.cn"), ("机器之心", "国内", "jiqizhixin.com"),
)
ENTRIES, RELEASES = 6, 3  # more than are read of each


def news_sources(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Feeds, release lists, list pages and article pages rendered from ``pages``; some of each cannot be read."""
    ids = corpus.table(spark, sf, "pages").select("page_id")
    pid, n = F.col("page_id").cast("string"), F.col("page_id")
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")
    name, region, site = (
        F.get(X.literal_array([f[i] for f in FEEDS]), (F.floor(n / 4) % len(FEEDS)).cast("int")) for i in range(3)
    )
    link = lambda j: F.concat(F.lit("https://www."), site, F.lit("/post/"), pid, F.lit(f"-{j}"))
    rss = F.concat(F.lit("<rss><channel>"), *[
        F.concat(F.lit("<item><title>Post "), pid, F.lit(f" {j}</title><link>"), link(j), F.lit("</link><description><![CDATA[<p>Told "), pid,
                 F.lit(f" &amp; {j}</p>]]></description><pubDate>Tue, "), day, F.lit(" Sep 2026 08:00:00 GMT</pubDate></item>"))
        for j in range(ENTRIES)
    ], F.lit("</channel>"), F.when(n % 5 == 0, "").otherwise("</rss>"))
    atom = F.concat(F.lit("<feed>"), *[
        F.concat(F.lit("<entry><title>Entry "), pid, F.lit(f" {j}</title><link rel='alternate' href='"), link(j), F.lit("'/><summary></summary><updated>2026-08-"),
                 day, F.lit("T01:00:00Z</updated></entry>"))
        for j in range(2)
    ], F.lit("</feed>"))
    feeds = ids.where(n % 4 < 2).select(
        n.alias("feed_id"), F.when(n % 4 == 0, rss).otherwise(atom).alias("content"), name.alias("source"), F.lit("公司动态").alias("category"),
        F.lit("mark").alias("image"), region.alias("region"), F.lit(None).cast("string").alias("keywords"), F.lit(False).alias("use_entry_source"),
    )
    releases = F.concat(F.lit("["), F.concat_ws(",", *[
        F.concat(F.lit('{"name":"v'), pid, F.lit(f'.{j}","html_url":"https://github.com/o/r'), pid, F.lit(f'/{j}","body":"","published_at":"2026-07-'), day, F.lit('"}'))
        for j in range(RELEASES)
    ]), F.lit("]"))
    payloads = ids.where(n % 4 == 2).select(
        F.concat(F.lit("o/r"), pid).alias("repo"), F.lit("GitHub").alias("source"),
        F.when(n % 5 == 0, '{"message":').otherwise(releases).alias("payload"),
    )
    listing = F.concat(
        F.lit('<a href="/news/'), pid, F.lit('"><h3>Listed '), pid, F.lit("</h3><time>Sep "), (n % 28 + 1).cast("string"),
        F.lit(', 2026</time><p>One</p></a><a href="/other"><h3>x</h3><time>Sep 30, 2026</time></a>'),
    )
    listings = ids.where(n % 4 == 3).select("page_id", F.when(n % 5 == 0, " ").otherwise(listing).alias("html"), F.lit("DeepSeek 官方").alias("source"))
    articles = ids.where(n % 4 < 2).select(
        F.explode(F.array(*[link(j) for j in range(0, ENTRIES, 2)])).alias("url"), pid.alias("p")
    ).select("url", F.concat(
        F.lit('<meta property="og:image" content="/img/'), "p", F.lit('.png"><meta name="description" content="Page of '), "p", F.lit('">')
    ).alias("html"))
    return feeds, payloads, listings, articles


def news_latest(spark, sf) -> DataFrame:
    """Feeds, release lists and list pages of one run, united, selected and enriched."""
    feeds, payloads, listings, articles = news_sources(spark, sf)
    listed = news.parse_listing(listings, "https://www.deepseek.com", "/news/", "DeepSeek 官方", "公司动态", "国际")
    return news.latest_news(feeds, payloads, listed, articles).select(
        "position", "phase", "source", "title", "published", "summary", "image", "image_kind"
    )


def news_failures(spark, sf) -> DataFrame:
    feeds, payloads, listings, _ = news_sources(spark, sf)
    return news.source_failures(feeds, payloads, listings)


QUERIES = {
    "news_latest": news_latest, "news_failures": news_failures,
    "contract_status": contract_status, "route_policy": route_policy, "followup_policy": followup_policy,
    "policy_metadata": policy_metadata, "news_enriched": news_enriched,
}


# --- SQL twins --------------------------------------------------------------------------


def _q(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _case(number: str, options: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {number} = {i} THEN {o}" for i, o in enumerate(options[:-1])) + f" ELSE {options[-1]} END"


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")" if words else "true"


def _matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace('(?<!不)', '(?:^|[^不])')}')"


def _complete_sql(c: C.Clause) -> str:
    if c.schedule:
        return f"{_matches('evidence', C.CALENDAR_DATE)} AND {_any('evidence', C.SCHEDULE_WORDS)}"
    if c.named_parties:
        name = lambda role: f"regexp_extract(flat, '{role}{C.PARTY_NAME}', 1)"
        good = lambda role: f"length({name(role)}) >= 2 AND {name(role)} NOT IN ({', '.join(map(_q, C.BLANK_NAMES))})"
        return " OR ".join(f"({good(a)} AND {good(b)})" for a, b in C.PARTY_PAIRS)
    parts = [_any("evidence", c.required)] + ([_matches("evidence", c.pattern)] if c.pattern else [])
    return " AND ".join(parts + [_matches("flat", p) for p in c.compact_patterns])


def _evidence_sql() -> str:
    values = {
        "y": "year(o_orderdate)", "m": "month(o_orderdate)", "d": "day(o_orderdate)", "n": "(o_custkey % 90 + 1)",
        "k": "o_orderkey", "p": "floor(o_totalprice)::BIGINT", "c": "c_name",
    }
    rows = []
    for field, i in NUMBER.items():
        texts = []
        for t in EVIDENCE[field]:
            sql = _q(t)
            for mark, value in values.items():
                sql = sql.replace(f"${mark}", f"' || {value} || '")
            texts.append(f"({sql})")
        case = _case(f"(o_orderkey + {i}) % 3", [*texts, "''"])
        rows.append(f"SELECT o_orderkey::VARCHAR AS document_id, '{field}' AS field, {case} AS evidence FROM o")
    return "o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey), e AS (" + " UNION ALL ".join(rows) + ")"


def oracle_sql() -> dict[str, str]:
    by_field = lambda f: "CASE field " + " ".join(f"WHEN '{c.key}' THEN {f(c)}" for c in C.CONTRACT_CLAUSES) + " END"
    issues = "CASE field " + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in C.ISSUES.items()) + f" ELSE {_q(C.DEFAULT_ISSUE)} END"
    vague = f"array_to_string(list_filter([{', '.join(map(_q, C.VAGUE_TERMS))}], lambda t: contains(evidence, t)), '、')"
    words = [*V.DEFAULT_VOCABULARY.catalog, *V.DEFAULT_VOCABULARY.project_meta]
    asked = _case(
        f"c_custkey % {len(words) + len(PLAIN_QUESTIONS)}",
        [f"'请问 ' || {_q(w)} || '，客户 ' || c_name" for w in words] + [_q(p) for p in PLAIN_QUESTIONS],
    )
    flat = "regexp_replace(lower(q), '\\s', '', 'g')"
    prefixes = V.DEFAULT_VOCABULARY.follow_up_prefixes
    follow = [f"{_q(p)} || '这一项制度的具体要求，客户' || c_name" for p in prefixes]
    follow += ["'我刚入职' || (c_custkey % 30 + 1) || '个月'", _q(PLAIN_QUESTIONS[2])]
    hints = [h for _, w in V.CATEGORY_HINTS for h in w] + ["其他"]
    guessed = "CASE " + " ".join(f"WHEN {_any('lower(path)', w)} THEN {_q(k)}" for k, w in V.CATEGORY_HINTS) + f" ELSE {_q(V.DEFAULT_CATEGORY)} END"
    labelled = lambda label: f"trim(regexp_extract(content, '(?i){label}\\s*[：:]\\s*([^\\n]+)', 1), ' -*')"
    page = _case("p_partkey % 3", [
        "'# ' || p_name || '制度 ' || chr(10) || '版本：V' || p_size || chr(10) || '生效日期：2026-01-01' || chr(10) || '责任部门：- ' || p_brand "
        "|| chr(10) || '- 负责人：第' || p_partkey || '号' || chr(10) || '## 适用范围' || chr(10) || '正文。' || chr(10) || '### 流程' || chr(10) "
        "|| '正文。' || chr(10) || '##### 附则' || chr(10) || '正文。'",
        "'文档名称：* ' || p_name || ' *' || chr(10) || '业务分类：分类' || p_partkey || chr(10) || '## 条款' || chr(10) || '正文。'",
        "'目录' || chr(10) || '第一章 总则' || chr(10) || '第二章' || chr(10) || '第三章' || chr(10) || '1' || chr(10) || '2' || chr(10) "
        "|| CASE WHEN p_size > 25 THEN '本页为目录。' ELSE '附则' END",
    ])
    lines = "list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g')), lambda x: x <> '')"
    sites = [*N.PUBLISHERS, "other.example"]
    feed = lambda i: _case(f"(page_id // 4) % {len(FEEDS)}", [_q(f[i]) for f in FEEDS])
    day = "lpad((page_id % 28 + 1)::VARCHAR, 2, '0')"
    post = "'https://www.' || site || '/post/' || page_id || '-' || j"
    return {
        "news_failures": f"""WITH a AS (SELECT *, page_id % 4 AS kind, {feed(0)} AS name FROM pages WHERE page_id % 5 = 0)
          SELECT CASE kind WHEN 0 THEN name WHEN 2 THEN 'GitHub' ELSE 'DeepSeek 官方' END AS source,
            CASE kind WHEN 0 THEN 'feed is not well-formed' WHEN 2 THEN 'release list is not a JSON array' ELSE 'page is empty' END AS reason
          FROM a WHERE kind <> 1""",
        "news_latest": f"""WITH RECURSIVE a AS (SELECT page_id, page_id % 4 AS kind, {day} AS day, {feed(0)} AS name, {feed(1)} AS region, {feed(2)} AS site FROM pages),
          u AS (
            SELECT name AS source, region, 'Post ' || page_id || ' ' || j AS title, '2026-09-' || day AS published, {post} AS link,
              'Told ' || page_id || ' & ' || j AS summary, page_id, j, site FROM a, range(4) AS r(j) WHERE kind = 0 AND page_id % 5 <> 0
            UNION ALL SELECT name, region, 'Entry ' || page_id || ' ' || j, '2026-08-' || day, {post}, '', page_id, j, site FROM a, range(2) AS r(j) WHERE kind = 1
            UNION ALL SELECT 'GitHub', '开源', 'o/r' || page_id || ' · v' || page_id || '.' || j, '2026-07-' || day,
              'https://github.com/o/r' || page_id || '/' || j, 'o/r' || page_id || ' 发布了新版本，点击查看变更说明。', page_id, j, ''
              FROM a, range(2) AS r(j) WHERE kind = 2 AND page_id % 5 <> 0
            UNION ALL SELECT 'DeepSeek 官方', '国际', 'Listed ' || page_id, '2026-09-' || day, 'https://www.deepseek.com/news/' || page_id, 'One', page_id, 1, ''
              FROM (SELECT *, row_number() OVER (ORDER BY day DESC, page_id) AS n FROM a WHERE kind = 3 AND page_id % 5 <> 0) WHERE n <= {N.LISTED_ITEMS}),
          o AS MATERIALIZED (SELECT *, regexp_replace(lower(title), '[^\\p{{L}}\\p{{Nd}}\\p{{M}}_]+', '', 'g') AS k,
            row_number() OVER (ORDER BY published DESC, ('0x' || substr(sha256(source || '|' || link), 1, 15))::BIGINT) AS o FROM u),
          v AS (SELECT *, list_position([{', '.join(map(_q, N.RESERVED_SOURCES))}], source) AS slot, row_number() OVER (PARTITION BY source ORDER BY o) AS nth FROM o),
          queue AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY p, place, o) AS step FROM (
            SELECT 1 AS p, 0 AS place, * FROM v WHERE region = '国内' UNION ALL SELECT 2, slot, * FROM v WHERE slot > 0 AND nth = 1
            UNION ALL SELECT 3, 0, * FROM v UNION ALL SELECT 4, 0, * FROM v)),
          greedy AS (SELECT 0::BIGINT AS step, []::STRUCT(o BIGINT, k VARCHAR, s VARCHAR, p INT)[] AS taken UNION ALL
            SELECT q.step, CASE WHEN (CASE q.p WHEN 1 THEN len(list_filter(taken, lambda t: t.p = 1)) < 3 AND len(list_filter(taken, lambda t: t.s = q.source)) = 0
                WHEN 2 THEN true WHEN 3 THEN len(taken) < 9 AND len(list_filter(taken, lambda t: t.s = q.source)) = 0 ELSE len(taken) < 9 END)
              AND len(list_filter(taken, lambda t: t.k = q.k)) = 0 AND len(list_filter(taken, lambda t: t.s = q.source)) < 2
              THEN list_append(taken, {{'o': q.o, 'k': q.k, 's': q.source, 'p': q.p}}) ELSE taken END
            FROM greedy g JOIN queue q ON q.step = g.step + 1),
          t AS (SELECT unnest(taken) AS t, generate_subscripts(taken, 1) AS i FROM (SELECT taken FROM greedy ORDER BY step DESC LIMIT 1))
          SELECT i::INT AS position, t.p AS phase, source, title, published,
            CASE WHEN summary <> '' THEN summary WHEN j % 2 = 0 THEN 'Page of ' || page_id ELSE '' END AS summary,
            CASE WHEN site <> '' AND j % 2 = 0 THEN 'https://www.' || site || '/img/' || page_id || '.png' WHEN site <> '' THEN 'mark'
              WHEN region = '开源' THEN 'https://github.com/o.png?size=480' ELSE '' END AS image,
            CASE WHEN site <> '' AND j % 2 = 0 THEN 'photo' ELSE 'logo' END AS image_kind
          FROM t JOIN o ON t.o = o.o""",
        "news_enriched": f"""WITH a AS (SELECT page_id, page_id % 4 AS kind, {_case(f'page_id % {len(sites)}', [_q(x) for x in sites])} AS site FROM pages),
          m AS (SELECT *, site <> 'other.example' AS allowed,
            CASE WHEN kind = 0 THEN 'https://www.' || site || '/img/' || page_id || '.png?a=1&b=2'
              WHEN kind = 1 AND site = 'qbitai.com' THEN 'https://i.qbitai.com/wp-content/uploads/' || page_id || '.jpg'
              WHEN kind = 1 THEN 'https://cdn.example.com/logo.png' ELSE '' END AS found,
            CASE kind WHEN 0 THEN 'Text ' || page_id || ' & more' WHEN 2 THEN 'Plain ' || page_id ELSE '' END AS told FROM a)
          SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'Own ' || page_id WHEN allowed THEN told ELSE '' END AS summary,
            CASE WHEN page_id % 5 = 0 THEN 'https://own.example/' || page_id WHEN allowed THEN found ELSE '' END AS image,
            CASE WHEN page_id % 5 = 0 OR allowed AND found <> '' THEN 'photo' ELSE 'mark' END AS image_kind FROM m""",
        "contract_status": f"""WITH {_evidence_sql()}, f AS (SELECT *, regexp_replace(evidence, '\\s', '', 'g') AS flat FROM e),
          s AS (SELECT *, CASE WHEN evidence = '' THEN 'missing' WHEN {by_field(lambda c: '(' + _complete_sql(c) + ')')} THEN 'found' ELSE 'incomplete' END AS status,
            {by_field(lambda c: _q(c.label))} AS label, {vague} AS vague FROM f)
          SELECT document_id, field, status, CASE WHEN status = 'incomplete' THEN {issues} ELSE '' END AS issue,
            CASE WHEN status = 'missing' THEN '待确认条款：未检出' || label || '。'
              WHEN status = 'incomplete' THEN '待确认条款：' || {issues} || CASE WHEN vague <> '' THEN '；其中包含“' || vague || '”等含糊表述' ELSE '' END
              WHEN vague <> '' THEN '审阅提示：' || label || '包含表述“' || vague || '”，建议确认具体条件或期限。' END AS message FROM s""",
        "route_policy": f"""WITH a AS (SELECT c_custkey, {asked} AS q FROM customer) SELECT c_custkey, CASE WHEN trim(q) = '' THEN 'invalid'
          WHEN {_any(flat, V.DEFAULT_VOCABULARY.catalog)} THEN 'catalog' WHEN {_any(flat, V.DEFAULT_VOCABULARY.project_meta)} THEN 'project_meta'
          ELSE 'retrieval' END AS route FROM a""",
        "followup_policy": f"""WITH a AS (SELECT c_custkey, {_case(f'c_custkey % {len(follow)}', follow)} AS q,
            CASE WHEN c_custkey % 5 > 0 THEN '客户' || c_name || '的年假有多少天' END AS previous FROM customer)
          SELECT c_custkey, CASE WHEN previous IS NOT NULL AND ({' OR '.join(f'starts_with(q, {_q(p)})' for p in prefixes)}
            OR regexp_full_match(q, '{V.DEFAULT_VOCABULARY.duration_pattern}'))
            THEN '{V.PREVIOUS_MARK}' || previous || chr(10) || '{V.FOLLOW_UP_MARK}' || q ELSE q END AS question FROM a""",
        "policy_metadata": f"""WITH a AS (SELECT p_partkey, {_case(f'p_partkey % {len(hints)}', [_q(h) for h in hints])} || p_partkey || '.md' AS path,
            {page} AS content FROM part), b AS (SELECT *, {lines} AS ls FROM a)
          SELECT p_partkey, CASE WHEN contains(content, '文档名称') THEN {labelled('文档名称')} ELSE trim(regexp_extract(content, '(?m)^#\\s+(.+?)\\s*$', 1)) END AS title,
            array_to_string(regexp_extract_all(content, '(?m)^#{{2,4}}\\s+(.+?)\\s*$', 1), '|') AS sections,
            CASE WHEN contains(content, '业务分类') THEN {labelled('业务分类')} ELSE {guessed} END AS category,
            list_contains(ls[1:3], '目录') AND len(list_filter(ls, lambda x: regexp_matches(x, '^(?:第[一二三四五六七八九十百0-9]+章|[0-9]+$)'))) >= 4
              AND len(list_filter(ls, lambda x: length(x) > 45 OR contains(x, '。') OR contains(x, '；'))) = 0 AS is_catalog,
            {labelled('版本')} AS version, {labelled('生效日期')} AS effective_date, {labelled('责任部门')} AS department, {labelled('负责人')} AS owner FROM b""",
    }
