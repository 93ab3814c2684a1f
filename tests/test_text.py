"""String scalars and chunking against plain-Python restatements."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sourcelight.functions import dates, html
from sourcelight.functions import text as X
from sourcelight.operators import chunking
from sourcelight.settings import Settings


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def normalized(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = "".join(c for c in text if c in "\t\n" or not (ord(c) < 32 or ord(c) == 127))
    lines = (re.sub("[ \t]+", " ", line).strip() for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


ALPHABET = st.text(alphabet=" \t\r\n\x00\x0b\x7f　ab。；-•1.年假", max_size=40)


@hyp(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ALPHABET, min_size=150, max_size=150))
def test_normalize_matches_restatement(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", X.normalize_text(F.col("t")).alias("n")).collect()}
    assert got == {i: normalized(v) for i, v in enumerate(values)}


def test_rare_characters_are_found_beside_all_others(spark):
    """White space of every kind is seen, and the search first passes over letters by a short class."""
    spaces, others = X.WS_CHARS, "!~a0Z.\xa1\u00e9\u167f\u1681\u1fff\u200b\u3001\u4e00\ud7ff\uffff\U0001f600\x7f#"
    values = [a + b + c for a in ("", "x", "\u3001") for b in spaces + others for c in ("", "y", " ", "\n", "\u3000")]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    columns = [X.compact(F.col("t")).alias("c"), X.normalize_text(F.col("t")).alias("n"), X.squeezed(X.normalize_text(F.col("t"))).alias("q")]
    for r in rows.select("t", *columns).collect():
        assert r["c"] == "".join(c for c in r["t"] if c not in spaces), repr(r["t"])
        assert r["q"] == "".join(c for c in r["n"].lower() if c not in spaces), repr(r["t"])
        assert r["n"] == r["n"].strip(spaces) and "\t" not in r["n"] and "\x7f" not in r["n"]
    plan = rows.select(*columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?![!-~") >= 3


def test_tokens_keep_codes_numbers_and_words(spark):
    row = one(spark, "年假怎么申请 AB-12.5 vpn_x 打印机维修", X.tokens(F.col("t")).alias("t"))
    assert row["t"] == ["年假", "怎么", "申请", "ab", "12.5", "vpn", "x", "打印机", "维修"]


def test_unknown_runs_become_pairs(spark):
    assert one(spark, "甲乙丙 丁", X.tokens(F.col("t")).alias("t"))["t"] == ["甲乙", "乙丙", "丁"]


def test_tokens_take_the_longest_word_of_shared_beginnings(spark):
    """Against one plain alternation of all words; a place must not try them one by one."""
    rng = random.Random(6)
    lexicon = ("甲", "甲乙", "甲乙丙丁", "乙丙", "丙", "丁戊己", "丁戊", "己", "庚辛", "壬癸", "c+", "a-b")
    values = ["".join(rng.choices("甲乙丙丁戊己庚辛壬癸子丑a-b1.c+ 。", k=rng.randint(0, 25))) for _ in range(300)]
    words = "|".join(re.escape(w) for w in sorted(lexicon, key=lambda w: (-len(w), w)))
    cjk = "\u4e00-\u9fff"

    def plain(text):
        found = re.findall(rf"[a-z]+|\d+(?:\.\d+)?|{words}|(?:(?!{words})[{cjk}])+" if re.search(f"[{cjk}]", text) else r"[a-z]+|\d+(?:\.\d+)?", text)
        cut = [[t[i : i + 2] for i in range(len(t) - 1)] if re.fullmatch(f"[{cjk}]{{3,}}", t) and t not in lexicon else [t] for t in found]
        return [t for part in cut for t in part]

    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    got = {r["i"]: r["k"] for r in rows.select("i", X.tokens(F.col("t"), lexicon).alias("k")).collect()}
    assert got == {i: plain(v) for i, v in enumerate(values)}
    assert X._longest_of(lexicon).count("甲") == 1


def test_sentences_rejoin_wrapped_lines(spark):
    row = one(spark, "第一行\n继续。下一句！ok? y\n- 项\n2. 二\n尾巴", X.sentences(F.col("t")).alias("s"))
    assert row["s"] == ["第一行继续。", "下一句！", "ok?", "y", "项", "2. 二尾巴"]


def test_catalog_pages(spark):
    toc = "目录\n第一章 总则\n1\n第二章 细则\n2"
    prose = toc + "\n本页说明了范围。"
    assert one(spark, toc, X.is_catalog(F.col("t")).alias("c"))["c"]
    assert not one(spark, prose, X.is_catalog(F.col("t")).alias("c"))["c"]


def test_metadata(spark):
    text = "# 标题\n版本：V2\n生效日期：2026-01-01\n- 负责人：某人\n部门负责人：负责预算\n归口部门：行政部\n业务分类：行政"
    meta = X.policy_metadata(F.col("t"))
    row = one(spark, text, *[v.alias(k) for k, v in meta.items()], X.heading_title(F.col("t")).alias("title"),
              X.category(F.col("t"), F.lit("x.md")).alias("category"))
    assert (row["version"], row["effective_date"], row["department"], row["owner"]) == ("V2", "2026-01-01", "行政部", "某人")
    assert row["title"] == "标题" and row["category"] == "行政"


def test_employee_answer_and_html(spark):
    text = "根据《甲》中的相关规定：\n- 3. 先**提交**\n出差申请：\n\n请以页面下方展示的原文来源为准。"
    row = one(spark, text, X.employee_answer(F.col("t")).alias("a"))
    assert row["a"] == "- 先提交"
    row = one(spark, "a<b\n- x\n- y\nz", X.answer_html(F.col("t"), False).alias("h"))
    assert row["h"] == '<section class="answer-panel"><p>a&lt;b</p><ul><li>x</li><li>y</li></ul><p>z</p></section>'


@pytest.mark.parametrize("length", [1, 499, 500, 501, 920, 921, 4999])
def test_windows_match_loop(spark, length):
    text = "".join(chr(0x4E00 + i % 500) for i in range(length))
    want, offset = [], 0
    while True:
        want.append(text[offset : offset + 500])
        if offset + 500 >= length:
            break
        offset += 420
    row = one(spark, text, chunking.windows(F.col("t")).alias("w"))
    assert row["w"] == want


def test_sections_drop_preamble_and_metadata(spark):
    text = "# 标题\n前言\n## 一章\n" + "甲" * 1000 + "\n## 文档信息\nx\n## 二章\n乙\n### 小\n丙"
    docs = spark.createDataFrame([("d", text, "ready"), ("e", "", "ready"), ("f", "x", "error")],
                                 "document_id string, content string, status string")
    rows = chunking.split_documents(docs).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["section"], len(r["content"])) for r in rows] == [
        ("d-000", "一章", 500), ("d-001", "一章", 500), ("d-002", "一章", 160), ("d-003", "二章", 9)]


def test_settings_are_checked():
    for bad in ({"chunk_size": 0}, {"chunk_overlap": 500}, {"rrf_k": -1}, {"hash_dim": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_dates(spark):
    values = ["Tue, 10 Sep 2026 08:00:00 GMT", "2026-09-10T23:00:00Z", "garbage value", ""]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = [r["d"] for r in rows.select("i", dates.news_date(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == ["2026-09-10", "2026-09-10", "garbage va", ""]
    assert one(spark, "于2026年3月5日发布", dates.cjk_date(F.col("t")).alias("d"))["d"] == "2026-03-05"
    assert one(spark, "Sep 5, 2026", dates.month_day_year(F.col("t")).alias("d"))["d"] == "2026-09-05"


def test_html_text_and_hosts(spark):
    page = "<style>p{}</style><p>A &amp; B&nbsp;[x]</p><script>var t='<p>';</script> 阅读原文>"
    assert one(spark, page, html.summary(F.col("t")).alias("s"))["s"] == "A & B x"
    assert one(spark, "x" * 300, html.plain_text(F.col("t")).alias("s"))["s"] == "x" * 220 + "…"
    for link, ok in (("https://blog.google/a", True), ("https://a.openai.com/", True), ("https://notopenai.com/", False)):
        assert one(spark, link, html.allowed_publisher(F.col("t")).alias("a"))["a"] is ok


def test_page_metadata_first_value_wins(spark):
    page = """<meta property="og:image" content="/a.png"><meta name='Description' content='one'>
              <meta name="description" content="two"><img data-src="b.png" src="c.png"><img alt="x">"""
    row = one(spark, page, html.meta_value(html.meta_tags(F.col("t")), "og:description", "description").alias("d"),
              html.images(F.col("t")).alias("i"))
    assert row["d"] == "one" and row["i"] == ["b.png"]


def test_labels_and_days(spark):
    rows = spark.createDataFrame(
        [("", "", True, True, ""), ("x", "y", True, False, "no model"), (None, "y", False, False, None), (None, None, True, False, None)],
        "model string, vector string, enabled boolean, effective boolean, error string")
    told = rows.select(
        X.degradation_warning(F.col("model"), F.col("vector")).alias("w"),
        X.reranker_label(F.col("enabled"), F.col("effective"), F.col("error")).alias("r"),
        X.role_label(F.lit("法务"), F.lit("legal")).alias("role"),
    ).collect()
    assert [t["w"][:4] for t in told] == ["", "大模型服", "向量检索", ""]
    assert [t["r"] for t in told] == ["已启用", "加载失败，已回退", "未启用", "已配置，首次问答时加载"]
    assert {t["role"] for t in told} == {"法务（legal）"}
    days = one(spark, "2026-09-01", dates.days_since(F.col("t"), F.to_date(F.lit("2026-09-11"))).alias("a"),
               dates.days_since(F.col("t"), F.to_date(F.lit("2026-08-01"))).alias("b"))
    assert (days["a"], days["b"]) == (10, 0)
