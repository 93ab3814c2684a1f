"""Files, cases, index, feedback, permissions, news and the feedback stream."""

import io
import json
import tempfile
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sourcelight.operators import catalog, evaluation, feedback, news, retrieval
from sourcelight.sources import cases, files, stores
from sourcelight.streaming import feedback_stream


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def docx(*paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(
        f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
        for style, text in paragraphs
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def write_corpus(folder):
    (folder / "a.md").write_bytes("﻿# 甲制度\n版本：V1\n## 总则\n正文。".encode())
    (folder / "a.txt").write_text("纯文本", encoding="utf-8")
    (folder / "travel.docx").write_bytes(docx(("Title", "差旅"), ("Heading1", "标准"), ("", " "), ("", "住宿 500 元")))
    (folder / "bad.docx").write_bytes(b"not a zip")
    (folder / "empty.txt").write_text("  \n", encoding="utf-8")
    (folder / "x.pdf").write_bytes(b"%PDF")
    (folder / "skip.csv").write_text("x")


def test_load_directory(spark, folder):
    write_corpus(folder)
    rows = {r["source_path"]: r for r in files.load_directory(spark, str(folder)).collect()}
    assert set(rows) == {"a.md", "a.txt", "travel.docx", "bad.docx", "empty.txt", "x.pdf"}
    assert rows["a.md"]["document_id"] == "a" and rows["a.txt"]["document_id"] == "a-txt"
    assert rows["a.md"]["title"] == "甲制度" and rows["a.md"]["version"] == "V1" and rows["a.md"]["sections"] == ["总则"]
    assert rows["travel.docx"]["content"] == "# 差旅\n## 标准\n住宿 500 元" and rows["travel.docx"]["category"] == "财务采购"
    assert {p for p, r in rows.items() if r["status"] == "error"} == {"bad.docx", "empty.txt", "x.pdf"}
    assert all(r["content"] == "" and r["error"] for r in rows.values() if r["status"] == "error")
    pdf = files.load_directory(spark, str(folder), pdf_parser=lambda b: (["一", "", "三"], "题")).where("source_path = 'x.pdf'").first()
    assert pdf["content"] == "## 第 1 页\n一\n## 第 3 页\n三" and pdf["title"] == "题"
    assert files.load_directory(spark, str(folder / "none")).count() == 0


def test_load_file_rejects(spark, folder):
    write_corpus(folder)
    assert files.load_file(spark, str(folder / "a.txt")).first()["content"] == "纯文本"
    with pytest.raises(ValueError):
        files.load_file(spark, str(folder / "skip.csv"))
    with pytest.raises(Exception):
        files.load_file(spark, str(folder / "empty.txt")).collect()


def test_index_reuse_and_checks(spark, folder):
    (folder / "in").mkdir()
    write_corpus(folder / "in")
    docs = files.load_directory(spark, str(folder / "in"))
    store = stores.IndexStore(spark, str(folder / "index"))
    assert not store.exists()
    first = store.build(docs)
    assert first["chunk_count"] == 3 and first["document_count"] == 6
    assert store.build(docs)["build"] == first["build"]
    assert store.vectors(first["fingerprint"]).count() == 3
    with pytest.raises(ValueError):
        store.vectors("other")
    asked = spark.createDataFrame([("q", "住宿 500")], "query_id string, question string")
    assert retrieval.hybrid(store.chunks(), asked, top_k=1).first()["document_id"] == "travel"
    (folder / "in" / "b.txt").write_text("新增", encoding="utf-8")
    second = store.build(files.load_directory(spark, str(folder / "in")))
    assert second["build"] != first["build"] and second["chunk_count"] == 4
    with pytest.raises(ValueError):
        store.build(docs.where("status = 'error'"))
    assert store.metadata()["build"] == second["build"]
    status = catalog.status(docs, store.chunks()).first()
    assert status["health"] == "degraded" and status["ready_document_count"] == 3


def everything(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*"))


def test_incremental_index(spark, folder):
    """An unchanged folder writes nothing, one new file parses one file, and searches equal those of a fresh index."""
    source, log = folder / "in", folder / "parsed"
    source.mkdir()
    for i in range(4):
        (source / f"p{i}.pdf").write_bytes(f"%PDF {i}".encode())
    (source / "a.md").write_text("# 甲\n住宿 500 元。", encoding="utf-8")

    def parser(data):
        with log.open("a") as out:
            out.write("x\n")
        return [f"text of {data.decode()} with words {len(data)}"], ""

    def refresh(store):
        before = len(log.read_text().split()) if log.exists() else 0
        meta = store.refresh(files.list_files(spark, str(source)), lambda new: files.parse_files(new, pdf_parser=parser))
        return meta, len(log.read_text().split()) - before

    store = stores.IndexStore(spark, str(folder / "index"))
    first, parsed = refresh(store)
    assert (first["document_count"], first["chunk_count"], parsed) == (5, 5, 4)
    held = everything(folder / "index")
    again, parsed = refresh(store)
    assert again == first and parsed == 0 and everything(folder / "index") == held
    (source / "p4.pdf").write_bytes(b"%PDF four")
    second, parsed = refresh(store)
    assert parsed == 1 and second["chunk_count"] == 6 and len(second["segments"]) == 2
    (source / "p1.pdf").write_bytes(b"%PDF other")  # changed: its segment is written again, the rest of it unparsed
    (source / "p2.pdf").unlink()
    third, parsed = refresh(store)
    assert parsed == 1 and third["chunk_count"] == 5 and first["build"] not in third["segments"]
    fresh = stores.IndexStore(spark, str(folder / "fresh"))
    refresh(fresh)
    asked = spark.createDataFrame([("a", "text words 500 住宿"), ("b", "other four")], "query_id string, question string")
    rows = lambda s: sorted(
        (r["query_id"], r["rank"], r["chunk_id"], r["vector_score"], r["bm25_score"])
        for r in retrieval.hybrid(s.search_index(), asked, top_k=5).collect()
    )
    assert rows(store) == rows(fresh) and len(rows(store)) == 10


def test_interleaved_grants_both_hold(spark, folder):
    one, two = (stores.PermissionStore(spark, str(folder / "acl")) for _ in range(2))
    one.write({"a.md": ["legal"], "b.md": ["legal"]})
    seen = spark.createDataFrame([("a.md", 1)], "source_path string, version bigint")
    one.grant(["a.md"], ["business"])
    two.grant(["b.md"], ["employee"])
    held = {r["source_path"]: r["allowed_roles"] for r in one.read().collect()}
    assert held == {"a.md": ["business"], "b.md": ["employee"]}
    with pytest.raises(ValueError, match="meanwhile"):
        two.append(spark.createDataFrame([("a.md", ["legal"])], stores.ACL_SCHEMA), expected=seen)
    one.write({"b.md": ["legal"]})
    assert [r["source_path"] for r in two.read().collect()] == ["b.md"] and two.log().count() == 6


def test_legacy_documents(spark, folder):
    (folder / "d.json").write_text(json.dumps([{"document_id": "d", "title": "t", "content": "x", "source_path": "d.md"}]))
    row = stores.read_documents_json(spark, str(folder / "d.json")).first()
    assert row["status"] == "ready" and row["knowledge_base_id"] == "policy" and row["allowed_roles"] == [] and row["owner"] == ""


def test_cases(spark, folder):
    good = [{"case_id": "b", "question": "q", "expected_source": "s"}, {"case_id": "a", "question": "q", "should_refuse": True}]
    (folder / "one.json").write_text(json.dumps(good))
    assert [r["case_id"] for r in cases.evaluation_cases(spark, str(folder)).collect()] == ["a", "b"]
    (folder / "two.json").write_text(json.dumps([good[0]]))
    with pytest.raises(ValueError, match="repeated"):
        cases.evaluation_cases(spark, str(folder))
    (folder / "two.json").write_text(json.dumps([{"case_id": "c", "question": "q"}]))
    with pytest.raises(ValueError, match="required"):
        cases.evaluation_cases(spark, str(folder))
    assert cases.answer_quality_cases(spark, str(folder / "none.json")).count() == 0


def test_evaluation_metrics(spark):
    cs = spark.createDataFrame(
        [("1", "q", "a", ["K"], False), ("2", "q", "d", [], False), ("3", "q", "gone", [], False), ("4", "q", "x", [], False),
         ("5", "q", "", [], True), ("6", "q", "", [], True)],
        "case_id string, question string, expected_source string, expected_keywords array<string>, should_refuse boolean")
    ranked = [("1", 1, "a", "has k"), ("1", 2, "b", "")]
    ranked += [("2", i + 1, s, "") for i, s in enumerate("abacd")]
    ranked += [("3", 1, "a", ""), ("4", 1, "a", ""), ("5", 1, "a", ""), ("6", 1, "a", "")]
    results = spark.createDataFrame(ranked, "query_id string, rank int, source_path string, content string")
    docs = spark.createDataFrame([(s, "ready") for s in "abcdx"] + [("gone", "error")], "source_path string, status string")
    gated = spark.createDataFrame([("5", None), ("6", "a")], "query_id string, best_document string")
    rows = evaluation.evaluate_cases(cs, results, docs, gated)
    got = {r["case_id"]: r for r in rows.collect()}
    assert {i: r["failure_type"] for i, r in got.items()} == {
        "1": "passed", "2": "ranked_too_low", "3": "missing_document", "4": "not_retrieved", "5": "passed",
        "6": "false_positive_evidence"}
    assert got["2"]["rank"] == 4 and got["1"]["keyword_hits"] == ["K"]
    m = evaluation.summarize(rows).first()
    assert (m["hit_at_1"], m["hit_at_3"], m["mrr"]) == (0.25, 0.25, 0.3125)
    assert (m["passed_count"], m["failed_count"], m["refusal_accuracy"], m["refusal_baseline_accuracy"]) == (2, 4, 0.5, 0.0)
    assert (m["citation_coverage"], m["document_coverage"]) == (0.5, 0.75)
    assert {r["Hit@3"] for r in evaluation.display_rows(rows).collect()} == {"通过", "失败", "拒答通过", "拒答失败"}
    assert evaluation.summarize(rows.where("false")).first()["hit_at_1"] == 0.0


def test_percentiles(spark):
    values = [5.0, 1.0, 9.0, 3.0, 100.0]
    row = evaluation.latency_percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (row["latency_p50_ms"], row["latency_p95_ms"]) == (5.0, 81.8)


def test_percentiles_of_a_hot_group(spark):
    import random

    rng = random.Random(3)
    data = [("hot", round(rng.expovariate(0.01), 3)) for _ in range(3000)] + [("flat", 7.0)] * 500 + [("one", 2.5)]
    rows = evaluation.latency_percentiles(spark.createDataFrame(data, "k string, v double"), "v", "k").collect()

    def exact(values, p):
        values = sorted(values)
        i = (len(values) - 1) * p
        low = int(i)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (i - low)

    for r in rows:
        mine = [v for k, v in data if k == r["k"]]
        assert r["latency_p50_ms"] == pytest.approx(exact(mine, 0.5), abs=0.0051)
        assert r["latency_p95_ms"] == pytest.approx(exact(mine, 0.95), abs=0.0051)
    assert len(rows) == 3


def test_feedback(spark, folder):
    store = stores.FeedbackStore(spark, str(folder / "feedback"))
    assert store.read().count() == 0

    def rows(*r):
        return spark.createDataFrame(list(r), "question string, answer string, rating string, reason string")

    store.record(rows((" q ", "a", "up", "未解决"), ("q", "a", "down", "未解决")))
    store.record(rows(("q", "a", "down", "")))
    assert sorted(r["reason"] for r in store.read().collect()) == ["", "", "未解决"]
    s = feedback.summarize_feedback(store.read()).first()
    assert (s["total"], s["up"], s["down"], s["unresolved"], s["reasons"]) == (3, 1, 2, 1, {"未解决": 1})
    for bad in ((" ", "a", "up", ""), ("q", "a", "meh", ""), ("q", "a", "down", "other")):
        with pytest.raises(Exception):
            store.record(rows(bad))
    assert store.read().count() == 3
    query = feedback_stream.start(
        feedback_stream.read_feedback(spark, str(folder / "feedback")), str(folder / "checkpoint"))
    query.awaitTermination(60)
    assert spark.sql("select sum(n) from feedback_summary").first()[0] == 3
    spark.createDataFrame([(1,)], "other int").write.parquet(str(folder / "corrupt"))
    with pytest.raises(ValueError):
        stores.FeedbackStore(spark, str(folder / "corrupt")).read()


@pytest.mark.parametrize("payload", ['["x"]', '{"a.md": "legal"}', '{"a.md": ["guest"]}', "not json"])
def test_malformed_permissions_fail_closed(spark, folder, payload):
    (folder / "acl").mkdir()
    (folder / "acl" / "p.txt").write_text(payload)
    with pytest.raises(Exception):
        rows = stores.PermissionStore(spark, str(folder / "acl")).read().collect()
        assert rows


def test_permissions_and_upload(spark, folder):
    acl = stores.PermissionStore(spark, str(folder / "acl"))
    assert acl.read().count() == 0
    acl.write({"a.md": ["legal", "business"]})
    assert acl.read().first()["allowed_roles"] == ["legal", "business"]
    with pytest.raises(ValueError):
        acl.write({"a.md": ["guest"]})
    docs = spark.createDataFrame([("n.md", "ready", "")], "source_path string, status string, error string")
    have = spark.createDataFrame([("old.md",)], "source_path string")
    assert stores.upload_contracts(docs, have, "legal", ["legal", "admin"]).first()["allowed_roles"] == ["admin", "legal"]
    with pytest.raises(PermissionError):
        stores.upload_contracts(docs, have, "employee", ["legal"])
    with pytest.raises(ValueError, match="exists"):
        stores.upload_contracts(docs, docs.select("source_path"), "admin", ["legal"])
    with pytest.raises(ValueError, match="could not be read"):
        stores.upload_contracts(docs.withColumn("status", F.lit("error")), have, "admin", ["legal"])


RSS = """<rss><channel><item><title>New GPT &lt;b&gt;model&lt;/b&gt;</title><link>https://a.example/1</link>
<description><![CDATA[<p>Text <img src="https://a.example/i.png"></p>]]></description><pubDate>Tue, 10 Sep 2026 08:00:00 GMT</pubDate></item>
<item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="x"><entry><title>开源 库</title><link rel="self" href="https://b.example/self"/><link href="https://b.example/2"/>
<summary>s</summary><media:thumbnail url="https://b.example/t.jpg"/><updated>2026-09-11T00:00:00Z</updated></entry></feed>"""


def test_feeds(spark):
    rows = spark.createDataFrame(
        [(1, RSS, "A", "公司动态", "logo", "国际", None, False), (2, ATOM, "B", "公司动态", "logo", None, "nothing|开源", False),
         (3, ATOM, "C", "公司动态", "logo", None, "absent", False)],
        "feed_id int, content string, source string, category string, image string, region string, keywords string, use_entry_source boolean")
    a, b = news.parse_feeds(rows).orderBy("feed_id").collect()
    assert (a["title"], a["link"], a["published"], a["category"]) == ("New GPT model", "https://a.example/1", "2026-09-10", "模型升级")
    assert (a["summary"], a["image"], a["image_kind"]) == ("Text", "https://a.example/i.png", "photo")
    assert (b["link"], b["image"], b["category"], b["region"]) == ("https://b.example/2", "https://b.example/t.jpg", "开源生态", "国际")


def test_releases_and_listing(spark):
    payload = json.dumps([{"name": "", "tag_name": "v1", "html_url": "https://g/1", "body": "", "created_at": "2026-01-02T00:00:00Z"},
                          {"name": "x", "html_url": "ftp://g"}, {"name": "third", "html_url": "https://g/3"}])
    rows = news.parse_releases(spark.createDataFrame([("o/r", "R", payload)], "repo string, source string, payload string")).collect()
    assert [(r["title"], r["published"], r["image"]) for r in rows] == [("o/r · v1", "2026-01-02", "https://github.com/o.png?size=480")]
    page = ('<a href="/news/a"><h3>T1</h3><time>Sep 5, 2026</time><p>One</p></a><a href="/news/a"><h3>again</h3><time>Sep 6, 2026</time></a>'
            '<a href="/other"><h3>x</h3><time>Sep 5, 2026</time></a><a href="/news/b"><h2>T2</h2>2026年9月7日</a>')
    got = news.parse_listing(spark.createDataFrame([(1, page)], "page_id int, html string"), "https://www.example.com", "/news/", "E", "公司动态", "国际")
    assert [(r["title"], r["published"]) for r in got.orderBy("published").collect()] == [("T1", "2026-09-05"), ("T2", "2026-09-07")]


def greedy(items, reserved):
    ordered = sorted(items, key=lambda r: r[0])
    ordered.sort(key=lambda r: r[2], reverse=True)
    out, titles, count = [], set(), {}

    def add(r):
        if r[1] in titles or count.get(r[3], 0) >= 2:
            return False
        titles.add(r[1])
        count[r[3]] = count.get(r[3], 0) + 1
        out.append(r[0])
        return True

    seen = set()
    for r in ordered:
        if r[4] == "国内" and r[3] not in seen and len(seen) < 3 and add(r):
            seen.add(r[3])
    for s in reserved:
        first = next((r for r in ordered if r[3] == s), None)
        if first:
            add(first)
    for fresh in (True, False):
        for r in ordered:
            if len(out) < 9 and (not fresh or r[3] not in count):
                add(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_news_selection_equals_greedy(spark, seed):
    import random

    rng = random.Random(seed)
    # One source and one title hold a third of all rows.
    items = [
        (i, "same" if i % 3 == 0 else f"t{rng.randint(0, 200)}", f"2026-0{rng.randint(1, 9)}-01",
         "hot" if i % 3 == 1 else f"s{rng.randint(0, 8)}", "国内" if rng.random() < 0.3 else "国际")
        for i in range(400)
    ]
    df = spark.createDataFrame(items, "item_id bigint, title string, published string, source string, region string")
    df = df.withColumn("region", F.when(F.col("source").isin("hot", "s1", "s2", "s3"), "国内").otherwise("国际"))
    plain = [tuple(r) for r in df.collect()]
    got = news.select_news(df, reserved=("s5", "hot")).orderBy("position").collect()
    assert [r["item_id"] for r in got] == greedy(plain, ("s5", "hot"))


@pytest.mark.parametrize(
    ("names", "want"),
    [
        (["a.md", "a.txt", "a-txt.md", "a-txt-2.md"], ["a", "a-txt-3", "a-txt", "a-txt-2"]),
        (["b.md", "b.MD", "b.Md", "b-md-2.txt"], None),
        (["c-md-md.txt", "c-md.md", "c-md.txt", "c.md", "c.txt", "c.markdown"], None),
    ],
)
def test_ids_of_clashing_names(spark, tmp_path, names, want):
    """As if files took their ids one by one in name order."""
    for name in names:
        (tmp_path / name).write_text("text of " + name)
    (tmp_path / "skipped.csv").write_text("a,b")
    got = {r["source_path"]: r["document_id"] for r in files.load_directory(spark, str(tmp_path)).collect()}
    used, expected = set(), {}
    for name in sorted(names):
        stem, suffix = name.rsplit(".", 1)
        free, n = stem, 1
        while free in used:
            free = f"{stem}-{suffix.lower()}" + (f"-{n}" if n > 1 else "")
            n += 1
        used.add(free)
        expected[name] = free
    assert got == expected
    if want:
        assert [got[n] for n in names] == want


def test_feedback_of_other_types_is_refused(spark, tmp_path):
    path = str(tmp_path / "feedback")
    names = ["feedback_id", "question", "answer", "rating", "reason"]
    spark.range(1).select(*[F.lit("x").alias(n) for n in names], F.lit(1).alias("created_at")).write.parquet(path)
    with pytest.raises(ValueError):
        stores.FeedbackStore(spark, path).read()


def test_a_table_that_cannot_be_read_is_an_error(spark, tmp_path):
    broken = tmp_path / "index" / "metadata"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        stores.IndexStore(spark, str(tmp_path / "index")).metadata()
