"""Feed rows, page metadata and the capped news selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelight.functions import dates, html
from sourcelight.functions.text import strip
from sourcelight.rules import news as N
from sourcelight.session import stored

ITEM = ("title", "summary", "published", "link", "source", "category", "image", "image_kind", "region")


def _items_per(df: DataFrame, key: str, order: Sequence, limit: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


# --- RSS / Atom -------------------------------------------------------------------


def _elements(entry: Column, *names: str) -> Column:
    """Texts of child elements with any of the local names, in document order."""
    tag = "|".join(names)
    pattern = rf"(?is)<(?:[\w.-]+:)?({tag})(?:\s[^>]*)?(?<!/)>\s*(?:<!\[CDATA\[(.*?)\]\]>|(.*?))\s*</(?:[\w.-]+:)?\1\s*>"
    cdata = F.regexp_extract_all(entry, F.lit(pattern), F.lit(2))
    plain = F.regexp_extract_all(entry, F.lit(pattern), F.lit(3))
    return F.filter(
        F.zip_with(cdata, plain, lambda c, p: F.when(c != "", c).otherwise(html_entities(p))),
        lambda t: strip(t) != "",
    )


def html_entities(c: Column) -> Column:
    """The five XML entities of element text."""
    out = c
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def _first_text(entry: Column, *names: str) -> Column:
    return F.coalesce(strip(F.get(_elements(entry, *names), F.lit(0))), F.lit(""))


def _link(entry: Column) -> Column:
    tags = F.regexp_extract_all(
        entry, F.lit(r"(?is)<(?:[\w.-]+:)?link\b[^>]*(?:/>|>[^<]*</(?:[\w.-]+:)?link\s*>)"), F.lit(0)
    )

    def parse(t: Column) -> Column:
        href = F.regexp_extract(t, r"""(?i)\shref\s*=\s*["']([^"']*)["']""", 1)
        rel = F.regexp_extract(t, r"""(?i)\srel\s*=\s*["']([^"']*)["']""", 1)
        body = F.regexp_extract(t, r"(?is)>\s*(?:<!\[CDATA\[)?([^<\]]*)", 1)
        return F.struct(strip(html_entities(F.when(href != "", href).otherwise(body))).alias("u"), rel.alias("rel"))

    usable = F.filter(
        F.transform(tags, parse), lambda x: x["u"].rlike("^https?://") & x["rel"].isin("", "alternate")
    )
    return F.coalesce(F.get(usable, F.lit(0))["u"], F.lit(""))


def _entry_image(entry: Column, markup: Column) -> Column:
    tags = F.regexp_extract_all(
        entry, F.lit(r"(?is)<(?:[\w.-]+:)?(?:thumbnail|content|enclosure)\b[^>]*>"), F.lit(0)
    )

    def url(t: Column) -> Column:
        address = F.regexp_extract(t, r"""(?i)\s(?:url|href)\s*=\s*["'](https?://[^"']*)["']""", 1)
        picture = (
            t.rlike(r"(?i)^<(?:[\w.-]+:)?thumbnail\b")
            | t.rlike(r"""(?i)\stype\s*=\s*["']image/""")
            | t.rlike(r"""(?i)\smedium\s*=\s*["']image["']""")
            | address.rlike(r"(?i)\.(?:jpe?g|png|webp|gif)(?:\?|$)")
        )
        return F.when(picture, html_entities(address)).otherwise("")

    tagged = F.filter(F.transform(tags, url), lambda u: u != "")
    inline = F.regexp_extract(markup, r"""(?i)<img[^>]+src=["'](https?://[^"']+)""", 1)
    return F.coalesce(F.get(tagged, F.lit(0)), F.nullif(html_entities(inline), F.lit("")))


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """News rows of RSS or Atom documents.

    Input: feed_id, content, source, category, image, region, keywords (may be
    null), use_entry_source. At most the first 4 entries of a feed are read.
    """
    entries = F.regexp_extract_all(
        "content", F.lit(r"(?is)<(?:[\w.-]+:)?(item|entry)\b[^>]*>.*?</(?:[\w.-]+:)?\1\s*>"), F.lit(0)
    )
    rows = feeds.select(
        "feed_id", "source", "category", "image", "region", "keywords", "use_entry_source",
        F.posexplode(F.slice(entries, 1, N.FEED_ITEMS)).alias("entry_no", "entry"),
    )
    e = F.col("entry")
    body = ("description", "summary", "encoded", "content")
    markup = F.array_join(_elements(e, *body), " ")
    own_source = html.plain_text(_first_text(e, "source"), N.SOURCE_LIMIT)
    parsed = rows.select(
        "feed_id",
        "entry_no",
        "keywords",
        html.plain_text(_first_text(e, "title"), N.TITLE_LIMIT).alias("title"),
        html.summary(_first_text(e, *body)).alias("summary"),
        dates.news_date(_first_text(e, "pubdate", "published", "updated", "date")).alias("published"),
        _link(e).alias("link"),
        F.when(F.col("use_entry_source") & (own_source != ""), own_source).otherwise(F.col("source")).alias("source"),
        F.col("category").alias("_default"),
        F.col("image").alias("_logo"),
        _entry_image(e, markup).alias("_photo"),
        "region",
    )
    wanted = F.col("keywords").isNull() | F.expr("rlike(concat_ws(' ', title, summary), concat('(?i)', keywords))")
    return parsed.where((F.col("title") != "") & (F.col("link") != "") & wanted).select(
        "feed_id",
        "entry_no",
        "title",
        "summary",
        "published",
        "link",
        "source",
        html.news_category(F.col("title"), F.col("summary"), F.col("_default")).alias("category"),
        F.coalesce("_photo", "_logo").alias("image"),
        F.when(F.col("_photo").isNotNull(), "photo").otherwise("logo").alias("image_kind"),
        F.coalesce("region", F.lit("国际")).alias("region"),
    )


def parse_releases(payloads: DataFrame) -> DataFrame:
    """News rows of release lists. Input: repo, source, payload (JSON array text)."""
    schema = "array<struct<name:string,tag_name:string,html_url:string,body:string,published_at:string,created_at:string>>"
    rows = payloads.select(
        "repo", "source", F.posexplode(F.slice(F.from_json("payload", schema), 1, N.RELEASE_ITEMS)).alias("release_no", "r")
    )

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(f"r.{n}"), F.lit("")) for n in names], F.lit(""))

    title = html.plain_text(pick("name", "tag_name"), N.TITLE_LIMIT)
    text = html.plain_text(pick("body"))
    fallback = F.concat("repo", F.lit(" 发布了新版本，点击查看变更说明。"))
    owner = F.substring_index("repo", "/", 1)
    return (
        rows.withColumn("_title", title)
        .withColumn("link", pick("html_url"))
        .where((F.col("_title") != "") & F.col("link").rlike("^https?://"))
        .select(
            "repo",
            "release_no",
            F.concat("repo", F.lit(" · "), "_title").alias("title"),
            F.when(text != "", text).otherwise(fallback).alias("summary"),
            dates.news_date(pick("published_at", "created_at")).alias("published"),
            "link",
            "source",
            F.lit("开源生态").alias("category"),
            F.concat(F.lit("https://github.com/"), owner, F.lit(".png?size=480")).alias("image"),
            F.lit("logo").alias("image_kind"),
            F.lit("开源").alias("region"),
        )
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page, link_no, href, block): anchors of a page in document order."""
    pattern = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    hrefs = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    blocks = F.regexp_extract_all("html", F.lit(pattern), F.lit(2))
    return pages.select(
        *[c for c in pages.columns if c != "html"], F.posexplode(F.arrays_zip(hrefs.alias("h"), blocks.alias("b"))).alias("link_no", "_l")
    ).select(
        *[c for c in pages.columns if c != "html"], "link_no", F.col("_l.h").alias("href"), F.col("_l.b").alias("block")
    )


def parse_listing(pages: DataFrame, base: str, path_prefix: str, source: str, default: str, region: str) -> DataFrame:
    """Dated articles linked from a list page; first row wins per link.

    Input: page_id, html. The date is a ``time`` element or a CJK date.
    """
    links = page_links(pages.select("page_id", "html")).withColumn("link", html.resolve(F.lit(base), html.unescape("href")))
    mine = links.where(
        (html.host(F.col("link")).isin(_host(base), _host(base).removeprefix("www.")))
        & F.coalesce(F.try_parse_url("link", F.lit("PATH")), F.lit("")).startswith(path_prefix)
    )
    block = F.col("block")
    heading = F.regexp_extract(block, r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", 2)
    span = F.regexp_extract(block, r'(?is)<span[^>]*class="[^"]*__title[^"]*"[^>]*>(.*?)</span>', 1)
    stamp = html.plain_text(F.regexp_extract(block, r"(?is)<time[^>]*>(.*?)</time>", 1))
    day = F.coalesce(dates.month_day_year(stamp), F.nullif(dates.cjk_date(block), F.lit("")))
    title = html.plain_text(F.when(heading != "", heading).otherwise(span), N.TITLE_LIMIT)
    picture = F.regexp_extract(block, r'(?is)<img[^>]+src="([^"]+)"', 1)
    rows = (
        mine.select(
            "page_id", "link_no", "link", title.alias("title"),
            html.summary(F.regexp_extract(block, r"(?is)<p[^>]*>(.*?)</p>", 1)).alias("summary"),
            day.alias("published"),
            F.when(picture != "", html.resolve(F.lit(base), picture)).otherwise("").alias("image"),
        )
        .where((F.col("title") != "") & F.col("published").isNotNull())
        .withColumn("source", F.lit(source))
        .withColumn("category", html.news_category(F.col("title"), F.col("summary"), F.lit(default)))
        .withColumn("image_kind", F.when(F.col("image") != "", "photo").otherwise("logo"))
        .withColumn("region", F.lit(region))
    )
    first = _items_per(rows, "link", [F.asc("page_id"), F.asc("link_no")], 1)
    return _items_per(first, "source", [F.desc("published"), F.asc("page_id"), F.asc("link_no")], N.LISTED_ITEMS).select(*ITEM)


def _host(url: str) -> str:
    return url.split("//", 1)[-1].split("/", 1)[0]


# --- all sources ---------------------------------------------------------------------


def union_news(feeds: DataFrame, releases: DataFrame, listed: DataFrame) -> DataFrame:
    """All sources as one table of items with ``item_id``, a number that every run gives an item anew.

    ``feeds`` and ``releases`` are the rows of ``parse_feeds`` and
    ``parse_releases``, ``listed`` those of any number of ``parse_listing``.
    The id is a digest of source and link; an item that several sources list
    under the same link and source is one item, the newest of its rows.
    """
    parts = [feeds.select(*ITEM), releases.select(*ITEM), listed.select(*ITEM)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    newest = F.max_by(F.struct(*[c for c in ITEM if c not in ("source", "link")]), F.struct("published", "title", "summary"))
    once = whole.groupBy("source", "link").agg(newest.alias("n")).select("source", "link", "n.*")
    digest = F.sha2(F.concat_ws("|", "source", "link"), 256)
    return once.withColumn("item_id", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))


def source_failures(feeds: DataFrame, payloads: DataFrame, listings: DataFrame) -> DataFrame:
    """(source, reason) of every input that gives no items because it cannot be read; the others go on without it.

    Inputs: source and content (feeds), payload (releases), html (listings).
    """
    bad_feed = F.col("content").isNull() | _ill_formed(F.col("content"))
    list_of = F.from_json("payload", "array<struct<html_url:string>>")
    bad_payload = F.col("payload").isNull() | list_of.isNull()
    parts = [
        feeds.where(bad_feed).select("source", F.lit("feed is not well-formed").alias("reason")),
        payloads.where(bad_payload).select("source", F.lit("release list is not a JSON array").alias("reason")),
        listings.where(F.coalesce(strip(F.col("html")), F.lit("")) == "").select("source", F.lit("page is empty").alias("reason")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ill_formed(xml: Column) -> Column:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return F.from_xml(xml, "_corrupt_record string, channel string", options)["_corrupt_record"].isNotNull()


def well_formed(feeds: DataFrame) -> DataFrame:
    """Feeds that an XML reader accepts."""
    return feeds.where(F.col("content").isNotNull() & ~_ill_formed(F.col("content")))


def latest_news(feeds: DataFrame, payloads: DataFrame, listed: DataFrame, pages: DataFrame) -> DataFrame:
    """The whole path: parse, one union of all sources, selection, then metadata of the selected items' pages alone."""
    items = stored(union_news(parse_feeds(well_formed(feeds)), parse_releases(payloads), listed), label="news")
    chosen = stored(select_news(items), label="chosen-news")  # at most as many rows as are shown
    own = pages.join(F.broadcast(chosen.select(F.col("link").alias("url"))), "url", "left_semi")
    return enrich(chosen, page_metadata(own))


# --- page metadata and enrichment ------------------------------------------------------


def page_metadata(pages: DataFrame) -> DataFrame:
    """(url, image, summary) that allowed publishers supply about their pages."""
    tags = html.meta_tags(F.col("html"))
    image = html.resolve(F.col("url"), html.unescape(html.meta_value(tags, "og:image", "twitter:image")))
    logo = F.lower(image).contains("logo") | (image == F.col("url"))
    own = F.get(
        F.filter(
            html.images(F.col("html")),
            lambda s: s.startswith("https://i.qbitai.com/") & s.contains("/wp-content/uploads/"),
        ),
        F.lit(0),
    )
    shown = F.when(
        html.host(F.col("url")).endswith("qbitai.com") & logo, F.coalesce(own, image)
    ).otherwise(image)
    return pages.where(html.allowed_publisher(F.col("url"))).select(
        "url",
        F.when((shown != F.col("url")) & shown.rlike("^https?://"), shown).otherwise("").alias("image"),
        html.summary(html.meta_value(tags, "og:description", "description")).alias("summary"),
    )


def enrich(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fill missing photos and summaries from page metadata."""
    meta = metadata.select(
        F.col("url").alias("link"), F.col("image").alias("_image"), F.col("summary").alias("_summary")
    )
    text = html.summary(F.col("summary"))
    better = (F.coalesce("_image", F.lit("")) != "") & ~F.col("image_kind").eqNullSafe("photo")
    return (
        items.join(meta, "link", "left")
        .withColumn("summary", F.when(text != "", text).otherwise(F.coalesce("_summary", F.lit(""))))
        .withColumn("image", F.when(better, F.col("_image")).otherwise(F.col("image")))
        .withColumn("image_kind", F.when(better, F.lit("photo")).otherwise(F.col("image_kind")))
        .drop("_image", "_summary")
    )


# --- selection ------------------------------------------------------------------------


def select_news(
    items: DataFrame,
    total: int = N.SELECTED_ITEMS,
    per_source: int = N.PER_SOURCE,
    region: str = N.DOMESTIC_REGION,
    region_items: int = N.REGION_ITEMS,
    reserved: Sequence[str] = N.RESERVED_SOURCES,
) -> DataFrame:
    """Greedy selection: newest first, distinct titles, capped per source.

    Order of phases: up to ``region_items`` of the region from distinct sources,
    the newest item of each reserved source, sources not yet shown, then fill.

    The greedy order only ever looks at a bounded head of the table: an item is
    rejected because of its source or its title, at most ``limit`` of each are
    taken, so a source's first ``limit + per_source`` titles, a title's first
    ``limit + 1`` sources and the first ``head`` rows of each phase decide the
    result exactly. Ranking keys are (source, title) first, so a hot source or
    title is reduced map-side before it meets a window.
    Input: item_id plus the item columns.
    """
    limit = total + region_items + len(reserved)
    deep = limit + per_source
    head = limit + limit * deep + limit * (limit + 1)
    order = [F.desc("published"), F.asc("item_id")]
    keyed = items.withColumn("title_key", html.title_key(F.col("title"))).where(F.col("title_key") != "")
    best = keyed.groupBy("source", "region", "title_key").agg(
        F.max_by(F.struct("published", "item_id", "title"), F.struct("published", -F.col("item_id"))).alias("b")
    )
    best = best.select("source", "region", "title_key", "b.*")
    kept = best
    for keys, n in ((["source", "region"], deep), (["title_key", "region"], limit + 1)):
        w = Window.partitionBy(*keys).orderBy(*order)
        kept = kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    fields = F.struct("published", "item_id", "title_key", "source", "region")
    domestic = kept.where(F.col("region") == region).orderBy(*order).limit(head)
    anywhere = kept.orderBy(*order).limit(head)
    firsts = best.where(F.col("source").isin(*reserved)) if reserved else best.where(F.lit(False))
    firsts = _items_per(firsts, "source", order, 1)
    # At most 2 * head + len(reserved) small rows meet here.
    phases = domestic.select(F.lit(1).alias("p"), fields.alias("x"))
    phases = phases.unionByName(anywhere.select(F.lit(3).alias("p"), fields.alias("x")))
    phases = phases.unionByName(firsts.select(F.lit(2).alias("p"), fields.alias("x")))
    slot = F.array_position(F.array(*[F.lit(s) for s in reserved] or [F.lit("")]), F.col("x.source"))
    keyed_rows = F.struct(
        (-F.col("p")).alias("p"),
        F.when(F.col("p") == 2, -slot).otherwise(0).alias("slot"),
        F.col("x.published").alias("published"),
        (-F.col("x.item_id")).alias("id"),
        F.col("x").alias("x"),
    )
    gathered = phases.groupBy().agg(F.collect_list(keyed_rows).alias("rows"))
    # Ascending on negated keys, then reversed: the day text itself sorts newest first.
    newest = F.transform(
        F.reverse(F.array_sort("rows")), lambda r: F.struct((-r["p"]).alias("p"), r["x"].alias("x"))
    )
    # Phase 4 looks at the rows of phase 3 again.
    again = F.transform(
        F.filter("queue", lambda r: r["p"] == 3), lambda r: F.struct(F.lit(4).alias("p"), r["x"].alias("x"))
    )
    taken_type = "array<struct<item_id:bigint,title_key:string,source:string,region:string,p:int>>"

    def step(taken: Column, row: Column) -> Column:
        x, p = row["x"], row["p"]
        same_source = F.size(F.filter(taken, lambda t: t["source"] == x["source"]))
        in_region = F.size(F.filter(taken, lambda t: t["p"] == 1))
        room = (
            F.when(p == 1, (in_region < region_items) & (same_source == 0))
            .when(p == 2, F.lit(True))
            .when(p == 3, (F.size(taken) < total) & (same_source == 0))
            .otherwise(F.size(taken) < total)
        )
        new_title = ~F.exists(taken, lambda t: t["title_key"] == x["title_key"])
        entry = F.struct(
            x["item_id"].cast("bigint").alias("item_id"),
            x["title_key"].alias("title_key"),
            x["source"].alias("source"),
            x["region"].alias("region"),
            p.cast("int").alias("p"),
        )
        return F.when(room & new_title & (same_source < per_source), F.concat(taken, F.array(entry))).otherwise(taken)

    chosen = (
        gathered.select(newest.alias("queue"))
        .select(F.concat("queue", again).alias("queue"))
        .select(F.aggregate("queue", F.array().cast(taken_type), step).alias("taken"))
        .select(F.posexplode("taken").alias("position", "t"))
        .select(
            (F.col("position") + 1).alias("position"),
            F.col("t.item_id").alias("item_id"),
            F.col("t.p").alias("phase"),
        )
    )
    # `chosen` has at most limit rows by construction.
    return items.join(F.broadcast(chosen), "item_id")
