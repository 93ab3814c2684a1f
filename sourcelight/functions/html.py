"""HTML and link scalars."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight.functions.batches import runs
from sourcelight.functions.text import strip
from sourcelight.rules import news as N

_WS_RUN = r"[\s\x{1c}-\x{1f}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SLICE_BYTES = 4_000_000  # of the texts that a task holds as Python strings at once


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def unescape(values: pa.Array) -> pa.Array:
    """All named and numeric character references, as the HTML standard has them."""

    def read(v):
        return v if v is None or "&" not in v else html.unescape(v)

    slices = (values.slice(*run).to_pylist() for run in runs(values, SLICE_BYTES))
    return _joined([pa.array([read(v) for v in part], pa.string()) for part in slices])


@F.arrow_udf(T.StringType())
def resolve(base: pa.Array, link: pa.Array) -> pa.Array:
    def join(b, u):
        try:
            return urljoin(b or "", u or "")
        except ValueError:
            return u

    slices = ((base.slice(*run).to_pylist(), link.slice(*run).to_pylist()) for run in runs(link, SLICE_BYTES))
    return _joined([pa.array([join(b, u) for b, u in zip(*part, strict=True)], pa.string()) for part in slices])


def plain_text(c: Column, limit: int = N.SUMMARY_LIMIT) -> Column:
    """Visible text of a fragment, squeezed and cut at ``limit``; 0 keeps all."""
    t = unescape(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"[#*_`>|\[\]]+", " ")
    t = strip(F.regexp_replace(t, _WS_RUN, " "))
    return cut(t, limit) if limit else t


def cut(t: Column, limit: int) -> Column:
    return F.when(
        F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("…"))
    ).otherwise(t)


def summary(c: Column) -> Column:
    """Plain text without read-more phrases and stock sentences."""
    return summary_of_plain(plain_text(c, 0))


def summary_of_plain(t: Column) -> Column:
    """The summary of a fragment whose whole plain text is known."""
    t = strip(F.regexp_replace(cut(t, N.SUMMARY_LIMIT), N.READ_MORE, ""))
    return F.when(t.isin(*N.EMPTY_SUMMARIES), F.lit("")).otherwise(t)


def host(link: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(link, F.lit("HOST"))), F.lit(""))


def allowed_publisher(link: Column) -> Column:
    """Host equals a known publisher or is below it."""
    h = host(link)
    out = F.lit(False)
    for domain in N.PUBLISHERS:
        out = out | (h == domain) | h.endswith("." + domain)
    return out


def source_type(link: Column, source: Column) -> Column:
    path = F.coalesce(F.try_parse_url(link, F.lit("PATH")), F.lit(""))
    depth = F.size(F.split(F.btrim(path, F.lit("/")), "/"))
    return (
        F.when((host(link) == "huggingface.co") & (depth > 2), F.lit("社区作者文章"))
        .when(source.isin(*N.MEDIA_SOURCES), F.lit("专业媒体"))
        .when(host(link) == "github.com", F.lit("官方项目发布"))
        .otherwise(F.lit("官方发布"))
    )


def news_category(title: Column, text: Column, default: Column) -> Column:
    """First class with a keyword in the title or text."""

    def classify(low: Column) -> Column:
        out = default
        for name, words in reversed(N.CATEGORIES):
            hit = low.contains(words[0])
            for w in words[1:]:
                hit = hit | low.contains(w)
            out = F.when(hit, F.lit(name)).otherwise(out)
        return out

    # In a lambda the text is worked out once, however many words ask for it.
    return F.get(F.transform(F.array(F.lower(F.concat_ws(" ", title, text))), classify), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one tag, quoted either way."""
    double = F.regexp_extract(tag, rf'(?i)\s{name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*'([^']*)'", 1)
    return F.when(double != "", double).otherwise(single)


def meta_tags(page: Column) -> Column:
    """Array of (key, content) of all meta tags, keys lower-cased."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def entry(t: Column) -> Column:
        prop = _attribute(t, "property")
        key = F.lower(F.when(prop != "", prop).otherwise(_attribute(t, "name")))
        return F.struct(key.alias("key"), _attribute(t, "content").alias("content"))

    return F.filter(F.transform(tags, entry), lambda m: (m["key"] != "") & (m["content"] != ""))


def meta_value(tags: Column, *keys: str) -> Column:
    """First non-empty value of the first key present."""
    found = [F.get(F.filter(tags, lambda m: m["key"] == keys[0]), F.lit(0))["content"]]
    for key in keys[1:]:
        found.append(_first_of(tags, key))
    return F.coalesce(*found, F.lit(""))


def _first_of(tags: Column, key: str) -> Column:
    return F.get(F.filter(tags, lambda m: m["key"] == key), F.lit(0))["content"]


def images(page: Column) -> Column:
    tags = F.regexp_extract_all(page, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))

    def source(t: Column) -> Column:
        lazy = _attribute(t, "data-src")
        return F.when(lazy != "", lazy).otherwise(_attribute(t, "src"))

    return F.filter(F.transform(tags, source), lambda s: s != "")


def title_key(title: Column) -> Column:
    """Letters and digits of the lower-cased title."""
    return F.regexp_replace(F.lower(title), r"(?U)\W+", "")
