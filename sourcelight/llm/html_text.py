"""Main text of web pages by removal of site templates.

Each page is cut into elements once; a subtree's hash covers its tags and its
text. Spark counts, for each host, on how many different pages a subtree
recurs, and subtrees on many pages of a host are its template. A second pass
drops them, and what markup itself declares to be no article (menus, headers,
footers, sidebars, forms, adverts, notices, comments), and returns the blocks
that are left.

Paragraphs and headings of an article are never template by themselves, however
often a site repeats them: a quoted passage or a copied article is still its
text. A box in an article goes if it stands around many different articles.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight.llm.common import salt, salts, saved

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "aside button canvas datalist dialog embed fieldset footer form head iframe input menu nav noscript object option "
    "script select style svg template textarea title video audio map".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words that name page furniture, and words that only say what kind of element it is. A class or id is furniture if
#: it has one of the first and nothing beyond the two: ``share-bar`` is, ``share-price`` and ``navy-theme`` are not.
NOISE = frozenset(
    "ad ads adbox adslot adunit adbanner advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs "
    "comment comments commentlist commentform consent cookie cookies disclaimer disqus footer menu modal nav navbar "
    "navigation newsletter notice notices notification pagination pager popup promo recommended related respond replies "
    "share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets login search".split()
)
KIND = frozenset(
    "area articles bar block bottom box button buttons container content field form group inner items js left link links "
    "list main mobile outer page panel posts primary results right row secondary section site slot stories thread top unit "
    "wrap wrapper".split()
)
#: Only outside of an article, where such a block holds its title.
PAGE_HEAD = frozenset("header masthead".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LABEL = re.compile(r"[a-z]+")


def named(labels: str, words: frozenset[str]) -> bool:
    """Whether a class or id consists of such words and of kinds of elements."""
    for label in labels.lower().split():
        parts = LABEL.findall(label)
        if any(p in words for p in parts) and all(p in words or p in KIND for p in parts):
            return True
    return False


@dataclass
class Node:
    tag: str
    parent: Node | None
    noise: bool
    main: bool
    digest: xxhash.xxh64 = field(default_factory=xxhash.xxh64)
    prose: bool = False  #: a paragraph or heading of an article, or inside one
    own: int = 0  #: hash of the whole subtree, once closed
    length: int = 0


@dataclass
class Block:
    node: Node
    pieces: list[str]
    main: bool
    noise: bool


class Page:
    """Blocks of text in page order, each with the elements around it."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.nodes: list[Node] = []
        self.open: list[Node] = [Node("", None, False, False)]
        self.count: Counter[str] = Counter()  # open elements by tag
        self.block: Block | None = None
        self._read(source)
        while len(self.open) > 1:
            self._close()

    def _read(self, source: str) -> None:
        for token in TOKEN.finditer(source):
            tag = token["tag"]
            if tag is None:
                if token["raw"] or token[0].startswith(("<!--", "<!", "<?", "</")):
                    continue
                self._text(entities.unescape(token[0]))
                continue
            tag = tag.lower()
            if token["close"]:
                self._end(tag)
            else:
                self._start(tag, token["attrs"])

    def _text(self, text: str) -> None:
        if self.block is None:
            node = self.open[-1]
            self.block = Block(node, [], node.main, node.noise)
            self.blocks.append(self.block)
        self.block.pieces.append(text)
        for node in self.open[-1:]:
            node.digest.update(text.encode("utf-8", "replace"))
            node.length += len(text)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self.block = None
            if self.count["p"]:  # an open paragraph ends, with what is open inside it
                self._end("p")
            rivals = CLOSED_BY.get(tag, ())
            for node in reversed(self.open) if any(self.count[r] for r in rivals) else ():
                if node.tag in rivals:
                    self._end(node.tag)
                    break
                if node.tag in ("ul", "ol", "dl", "table", "menu"):
                    break
        if tag == "br":
            self._text(" ")
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            return
        parent = self.open[-1]
        given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)} if "=" in attrs else {}
        role = given.get("role", "").lower()
        main = parent.main or tag in ("article", "main") or role in ("main", "article")
        labels = f"{given.get('class', '')} {given.get('id', '')}"
        noise = (
            parent.noise or tag in NEVER or role in ROLES or "hidden" in re.split(r"[\s=]", attrs.lower())
            or tag not in ("html", "body", "article", "main") and bool(labels.strip()) and (
                named(labels, NOISE) or not parent.main and named(labels, PAGE_HEAD)
            )
            or bool(HIDDEN.search(given.get("style", "")))
            or tag == "article" and bool(re.search(r"comment|reply", labels, re.I))
            or tag == "header" and not parent.main
        )
        prose = parent.prose or main and tag in PROSE
        node = Node(tag, parent, noise, main and not noise, prose=prose)
        node.digest.update(tag.encode() + b"\x00")
        self.open.append(node)
        self.count[tag] += 1
        self.nodes.append(node)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block = None
        if self.count[tag]:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        node = self.open.pop()
        self.count[node.tag] -= 1
        node.own = node.digest.intdigest() - (1 << 63)
        parent = self.open[-1]
        parent.digest.update(node.own.to_bytes(8, "big", signed=True))
        parent.length += node.length
        if node.tag in BLOCKS:
            self.block = None
        return node.tag

    def candidates(self) -> set[int]:
        """Hashes of subtrees with text that a template could hold: not declared noise, no article and no prose of one."""
        return {
            n.own for n in self.nodes
            if not n.noise and n.length and not n.prose and n.tag not in ("article", "main", "body", "html")
        }

    def article(self, template: frozenset[int] = frozenset()) -> list[str]:
        """Texts of the blocks that are left: of articles if the page has any, else of the whole body."""
        kept: list[tuple[Block, str]] = []
        gone: set[int] = set()  # nodes within a template; parents come before their children
        for node in self.nodes if template else ():
            if node.own in template or id(node.parent) in gone:
                gone.add(id(node))
        for block in self.blocks:
            text = " ".join("".join(block.pieces).split())
            if not text or block.noise:
                continue
            if id(block.node) not in gone:
                kept.append((block, text))
        within = [t for b, t in kept if b.main]
        return within if any(n.main for n in self.nodes) else [t for _, t in kept]


def host(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty for null or without ``://``."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[int | None, str, int, int]] = []
        for page, site, source in zip(*(batch.column(i) for i in range(3)), strict=True):
            read = Page(source.as_py())
            body = xxhash.xxh64_intdigest("\n".join(read.article())) - (1 << 63)
            rows.extend((page.as_py(), site.as_py(), own, body) for own in read.candidates())
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page", "host", "subtree", "body"]
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            " ".join(Page(source.as_py()).article(frozenset(drop.as_py() or ())))
            for source, drop in zip(batch.column(2), batch.column(3), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def templates(pages: DataFrame, min_pages: int, spread: int = 16) -> DataFrame:
    """Template subtrees of each page: page, drop (array of hashes); pages without one are missing.

    A subtree is template if it stands around at least ``min_pages`` different
    main texts of its host, however large that is. Counts combine map-side; the join that follows is salted, so that no host or
    subtree is gathered in one task.
    """
    source = pages.select(
        F.col("page_id").cast("bigint"), host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")
    )
    found = saved(
        source.mapInArrow(_subtrees, "page bigint, host string, subtree bigint, body bigint"), "html-subtrees"
    )
    each = found.groupBy("host", "subtree", "body").agg(F.lit(1).alias("one"))
    often = each.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    known = often.select(F.col("host").alias("_h"), F.col("subtree").alias("_t"), salts(spread).alias("_s"))
    seen = found.select("page", "host", "subtree", salt(spread, "page").alias("salt")).distinct()
    hit = seen.join(
        known, (F.col("host") == F.col("_h")) & (F.col("subtree") == F.col("_t")) & (F.col("salt") == F.col("_s"))
    )
    return hit.groupBy("page").agg(F.collect_set("subtree").alias("drop"))


def main_texts(pages: DataFrame, min_pages: int = 8) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    Blocks keep the page's order and are joined by one space; white space inside
    a block becomes one space. Null or empty html, and pages without text, give
    an empty text. Rows that repeat a page_id stay as many as they were; a
    subtree that is template on any of them is dropped from all. A null page_id
    loses only what the markup declares. Other columns are ignored.
    """
    drop = saved(templates(pages, min_pages), "html-templates")
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    both = source.join(drop, F.col("page_id") == F.col("page"), "left").select("page_id", "url", "html", "drop")
    texts = both.mapInArrow(_texts, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
