"""Main text of web pages.

Markup says most: where a page marks its article, the article is the text, without the elements that are
known to hold menus, adverts, forms and the like. It is the article only if it holds the larger part of the text
of the page's main part, or of the body; else the main part is the text. A page that marks neither is left
open: of its blocks those runs go that other pages of the same host also have. They are found by the suffix order of
turnstile.llm.suffix, kept apart by host: strings of 50 bytes or more that three distinct texts of a host share, and
one in ten of them, are boilerplate in each of them (both, of two), and the other runs stay. Pages of one
host with one text count as one page, so what is published under several addresses is no boilerplate, nor is
what two pages of many quote.

The shared strings alone cannot decide for marked pages: adverts and menus differ from page to page, while
articles are copied between pages of one host.
"""

from __future__ import annotations

import gc
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import only, ship, stored, tidied
from turnstile.llm.suffix import repeated_spans

#: Elements by what becomes of them.
DROPPED = frozenset("head script style noscript template nav header footer aside form button select option textarea iframe object svg canvas dialog menu datalist audio video map".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
SPACED = frozenset(["br", "td", "th"])
#: Words of class and id names, and roles, of what is not the article.
SIGNS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer comment comments disqus reply replies respond discussion share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay paywall widget toolbar pager pagination search skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Attributes up to the end of a tag; the quantifiers give nothing back, so a try is linear.
ATTRIBUTES = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[a-z]+")
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def unwanted(tag: str, attributes: str) -> bool:
    """Whether an element is not part of any article."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    if named(attributes):
        return True
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDES.search(value):
            return True
    return False


def named(attributes: str) -> bool:
    """Whether the class, id or role of an element names what is not the article."""
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and not SIGNS.isdisjoint(WORDS.findall(value)) or name == "role" and value in ROLES:
            return True
    return False


def blocks(html: str | None) -> list[str]:
    """Text blocks of a page in order: of its articles if it has any, else of its main parts, else of its body."""
    found, met = scanned(html or "")
    return [t for t, where in found if not met or ("article" if "article" in met else "main") in where]


def main_blocks(html: str | None) -> tuple[list[str], bool]:
    """(text blocks of a page in order, whether no element says which of them are the article).

    Articles whose class, id or role names what is not the article go, if the rest is larger. Then the articles
    are the text if they hold the larger part of the main part's, or without one of the body's; else the main part.
    """
    found, _ = scanned(html or "")
    size = lambda rows: sum(len(t) for t, _ in rows)
    rest = [x for x in found if "aside" not in x[1]]
    doubtful = size(found) > 2 * size(rest)
    body = found if doubtful else rest
    main = [x for x in body if "main" in x[1]]
    articles = [x for x in body if "article" in x[1]]
    if articles and not doubtful and 2 * size(articles) > size(main or body):
        return [t for t, _ in articles], False
    return [t for t, _ in main or body], not main


class Tags:
    """Tags and comments of a page from left to right, in time linear in its length.

    A tag ends at the first > outside quotes. A page where a quote is never closed gets its tags from there on cut at the
    first > whatever the quotes; where no > is left, < is text.
    """

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, tag, attributes) of the first one from a place on; the tag of a comment or the like is empty."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if start > self.last:
                start = html.find("<!--", start)
                return (start, len(html), False, "", "") if start >= 0 else None
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), False, "", ""
            if m := TAG.match(html, start):
                found = ATTRIBUTES.match(html, m.end()) if self.quotes else None
                self.quotes = found is not None
                end = found.end() if found else html.index(">", m.end()) + 1
                return start, end, bool(m[1]), m[2].lower(), html[m.end() : end - 1]
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                return start, html.index(">", start) + 1, False, "", ""
            at = start + 1
        return None


def scanned(html: str) -> tuple[list[tuple[str, frozenset[str]]], set[str]]:
    """(blocks, each with those of article, main and aside that it is in; which of article and main there are).

    aside: an article whose class, id or role names what is not the article.
    """
    met: set[str] = set()
    out: list[tuple[str, frozenset[str]]] = []
    now: list[str] = []
    depth = {"article": 0, "main": 0}
    aside: list[int] = []  # the depths at which such articles stand
    at = skipped = 0
    skip = ""

    def flush() -> None:
        if now:
            text = " ".join(unescape("".join(now)).split())
            now.clear()
            if text:
                out.append((text, frozenset([k for k, n in depth.items() if n] + ["aside"] * bool(aside))))

    def text(part: str) -> None:
        if part and not skip:
            now.append(part)

    tags = Tags(html)
    while m := tags.after(at):
        start, end, closing, tag, attributes = m
        text(html[at:start])
        at = end
        if not tag:
            continue
        alone = tag in VOID or attributes.endswith("/") and tag not in BLOCK
        if skip and not closing and skipped == 1 and (skip == "p" and tag in BLOCK or skip == tag == "li"):
            skip, skipped = "", 0  # an element whose end tag may be left out
        if skip:
            if tag == skip and not alone:
                skipped += -1 if closing else 1
                if not skipped:
                    skip = ""
        elif not closing and unwanted(tag, attributes):
            if tag in BLOCK:
                flush()
            if not alone:
                skip, skipped = tag, 1
        elif tag in BLOCK:
            flush()
            if tag in depth:
                met.add(tag)
                depth[tag] = max(0, depth[tag] + (-1 if closing else 1))
                if tag == "article" and not closing and named(attributes):
                    aside.append(depth[tag])
                while aside and aside[-1] > depth["article"]:
                    aside.pop()
        elif tag in SPACED:
            text(" ")
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}", re.I | re.A).search(html, at)
            at = end.start() if end else len(html)
    text(html[at:])
    flush()
    return out, met


def parsed(pages: DataFrame, keep: list[str], html_col: str) -> DataFrame:
    """The kept columns, text: blocks joined by two line ends, and _open: whether no element marks them."""
    ship(pages.sparkSession)
    schema = T.StructType([*[pages.schema[k] for k in keep], T.StructField("text", T.StringType()), T.StructField("_open", T.BooleanType())])

    def run(batches):
        gc.disable()
        for b in batches:
            found = [main_blocks(h) for h in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(["\n\n".join(x) for x, _ in found], pa.string()), pa.array([o for _, o in found], pa.bool_())], names=schema.names)

    return only(pages, *keep, html_col).mapInArrow(tidied(run), schema)


def host(url):
    """The host of a URL, lower-cased; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def unique_runs(kept: bytes | None) -> str:
    """Blocks of what was kept, trimmed; blocks that are gone leave nothing."""
    found = (" ".join(x.split()) for x in (kept or b"").decode("utf-8", "ignore").split("\n\n"))
    return "\n\n".join(x for x in found if x)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text), one row for each row of pages.

    A null or empty page, or one with nothing but boilerplate, has an empty text. Unclosed elements run to the
    next that closes them. Pages of a host with the same text are one page: they do not take from each other.
    Pages without a host share the empty one.
    """
    keep = [id_col, url_col]
    rows, _ = stored(parsed(pages, keep, html_col), "page-texts")
    closed = rows.where(~F.col("_open")).select(*keep, "text")
    open_ = rows.where("_open").select(*keep, "text").withColumn("_host", host(F.col(url_col)))
    row = F.xxhash64("_host", "text")
    spans = repeated_spans(open_.select("_host", "text").distinct().withColumn("_row", row), "_row", "text", scope_col="_host", every=True).select(F.col("_row").alias("_of"), F.col("text_hash"), "kept")

    def texts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([unique_runs(k) for k in b.column(2).to_pylist()], pa.string())], names=["_of", "text_hash", "_text"])

    cut = spans.mapInArrow(texts, "_of long, text_hash long, _text string")
    left = open_.join(cut, (row == F.col("_of")) & (F.xxhash64("text") == F.col("text_hash"))).select(*keep, F.col("_text").alias("text"))
    return closed.unionByName(left)
