"""Main text of web pages by site template removal.

Every element's subtree gets a hash of its tags and text, menus and scripts included. Spark counts on how
many different pages of a host, and of a path section of it (`host/first-part/`), each hash is; what is on
a share of them is template and is deleted. What is then left of the page is its `article` or `main`
elements, or the body where it has none, without elements whose tag, role, class or id says menu,
header, footer, sidebar, notice, advert, form, script, style or comment.

Inside an article, paragraphs, headings and the like are text that may well be quoted on many pages and
are never template; outside everything can be. A large host's template may be on a smaller share of its
pages, but never is a number of pages enough by itself. Copies of a page under several urls are one page.
A class or id says menu, advert or the like only if the whole of it does: `share-buttons` is chrome,
`share-prices` isn't. Every page is joined with those of its own subtrees that are template, so a host's
template may have any size.
"""

from __future__ import annotations

import hashlib
import html
import re

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchload.session import cut

SHARE, PAGES = 0.2, 5        # of the pages of a host or section, and pages, that a template's subtree is on at least
LARGE_SHARE, MANY = 0.05, 10     # the same for a host, where the subtree is on so many pages
SALT = 16                    # parts that a host's pages are dealt to

#: fixed values: HTML's void elements, elements with raw text, and what ends an open element of a name
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
summary table tbody tfoot thead tr ul""".split())
IN_LINE = frozenset("option optgroup legend".split())       # blocks that don't end an open paragraph
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
#: fixed values: what marks an element that is no main text
CHROME_TAGS = frozenset("""nav footer aside form script style noscript template iframe head title button select textarea svg canvas
object audio video dialog menu input datalist map search""".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CHROME_WORDS = frozenset("""ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner cookie
cookies consent gdpr notice notices alert sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment
comments disqus share sharing social related recommended newsletter subscribe popup modal overlay widget widgets pagination pager
skip login signup toolbar masthead""".split())
#: words that may stand beside a word of CHROME_WORDS in a class or an id that is chrome
AROUND = frozenset("""a active area article articles bar block blocks body bottom bottombar box btn button buttons card center
col column container content count desktop drawer entry feed fixed form global grid group header heading holder icon icons id
image inline inner item items js label layout left legal link links list logo main message mobile module page panel policy post
posts primary region right row section secondary site slot small social stories sticky strip tab tabs text thread title top
topbar unit view wide wrap wrapper zone""".split())
#: chrome outside of an article only
COMMENT_WORDS = frozenset(["comment", "comments"])
OUTER_TAGS, OUTER_WORDS = frozenset(["header"]), frozenset(["header", "topbar", "top", "bottom"])
#: text elements that are never template inside an article
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt b i em strong a span td th tr code q cite figcaption".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_attr = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


class Element:
    """An element with its children (elements and strings) and, in pass one, its subtree's hash."""

    __slots__ = ("tag", "attrs", "kids", "hash")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.hash = tag, attrs, [], 0


def parse(page: str) -> Element:
    """A tolerant tree: unclosed elements end where HTML says, stray end tags are passed over."""
    root = Element("html")
    stack = [root]
    at, n, lower = 0, len(page), None
    while at < n:
        m = _token.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at:m.start()])
        at = m.end()
        if m[1] is not None:
            stack[-1].kids.append(m[1])
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag in VOID:
                if tag == "br":
                    stack[-1].kids.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                # an inline end tag reaches out of no block but an option
                if stack[k].tag in BLOCK and stack[k].tag not in IN_LINE and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK and tag not in IN_LINE and tag not in ("body", "html"):
            # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in FENCE[tag]:
                    break
                if stack[k].tag in ENDS[tag]:
                    del stack[k:]
                    break
        if tag in ("body", "html"):
            if tag == "body" and any(e.tag == "head" for e in stack):
                del stack[1:]
            continue
        if tag not in ("head", "meta", "link", "title", "style", "script", "base", "noscript") and len(stack) > 1 and stack[1].tag == "head":
            del stack[1:]
        e = Element(tag, m[4])
        stack[-1].kids.append(e)
        if tag in RAW:
            lower = lower or page.lower()
            end = lower.find("</" + tag, at)
            e.kids.append(page[at:end if end >= 0 else n])
            at = n if end < 0 else (page.find(">", end) + 1 or n)
        elif tag not in VOID and not m[4].endswith("/"):
            stack.append(e)
    return root


def _marks(e: Element) -> tuple[list, str, bool]:
    """Words of each class and id, role, hidden or not."""
    if not e.attrs.strip():
        return [], "", False
    attrs = {k.lower(): v.strip("\"'") for k, v in _attr.findall(e.attrs)}
    tokens = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    words = [frozenset(re.split(r"[_-]+", t)) - {""} for t in tokens]
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or \
        "display:none" in attrs.get("style", "").lower().replace(" ", "")
    return words, attrs.get("role", "").lower(), hidden


def chrome(e: Element, inside: bool) -> bool:
    """Whether an element's tag or attributes say that it is no main text."""
    if e.tag in CHROME_TAGS or (not inside and e.tag in OUTER_TAGS):
        return True
    words, role, hidden = _marks(e)
    if e.tag in ("article", "main"):
        return hidden or any(_says(t, COMMENT_WORDS) for t in words)
    which = CHROME_WORDS if inside else CHROME_WORDS | OUTER_WORDS
    return hidden or role in CHROME_ROLES or any(_says(t, which) for t in words)


def _says(token: frozenset, which: frozenset) -> bool:
    """Whether a class or an id, as the set of its words, is one of these: the other words must be neutral ones or have digits."""
    return not token.isdisjoint(which) and all(w in which or w in CHROME_WORDS or w in AROUND or any(c.isdigit() for c in w) for w in token)


def is_main(e: Element) -> bool:
    return e.tag in ("article", "main") or _marks(e)[1] in ("main", "article")


def walk(root: Element, every: bool = False):
    """(element, in an article) of the elements that aren't chrome, or of every one, parents first."""
    stack = [(root, False)]
    while stack:
        e, inside = stack.pop()
        yield e, inside
        for k in reversed(e.kids):
            if isinstance(k, Element):
                now = inside or is_main(k)
                if every or not chrome(k, now):
                    stack.append((k, now))


def number(root: Element) -> None:
    """Set every element's hash: of its tag, its white-space normalised text and its children's hashes."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [k for k in e.kids if isinstance(k, Element)]
    for e in reversed(order):
        h = hashlib.blake2b(e.tag.encode(), digest_size=8)
        for k in e.kids:
            if isinstance(k, Element):
                h.update(k.hash.to_bytes(8, "little", signed=True))
            elif text := " ".join(k.split()):
                h.update(b"\0" + text.encode("utf-8", "surrogatepass"))
        e.hash = int.from_bytes(h.digest(), "little", signed=True)


def may_be_template(e: Element, inside: bool) -> bool:
    return e.tag not in ("html", "body", "br", "img", "hr") and not is_main(e) and not (inside and e.tag in PROSE)


def subtrees(page: str) -> list[int]:
    """The whole page's hash, then the distinct hashes of the subtrees that could be template."""
    root = parse(page)
    number(root)
    return [root.hash] + sorted({e.hash for e, inside in walk(root, every=True) if may_be_template(e, inside) and e.kids})


def main_text(page: str, template: frozenset = frozenset(), lists: bool = True) -> str:
    """The main text: blocks in page order, joined by an empty line. Without `lists` only the template goes
    and the whole body counts (to measure what each step removes)."""
    root = parse(page)
    if template:
        number(root)
    has_main = lists and any(is_main(e) for e, _ in walk(root) if e is not root)
    blocks: list[str] = []
    open_: list[str] = []

    def close() -> None:
        text = " ".join("".join(open_).split())
        if text:
            blocks.append(text)
        open_.clear()

    stack: list = [(root, False, False)]
    while stack:
        item, inside, ends = stack.pop()
        if ends:
            close()
        elif isinstance(item, str):
            if inside or not has_main:
                open_.append(html.unescape(item))
        else:
            inside = inside or is_main(item)
            if item is not root and ((lists and chrome(item, inside)) or (item.hash in template and may_be_template(item, inside))):
                if item.tag in BLOCK:
                    close()
                continue
            if item.tag in ("br", "td", "th", "img"):
                open_.append(" ")
            if item.tag in BLOCK:
                close()
                stack.append((item, inside, True))
            for k in reversed(item.kids):
                stack.append((k, inside, False))
    close()
    return "\n\n".join(blocks)


def host(url):
    """Host of a url column: what stands between the first `://` and `/`, `?`, `#` or the end, in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.lower(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def _section(url):
    """Host and first part of a path that goes on behind it; else null."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    part = F.regexp_extract(rest, r"^[^/?#]*(/[^/?#]+/)[^?#]", 1)
    return F.when(part != "", F.concat(F.col("__host"), part))


def _templates(each: DataFrame, share: float, least: int, many: int, large_share: float) -> DataFrame:
    """(scope, hash) of the subtrees that are template in a scope (a host or a section), by different pages."""
    pages = each.groupBy("scope", "is_host", "body").agg(F.first("subtrees").alias("subtrees"))
    total = pages.groupBy("scope", "is_host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (pages.select("scope", "is_host", F.explode("subtrees").alias("hash")).groupBy("scope", "is_host", "hash")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    n, of = F.col("n"), F.col("pages")
    large = F.col("is_host") & (n >= many) & (n >= large_share * of)
    return counts.hint("merge").join(total, ["scope", "is_host"]).where((n >= share * of) | large).select("scope", "hash")


def extract(pages: DataFrame, share: float = SHARE, least: int = PAGES, many: int = MANY, large_share: float = LARGE_SHARE,
            lists: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html; others are ignored).

    A null or empty page has an empty text. Repeated rows and copies of a page count as one page for the
    shares, and each row gets its text. A subtree that is on exactly the least share of pages is template.
    Pages without a host share no template. Pages of any length are parsed whole, one at a time. An empty
    table gives an empty table.
    """
    rows = pages.select("page_id", "url", "html").withColumn("__host", host(F.col("url"))).withColumn(
        "__page", F.xxhash64(F.to_json(F.struct("page_id", "url")), "html"))     # pages of one number only share their sets of hashes

    @F.pandas_udf("array<long>")
    def hashes(page: pd.Series) -> pd.Series:
        return page.map(lambda p: subtrees(p) if isinstance(p, str) else [])

    parsed = cut(rows.where("__host <> ''").select("__page", "__host", _section(F.col("url")).alias("__section"), hashes("html").alias("hashes")),
                 "page_subtrees").where(F.size("hashes") > 1)
    scopes = F.array(F.struct(F.xxhash64("__host").alias("scope"), F.lit(True).alias("is_host")),
                     F.struct(F.xxhash64("__section").alias("scope"), F.lit(False).alias("is_host")))
    each = (parsed.select("__page", F.col("hashes")[0].alias("body"), F.slice("hashes", F.lit(2), F.size("hashes") - 1).alias("subtrees"),
                          F.explode(F.when(F.col("__section").isNull(), F.slice(scopes, 1, 1)).otherwise(scopes)).alias("of"))
            .select("__page", "body", "subtrees", "of.*"))
    templates = _templates(each, share, least, many, large_share).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64("__page"), F.lit(SALT)).cast("int").alias("__salt")
    own = (each.select("__page", "scope", salt, F.explode("subtrees").alias("hash"))
           .join(templates.hint("merge"), ["scope", "hash", "__salt"])
           .groupBy("__page").agg(F.collect_set("hash").alias("template")))

    @F.pandas_udf("binary")
    def packed(page: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=3).compress
        return page.map(lambda p: pack(p.encode("utf-8", "surrogatepass")) if isinstance(p, str) else None)

    @F.pandas_udf("string")
    def text(page: pd.Series, template: pd.Series) -> pd.Series:
        unpack = zstandard.ZstdDecompressor().decompress
        return pd.Series([main_text(unpack(p).decode("utf-8", "surrogatepass"), frozenset(t) if t is not None else frozenset(), lists)
                          if p is not None else "" for p, t in zip(page, template)], dtype=object)

    # pages move to their templates once, packed
    moved = rows.select("page_id", "url", "__page", packed("html").alias("__packed"))
    out = moved.join(own.hint("merge"), "__page", "left").select("page_id", "url", text("__packed", "template").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
