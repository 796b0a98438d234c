"""Main text of web pages by site template removal.

1. Every page is parsed where it lies; each element's subtree gets a hash of
   its tag, class, id, text and children.
2. Spark counts, per host, the pages each subtree occurs on. A subtree on at
   least ``min_pages`` pages is template if it is also on ``min_share`` of the host's
   pages or on as many as their square root (1 % of 10,000 pages, 0.1 % of a million).
   (host, hash) is the key and a page gives each hash once, so a host
   with a third of all pages is summed on the map side like any other.
3. The pages meet their host's templates. Up to ``broadcast_hashes`` templates in
   all are broadcast once a worker, which leaves the pages where they are; more are joined
   by shuffle to the subtrees of each page, salted, so a large host's pages are spread
   over many tasks and a page carries only templates of its own.
4. The pages are parsed again: template subtrees go, and with them what HTML
   itself names as not the article (menus, forms, scripts, ...; classes, ids and
   roles that say so, of inline elements too). What holds the article or most of the page's text
   outside links is never dropped by its layout names, and inside an article only whole
   names count. All that is left is cut in blocks, in <article> or <main> and around them.

An article's running text is never template: a paragraph, list or heading without class and id,
inside <article> or <main> and not made of links, stays however often it
recurs (mirrored articles, repeated sentences).
"""

from __future__ import annotations

import html
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, picked

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_END = re.compile(r"""[>"']""")
FAILED_QUOTES = 64  # tags of a page whose quotes never close, after which quotes are not followed any more
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Names of HTML: elements without content, whose content is not text, that run inside a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_P = HEADINGS | set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header "
    "hgroup hr main menu nav ol p pre search section summary table ul".split())
# an element's start tag ends open elements of these names, up to one of those
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
CELLS = {"td", "th"}  # a table row is one block
PROSE = HEADINGS | set("p li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
SCOPES = ("article", "main")

# What is never the article.
NOT_TEXT = set("head nav aside footer form fieldset menu dialog button select datalist svg math canvas object audio video map".split())
NOT_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOT_WORDS = set(
    "ad ads advert advertisement advertising adverts adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside "
    "comment comments disqus respond replies share sharing social follow subscribe subscription newsletter signup login "
    "related recommended footer widget toolbar pagination pager skip copyright".split())
HEADER_WORDS = {"header", "masthead", "topbar"}  # of the site; an article's own header is its title
# Parts of names beside those words ("share-buttons", "site-footer") that change nothing in what they say.
PLAIN_WORDS = set(
    "bar block box button buttons container content form inner item items left link links list main outer page post posts primary "
    "right section site slot text top bottom unit wrap wrapper".split())
NEVER_TEXT = set("head select datalist svg math canvas object audio video map".split())  # whatever they hold
AROUND = {"form", "fieldset", "header"}  # may stand around an article
SAYS_TAG, SAYS_WORD, SAYS_PART = 1, 2, 3  # what speaks against an element: its tag, a whole name, part of a name


class Element:
    __slots__ = ("tag", "parent", "marked", "says", "scope", "parts", "hash", "chars", "linked", "holds")

    def __init__(self, tag: str, parent: int, marked: bool, says: int, scope: str | None, head: str):
        self.tag, self.parent, self.marked, self.says, self.scope = tag, parent, marked, says, scope
        self.parts, self.hash, self.chars, self.linked, self.holds = [head], 0, 0, 0, False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def _names(attrs: dict[str, str], words: set[str]) -> int:
    """Whether a whole class name or id, or else a part of one, is among the words."""
    found = 0
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if any(x in words for x in parts):
            if all(x in words or x in PLAIN_WORDS or x.isdigit() for x in parts):
                return SAYS_WORD
            found = SAYS_PART
    return found


def _says_other(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """What says that this is not the article's text: the tag, a whole name or role, part of a name, or 0."""
    if tag in NOT_TEXT or (tag == "header" and not in_article):
        return SAYS_TAG
    if not attrs:
        return 0
    if _hidden(attrs):
        return SAYS_WORD
    if tag in ("html", "body") + SCOPES and not set(attrs.get("class", "").lower().split()) & {"comment", "comments"}:
        return 0
    if attrs.get("role", "").lower() in NOT_ROLES:
        return SAYS_WORD
    found = _names(attrs, NOT_WORDS if in_article else NOT_WORDS | HEADER_WORDS)
    return 0 if in_article and found == SAYS_PART else found


def _tokens(page: str):
    """(start, end, closing, name, attributes) of each tag, comment and declaration (these without name).

    Linear in any markup: nothing is looked for that is known not to follow, and quotes
    that never close are followed at most ``FAILED_QUOTES`` times.
    """
    at, last, failed = 0, page.rfind(">"), 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            return
        mark = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt) or page.startswith("<![CDATA[", lt):
            stop, skip = ("-->", 4) if page[lt + 2] == "-" else ("]]>", 9)
            end = page.find(stop, lt + skip)
            end = len(page) if end < 0 else end + 3
            at = (yield lt, end, False, "", "") or end
            continue
        if lt > last:
            return
        if mark in ("!", "?"):
            end = page.find(">", lt) + 1
            at = (yield lt, end, False, "", "") or end
            continue
        closing = mark == "/"
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            at = lt + 1
            continue
        end = page.find(">", name.end())
        if not closing and failed < FAILED_QUOTES:
            place = name.end()
            while place >= 0:
                hit = TAG_END.search(page, place)
                if not hit or hit[0] == ">":
                    place = hit.start() if hit else -1
                    break
                place = page.find(hit[0], hit.end())
                place = place + 1 if place >= 0 else -1
            if place < 0:
                failed += 1
            else:
                end = place
        at = (yield lt, end + 1, closing, name[0].lower(), "" if closing else page[name.end():end]) or end + 1


def parse(page: str | None) -> tuple[list[Element], list[tuple[int, str]]]:
    """Elements (parents before children, hashed) and blocks (element, text) of a page, in page order."""
    root = Element("", -1, False, 0, None, "")
    elements, stack, blocks = [root], [0], []
    opened: dict[str, int] = {}  # open elements by name
    text: list[str] = []
    linked = in_link = 0
    mute, muted = "", 0  # an inline element whose text does not count, and how many of its name are open inside
    page = page or ""
    at = 0

    def flush():
        nonlocal linked, mute
        mute = ""
        if not text:
            return
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if block:
            e = elements[stack[-1]]
            e.parts.append(block)
            e.chars += len(block)
            e.linked += min(linked, len(block))
            blocks.append((stack[-1], block))
        linked = 0

    def close(depth: int):
        flush()
        while len(stack) > depth:
            e = elements[stack.pop()]
            opened[e.tag] -= 1
            e.hash = xxhash.xxh64_intdigest("\x1f".join(e.parts)) >> 1  # fits a signed long
            e.parts = []
            up = elements[e.parent]
            up.parts.append(f"\x1e{e.hash:x}")
            up.chars += e.chars
            up.linked += e.linked

    def close_within(ended: set[str], stops: set[str]):
        if not any(opened.get(x) for x in ended):
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = elements[stack[depth]].tag
            if name in ended:
                close(depth)
                return
            if name in stops:
                return

    tokens = _tokens(page)
    token = next(tokens, None)
    while token:
        start, end, closing, tag, raw = token
        if start > at and not mute:
            text.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        if tag in RAW and not closing:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at) if page.find(">", at) >= 0 else None
            at = stop.end() if stop else len(page)
            text.append(" ")
            try:
                token = tokens.send(at)
            except StopIteration:
                token = None
            continue
        token = next(tokens, None)
        if not tag:  # comment, doctype, processing instruction
            continue
        if closing:
            if tag == "a":
                in_link = 0
            if tag in INLINE:
                if tag == mute:
                    muted -= 1
                    mute = mute if muted else ""
            elif tag in CELLS:
                text.append(" ")
            elif opened.get(tag):
                close(next(d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].tag == tag))
            elif tag == "p":  # HTML makes an empty paragraph of it
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            text.append(" ") if text else None
            continue
        attrs = _attributes(raw) if raw and not raw.isspace() else {}
        if tag in INLINE:
            if mute:
                muted += tag == mute
            elif attrs and (_hidden(attrs) or attrs.get("role", "").lower() in NOT_ROLES or _names(attrs, NOT_WORDS) == SAYS_WORD):
                mute, muted = tag, 1
                text.append(" ")
            in_link = 1 if tag == "a" else in_link
            continue
        if tag in CELLS:
            text.append(" ")
            continue
        if tag in ENDS_P:
            close_within({"p"}, ENDS_P | CELLS)
        if tag in SCOPES:  # a menu that was never closed
            close_within({"nav"}, set(SCOPES))
        if tag in ENDS:
            close_within(*ENDS[tag])
        flush()
        up = elements[stack[-1]]
        scope = tag if tag in SCOPES else up.scope
        marked = bool(attrs.get("class") or attrs.get("id"))
        elements.append(Element(
            tag, stack[-1], marked, _says_other(tag, attrs, up.scope is not None), scope,
            f"{tag}\x1f{attrs.get('class', '')}\x1f{attrs.get('id', '')}" if attrs else tag))
        stack.append(len(elements) - 1)
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(page) and not mute:
        text.append(page[at:])
    close(1)
    flush()
    return elements, blocks


def _own(e: Element) -> int:
    """Characters outside links."""
    return e.chars - e.linked


def _dropped(elements: list[Element]) -> list[bool]:
    """Which elements go by what they say of themselves.

    Never one that holds the page's article by its names: <main>, else the <article> with most text
    outside links. Where that is missing or has less than a quarter of the page's text outside links, part of a
    name ("has-sidebar", "comments-open") does not count against an element with the larger part of
    that text, and a whole name gives way to nine tenths of it. A form or header gives way like part of
    a name, other tags (a side bar that was never closed) only to nine tenths and where no article is elsewhere.
    """
    real = [e for e in elements[1:] if e.tag in SCOPES and not e.says]
    article = max((e for e in real if e.tag == "main"), key=_own, default=None) or max(real, key=_own, default=None)
    whole = _own(elements[0])
    marked = article is not None
    bare = article is None or 4 * _own(article) < whole  # the page's text is not in a marked article
    while article is not None and article.parent >= 0:
        article = elements[article.parent]
        article.holds = True
    out = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        if not e.says:
            continue
        most, nearly = 2 * _own(e) > whole, 10 * _own(e) > 9 * whole
        if e.tag in NEVER_TEXT:
            out[i] = True
        elif e.tag in AROUND:
            out[i] = not e.holds and not (bare and most)
        elif e.says == SAYS_TAG:
            out[i] = not (nearly and (e.holds or not marked))
        elif e.says == SAYS_PART:
            out[i] = not e.holds and not (bare and most)
        else:
            out[i] = not e.holds and not (bare and nearly)
    return out


def subtree_hashes(page: str | None) -> list[int]:
    """Hashes of the subtrees that hold text, each once."""
    elements, _ = parse(page)
    return list({e.hash for e in elements[1:] if e.chars})


def main_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    """All blocks, joined by empty lines, but those of template subtrees and of what names itself other than the article."""
    elements, blocks = parse(page)
    dropped = _dropped(elements)
    gone = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        dropped[i] |= dropped[e.parent]
        running = e.scope and not e.marked and (e.tag in PROSE or e.tag in SCOPES) and 2 * e.linked <= e.chars
        whole = e.tag in ("html", "body") or (e.tag in SCOPES and not dropped[i])
        gone[i] = gone[e.parent] or dropped[i] or (e.hash in templates and not running and not whole)
    return "\n\n".join(block for i, block in blocks if not gone[i])


def _host(url: str):
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _page_hashes(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` but ``html``, and ``hash``: one row for each subtree of a page with a host."""
    keys = [c for c in pages.columns if c != "html"]

    def run(it):
        for pdf in it:
            yield pdf[keys].assign(hash=[subtree_hashes(p) for p in pdf["html"]])

    schema = "".join(f"{c} {pages.schema[c].dataType.simpleString()}, " for c in keys) + "hash array<bigint>"
    return pages.where("host IS NOT NULL").mapInPandas(run, schema).select(*keys, F.explode("hash").alias("hash"))


def template_rows(pages: DataFrame, min_pages: int, min_share: float, salts: int = 64) -> DataFrame:
    """Rows ``(host, hash)``: the subtrees that recur on a host's pages, none gathered."""

    counts = _page_hashes(pages.select("host", "html")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= min_pages).withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(salts)).cast("int"))
    # a small table, one row a host; the salt spreads a large host's hashes over many tasks
    sizes = pages.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return often.join(sizes, ["host", "salt"]).where(
        F.col("n") >= F.least(F.col("pages") * min_share, F.sqrt("pages"))).select("host", "hash")


def host_templates(pages: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """Rows ``(host, templates)``: the template hashes of each host that has any."""
    return template_rows(pages, min_pages, min_share).groupBy("host").agg(F.collect_list("hash").alias("templates"))


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_pages: int = 5, min_share: float = 0.1, salts: int = 64, broadcast_hashes: int = 200_000,
) -> DataFrame:
    """Main text of every page: ``<id_col>``, ``<url_col>``, ``text``, ``n_chars``.

    One row per input row. Null and empty pages have the empty text. Pages
    without a host in their url are extracted without templates.
    """
    src = picked(pages, id=id_col, url=url_col, html=html_col).withColumn("host", _host("url"))
    id_type, url_type = (src.schema[c].dataType.simpleString() for c in ("id", "url"))
    templates = cut(template_rows(src, min_pages, min_share, salts))
    if templates.count() <= broadcast_hashes:  # pages stay where they are
        by_host: dict[str, set[int]] = {}
        for r in templates.collect():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        held = src.sparkSession.sparkContext.broadcast({h: frozenset(x) for h, x in by_host.items()})

        def run(it):
            for pdf in it:
                text = [main_text(p, held.value.get(h, frozenset())) for p, h in zip(pdf["html"], pdf["host"])]
                yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": text})

        out = src.mapInPandas(run, f"id {id_type}, url {url_type}, text string")
    else:  # a salt in the key spreads the pages that share a template over many tasks
        keyed = src.withColumns({
            "k1": F.xxhash64("id", "url", "html"), "k2": F.xxhash64(F.lit(1), F.reverse("html"), "url", "id")})
        salt = F.pmod("k1", F.lit(salts)).cast("int")
        spread = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        own = (
            _page_hashes(keyed.select("k1", "k2", "host", "html")).withColumn("salt", salt)
            .join(spread, ["host", "hash", "salt"], "left_semi")
            .groupBy("k1", "k2").agg(F.collect_set("hash").alias("templates")))
        met = keyed.join(own, ["k1", "k2"], "left")

        def run(it):
            for pdf in it:
                text = [main_text(p, frozenset(() if t is None else (int(x) for x in t))) for p, t in zip(pdf["html"], pdf["templates"])]
                yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": text})

        out = met.select("id", "url", "html", "templates").mapInPandas(run, f"id {id_type}, url {url_type}, text string")
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
