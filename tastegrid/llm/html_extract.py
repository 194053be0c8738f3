"""Main text of web pages by removing what belongs to the site.

Pass one hashes the subtree of every block element and counts, per host, the pages that hold it; a subtree that recurs on
a large share of a host's pages is template. Pass two reads each page again, drops the template subtrees and the elements
that say by name or class what they are (menus, footers, adverts, forms, comments, ...), and joins what is left of the
article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.session import materialise

#: A subtree on at least this share of a host's pages, and on at least so many, is template.
SHARE = 0.3
MIN_PAGES = 4

# Fixed values of HTML and of common page markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dd dt".split())
SITE_TAGS = frozenset("nav aside footer form menu dialog button select option label fieldset input canvas audio video head".split())
SITE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies discussion disqus "
    "footer form login masthead menu menubar modal nav navbar navigation navi newsletter notice notices notification outbrain overlay pager pagination "
    "popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar topbar widget widgets".split()
)
#: First words of the classes of articles that are reader comments, and last words that only say whether comments are on.
COMMENT_WORDS = frozenset("comment commentlist comments replies reply".split())
COMMENT_STATES = frozenset("closed count disabled enabled off on open".split())
SITE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
ATTRIBUTES = frozenset(["class", "id", "role", "hidden", "style", "aria-hidden"])
#: Raw elements that end themselves where they say so.
FOREIGN = frozenset(["svg", "math"])
#: A class that begins so says what its element has or lacks, not what it is.
LAYOUT = frozenset(["has", "no", "not", "with", "without"])
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)  # texts and elements in page order
    key: int = 0

    def is_site(self, inside: bool) -> bool:
        """Whether name, class, id or role say that the element is no part of the article. ``inside`` an article, headers
        are its own."""
        if self.tag in SITE_TAGS or (self.tag == "header" and not inside):
            return True
        a = self.attrs
        if not a:
            return False
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return True
        if a.get("role", "").lower() in SITE_ROLES:
            return True
        names = [[w.lower() for w in _WORD.findall(name)] for k in ("class", "id") for name in a.get(k, "").split()]
        if self.tag == "article":
            return any(words[0] in COMMENT_WORDS and words[-1] not in COMMENT_STATES for words in names if words)
        named = {w for words in names if words and words[0] not in LAYOUT for w in words}
        return self.tag not in ("body", "html", "main") and bool(named & SITE_WORDS)


def parse(page: str) -> Element:
    """The element tree of a page, also of a broken one: missing end tags are supplied, stray ones ignored."""
    root = Element("#root")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            _close(stack, tag)
            continue
        _make_room(stack, tag)
        e = Element(tag, {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(rest) if k.lower() in ATTRIBUTES} if rest and not rest.isspace() else {})
        stack[-1].parts.append(e)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(page, at)
            if not rest.endswith("/") or (end and tag not in FOREIGN):  # <svg/> is empty, and so is <script/> that nothing ends
                at = end.end() if end else n
        elif tag not in VOID and not rest.endswith("/") or tag in BLOCK:
            if tag not in VOID:
                stack.append(e)
    return root


def _close(stack: list[Element], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if tag not in BLOCK and stack[k].tag in BLOCK:  # an inline end tag does not reach out of its block
            return


def _make_room(stack: list[Element], tag: str) -> None:
    """Close what the start of ``tag`` ends: an open paragraph (with the inline elements in it), the item before."""
    if tag in BLOCK:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in BLOCK:
                break
    if tag in CLOSES:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in SCOPES[tag]:
                break
            if stack[k].tag in CLOSES[tag]:
                del stack[k:]
                break


def hash_blocks(root: Element) -> None:
    """Give every block element a hash of its tag and of all that is in it, bottom up, without recursion."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(p for p in e.parts if isinstance(p, Element))
    for e in reversed(order):
        h = blake2b(e.tag.encode(), digest_size=8)
        for p in e.parts:
            h.update(p.key.to_bytes(8, "big", signed=True) if isinstance(p, Element) else " ".join(p.split()).encode("utf-8", "surrogatepass"))
        e.key = int.from_bytes(h.digest(), "big", signed=True)


def block_keys(page: str | None) -> list[int]:
    """Different hashes of the page's block elements that hold text."""
    root = parse(page or "")
    hash_blocks(root)
    found, todo = set(), [root]
    while todo:
        e = todo.pop()
        if e.tag in BLOCK and e.parts:
            found.add(e.key)
        todo.extend(p for p in e.parts if isinstance(p, Element))
    return sorted(found)


def _is_main(e: Element) -> bool:
    return e.tag == "main" or e.attrs.get("role", "").lower() == "main"


def _beside(main: Element, template: set[int]) -> tuple[bool, bool]:
    """Whether a main element holds running text outside the articles in it that is no template, and whether it holds articles."""
    text = articles = False
    todo = [(main, False)]
    while todo:
        e, running = todo.pop()
        for p in e.parts:
            if isinstance(p, str):
                text = text or running and not p.isspace()
            elif p.tag in RAW or p.is_site(True):
                continue
            elif p.tag == "article":
                articles = True
            elif p.key in template and p.tag in BLOCK:
                continue
            else:
                todo.append((p, running or p.tag in ("p", "pre", "blockquote")))
    return text, articles


def _articles(root: Element, template: set[int]) -> dict[int, bool]:
    """By identity, the outermost elements that hold the page's article: articles that are no reader comments, and main
    elements with running text beside their articles or without any. The value says whether running text directly in it is
    never template."""
    found: dict[int, bool] = {}
    todo = [root]
    while todo:
        e = todo.pop()
        for p in e.parts:
            if isinstance(p, str) or p.is_site(False):
                continue
            if p.tag == "article":
                found[id(p)] = True
                continue
            if _is_main(p):
                text, articles = _beside(p, template)
                if text or not articles:
                    found[id(p)] = not articles
                    continue
            todo.append(p)
    return found


def main_text(page: str | None, template: set[int]) -> str:
    """Text of the page without site elements and template subtrees: white space runs are one space, blocks joined by one.

    Inside an article running text (paragraphs, headings, quotes) is never template, wherever else it stands; beside one,
    in a main element, it may be. Character references are read within a run of text, never across markup.
    """
    if not page:
        return ""
    root = parse(page)
    if template:
        hash_blocks(root)
    chosen = _articles(root, template)
    out: list[str] = []
    todo: list[tuple[object, bool, bool]] = [(root, not chosen, False)]  # what to visit, whether its text counts, whether running text is safe
    while todo:
        e, counts, safe = todo.pop()
        if isinstance(e, str):
            if counts:
                out.append(entities.unescape(e) if "&" in e else e)
            continue
        inside = bool(chosen) and counts
        if e.tag in RAW or e.is_site(inside) and id(e) not in chosen:
            continue
        if id(e) in chosen:
            counts, safe = True, chosen[id(e)]
        elif inside and e.tag == "article":
            safe = True
        if e.key in template and e.tag in BLOCK and e.tag not in ("html", "body", "article", "main") and not (inside and safe and e.tag in FLOW):
            continue
        if e.tag in BLOCK or e.tag == "br":
            out.append(" ")
            todo.append((" ", counts, safe))
        todo.extend((p, counts, safe) for p in reversed(e.parts))
    return " ".join("".join(out).split())


def host_of(url: Column) -> Column:
    """Host of an address in lower case; empty for null and for what is no address."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, template``: the hashes of each host's template subtrees. A host has at most (mean blocks of a page) / share."""
    kept = pages.select(host_of(F.col("url")).alias("host"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([block_keys(h) for h in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["host", "keys"])

    rows = kept.mapInArrow(run, "host string, keys array<long>")
    counted = rows.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "keys")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.where("key IS NULL").select("host", F.col("n").alias("pages"))  # the null key counts the host's pages
    often = counted.where(F.col("key").isNotNull() & (F.col("n") >= min_pages)).join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("key").alias("template"))


def extract(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    Null and empty pages give an empty text. Null urls share one host; repeated rows are pages of their own; null ids are
    rows like any other. Extra columns are ignored; an empty table gives an empty one. The hosts' hashes are written first, so
    Spark knows their size when it joins them by host: it broadcasts them if they are small and else splits the pages of a
    hot host.
    """
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = materialise(templates(pages, share, min_pages), "templates")
    joined = own.join(found, "host", "left").select("page_id", "url", "html", "template")
    kind = joined.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, set(t or ())) for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
