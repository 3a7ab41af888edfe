"""Main text of web pages, with site templates removed.

Each page becomes a tree of elements and each element's subtree a hash of its tags,
names and text.  Containers beside the element with most of the page's text also have a
hash of their shape, without text and digits, as menus and footers differ in words from
page to page.  Spark counts, for each host, on how many different pages a subtree stands;
subtrees that stand on a large share of a host's pages are its template and are deleted
first.  What the counts cannot show, as on hosts with few pages, is left to the meaning
of tags, classes and roles.  The text of the article is then read off block by block.

The counts are shuffled as (host, page, subtrees) hashes, one row for each page, and summed map-side, so a
host with a third of all pages only adds to its sums.  The templates of all hosts (at
most a few times the elements of one page for each host) are settled and measured
first; they are broadcast up to ``MAX_BROADCAST`` hashes, so that pages need no
shuffle, and joined by host beyond that, where Spark splits skewed hosts.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.exchange import bounded, settled

#: A subtree is a template if it stands on so many different pages of its host at least, and on this share of them.
MIN_PAGES = 10
MIN_SHARE = 0.5
#: Template hashes (8 bytes each) of all hosts together up to which they are broadcast; beyond it pages and templates are shuffled by host.
MAX_BROADCAST = 1_000_000

# Kinds of elements in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript iframe noembed noframes xmp textarea title".split())
BLOCKS = set("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend".split())
#: Recurring elements that are deleted inside an article too; its headings, paragraphs and lists of their own are its text, however common.
CONTAINERS = set("div section ul ol dl table details address center hr".split())
#: What never belongs to the article's text.
DROPPED = RAW | set("head nav footer aside form button select option input label datalist output dialog menu svg canvas audio video object embed map search".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements that can be a template by their shape.
SHAPED = CONTAINERS | set("nav header footer aside form menu search dialog".split())
ROOTS = ("#page", "html", "body")
#: What attributes and names say is remembered for so many of at most so many characters.
REMEMBERED, SHORT = 4096, 200
_DIGITS = re.compile(r"\d+")
# Words in class, id or role of elements that are no part of an article.
NAMED = "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription paywall signup signin login register nav navbar navigation menu menubar topbar breadcrumb breadcrumbs sidebar sidenav rail complementary contentinfo footer foot masthead toolbar comment comments commentlist respond disqus reply replies discussion share sharing social follow related recommended recommendations more-articles search searchbox pagination pager skip-link widget widgets copyright disclaimer legal".split()
_NAMED = re.compile(r"(?:^|[\s_-])(?:" + "|".join(NAMED) + r")(?:$|[\s_\d-])", re.I)
# Parts of names that only say how the rest of a page is set up, as in has-comments or sidebar-off.
_STATE = re.compile(r"^(?:has|no|with|without|is|not)[-_]|[-_](?:open|closed|enabled|disabled|on|off)$", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_NAME = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _remembered(f: Callable) -> Callable:
    """``f`` of one string, with the results for short ones kept."""
    kept = functools.lru_cache(REMEMBERED)(f)
    return lambda x: kept(x) if len(x) <= SHORT else f(x)


@_remembered
def _name(attrs: str) -> str:
    return " ".join(a or b or c for _, a, b, c in _NAME.findall(attrs))


@_remembered
def _hidden(attrs: str) -> bool:
    return _HIDDEN.search(attrs) is not None


@_remembered
def _named(name: str) -> bool:
    return any(_NAMED.search(t) and not _STATE.search(t) for t in name.split())


@_remembered
def _without_digits(name: str) -> str:
    return _DIGITS.sub("#", name)


class Element:
    """``all``: of a page's root, its elements, parents first."""

    __slots__ = ("all", "attrs", "digest", "kids", "name", "number", "parent", "size", "tag")

    def __init__(self, tag: str, attrs: str, parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Element | str] = []
        self.digest = b""
        self.number = self.size = 0
        self.name = _name(attrs) if attrs else ""


def parse(source: str) -> Element:
    """The page as a tree; end tags may be missing or wrong."""
    root = at = Element("#page", "", None)
    root.all = [root]
    place, size = 0, len(source)
    while place < size:
        for m in _TOKEN.finditer(source, place):
            if m.start() > place:
                at.kids.append(source[place : m.start()])
            place = m.end()
            closing, tag, attrs = m.groups()
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                up = at
                while up is not None and up.tag != tag:
                    up = up.parent
                if up is not None and up.parent is not None:
                    at = up.parent
                continue
            if tag in BLOCKS:
                at = _close(at, {"p"}, {"table", "td", "th", "button"})
            if tag in CLOSED_BY:
                at = _close(at, CLOSED_BY[tag], FENCES[tag])
            new = Element(tag, attrs, at)
            at.kids.append(new)
            root.all.append(new)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, place)
                new.kids.append(source[place : end.start() if end else size])
                place = end.end() if end else size
                break
            if tag not in VOID and not attrs.endswith("/"):
                at = new
        else:
            if place < size:
                at.kids.append(source[place:])
            break
    return root


def _close(at: Element, tags: set[str], fences: set[str]) -> Element:
    """The parent of the outermost open element of ``tags`` within the nearest fence, or ``at``."""
    found, up = at, at
    while up is not None and up.tag not in fences:
        if up.tag in tags:
            found = up.parent
        elif up.tag in BLOCKS and up.tag not in tags and tags == {"p"}:
            break
        up = up.parent
    return found


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


def _downwards(tops: list[Element]) -> list[Element]:
    """Elements with all below them, parents first."""
    order, stack = [], tops[:]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [k for k in e.kids if isinstance(k, Element)]
    return order


def digests(root: Element) -> list[tuple[Element, int]]:
    """Hash of each element's subtree (tags, names and text; white space and other attributes don't count).

    Also notes the size of each element's text.
    """
    out = []
    for e in reversed(root.all):
        parts, size = [f"{e.tag}\0{e.name}\0".encode()], 0
        for k in e.kids:
            if k.__class__ is Element:
                parts.append(k.digest)
                size += k.size
            elif not k.isspace():
                text = " ".join(k.split())
                parts.append(text.encode("utf-8", "replace"))
                size += len(text)
        e.size = 0 if e.tag in RAW else size
        e.digest = hashlib.blake2b(b"".join(parts), digest_size=8).digest()
        e.number = _number(e.digest)
        out.append((e, e.number))
    return out


def shapes(root: Element) -> dict[int, int]:
    """Hash of tags and names, by the element's id, of the containers beside the one with most of the text.

    Digits of names and repeats of a child's shape don't count.  A page whose text is not
    mostly in one element below its body has none, so parts of a text are never judged by
    their shape.  ``digests`` has to have noted sizes.
    """
    path = [root]
    while (next_ := next((k for k in path[-1].kids if isinstance(k, Element) and 2 * k.size > root.size), None)) is not None:
        path.append(next_)
    if path[-1].tag in ROOTS:
        return {}
    below = {id(e) for e in path}
    order = _downwards([k for e in path[:-1] for k in e.kids if isinstance(k, Element) and id(k) not in below and k.tag != "head"])
    found: dict[int, bytes] = {}
    for e in reversed(order):
        parts, last = [f"{e.tag}\0{_without_digits(e.name)}\0".encode()], b""
        for k in e.kids:
            if k.__class__ is Element and k.tag not in RAW and found[id(k)] != last:
                parts.append(last := found[id(k)])
        found[id(e)] = hashlib.blake2b(b"".join(parts), digest_size=8, person=b"shape").digest()
    return {id(e): _number(found[id(e)]) for e in order if e.size and e.tag in SHAPED}


def _text(e: Element) -> str:
    """All text below the element, as it stands."""
    parts, stack = [], [e]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            parts.append(k)
        elif k.tag not in RAW:
            stack += reversed(k.kids)
    return "".join(parts)


def _holds(e: Element, tags: set[str]) -> bool:
    stack = [e]
    while stack:
        k = stack.pop()
        if isinstance(k, Element):
            if k.tag in tags:
                return True
            stack += k.kids
    return False


def _dropped(e: Element, inside: bool, names: bool = True) -> bool:
    """Whether tag or (unless not ``names``) names say that the element is no part of an article."""
    if e.tag in DROPPED:
        return True
    if e.tag in ROOTS or e.tag == "main":
        return False
    if e.tag == "header" and not inside:
        return not _holds(e, {"article", "main"})
    if e.attrs and _hidden(e.attrs):
        return True
    return bool(names and e.name and _named(e.name) and not _holds(e, {"article", "main"} - {e.tag}))


def _blocks(e: Element, gone: set[int]) -> list[str]:
    """Text of each block in page order; ``gone``: ids of deleted elements."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run and (s := " ".join(html.unescape("".join(run)).split())):
            blocks.append(s)
        run.clear()

    stack: list[Element | str | None] = [e]
    while stack:
        k = stack.pop()
        if k is None:
            end()
        elif isinstance(k, str):
            run.append(k)
        elif id(k) not in gone:
            if k.tag == "br":
                run.append("\n")
            elif k.tag in BLOCKS:
                end()
                stack.append(None)
            stack += reversed(k.kids)
    end()
    return blocks


def extract(source: str, templates: set[int]) -> str:
    """The article's text of a page on whose host the subtrees ``templates`` recur.

    If names leave nothing of it, only templates and tags count; if these leave nothing, only tags and names.
    """
    root = parse(source)
    return _read(root, templates) or _read(root, templates, names=False) or (_read(root, set()) if templates else "")


def _read(root: Element, templates: set[int], names: bool = True, tags: bool = True) -> str:
    """The text without templates, then without what tags and names say (unless not ``names``, not ``tags``)."""
    gone: set[int] = set()
    articles: list[Element] = []
    mains: list[Element] = []
    if templates:
        digests(root)
    looks = shapes(root) if templates else {}
    stack: list[tuple[Element, bool]] = [(root, False)]
    while stack:
        e, inside = stack.pop()
        if templates and e.tag not in ROOTS and _recurs(e, inside, looks, templates):
            gone.add(id(e))
            continue
        if _dropped(e, inside, names) if tags else e.tag in RAW or e.tag == "head":
            gone.add(id(e))
            continue
        if e.tag == "article" and not inside:
            articles.append(e)
        elif e.tag == "main" or 'role="main"' in e.attrs:
            mains.append(e)
        stack += [(k, inside or e.tag == "article") for k in reversed(e.kids) if isinstance(k, Element)]
    top = [root] if not tags else [max(articles, key=lambda a: len(_text(a)))] if articles else mains[:1] or [root]
    return "\n".join(_blocks(top[0], gone))


def _recurs(e: Element, inside: bool, looks: dict[int, int], templates: set[int]) -> bool:
    """Whether the element is one of its host's templates; what holds an article or main element is none."""
    if inside:
        return e.tag in CONTAINERS and e.number in templates
    return (e.number in templates or looks.get(id(e)) in templates) and not _holds(e, {"article", "main"})


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the url's host in lower case ("" if it has none)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return pages.select("page_id", "url", "html", host.alias("host"))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host and its template subtrees (array of hashes, with and without text), for hosts that have some.

    Pages that are equal as a whole count once, so copies of a page are no template.
    """

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, subs, whole = [], [], []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = digests(tree := parse(source or ""))
                page = found[-1][1]  # the root's
                mine = {h for e, h in found if e.tag not in RAW and e.tag not in VOID and e.kids} | {page} | set(shapes(tree).values())
                hosts.append(host)
                subs.append(list(mine))
                whole.append(page)
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "subtrees": pa.array(subs, pa.list_(pa.int64())), "page": pa.array(whole, pa.int64())})

    each = pages.select("host", "html").mapInArrow(subtrees, "host string, subtrees array<bigint>, page bigint")
    # equal pages have equal subtrees, and the root's subtree is the page itself: one row for each different page
    different = each.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees")).select("host", "page", F.explode("subtrees").alias("subtree"))
    counts = different.groupBy("host", "subtree").agg(F.count("page").alias("n"), F.max(F.col("subtree") == F.col("page")).alias("root"))
    sizes = counts.filter("root").groupBy("host").agg(F.count("root").alias("pages"))
    return counts.filter(F.col("n") >= min_pages).join(sizes, "host").filter(F.col("n") >= F.col("pages") * F.lit(min_share)).groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The article's text of each row of ``pages``.

    Needs page_id, url and html; others are ignored, whatever their names.  A null or
    empty html gives an empty text; a null url, or one without host, counts as the host
    "".  Repeated rows stay, an empty table gives an empty result.  The article is the
    article element with most text, else the main element, else the whole page.
    White space is what ``str.split`` splits at; br is white space.

    Returns page_id, url, text, n_chars (code points).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("templates").to_pylist()
            texts = [extract(source, set(found or ())) if source else "" for source, found in zip(batch.column("html").to_pylist(), lists, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    hosted = with_host(bounded(pages))
    templates = settled(site_templates(hosted, min_pages, min_share))
    size = templates.agg(F.coalesce(F.sum(F.size("templates") + 8), F.lit(0))).first()[0]
    joined = hosted.join(F.broadcast(templates) if size <= MAX_BROADCAST else templates, "host", "left").select("page_id", "url", "html", "templates")
    return joined.mapInArrow(read, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
