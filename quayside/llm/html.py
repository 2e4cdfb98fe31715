"""Main text of web pages with site template removal (operator 7).

A page becomes an element tree.  All its subtrees are hashed over tags, classes
and text and counted by host over distinct pages; one that recurs on some pages
of its host is the site's template and goes.  Where a good part of what stands in a
slot of a host, a path of tags and classes, are templates, the rest of the slot goes
too: a menu or an advert that only a few pages have is no less the site's.

Of what is left the articles are taken, or else the main element, or the body, and
subtrees that are menus, adverts and the like by their tag, role or class go as well,
on hosts of any size.  A class that tells of a state (`has-sidebar`, `menu-open`) names
nothing, code inside `pre` has no listed classes, and where a page would be left
without its article, or without most of its prose, the listed wrapper of it stays.

Paragraphs, headings and other prose blocks of an article are never templates,
as an article may well quote what another one says; containers inside an article
are.  Nor is what holds an article or main element.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import bound_batches, cut, read_table

#: A subtree is a template from so many distinct pages of its host on.
MIN_PAGES = 5
#: Share of a slot's subtrees that are templates from which on the whole slot goes.
SLOT_SHARE = 0.2
#: Bytes of templates that may be broadcast; beyond, the pages' subtrees are joined with them.
BROADCAST_BYTES = 16 << 20

# --- fixed sets of names ------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object xmp".split())
UNSHOWN = frozenset("head button select canvas audio video".split()) | RAW - {"xmp"}
GONE = frozenset("nav footer aside form dialog menu".split()) | UNSHOWN
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption hr address fieldset details summary center header hgroup".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr b i em strong a span code q cite sub sup u s small br hr img".split())
KEPT = frozenset("html body article main".split())
ENDS_P = BLOCK - {"html", "body"} | {"footer", "nav", "aside", "form"}
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
GONE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended widget comment comments reply replies "
    "disqus respond toolbar pagination pager".split()
)
HEADER_WORDS = frozenset(["header"])
WRAPPER_WORDS = frozenset("nav navbar navigation menu sidebar header banner masthead footer widget toolbar modal overlay popup share sharing social".split())
ARTICLES = frozenset(["article", "main"])
RUNNING = frozenset("p blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_STATE = re.compile(r"(?:^|\s)(?:(?:has|is|with|without)-\S+|\S+-(?:open|opened|closed|enabled|disabled|active|expanded|collapsed))(?=\s|$)")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "children", "hash", "slot", "gone", "unshown", "rooted", "holds", "coded", "words", "size", "prose", "article")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.hash = self.slot = self.size = self.prose = 0
        self.gone = self.unshown = self.rooted = self.holds = self.coded = self.article = False
        self.words: set[str] = set()


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def parse(source: str) -> Node:
    """The element tree; end tags that HTML implies are supplied, and an unclosed rest belongs to what is open."""
    root = Node("html", {})
    stack, at, end = [root], 0, len(source)
    while at < end:
        lt = source.find("<", at)
        m = _TOKEN.match(source, lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a < that opens nothing is text
            lt = source.find("<", lt + 1)
            m = _TOKEN.match(source, lt) if lt >= 0 else None
        stop = lt if lt >= 0 else end
        if stop > at:
            stack[-1].children.append(references.unescape(source[at:stop]))
        if m is None:
            break
        at = m.end()
        slash, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "body") and (tag == "html" or any(n.tag == "body" for n in stack)):
            continue
        if tag in ENDS_P:
            _close(stack, {"p"}, {"td", "th", "div", "article", "section", "main", "body", "html", "li", "blockquote"} - {"p"})
        if tag == "li":
            _close(stack, {"li"}, {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            _close(stack, {"dt", "dd"}, {"dl"})
        elif tag in ("td", "th"):
            _close(stack, {"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            _close(stack, {"tr"}, {"table"})
        node = Node(tag, _attributes(raw))
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            if tag == "xmp":  # shown as it stands
                node.children.append(source[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not raw.endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str], within: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in within:
            return


def _words(node: Node) -> set[str]:
    named = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return set(_SPLIT.split(_STATE.sub(" ", _CAMEL.sub("-", named).lower()))) if named != " " else set()


def mark(root: Node) -> None:
    """Mark what goes by tag, role or class, what stands inside an article or main element, and hash every subtree and its slot."""
    order: list[Node] = []
    root.slot = 1
    todo = [root]
    while todo:  # no recursion: pages nest as deep as they like
        node = todo.pop()
        order.append(node)
        inside = node.rooted or node.tag in ARTICLES
        if node.tag in GONE or node.attrs.get("role", "").lower() in GONE_ROLES or "hidden" in node.attrs:
            node.gone = node is not root
        elif node.attrs and not node.coded and node.tag not in ("html", "body", "main"):
            node.words = _words(node) & (GONE_WORDS if node.rooted or node.tag == "article" else GONE_WORDS | HEADER_WORDS)
            node.gone = bool(node.words)
        if node.tag == "header" and not node.rooted:
            node.gone = True
        node.unshown = node is not root and (node.tag in UNSHOWN or "hidden" in node.attrs)
        for c in node.children:
            if isinstance(c, Node):
                c.rooted, c.coded = inside, node.coded or node.tag == "pre"
                c.slot = xxhash.xxh64_intdigest(f"{node.slot:x}/{c.tag}.{c.attrs.get('class', '')}") - (1 << 63)
                todo.append(c)
    for node in reversed(order):
        if node.tag == "header" and node.rooted and not any(isinstance(c, Node) and (c.tag in HEADINGS) for c in node.children):
            node.gone = True
        node.holds = any(isinstance(c, Node) and (c.holds or c.tag in KEPT) for c in node.children)
        node.article = any(isinstance(c, Node) and (c.article or c.tag in ARTICLES and not c.gone) for c in node.children)
        if not node.unshown:
            node.size = sum(len(c) - c.count(" ") if isinstance(c, str) else c.size for c in node.children)
            node.prose = node.size if node.tag in RUNNING else sum(c.prose for c in node.children if isinstance(c, Node))
        parts = [node.tag, node.attrs.get("class", ""), node.attrs.get("id", "")]
        for c in node.children:
            parts.append(format(c.hash, "x") if isinstance(c, Node) else " ".join(c.split()))
        node.hash = xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)
    _spare_wrappers(root)


def _spare_wrappers(root: Node) -> None:
    """Unlist the wrappers of a page's article, or without one of most of its prose, that the lists took by mistake."""
    while True:
        outer, found, todo = [], False, [root]
        while todo:
            node = todo.pop()
            if node.gone:
                outer += [] if node.unshown else [node]
            elif node.tag in ARTICLES:
                found = True
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        around = [n for n in outer if n.article]
        if found or not (around or not root.article):
            return
        if not around:
            around = [n for n in outer if n.words and n.words <= WRAPPER_WORDS and n.prose * 2 > root.size]
        if not around:
            return
        max(around, key=lambda n: n.prose).gone = False


def articles(root: Node) -> list[Node]:
    """The outermost articles that no list takes, else main elements, else the whole."""
    for tag in sorted(ARTICLES):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.gone:
                continue
            if node.tag == tag:
                found.append(node)
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return [root]


def _deletable(node: Node) -> bool:
    return node.tag not in KEPT and not node.holds and not (node.rooted and node.tag in PROSE)


def candidates(source: str) -> set[tuple[int, int]]:
    """(hash, slot) of all subtrees of a page that may be templates, those that tag, role and class take among them."""
    root = parse(source)
    mark(root)
    out: set[tuple[int, int]] = set()
    todo = [root]
    while todo:
        node = todo.pop()
        if node is not root and node.children and _deletable(node):
            out.add((node.hash, node.slot))
        todo += [c for c in node.children if isinstance(c, Node)]
    return out


class Site(NamedTuple):
    """What a host's pages tell: template hashes, and slots that go."""

    templates: frozenset[int] = frozenset()
    slots: frozenset[int] = frozenset()

    def takes(self, node: Node) -> bool:
        return (node.hash in self.templates or node.slot in self.slots) and _deletable(node)


def removals(source: str, site: Site = Site()) -> tuple[int, int, int]:
    """How many outermost subtrees that have text go as the site's and by the lists alike, as the site's only, and by the lists only."""
    root = parse(source)
    mark(root)
    both, only, listed, todo = 0, 0, 0, [root]
    while todo:
        node = todo.pop()
        if node.unshown:
            continue
        template = node is not root and site.takes(node)
        if template or node.gone:
            both, only, listed = both + (template and node.gone), only + (template and not node.gone), listed + (not template)
        else:
            todo += [c for c in node.children if isinstance(c, Node)]
    return both, only, listed


def main_text(source: str, site: Site = Site(), lists: bool = True) -> str:
    """The text that is left, a line for each block; without `lists` what the site's rules alone leave of the body."""
    root = parse(source)
    mark(root)
    done: list[str] = []
    open_: list[str] = []

    def flush() -> None:
        line = " ".join("".join(open_).split())
        open_.clear()
        if line:
            done.append(line)

    for top in articles(root) if lists else [root]:
        todo: list = [top]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                open_.append(item)
            elif item.tag == "br":
                open_.append(" ")
            elif item is top or not (site.takes(item) or (item.gone if lists else item.unshown)):
                if item.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo += reversed(item.children)
        flush()
    return "\n".join(done)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, hashes, slots, pages = [], [], [], []
        for host, source, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = candidates(source)
            hosts += [host] * len(found)
            hashes += [h for h, _ in found]
            slots += [s for _, s in found]
            pages += [page] * len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (hashes, slots, pages))], ["host", "hash", "slot", "page"]
        )


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))


def _named(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, html, page): a page is named by a hash of its source."""
    source = F.col(f"`{html_col}`")
    return pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), source.alias("html"), F.xxhash64(source).alias("page")).filter("html IS NOT NULL")


def subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, hash, slot, page): the subtrees of every distinct page."""
    return _named(pages, url_col, html_col).mapInArrow(_counted, "host string, hash long, slot long, page long").distinct()


#: Kinds of site_rules().
TEMPLATE, SLOT = 0, 1


def site_rules(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, kind, value): hashes of subtrees that recur on min_pages distinct pages of a host, however many it has, and
    slots of which a share of SLOT_SHARE and more do."""
    counts = cut(subtrees(pages, url_col, html_col).groupBy("host", "slot", "hash").count())
    often = F.col("count") >= min_pages
    templates = counts.filter(often).select("host", F.lit(TEMPLATE).alias("kind"), F.col("hash").alias("value")).distinct()
    share = F.sum(F.when(often, F.col("count")).otherwise(0)) / F.sum("count")
    slots = counts.groupBy("host", "slot").agg(share.alias("share")).filter(F.col("share") >= SLOT_SHARE).select("host", F.lit(SLOT).alias("kind"), F.col("slot").alias("value"))
    return templates.unionByName(slots)


def site_of(rules: list[tuple[int, int]]) -> Site:
    return Site(*(frozenset(v for k, v in rules if k == kind) for kind in (TEMPLATE, SLOT)))


def by_host(rules: DataFrame) -> dict[str, Site]:
    """Rules that fit a broadcast, on the driver."""
    found: dict[str, list[tuple[int, int]]] = {}
    for host, kind, value in rules.toLocalIterator():
        found.setdefault(host, []).append((kind, value))
    return {host: site_of(x) for host, x in found.items()}


def _extracted(batches: Iterator[pa.RecordBatch], sites: dict[str, Site] | None) -> Iterator[pa.RecordBatch]:
    """Columns page_id, url, html and the host, or without `sites` the rules that the page meets."""
    for batch in batches:
        known = batch.column(3).to_pylist()
        of_page = [sites.get(x, Site()) for x in known] if sites is not None else [site_of([(r["kind"], r["value"]) for r in x or ()]) for x in known]
        texts = [main_text(source, site) if source else "" for source, site in zip(batch.column(2).to_pylist(), of_page, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES
) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of `pages`.

    A null or empty html has the empty text.  Pages without a host in their url
    count as one site.  Copies of a page count once towards a template.  Repeated
    rows repeat, an empty table gives no rows, and other columns are not read.
    """
    bound_batches(pages.sparkSession)
    rules = cut(site_rules(pages, url_col, html_col, min_pages))
    size = rules.agg(F.sum(F.length("host") + 16)).first()[0] or 0
    source = F.col(f"`{html_col}`")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").alias("url"),
        source.alias("html"),
        host_of(F.col(f"`{url_col}`")).alias("host"),
        F.xxhash64(source).alias("page"),
    )
    made = "page_id long, url string, text string, n_chars long"
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast(by_host(rules))
        return rows.select("page_id", "url", "html", "host").mapInArrow(lambda it: _extracted(it, shared.value), made)
    trees = subtrees(pages, url_col, html_col)
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col(value).alias("value"))
    own = trees.select("host", "page", F.explode(F.array(pair(TEMPLATE, "hash"), pair(SLOT, "slot"))).alias("r")).select("host", "page", "r.*").distinct()
    met = own.join(rules, ["host", "kind", "value"])  # Spark splits the partitions of slots that many pages have
    of_page = met.groupBy("host", "page").agg(F.collect_set(F.struct("kind", "value")).alias("rules"))
    joined = rows.join(of_page, ["host", "page"], "left").select("page_id", "url", "html", "rules")
    return joined.mapInArrow(lambda it: _extracted(it, None), made)


def op7_html_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))
