"""Main text of pages by wrapper induction over pages of the same host.

Pages of a host are dealt to groups of about ``GROUP_PAGES``; hosts with more pages are salted, so no group grows with its
host. Within a group a page's DOM is a small tree (runs of equal siblings are one node). The group's wrapper is the union of
these trees: one after the other is aligned with it by simple tree matching (the largest set of node pairs that keeps parents
and the order of siblings), and what finds no partner is put in. Slots of the wrapper whose text is the same on all pages are
template, those whose text varies are content; copies of a page count once, and ``TEMPLATE_PAGES`` different pages have to agree.
So a banner that a host repeats goes also where it stands inside the article and nothing in the markup says what it is. Where
template would be over ``MOST_TEMPLATE`` of a marked article, the pages are versions of one text, and it stays.

The main region is the element marked as such (main, article), or else the smallest one that holds nearly all varying text. Its
blocks are the text, without template and without elements whose tag or role isn't the article's (menus, footers, notices,
adverts, forms, comments): those vary from page to page as content does, so alignment alone can't tell them.

Null and empty pages have an empty text; null URLs are one host of their own. Repeated rows get repeated results, deep or
broken markup is read as far as it goes, and an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.urlfilter import host_of

#: Pages of one group, about; a constant slot counts as template when all different pages have it, so many at least.
GROUP_PAGES, TEMPLATE_PAGES = 64, 3
#: The share of a marked article that may be template.
MOST_TEMPLATE = 0.25
#: Salted hosts that are broadcast; if more hosts are as large, their table is joined instead.
MOST_BROADCAST = 100_000
#: Levels of the DOM that are aligned; what is deeper belongs to its ancestor's slot.
LEVELS = 24

#: Fixed values of HTML: elements without content, elements whose content is not markup, blocks, and what ends an open p.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
ENDS_P = BLOCK - {"body", "html", "caption", "legend", "tbody", "tfoot", "thead", "tr", "option", "optgroup"}
SAME_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
CELL = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements and words of class, id and role that aren't the article.
OUTSIDE = frozenset("head nav footer aside form script style noscript template iframe textarea button select input option svg canvas object dialog menu title audio video map".split())
ROLES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendation recommendations sidebar menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments reply replies respond discussion disqus login search pagination pager widget widgets toolbar complementary contentinfo skip copyright disclaimer".split()
)
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
LOOSE = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
ROLE = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element; ``parts`` are texts and elements in order, ``path`` its place in the aligned tree."""

    __slots__ = ("tag", "roles", "parts", "hidden", "label", "shape", "path")

    def __init__(self, tag: str, roles: frozenset = frozenset(), hidden: bool = False) -> None:
        self.tag, self.roles, self.parts, self.hidden = tag, roles, [], hidden
        self.label = tag if not roles else f"{tag}.{'.'.join(sorted(roles))}"
        self.shape = self.path = None


@functools.lru_cache(1 << 14)
def _roles(attributes: str, heading: bool = False) -> tuple[frozenset, bool]:
    """Words of class, id, role and label (a heading's id names its section, not its role), and whether an element is hidden."""
    values = " ".join(x for m in ROLE.finditer(attributes) for x in m.groups() if x and not (heading and m[0].lstrip()[:2].lower() == "id"))
    return frozenset(x.lower() for x in PARTS.findall(values)), bool(HIDDEN.search(attributes))


def parse(page: str) -> Node:
    """The DOM of a page, with the usual repairs: implied ends of p, li, table cells; stray ends are skipped."""
    root = Node("#root")
    stack, at, pattern = [root], 0, TAG
    while True:
        m = pattern.search(page, at)
        if m is None:
            if pattern is TAG and "<" in page[at:]:
                pattern = LOOSE  # an unclosed quote: read tags up to the next >
                continue
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if not (tag := (m[2] or "").lower()):
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ENDS_P:
            _close(stack, ("p",), {"table", "td", "th", "button", "object"})
        if tag in SAME_ENDS:
            _close(stack, CELL.get(tag, (tag,)), SAME_ENDS[tag])
        roles, hidden = _roles(m[3], tag in HEADINGS) if m[3] and not m[3].isspace() else (frozenset(), False)
        node = Node(tag, roles, hidden)
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag not in ("svg", "path"):
            stack.append(node)  # a slash doesn't close an HTML element
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def _close(stack: list[Node], tags: tuple, within: set) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in within:
            return


def outside(node: Node, in_article: bool) -> bool:
    """Is an element something else than the article?"""
    if node.tag in OUTSIDE or node.hidden:
        return True
    if node.tag in ("html", "body", "main") or node.tag == "article" and not node.roles & {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo", "related"}:
        return False
    return _is_header(node) and not in_article or bool(node.roles & ROLES - {"header"})


def _is_header(node: Node) -> bool:
    return node.tag == "header" or "header" in node.roles


def blocks(region: Node, in_article: bool) -> list[tuple[str, list[Node]]]:
    """Texts of the blocks of a region in page order, white space made one space, each with its elements from the region down."""
    out, run, above = [], [], [region]

    def flush():
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append((text, above[:]))

    work: list = [iter(region.parts)]
    while work:
        for part in work[-1]:
            if part.__class__ is str:
                run.append(part)
                continue
            tag = part.tag
            if outside(part, in_article):
                if tag in BLOCK:
                    flush()
                continue
            if tag in ("br", "td", "th"):
                run.append(" ")
            if tag in VOID:
                if tag in BLOCK:
                    flush()
                continue
            parts = part.parts
            if _is_header(part) and tag not in HEADINGS:
                parts = [x for x in parts if isinstance(x, Node) and x.tag in HEADINGS]
            if tag in BLOCK:
                flush()
            above.append(part)
            work.append(iter(parts))
            break
        else:
            work.pop()
            if above[-1].tag in BLOCK or not work:
                flush()
            above.pop()
    return out


def shape(node: Node, path: tuple = (), level: int = 0) -> tuple:
    """The tree of labels that is aligned: (label, children), equal neighbours once; elements that are no blocks are left out."""
    below, last = [], None
    node.path = path
    if level < LEVELS:
        for x in node.parts:
            if x.__class__ is Node and x.tag in BLOCK:
                one = shape(x, (*path, len(below)), level + 1)
                if one == last:
                    _renumber(x, len(path), len(below) - 1)
                else:
                    below.append(one)
                    last = one
    node.shape = node.label, tuple(below)
    return node.shape


def _renumber(node: Node, at: int, number: int) -> None:
    """Move an element and what is below it to the place of its equal neighbour."""
    node.path = (*node.path[:at], number, *node.path[at + 1 :])
    for x in node.parts:
        if x.__class__ is Node and x.path is not None:
            _renumber(x, at, number)


@functools.lru_cache(1 << 14)
def matching(a: tuple, b: tuple) -> tuple[int, tuple]:
    """Simple tree matching of two shapes: (pairs matched, ((child of a, child of b), ...))."""
    if a[0] != b[0]:
        return 0, ()
    x, y = a[1], b[1]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + matching(p, q)[0])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return 1 + table[-1][-1], tuple(reversed(pairs))


@functools.lru_cache(1 << 14)
def places(wrapper: tuple, own: tuple, at: tuple = ()) -> dict[tuple, tuple]:
    """Paths of a page's shape to the wrapper's paths that they are aligned with."""
    out = {(): at} if wrapper[0] == own[0] else {}
    for i, j in matching(wrapper, own)[1]:
        for path, to in places(wrapper[1][i], own[1][j]).items():
            out[(j, *path)] = (*at, i, *to)
    return out


def _marked(node: Node) -> Node | None:
    """The element that the page marks as the main one: main, else the longest article not inside another."""
    found: dict[str, list[Node]] = {"main": [], "article": []}
    work = [node]
    while work:
        x = work.pop()
        if x is not node and outside(x, False):
            continue
        if x.tag == "main" or "main" in x.roles and x.tag in ("div", "section"):
            found["main"].append(x)
        elif x.tag == "article":
            found["article"].append(x)
            continue
        work += [y for y in x.parts if isinstance(y, Node)]
    for kind in ("article", "main"):
        if found[kind]:
            return found[kind][0] if len(found[kind]) == 1 else max(found[kind], key=lambda x: sum(len(t) for t, _ in blocks(x, True)))
    return None


def _region(found: list[tuple[str, list[Node]]], weights: list[int]) -> Node | None:
    """The smallest element with nearly all weight; None for the region itself."""
    level, at = 1, None
    while True:
        inside: Counter = Counter()
        for (_, above), w in zip(found, weights, strict=True):
            if len(above) > level and (at is None or above[level - 1] is at):
                inside[above[level]] += w
        best = max(inside, key=inside.__getitem__, default=None)
        if best is None or inside[best] < 0.9 * sum(weights) or best.tag not in ("html", "body", "div", "section", "main", "article", "table", "tbody", "tr", "td"):
            return at
        at, level = best, level + 1


def union(a: tuple, b: tuple) -> tuple:
    """Two shapes laid over each other: aligned children once, all others in their order; a's where the roots differ."""
    if a == b or a[0] != b[0]:
        return a
    out, i, j = [], 0, 0
    for x, y in (*matching(a, b)[1], (len(a[1]), len(b[1]))):
        out += [*a[1][i:x], *b[1][j:y]]
        if x < len(a[1]):
            out.append(union(a[1][x], b[1][y]))
        i, j = x + 1, y + 1
    return a[0], tuple(out)


def wrap(documents: list[str]) -> list[str]:
    """Main texts of pages of one host; their order doesn't matter."""
    roots = [parse(x) for x in documents]
    shapes = [shape(x) for x in roots]
    wrapper = functools.reduce(union, sorted(set(shapes), key=str))
    pages, chosen = [], []
    for root, own in zip(roots, shapes, strict=True):
        marked, to = _marked(root), places(wrapper, own)
        found = blocks(marked or root, marked is not None)
        # Each block with the wrapper's slot of its innermost aligned element, if it has one.
        pages.append([(next((to.get(x.path) for x in reversed(above) if x.path is not None), None), text) for text, above in found])
        chosen.append((marked, found))
    different = {tuple(x) for x in pages}
    held = Counter(x for page in different for x in set(page) if x[0] is not None)
    enough = len(different) >= TEMPLATE_PAGES
    template = {x for x, n in held.items() if enough and n == len(different)}
    out = []
    for (marked, found), page in zip(chosen, pages, strict=True):
        kept = [x not in template for x in page]
        if marked is not None and sum(len(t) for (_, t), k in zip(page, kept, strict=True) if k) < (1 - MOST_TEMPLATE) * sum(len(t) for _, t in page):
            kept = [True] * len(page)
        if marked is None:
            region = _region(found, [len(t) * k for (_, t), k in zip(page, kept, strict=True)])
            kept = [k and (region is None or region in above) for k, (_, above) in zip(kept, found, strict=True)]
        out.append("\n".join(t for (_, t), k in zip(page, kept, strict=True) if k))
    return out


def main_text(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row."""
    rows = df.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.coalesce(html_column, F.lit("")).alias("html"), host_of(F.col(url_column)).alias("host"))
    large = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_PAGES).select(F.col("host").alias("large_host"), F.ceil(F.col("n") / GROUP_PAGES).alias("parts"))
    if large.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        large = F.broadcast(large)
    dealt = rows.join(large, F.col("host") == F.col("large_host"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "url"), F.col("parts")), F.lit(0)))

    def run(pages: pd.DataFrame) -> pd.DataFrame:
        found = wrap(pages["html"].tolist())
        return pd.DataFrame({"id": pages["id"], "url": pages["url"], "text": found, "n_chars": [len(x) for x in found]})

    found = dealt.select("id", "url", "html", "host", "part").groupBy("host", "part").applyInPandas(run, "id long, url string, text string, n_chars long")
    return found.withColumnsRenamed({"id": id_column, "url": url_column})
