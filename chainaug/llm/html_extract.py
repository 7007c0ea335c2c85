"""Operator 3: main text of web pages by composite text density (Sun, Song and Liao, 2011).

Every element gets a link-adjusted density: its characters per tag, scaled down the more of
them are links.  The element whose children's densities sum highest holds the text; the least density on
the path from the body to it is the threshold that elements beside that path must reach to be
kept.  Parts that their tag, role, class or id names as no text (menus, notices, forms, comments
and so on) are taken out of the tree first, so they neither count nor appear."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike "
    "strong sub sup time tt u var img wbr br".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "option": ("option", "select"),
          "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
          "thead": ("thead tbody tfoot", "table"), "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
NO_TEXT = frozenset(
    "head script style noscript template iframe object embed applet canvas svg audio video map nav aside footer form fieldset "
    "button select option datalist textarea input label legend menu dialog title xmp noembed noframes".split())
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NO_TEXT_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion nav navbar "
    "navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside footer masthead banner cookie cookies consent "
    "gdpr adsense adsbygoogle adunit commercial notice notices alert alerts popup modal overlay newsletter subscribe subscription signup signin login form forms comment comments "
    "commentlist disqus respond reply replies discussion share sharing social related recommended recommendations widget widgets "
    "toolbar pagination pager paywall".split())
# of these, the ones that class names whole need no links to confirm them inside an article or main element
SURE_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising sponsored adsense adsbygoogle adunit cookie cookies "
    "consent gdpr newsletter comment comments commentlist disqus paywall".split())
LAYOUT_NAMES = frozenset("area bar block body box button buttons container inner items left links list outer right section wrap wrapper".split())
TEXT_NAMES = frozenset("article post entry story content main".split())  # parts whose own header belongs to the text
FRAME_NAMES = frozenset("wrapper wrap container page layout site outer body".split())
WRAPPER_NAMES = frozenset("has with no without layout open closed".split())
TEXT_ROOTS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


class Tree:
    """Elements in page order (an element comes after its parent); ``pieces`` are its texts and elements."""

    def __init__(self) -> None:
        self.tag: list[str] = ["#root"]
        self.attributes: list[str] = [""]
        self.parent: list[int] = [-1]
        self.pieces: list[list[int | str]] = [[]]

    def add(self, tag: str, attributes: str, parent: int) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.parent.append(parent)
        self.pieces.append([])
        self.pieces[parent].append(node)
        return node


def parse(html: str) -> Tree:
    """The element tree, with the end tags that HTML lets authors leave out."""
    tree, open_, at, find, size = Tree(), [0], 0, _MARK.search, len(html)
    tags, pieces = tree.tag, tree.pieces
    count: dict[str, int] = {}

    def close(depth: int) -> None:
        for n in open_[depth:]:
            count[tags[n]] -= 1
        del open_[depth:]

    def close_upto(names: frozenset, stop: frozenset) -> None:
        for name in names:
            if count.get(name):
                break
        else:
            return
        for depth in range(len(open_) - 1, 0, -1):
            tag = tags[open_[depth]]
            if tag in names:
                return close(depth)
            if tag in stop:
                return

    while at < size:
        m = find(html, at)
        if m is None:
            pieces[open_[-1]].append(unescape(html[at:]))
            break
        begin, end = m.span()
        if begin > at:
            pieces[open_[-1]].append(unescape(html[at:begin]))
        at = end
        ends, name, attributes, ends_open, name_open, attributes_open = m.groups()
        name = name or name_open
        if not name:
            continue
        tag = name.lower()
        if ends or ends_open:
            if not count.get(tag):
                continue
            if tags[open_[-1]] == tag:
                open_.pop()
                count[tag] -= 1
                continue
            for depth in range(len(open_) - 1, 0, -1):
                over = tags[open_[depth]]
                if over == tag:
                    close(depth)
                    break
                if tag in INLINE and over not in INLINE:
                    break  # a stray </b> does not end the block it stands in
            continue
        if tag in CLOSES_P:
            close_upto(_P, _P_STOP)
        if tag in CLOSES:
            close_upto(*CLOSES[tag])
        if tag == "body":
            close_upto(_HEAD, frozenset())
        attributes = attributes or attributes_open or ""
        node = tree.add(tag, attributes, open_[-1])
        if tag in VOID or attributes.endswith("/") and tag not in CLOSES_P and tag not in RAW:
            continue
        if tag in RAW:
            close_mark = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close_mark.end() if close_mark else size
            continue
        open_.append(node)
        count[tag] = count.get(tag, 0) + 1
    return tree


_P, _HEAD = frozenset(["p"]), frozenset(["head"])
_P_STOP = frozenset("table td th button caption object".split())


class Named(NamedTuple):
    words: frozenset = frozenset()  # lower-case words of class, id and role
    strong: bool = False  # a class or id means no text by all its words or its last one (of headings and p: a class)
    whole: frozenset = frozenset()  # no-text words of the classes and ids that have no other words
    sure: bool = False  # one of SURE_NAMES is a whole class
    role: bool = False  # the role is one of no text
    header: bool = False
    hidden: bool = False


def _names(tree: Tree, node: int) -> Named:
    words, whole, tag = set(), set(), tree.tag[node]
    strong = sure = role = header = hidden = False
    for m in _ATTRIBUTE.finditer(tree.attributes[node]):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role":
            role = value.strip().lower() in NO_TEXT_ROLES
        elif key in ("class", "id"):
            by_name = key == "class" or tag not in HEADINGS and tag != "p"
            for token in value.split():
                parts = [w.lower() for w in _NAME.findall(token)]
                words.update(parts)
                core = [token.lower()] if token.lower() in NO_TEXT_NAMES else list(parts)
                while len(core) > 1 and core[-1] in LAYOUT_NAMES:
                    core.pop()
                if not core or not by_name:
                    continue
                header |= core[-1] == "header"
                strong |= core[-1] in NO_TEXT_NAMES
                if NO_TEXT_NAMES.issuperset(core):
                    whole.update(core)
                    sure |= key == "class" and not SURE_NAMES.isdisjoint(core)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return Named(frozenset(words), strong, frozenset(whole), sure, role, header, hidden)


_NO_NAMES = Named()


def _mostly_links(tree: Tree, named: list[Named]) -> list[bool]:
    """True for the elements with more than half of their characters in links."""
    n = len(tree.tag)
    chars, links = [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        if tree.tag[k] in NO_TEXT or named[k].hidden:
            continue
        chars[k] += sum(len("".join(p.split())) for p in tree.pieces[k] if isinstance(p, str))
        if tree.tag[k] == "a":
            links[k] = chars[k]
        chars[tree.parent[k]] += chars[k]
        links[tree.parent[k]] += links[k]
    return [2 * a > b for a, b in zip(links, chars)]


def _without_text(tree: Tree) -> list[bool]:
    """True for the elements that are no part of the text, and all below them.

    A name counts by all words of a class or id or by its last one, so 'related-work' says nothing; inside an
    article or main element links must make up most of what it names, or a class must be a sure name."""
    n = len(tree.tag)
    named = [_names(tree, k) if tree.attributes[k] else _NO_NAMES for k in range(n)]
    linked: list[bool] = []
    holds_root = [False] * n  # an article or main element lies below
    for k in range(n - 1, 0, -1):
        if holds_root[k] or tree.tag[k] in TEXT_ROOTS and not (named[k].strong or named[k].role):
            holds_root[tree.parent[k]] = True
    out, in_root, in_text = [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        tag, name = tree.tag[k], named[k]
        up = tree.parent[k]
        in_root[k] = in_root[up] or tag in TEXT_ROOTS
        in_text[k] = in_text[up] or in_root[k] or tag != "body" and bool(name.words & TEXT_NAMES) and not name.words & FRAME_NAMES
        if out[up] or tag in NO_TEXT or name.hidden:
            out[k] = True
        elif tag in ("html", "body") or holds_root[k]:
            continue
        elif tag == "header" or name.header and tag not in TEXT_ROOTS:
            out[k] = not in_text[k]
        elif (name.strong or name.role) and not name.words & WRAPPER_NAMES:
            if tag in TEXT_ROOTS and not in_root[up]:
                # the element of an article may say that it has comments; one that is a comment lies in another
                out[k] = bool(name.whole & {"comment", "reply"})
            elif not in_root[up] or name.role or name.sure and tag not in INLINE:
                out[k] = True
            else:
                linked = linked or _mostly_links(tree, named)
                out[k] = linked[k]
    return out


def densities(tree: Tree, out: list[bool]) -> tuple[list[float], list[float]]:
    """(composite text density, sum of the children's densities) of every element; text that stands
    in an element directly counts as one child."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        if out[k]:
            continue
        own[k] = sum(len("".join(p.split())) for p in tree.pieces[k] if isinstance(p, str))
        chars[k] += own[k]
        if tree.tag[k] == "a":
            link_chars[k], link_tags[k] = chars[k], link_tags[k] + 1
        if k:
            up = tree.parent[k]
            chars[up] += chars[k]
            tags[up] += tags[k] + 1
            link_chars[up] += link_chars[k]
            link_tags[up] += link_tags[k]
    share = link_chars[0] / chars[0] if chars[0] else 0.0
    density, total = [0.0] * n, [float(x) for x in own]
    for k in range(n - 1, 0, -1):
        c = chars[k]
        if out[k] or not c:
            continue
        t, lc, lt = tags[k] or 1, link_chars[k] or 1, link_tags[k] or 1
        base = math.log(c / ((c - link_chars[k]) or 1) * lc + share * c + math.e)
        density[k] = c / t * max(0.0, math.log(c / lc * t / lt + 1e-9) / math.log(base))
        total[tree.parent[k]] += density[k]
    return density, total


def main_text(html: str | None) -> str:
    """The page's main text: white space inside a block is one blank, blocks end with a line."""
    tree = parse(html or "")
    out = _without_text(tree)
    density, total = densities(tree, out)
    best = max(range(len(tree.tag)), key=total.__getitem__)
    if not total[best]:
        return ""
    path = [best]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    body = next((i for i, k in enumerate(path) if tree.tag[k] == "body"), len(path) - 1)
    path = path[: body + 1]
    threshold = min((density[k] for k in path if density[k]), default=0.0)
    roots = [k for k in path if tree.tag[k] in TEXT_ROOTS]
    if roots:  # the page itself says where the text begins and ends
        path = path[path.index(roots[-1]) :]
    keep = [False] * len(tree.tag)
    keep[path[0]] = True
    for inner, outer in zip(path, path[1:]):
        before = True
        for piece in tree.pieces[outer]:
            if piece == inner:
                before = False
            elif isinstance(piece, int) and (density[piece] >= threshold > 0 or before and tree.tag[piece] in HEADINGS):
                keep[piece] = True
    return _render(tree, out, keep)


def _render(tree: Tree, out: list[bool], keep: list[bool]) -> str:
    blocks, block = [], []

    def end() -> None:
        text = " ".join("".join(block).split())
        if text:
            blocks.append(text)
        block.clear()

    todo: list[tuple[int, int, bool]] = [(0, 0, keep[0])]  # element, next piece, inside a kept one
    while todo:
        node, at, kept = todo.pop()
        pieces, is_block = tree.pieces[node], tree.tag[node] not in INLINE
        if at == 0 and is_block:
            end()
        for k in range(at, len(pieces)):
            piece = pieces[k]
            if isinstance(piece, str):
                if kept:
                    block.append(piece)
            elif not out[piece]:
                if tree.tag[piece] == "br":
                    block.append(" ")
                    continue
                todo += [(node, k + 1, kept), (piece, 0, kept or keep[piece])]
                break
        else:
            if is_block:
                end()
    end()
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``page_id, url, text, n_chars``, one row per row.

    A null or empty page, and one without text, has the empty text.  Extra columns are ignored,
    repeated rows kept; pages of any length and depth are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
