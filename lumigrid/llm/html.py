"""Main-text extraction from HTML: boosted trees over the features of DOM nodes, decoded along the tree.

A page is parsed leniently into a tree of its block elements. Every node gets the log odds of
holding main text from its text density, links, attribute tokens, depth, siblings and ancestors.
Decoding picks the most probable labelling in which nothing below a dropped node is kept. The
model is trained here, on pages made by rule (see pages.py).
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import batch, slices

# HTML element names by role, and words of class, id and role attributes by kind.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
SILENT = frozenset("button canvas datalist head object option select svg audio video".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BARRIERS = ("table", "article", "section", "nav", "aside", "footer", "header", "main", "form", "div")
CONTROLS = frozenset("input button select textarea option".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "tbody", "thead"), "tbody": ("tr", "td", "th", "tbody", "thead")}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "option": ("select",)}
GROUPS = [("article", "main"), ("section",), ("div", "center"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "dl", "menu", "dir"), ("li", "dt", "dd"), ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "legend"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html")]
TOKENS = [
    "nav menu navbar navigation breadcrumb breadcrumbs toc tabs pagination pager".split(),
    "header masthead topbar logo branding".split(),
    "footer copyright colophon legal bottom".split(),
    "sidebar side aside related widget widgets recommended popular trending rail complementary".split(),
    "notice cookie cookies consent gdpr alert banner warning disclaimer popup modal overlay newsletter subscribe".split(),
    "ad ads advert advertisement adverts sponsor sponsored promo promoted".split(),
    "form search login signup register".split(),
    "comment comments disqus reply replies respond discussion feedback reviews".split(),
    "share social follow".split(),
    "article content main post entry body story text".split(),
]

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-k)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_LETTERS = re.compile(r"[a-z]+")
_GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in g}
_KIND_OF = {w: i for i, words in enumerate(TOKENS) for w in words}
_ENDS = {kind: re.compile(rf"</{kind}\s*/?>|</{kind}\s[^>]*>", re.IGNORECASE) for kind in RAW}


class Node:
    __slots__ = ("tag", "parent", "kinds", "key", "depth", "children", "chars", "linked", "direct", "tags", "stops", "commas", "words", "links", "controls", "first")

    def __init__(self, tag: str, parent: int, depth: int, kinds: frozenset, key: bool, first: int):
        self.tag, self.parent, self.depth, self.kinds, self.key, self.first = tag, parent, depth, kinds, key, first
        self.children: list[int] = []
        self.chars = self.linked = self.direct = self.tags = self.stops = self.commas = self.words = self.links = self.controls = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order, and the page's blocks of text as (node, text). Linear in the page, however deep."""
    nodes = [Node("html", -1, 0, frozenset(), False, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, each with the nearest block node
    opened: dict[str, list[int]] = {"html": [0]}  # where in the stack the open elements of each name are
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    owner = silent = linked = total = 0

    def flush():
        nonlocal total
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                blocks.append((owner, text))
                n = nodes[owner]
                n.direct += len(text)
                total += len(text)
                n.stops += text.count(".") + text.count("!") + text.count("?")
                n.commas += text.count(",")
                n.words += text.count(" ") + 1

    def push(tag: str, node: int):
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def pop(to: int):
        """Close open elements down to ``to`` of them."""
        nonlocal silent, linked, owner
        for tag, _ in stack[to:]:
            if tag in BLOCKS:
                flush()
            silent -= tag in SILENT
            linked -= tag == "a"
        for tag, _ in reversed(stack[to:]):
            opened[tag].pop()
        del stack[to:]
        owner = stack[-1][1]

    def last(names) -> int:
        """Where the innermost open element of these names is, 0 for none (or the root)."""
        return max((opened[t][-1] for t in names if opened.get(t)), default=0)

    def close_within(names: tuple[str, ...], scope: tuple[str, ...]):
        at = last(names)
        if at > last(scope):
            pop(at)

    at, size = 0, len(page)
    for_ = _TAG.search
    while at < size:
        m = for_(page, at)
        stop = m.start() if m else size
        if stop > at:
            text = unescape(page[at:stop])
            if stack[-1][0] == "head" and text.strip():
                pop(len(stack) - 1)  # text ends a head left open
            if not silent:
                run.append(text)
                if linked:
                    nodes[owner].linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            place = last((tag,))
            if tag == "p" and not place:
                flush()
            if place and (tag in BLOCKS or place > last(BARRIERS)):  # a stray inline end tag doesn't close blocks around it
                pop(place)
            continue
        attributes = m[3] if m[2] else m[6]
        if opened.get("head") and tag not in IN_HEAD:
            pop(opened["head"][-1])
        nodes[owner].tags += 1
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else size
            nodes[owner].controls += tag in CONTROLS
            run.append(" ")
            continue
        nodes[owner].controls += tag in CONTROLS
        if tag == "br":
            run.append("\n")
        if tag in VOID and tag != "hr":
            continue
        if tag in ("html", "body") and opened.get(tag):
            continue
        if tag in BLOCKS:
            flush()
            if tag in SAME_CLOSES:
                close_within(SAME_CLOSES[tag], SCOPES[tag])
            close_within(("p",), ("table", "td", "th", "button", "object"))
            if tag == "hr":
                continue
            kinds, key = frozenset(), False
            if attributes:
                found = set()
                for name, a, b, c in _ATTRIBUTE.findall(attributes):
                    if name.lower() == "data-k":
                        key = True
                    else:
                        found.update(_KIND_OF[w] for w in _LETTERS.findall((a or b or c).lower()) if w in _KIND_OF)
                kinds = frozenset(found)
            node = len(nodes)
            nodes.append(Node(tag, owner, nodes[owner].depth + 1, kinds, key, total))
            nodes[owner].children.append(node)
            if not attributes.rstrip().endswith("/"):
                push(tag, node)
                owner = node
        else:
            if tag == "a":
                nodes[owner].links += 1
                linked += 1
            silent += tag in SILENT
            push(tag, owner)
    pop(1)
    flush()
    return nodes, blocks


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node; subtree sums are gathered from the leaves up."""
    n = len(nodes)
    sums = np.array([[x.direct, x.linked, x.tags, x.stops, x.commas, x.words, x.links, x.controls] for x in nodes], np.float64)
    parents = np.fromiter((x.parent for x in nodes), np.int64, n)
    kids = np.fromiter((len(x.children) for x in nodes), np.float64, n)
    direct = sums[:, 0].copy()
    rows = sums.tolist()
    for i in range(n - 1, 0, -1):
        p, own = rows[parents[i]], rows[i]
        for k in range(8):
            p[k] += own[k]
    sums = np.array(rows)
    chars, linked, tags, stops, commas, words, links, controls = sums.T
    total = max(1.0, chars[0])
    group = np.fromiter((_GROUP_OF.get(x.tag, len(GROUPS)) for x in nodes), np.int64, n)
    width = len(GROUPS) + 1
    inherited = np.zeros((n, len(TOKENS) + 6))  # from the node itself and everything above it
    place, same = np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        if i:
            inherited[i] = inherited[x.parent]
        for k in x.kinds:
            inherited[i, k] = 1
        g = group[i]
        if 8 <= g <= 12:
            inherited[i, len(TOKENS) + g - 8] = 1
        elif g == 0:
            inherited[i, len(TOKENS) + 5] = 1
        if x.children:
            tally: dict[str, int] = {}
            for c in x.children:
                tally[nodes[c].tag] = tally.get(nodes[c].tag, 0) + 1
            for j, c in enumerate(x.children):
                place[c], same[c] = j, tally[nodes[c].tag] / len(x.children)
    up = np.maximum(parents, 0)
    brothers = kids[up]
    first = np.fromiter((x.first for x in nodes), np.float64, n)
    long_ = np.fromiter((x.direct > 120 for x in nodes), np.float64, n)
    big = np.zeros(n)
    np.add.at(big, up[1:], long_[1:])
    numbers = np.stack([np.fromiter((x.depth for x in nodes), np.float64, n), np.log1p(chars), np.log1p(direct), linked / np.maximum(chars, 1), np.log1p(tags), chars / (tags + 1), np.log1p(stops), stops / np.maximum(words, 1), commas / np.maximum(words, 1), chars / np.maximum(words, 1), np.log1p(words), kids, place, brothers, same, place / np.maximum(brothers, 1), first / total, (first + chars) / total, chars / total, chars / np.maximum(chars[up], 1), np.log1p(links), controls, np.log1p(chars[up]), big], axis=1)
    return np.concatenate([numbers, np.eye(width)[group], np.eye(width)[group[up]], inherited], axis=1)


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The most probable labels such that nothing below a dropped node is kept; the root is kept."""
    yes = -np.logaddexp(0, -odds)
    no = -np.logaddexp(0, odds)
    keep, drop = yes.tolist(), no.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [True] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].parent] and (keep[i] >= drop[i] or nodes[i].tag == "body")
    return out


@lru_cache(maxsize=1)
def model() -> BoostedTrees:
    """Trained on pages that are made by rule; the same in every process."""
    from .pages import labelled_pages

    x, y = [], []
    for page in labelled_pages():
        nodes, _ = parse(page)
        marked = [n.key for n in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            marked[nodes[i].parent] |= marked[i]
        x.append(features(nodes)[1:])
        y.append(marked[1:])
    return BoostedTrees().fit(np.concatenate(x), np.concatenate(y).astype(np.float64))


def extract(pages: list[str], trees: BoostedTrees) -> list[str]:
    """The main texts: kept blocks, joined by an empty line."""
    parsed = [parse(p) for p in pages]
    odds = trees.margin(np.concatenate([features(nodes) for nodes, _ in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for nodes, blocks in parsed:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(text for node, text in blocks if kept[node]))
    return out


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extractor(trees: BoostedTrees):
    def run(batches):
        for whole in batches:
            for b in slices(whole, "html", 4 << 20, 512):
                texts = extract([h or "" for h in b.column("html").to_pylist()], trees)
                yield batch(_TEXTS, b.column("page_id"), b.column("url"), texts, [len(t) for t in texts])

    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none), n_chars.

    Null html counts as empty; ids and urls pass through, null or repeated as they are, and equal
    pages give equal texts. Very long or deeply nested pages take time and memory in proportion to
    their length, one page in memory at least. Other columns are not read, whatever their names;
    an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extractor(model()), "page_id long, url string, text string, n_chars long")
