"""Main text of web pages: boosted trees judge the nodes of the page's tree, a hierarchical decoding decides.

A page is parsed into a tree of elements. Each element that carries text has features: size, link and markup density of its
subtree, tokens of its tag, class, id and role, depth, and its place among its siblings. Gradient-boosted trees (``boost``,
trained here) give it the log-odds of being main text. The decoding takes for the whole tree the choice of
greatest total: an element is either dropped with everything in it, or kept with each child decided again, so a kept element never lies
in a dropped one.

There are no marked pages. The trees learn from the page's own semantic markup on a bounded sample (``SAMPLE_PAGES``
pages, by a hash of their id): what stands in article or main and in nothing that its tag or its attribute tokens
name as boilerplate is text. Each sampled page is shown a second time in another layout (``varied``), and half of the
training rows without the names of article and main, so that the trees also judge pages of other makes.

Text: character references are decoded, white space in a block becomes one space, blocks are joined by a line break in
page order; a block ends at each block-level tag and at br. Nothing else is dropped or cut.

Defined cases: null html is empty; a page without any element of text gives an empty text; tags that are never closed
end with their parent; an unclosed script or style takes the rest of the page; text outside of every element belongs to
the page's root; rows with one id are judged alone; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import blocks, bounded_sample, mapped, out, pick, table

SAMPLE_PAGES = 400
TREES = 40
DEPTH = 3
RATE = 0.2
BINS = 24

# Fixed values of the HTML standard, in its groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template iframe canvas audio video select textarea datalist".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
                  "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br html body".split())
#: A new one of these ends an open one of the second group, up to the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
BAD_TOKENS = frozenset(
    "nav navigation navbar menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar side aside widget ad ads advert adverts advertisement advertising "
    "sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations more pagination pager tags toolbar "
    "search form copyright legal hidden skip toc outbrain taboola paywall contentinfo complementary dialog tooltip feedback rating reader responses".split())
GOOD_TOKENS = frozenset("article main content post entry story text body page blog news maincontent articlebody".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACES = re.compile(r"[\s]+")


class Node:
    __slots__ = ("tag", "tokens", "hidden", "parent", "children", "parts", "order")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.children, self.parts = tag, parent, [], []
        tokens: set[str] = set()
        self.hidden = False
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                tokens.update(x.lower() for x in _TOKEN.findall(value))
            self.hidden |= name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and value == "true"
        self.tokens = tokens


def parse(html: str) -> Node:
    """The tree of a page; ``parts`` of a node are its texts (str) and its children (Node), in order."""
    root = Node("#root", "", None)
    at, here, end = 0, root, len(html)

    def text(s: int, e: int) -> None:
        if e > s:
            here.parts.append(html[s:e])

    while True:
        m = _TAG.search(html, at)
        if not m:
            text(at, end)
            return root
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            elif tag in ("p", "br"):
                here.parts.append(Node("br", "", here))
            continue
        if tag in CLOSES_P or tag in IMPLIED:
            ends, stop = IMPLIED.get(tag, ((), ()))
            node = here
            while node is not root and node.tag not in stop and (node.tag in ends or node.tag == "p" or node.tag not in BLOCK):
                if node.tag in ends or node.tag == "p":
                    here = node.parent
                node = node.parent
        child = Node(tag, m[3], here)
        here.children.append(child)
        here.parts.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            child.parts.append(html[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            here = child


def nodes_of(root: Node) -> list[Node]:
    """All nodes but silent and hidden ones and what is in them, parents first."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in SILENT or node.hidden:
            continue
        node.order = len(found)
        found.append(node)
        stack.extend(reversed(node.children))
    return found


TAGS = ["p", "div", "section", "article", "main", "ul", "ol", "li", "a", "span", "h1", "h2", "h3", "table", "td", "form", "nav", "header", "footer", "aside", "blockquote", "pre"]
NAMES = ["text", "own_text", "links", "link_share", "tag_share", "depth", "position", "siblings", "same_tag", "before", "after", "stops", "commas", "words", "children",
         "bad_name", "good_name", "inside_bad", "inside_good", "sibling_text", "share_of_parent"] + [f"is_{t}" for t in TAGS]
_BAD, _GOOD = NAMES.index("bad_name"), NAMES.index("good_name")


def bad_name(node: Node) -> bool:
    return node.tag in BAD_TAGS or bool(node.tokens & BAD_TOKENS) and node.tag not in ("html", "body", "#root", "article", "main")


def good_name(node: Node) -> bool:
    return node.tag in ("article", "main") or bool(node.tokens & GOOD_TOKENS) and not bad_name(node)


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    x = np.zeros((n, len(NAMES)))
    parent = np.array([-1 if v.parent is None else v.parent.order for v in nodes])
    own, link, stops, commas = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    inner = np.zeros(n)
    for k, v in enumerate(nodes):
        for part in v.parts:
            if isinstance(part, str):
                own[k] += len(part.strip())
                stops[k] += part.count(".")
                commas[k] += part.count(",")
        inner[k] = 1
    anchor = np.array([v.tag == "a" for v in nodes])
    total, tags, in_link, s, c = own.copy(), inner.copy(), link, stops, commas
    in_link[anchor] = own[anchor]
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = parent[k]
        if anchor[k]:
            in_link[k] = total[k]
        total[p] += total[k]
        tags[p] += tags[k]
        in_link[p] += in_link[k]
        s[p] += s[k]
        c[p] += c[k]
    every = max(total[0], 1)
    depth, bad, good = np.zeros(n), np.zeros(n), np.zeros(n)
    index, same = np.zeros(n), np.zeros(n)
    for k, v in enumerate(nodes):
        visible = [w for w in v.children if w.tag not in SILENT and not w.hidden]
        kinds: dict[str, int] = {}
        for w in visible:
            kinds[w.tag] = kinds.get(w.tag, 0) + 1
        for i, w in enumerate(visible):
            index[w.order], same[w.order] = (i + 0.5) / len(visible), kinds[w.tag] / len(visible)
            x[w.order, 7] = len(visible)
            x[w.order, 19] = (total[k] - total[w.order]) / max(len(visible) - 1, 1)
        p = parent[k]
        if p >= 0:
            depth[k], bad[k], good[k] = depth[p] + 1, max(bad[p], x[p, _BAD]), max(good[p], x[p, _GOOD])
        x[k, _BAD], x[k, _GOOD], x[k, 14] = bad_name(v), good_name(v), len(visible)
        if v.tag in TAGS:
            x[k, 21 + TAGS.index(v.tag)] = 1
    starts = np.cumsum(own) - own
    x[:, 0], x[:, 1], x[:, 2] = np.log1p(total), np.log1p(own), np.log1p(in_link)
    x[:, 3], x[:, 4] = in_link / np.maximum(total, 1), tags / np.maximum(total, 1)
    x[:, 5], x[:, 6], x[:, 8] = depth, index, same
    x[:, 9], x[:, 10] = starts / every, (every - starts - total) / every
    x[:, 11], x[:, 12], x[:, 13] = s / np.maximum(total, 1), c / np.maximum(total, 1), total / every
    x[:, 17], x[:, 18] = bad, good
    x[:, 19] = np.log1p(np.maximum(x[:, 19], 0))
    x[:, 20] = np.where(parent >= 0, total / np.maximum(total[np.maximum(parent, 0)], 1), 1)
    return x


def teach(nodes: list[Node]) -> np.ndarray:
    """1 for text, 0 for boilerplate, -1 for elements that hold both or cannot be told."""
    bad, good = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for k, v in enumerate(nodes):
        p = v.parent.order if v.parent is not None else None
        bad[k] = bad_name(v) or p is not None and bad[p]
        good[k] = v.tag in ("article", "main") or p is not None and good[p]
    mark = np.where(bad, 0, np.where(good, 1, -1))
    if good.any():  # on a page with such markup, what stands outside of it and holds none of it is not text
        holds = good.copy()
        for k in range(len(nodes) - 1, 0, -1):
            holds[nodes[k].parent.order] |= holds[k]
        mark = np.where(~holds, 0, mark)
    return mark


NEUTRAL = [_GOOD, NAMES.index("inside_good"), NAMES.index("is_article"), NAMES.index("is_main")]


# --- gradient-boosted trees -------------------------------------------------------


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, smooth: float = 1.0) -> dict:
    """Binary trees of ``depth`` levels on binned features, by second-order gain. Each tree: features, cuts, leaves."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = {"base": float(np.log(share / (1 - share))), "trees": []}
    if not len(y):
        return model
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    b = np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], 1)
    total = np.full(len(y), model["base"])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        leaf = np.zeros(len(y), int)
        feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = [(1e-6, 0, None)] * width
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                size = len(e) + 1
                cell = leaf * size + b[:, k]
                cg, ch = (np.cumsum(np.bincount(cell, v, width * size).reshape(width, size), 1) for v in (g, h))
                gl, hl, gt, ht = cg[:, :-1], ch[:, :-1], cg[:, -1:], ch[:, -1:]
                gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
                at = gain.argmax(1)
                for q in range(width):
                    if gain[q, at[q]] > best[q][0]:
                        best[q] = (gain[q, at[q]], k, int(at[q]))
            right = np.zeros(len(y), int)
            for q, (_, k, at) in enumerate(best):
                if at is not None:
                    feature[first + q], cut[first + q] = k, edges[k][at]
                    here = leaf == q
                    right[here] = b[here, k] > at
            leaf = leaf * 2 + right
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + smooth)
        model["trees"].append((feature, cut, value))
        total += value[leaf]
    return model


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    total, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for feature, cut, value in model["trees"]:
        node = np.zeros(len(x), int)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
        total += value[node - len(feature)]
    return total


def decode(nodes: list[Node], odds: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the choice of greatest total, where a dropped node takes its subtree along. A node's
    own text counts with its log-odds; so does an element without text of its own, a little."""
    gain = odds * np.maximum(weight, 0.05)
    drop = -gain.copy()  # of the whole subtree
    best = gain.copy()  # kept, children at their best
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k].parent.order
        drop[p] += drop[k]
        best[p] += max(best[k], drop[k])
    keep = np.zeros(len(nodes), bool)
    for k, v in enumerate(nodes):
        keep[k] = (v.parent is None or keep[v.parent.order]) and (v.parent is None or best[k] >= drop[k])
    return keep


def main_text(root: Node, nodes: list[Node], keep: np.ndarray) -> str:
    kept = {id(v) for v, k in zip(nodes, keep) if k}
    found: list[str] = []
    line: list[str] = []

    def end() -> None:
        block = _SPACES.sub(" ", unescape("".join(line))).strip()
        if block:
            found.append(block)
        line.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            end()
        elif x.tag == "br":
            end()
        elif id(x) in kept:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.parts))
        elif x.tag in BLOCK:
            end()
    end()
    return "\n".join(found)


def extract(html: str, model: dict) -> str:
    root = parse(html)
    nodes = nodes_of(root)
    x = features(nodes)
    weight = np.log1p(np.expm1(x[:, 1]) / 20)
    return main_text(root, nodes, decode(nodes, log_odds(model, x), weight))


_FRAMES = ["nav", "header", "footer", "aside", "form"] + [f'div class="{x}"' for x in ("sidebar", "cookie-notice", "ad-box", "comments", "site-header", "related-posts", "newsletter")] \
    + ['section id="comments"', 'ul class="menu"', 'div id="footer"', 'div role="banner"']


def varied(html: str, seed: int) -> str:
    """A page of other layout with the texts of this one: some of its blocks stand in an article, others, by chance, in
    frames that name them as boilerplate, before, in and behind it. So texts alone do not tell, places and names do."""
    rng = random.Random(seed)
    root = parse(html)
    nodes = nodes_of(root)
    lines = main_text(root, nodes, np.ones(len(nodes), bool)).split("\n")

    def block(inner: str) -> str:
        tag = rng.choice(["p", "p", "p", "div", "li", "h2", "span"])
        return f"<{tag}>{escape(inner)}</{tag}>" if rng.random() < 0.8 else f"<{tag}><a href='#'>{escape(inner)}</a></{tag}>"

    def frames(most: int) -> str:
        some = (rng.choice(_FRAMES) for _ in range(rng.randint(0, most)))
        return "".join(f"<{f}>{''.join(block(rng.choice(lines)) for _ in range(rng.randint(1, 4)))}</{f.split()[0]}>" for f in some)

    body = "".join((frames(1) if rng.random() < 0.1 else "") + f"<{t}>{escape(x)}</{t}>" for x in lines for t in [rng.choice(["p", "p", "p", "h2", "li", "blockquote", "div"])])
    outer = rng.randint(0, 3)
    return f"<body>{'<div>' * outer}{frames(3)}<article>{body}</article>{frames(3)}{'</div>' * outer}{frames(2)}</body>"


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "html"):
        found = batch.column(batch.schema.get_field_index("html")).to_pylist()
        for html in found + [varied(x, zlib.crc32(x.encode())) for x in found]:
            nodes = nodes_of(parse(html))
            y, x = teach(nodes), features(nodes)
            plain = x.copy()
            plain[:, NEUTRAL] = 0
            for rows in (x, plain):
                yield out(_TAUGHT, [r.tolist() for r in rows[y >= 0]], y[y >= 0].astype(float))


_TAUGHT = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.float64())])
_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    df = pick(df, page_id=id_col, url=url_col, html=html_col)
    return df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def train(df: DataFrame, sample: int = SAMPLE_PAGES) -> dict:
    """Boosted trees from a bounded sample of pages."""
    rows = mapped(bounded_sample(df, sample, "page_id").select("html"), _training, "x array<double>, y double").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(NAMES))
    return boost(x, rows["y"].to_numpy(float))


def extracted(df: DataFrame, model: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            texts = [extract(x, model) for x in batch.column(2).to_pylist()]
            yield out(_TEXT, batch.column(0), batch.column(1), texts, [len(x) for x in texts])

    return mapped(df.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    df = pages(table(spark, sf_dir, "pages"))
    return extracted(df, train(df))
