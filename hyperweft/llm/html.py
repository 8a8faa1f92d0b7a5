"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags. Each block is described by its own words and link
density, those of the blocks around it, whether it is in an article, and what its elements' tags and class names say
(menu, footer, sidebar, advert, notice, form, comments): a class name made of such words alone is strong evidence, one with
other words weak. A decision tree, grown on the small labelled table in `pages`, tells content from the rest.

White space inside a block becomes one space, blocks are joined by a line break, and equal blocks each count. Pages that are null,
empty or without content give the empty text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hyperweft.llm.common import slices, with_fields
from hyperweft.llm.pages import PAGES, written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<[/A-Za-z][^>]*\Z", re.S)
CLASS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACES = re.compile(r"\s+")

# HTML's elements by what they do to text.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
APART_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header",
    "legal", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}

#: How often each labelled page is written, with other lengths.
DRAWS = 20
#: Words that say nothing about a part: an element whose class is made of these and words above is that part.
NEUTRAL = {
    "area", "bar", "bottom", "box", "buttons", "form", "global", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "primary", "right", "secondary",
    "section", "site", "slot", "stories", "text", "top", "unit", "wrap", "wrapper",
}
#: Words with which a class speaks of the page's layout, or of the article itself.
OWN_WORDS = {"article", "body", "content", "entry", "has", "hide", "layout", "no", "page", "post", "story", "title", "with", "without"}


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 8):
    """A CART tree by Gini impurity: a leaf is its majority (ties: 1), else (feature, threshold, low, high). Leaves have at least `least` rows."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return int(2 * y.sum() >= len(y))
    best, n = None, len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])[:-1]
        low = np.arange(1, n)
        cost = ones * (1 - ones / low) + (y.sum() - ones) * (1 - (y.sum() - ones) / (n - low))
        cost[(v[1:] == v[:-1]) | (np.minimum(low, n - low) < least)] = np.inf
        k = int(cost.argmin()) if n > 1 else 0
        if n > 1 and cost[k] < np.inf and (best is None or cost[k] < best[0] - 1e-9):
            best = (cost[k], f, float(v[k] + v[k + 1]) / 2)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, t, low, high = tree
    return np.where(x[:, f] <= t, classify(low, x), classify(high, x))


def features(found: list[tuple]) -> np.ndarray:
    """One row a block of blocks(): words and link density of its own, of the block before and of the one after; the words of the two longer
    neighbours within two blocks; in an article; evidence of its element's tag and class names."""
    own = np.array([(w, min(1.0, k / w)) for _, w, k, *_ in found], dtype=float).reshape(-1, 2)
    edge = np.zeros((2, 2))
    padded = np.concatenate([edge, own, edge])
    n = len(own)
    prose = np.where(padded[:, 1] < 0.5, padded[:, 0], 0)
    around = np.stack([prose[k : n + k] for k in (0, 1, 3, 4)], axis=1)
    around.sort(axis=1)
    where = np.array([b[3:] for b in found], dtype=float).reshape(n, -1)
    return np.concatenate([own, padded[1 : n + 1], padded[3 : n + 3], around[:, 2:], where], axis=1)


@cache
def content_tree():
    """The tree of the labelled pages, each in DRAWS lengths."""
    x, y, rng = [], [], np.random.default_rng(5)
    for page in PAGES * DRAWS:
        found = blocks(written(page, rng))
        y += [b[0].startswith("+") for b in found]
        x.append(features(found))
    return grow(np.concatenate(x), np.array(y, dtype=np.int64))


def class_evidence(attributes: str) -> int:
    """Whether class, id or role names say that an element is apart from the article: 0 no, 1 perhaps, 2 yes."""
    found = 0
    for m in CLASS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if set(words) & APART_WORDS and not set(words) & OWN_WORDS:
                found = max(found, 2 if set(words) <= APART_WORDS | NEUTRAL else 1)
    return found


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """Flat blocks (text, words, words in links, in article, apart by tag, apart by class) in page order; empty ones are left out.

    An article inside an element whose class names seem to set it apart is not apart: such an element is a wrapper.
    """
    out: list[tuple[str, int, int, int, int, int]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open block-level elements: name, article, apart by tag, by class
    parts: list[tuple[str, bool]] = []
    link, at, n = 0, 0, len(page)

    def close() -> None:
        if parts:
            text = SPACES.sub(" ", entities.unescape("".join(t for t, _ in parts))).strip()
            if text:
                _, article, apart, named = stack[-1] if stack else ("", False, False, 0)
                linked = sum(len(t.split()) for t, is_link in parts if is_link)
                out.append((text, text.count(" ") + 1, linked, int(article), int(apart), named))
            parts.clear()

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append((page[at:], link > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], link > 0))
        at = m.end()
        if m[2] is None:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name == "a":
            link = 0 if ends else 1
        elif name == "br":
            parts.append((" ", False))
        elif name in RAW and not ends:
            if m[3].endswith("/") and name in ("svg", "math", "object", "iframe"):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name in BLOCKS:
            close()
            link = 0
            if name in VOID:
                continue
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                continue
            if name in ("p", "li", "dt", "dd", "td", "th", "tr") and stack and stack[-1][0] == name:
                stack.pop()
            if stack and stack[-1][0] == "p":
                stack.pop()
            _, article, apart, named = stack[-1] if stack else ("", False, False, 0)
            if name in ("article", "main"):
                article, named = True, 0
            elif name not in ("body", "html") and "=" in m[3]:
                named = max(named, class_evidence(m[3]))
            stack.append((name, article, apart or name in APART or (name == "header" and not article), named))
    close()
    return out


def main_text(page: str | None, tree=None) -> str:
    """The blocks that the tree takes for content. If there are none, a wrapper may be named like a part of a page, and class names don't count."""
    found = blocks(page) if page else []
    if not found:
        return ""
    x, tree = features(found), tree or content_tree()
    keep = classify(tree, x)
    if not keep.any():
        x[:, -1] = 0
        keep = classify(tree, x)
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def op5_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html).

    A null or empty page has an empty text; rows that repeat a page_id are judged row by row. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text=2):
            texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    tree = content_tree()  # grown once, and sent with the task
    narrow = pages.select("page_id", "url", "html")
    return narrow.mapInArrow(run, with_fields(pages.select("page_id", "url").schema, "text string, n_chars long"))
