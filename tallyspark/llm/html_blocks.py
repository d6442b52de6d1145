"""Main text of web pages: flat text blocks, judged by a decision tree on shallow features.

A page is cut into flat blocks of text. A block's features are its word count and link density, those of its two neighbours,
whether it is a heading or a list item, and whether the elements around it name themselves as article or as furniture. A small
decision tree, trained on the labelled table below, decides which blocks are main text: furniture first, then article, and
only blocks without either by words and link density. The tree is fitted once on
the driver (the table is a constant) and travels with the job.

Null and empty pages have an empty text. Broken markup is read as browsers do: unknown end tags are ignored, an unfinished tag at
the end of the page is dropped. Repeated pages give repeated rows.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select|button|title|canvas|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"\S+")

# Elements by their part in HTML.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|footer|header|masthead|side-?bar|aside|breadcrumbs?|cookies?\w*|consent|banner|notices?|alerts?|popup|modal|"
    r"ads?|advert\w*|adverts|sponsor\w*|promo\w*|comments?|commentlist|respond|reply|replies|disqus|share\w*|social\w*|related|recommend\w*|"
    r"newsletter|subscribe\w*|signup|login|search\w*|pagination|pager|tags?|toolbar|widget\w*|copyright|legal|skip\w*|contentinfo|navigation|"
    r"complementary|disclaimer|gdpr|outbrain|taboola)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:articles?|article-?body|articlebody|main|content|entry|post|story|body-?text|text)(?:$|[\s_-])", re.I)
# Class tokens that say something about the page or its subject: states (has-sidebar), layouts, and subjects (tag-news).
ABOUT = re.compile(r"(?:^|[_-])(?:has|no|not|is|with|without|hide|show|enable|disable)[_-]|[_-](?:layout|template|enabled|disabled|open|closed)\Z|"
                   r"^(?:category|cat|tag|term|topic|author|format|type|status)[_-](?!(?:cloud|list|links?)\Z)", re.I)

FEATURES = ("words", "link_share", "before_words", "before_links", "after_words", "after_links", "heading", "item", "content", "furniture")
# The labelled table: one row for each block with the features above, then 1 for main text and 0 for the rest.
LABELLED = (
    # articles in a content element: paragraphs and headings of any length, links inside them
    (40, 0.0, 8, 0.0, 35, 0.0, 0, 0, 1, 0, 1), (1, 0.0, 30, 0.0, 20, 0.0, 0, 0, 1, 0, 1), (2, 0.0, 1, 0.0, 3, 0.0, 0, 0, 1, 0, 1),
    (7, 0.0, 12, 0.0, 7, 0.0, 1, 0, 1, 0, 1), (3, 0.0, 9, 0.0, 50, 0.0, 1, 0, 1, 0, 1), (60, 0.2, 50, 0.0, 10, 0.0, 0, 0, 1, 0, 1),
    (4, 0.0, 20, 0.0, 5, 0.0, 0, 1, 1, 0, 1), (9, 0.3, 4, 0.0, 8, 0.1, 0, 1, 1, 0, 1), (25, 0.5, 30, 0.0, 5, 1.0, 0, 0, 1, 0, 1),
    (300, 0.0, 3, 0.0, 9, 0.2, 0, 0, 1, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 1), (2, 1.0, 20, 0.0, 30, 0.0, 0, 0, 1, 0, 1),
    (1, 1.0, 3, 0.0, 12, 0.0, 0, 1, 1, 0, 1), (15, 0.0, 10, 1.0, 10, 1.0, 0, 0, 1, 0, 1), (5, 0.0, 2, 1.0, 40, 0.0, 1, 0, 1, 0, 1),
    (1, 0.0, 30, 0.0, 2, 1.0, 0, 0, 1, 0, 1), (4, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0, 1), (13, 0.0, 6, 0.8, 3, 1.0, 0, 0, 1, 0, 1),
    (3, 0.7, 40, 0.0, 1, 1.0, 0, 0, 1, 0, 1), (6, 1.0, 5, 1.0, 7, 1.0, 0, 1, 1, 0, 1), (2, 0.0, 2, 0.0, 2, 1.0, 1, 0, 1, 0, 1),
    (8, 0.9, 60, 0.0, 2, 1.0, 0, 1, 1, 0, 1), (1, 0.0, 1, 0.0, 4, 0.7, 0, 0, 1, 0, 1),
    # furniture elements, long and short, linked and not, inside and outside of articles
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1, 0), (3, 1.0, 2, 1.0, 1, 1.0, 0, 1, 0, 1, 0), (9, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0, 1, 0),
    (40, 0.0, 2, 1.0, 12, 0.0, 0, 0, 0, 1, 0), (120, 0.0, 10, 0.0, 12, 0.3, 0, 0, 0, 1, 0), (8, 0.1, 30, 0.0, 0, 0.0, 0, 0, 0, 1, 0),
    (6, 0.0, 20, 0.0, 14, 0.0, 1, 0, 0, 1, 0), (35, 0.0, 25, 0.0, 30, 0.0, 0, 0, 1, 1, 0), (4, 0.0, 40, 0.0, 22, 0.0, 1, 0, 1, 1, 0),
    (18, 1.0, 40, 0.0, 18, 1.0, 0, 1, 1, 1, 0), (60, 0.0, 60, 0.0, 2, 1.0, 0, 0, 1, 1, 0), (1, 0.0, 3, 0.0, 90, 0.0, 0, 1, 0, 1, 0),
    # no names to go by: long plain blocks and what stands between them are text
    (45, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (30, 0.1, 6, 0.0, 42, 0.0, 0, 0, 0, 0, 1), (80, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 1),
    (22, 0.0, 30, 0.0, 4, 1.0, 0, 0, 0, 0, 1), (6, 0.0, 4, 1.0, 60, 0.0, 1, 0, 0, 0, 1), (5, 0.0, 45, 0.0, 38, 0.0, 0, 0, 0, 0, 1),
    (12, 0.0, 35, 0.1, 28, 0.0, 0, 0, 0, 0, 1), (14, 0.0, 60, 0.0, 25, 0.0, 0, 1, 0, 0, 1), (200, 0.05, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (17, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 24, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 80, 0.0, 44, 0.0, 1, 0, 0, 0, 1),
    # no names: link lists, short scraps between short scraps
    (2, 1.0, 1, 1.0, 3, 1.0, 0, 1, 0, 0, 0), (5, 1.0, 0, 0.0, 4, 1.0, 0, 0, 0, 0, 0), (12, 0.9, 30, 0.0, 9, 1.0, 0, 0, 0, 0, 0),
    (30, 0.8, 3, 1.0, 25, 0.8, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (4, 0.5, 6, 0.5, 5, 0.6, 0, 0, 0, 0, 0),
    (6, 0.0, 5, 1.0, 3, 0.0, 0, 0, 0, 0, 0), (2, 0.0, 4, 0.0, 3, 1.0, 0, 1, 0, 0, 0), (8, 0.9, 60, 0.0, 2, 1.0, 0, 1, 0, 0, 0),
    (1, 0.0, 1, 1.0, 5, 1.0, 1, 0, 0, 0, 0), (3, 1.0, 50, 0.0, 40, 0.0, 0, 0, 0, 0, 0), (7, 0.7, 20, 0.5, 1, 1.0, 0, 1, 0, 0, 0),
)


def names_furniture(names: str) -> bool:
    """Whether one of the class tokens or ids names the element itself as furniture."""
    return bool(FURNITURE.search(names)) and any(FURNITURE.search(t) and not ABOUT.search(t) for t in names.split())


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    heading: bool
    item: bool
    content: bool
    furniture: bool


def text_blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]  # tag, inside content, inside furniture, hidden
    parts: list[str] = []
    links: list[str] = []
    in_link = 0
    head = ""

    def close():
        text = " ".join("".join(parts).split())
        if text:
            _, content, furniture, hidden = stack[-1]
            out.append(Block(text, len(WORD.findall(text)), len(WORD.findall("".join(links))), head[:1] == "h" and head[1:].isdigit(), head in ("li", "dd", "dt"),
                             content, furniture or hidden))
        parts.clear()
        links.clear()

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            plain = html.unescape(text) if "&" in text else text
            parts.append(plain)
            if in_link:
                links.append(plain)
            continue
        if m["raw"] or not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag == "a":
            in_link = 0 if m["end"] else 1
            links.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        close()
        if m["end"]:
            in_link = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            head = stack[-1][0]
            continue
        if tag in VOID:
            continue
        in_link = 0
        if stack[-1][0] == "p" or tag in ("li", "dd", "dt", "tr", "td", "th") and stack[-1][0] == tag:
            stack.pop()
        _, content, furniture, hidden = stack[-1]
        names = ""
        attrs = m["attrs"]
        if attrs and "=" in attrs:
            names = " ".join(a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attrs))
            hidden = hidden or bool(HIDDEN.search(attrs))
        elif attrs:
            hidden = hidden or bool(HIDDEN.search(attrs))
        if tag in CONTENT_TAGS:
            # A comment marked up as an article of its own stays what the elements around it are.
            content = True
        if tag in FURNITURE_TAGS or tag == "header" and not content:
            furniture = True
        if names and tag not in ("html", "body"):
            # An article or main element is what its tag says, whatever its classes tell of the page or the subject.
            if tag not in CONTENT_TAGS and names_furniture(names):
                furniture = True
            elif CONTENT.search(names):
                content = True
        stack.append((tag, content, furniture, hidden))
        head = tag
    close()
    return out


def block_features(blocks: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.link_words for b in blocks], float) / np.maximum(words, 1)
    pad = lambda v, ahead: np.concatenate([v[1:], [0.0]]) if ahead else np.concatenate([[0.0], v[:-1]])
    flags = [np.array([getattr(b, f) for b in blocks], float) for f in ("heading", "item", "content", "furniture")]
    return np.stack([words, links, pad(words, False), pad(links, False), pad(words, True), pad(links, True), *flags], 1)


@dataclass
class DecisionTree:
    """Nodes as arrays: feature (-1 in leaves), cut (up to it: left), children and the leaf's answer."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    answer: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (self.feature[node] >= 0).any():
            f = self.feature[node]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.cut[node], self.left[node], self.right[node])
            node = np.where(f >= 0, down, node)
        return self.answer[node]


def fit_tree(table: tuple = LABELLED, depth: int = 8) -> DecisionTree:
    """Least Gini impurity; ties go to the first feature and the lowest cut."""
    data = np.array(table, float)
    nodes: list[list] = []

    def grow(rows: np.ndarray, level: int) -> int:
        y = rows[:, -1]
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, bool(y.mean() >= 0.5)])
        best = None
        if level < depth and 0 < y.mean() < 1:
            for f in range(rows.shape[1] - 1):
                values = np.unique(rows[:, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    low = rows[:, f] <= cut
                    gini = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[low], y[~low]))
                    if best is None or gini < best[0] - 1e-12:
                        best = (gini, f, cut, low)
        if best:
            _, f, cut, low = best
            nodes[at][:4] = f, cut, grow(rows[low], level + 1), grow(rows[~low], level + 1)
        return at

    grow(data, 0)
    return DecisionTree(*(np.array(c) for c in zip(*nodes)))


def main_text(page: str | None, tree: DecisionTree) -> str:
    blocks = text_blocks(page) if page else []
    if not blocks:
        return ""
    return " ".join(b.text for b, keep in zip(blocks, tree.predict(block_features(blocks))) if keep)


def extract_main_text(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labelled: tuple = LABELLED) -> DataFrame:
    """``keep`` columns, the main ``text``, ``n_chars`` and the number of blocks found and kept."""
    tree = fit_tree(labelled)

    def make():
        def work(pages):
            out = {"text": [], "n_chars": [], "n_blocks": [], "n_kept": []}
            for p in pages:
                blocks = text_blocks(p) if p else []
                chosen = tree.predict(block_features(blocks)) if blocks else []
                text = " ".join(b.text for b, k in zip(blocks, chosen) if k)
                for name, v in zip(out, (text, len(text), len(blocks), int(sum(chosen)))):
                    out[name].append(v)
            return out

        return work

    return map_texts(df, [page], "text string, n_chars long, n_blocks long, n_kept long", make, keep)
