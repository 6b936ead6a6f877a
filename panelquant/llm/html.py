"""Main text of web pages: flat text blocks, classified by a decision tree on shallow features.

A page is cut at block-level tags into a flat list of text blocks. A block is described by its word count and link density,
those of the blocks before and after it, and by what encloses it (page furniture such as nav or footer, class or id names of
adverts and comments, an article). A Spark ML decision tree, trained on a small labelled table of blocks, keeps or drops each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import product

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>?", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")

#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg math select button canvas audio video".split())
#: Elements that end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are remembered while open.
OPEN = frozenset("article aside details dialog div fieldset footer form head header main menu nav ol section table td ul".split())
FURNITURE = frozenset("aside dialog footer form head header menu nav".split())
#: Words in class, id or role that mark page furniture, and those that mark the article.
AGAINST = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disclaimer "
    "disqus dialog footer form header login menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted recommended related "
    "replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
FOR = frozenset("article content entry main maincontent post story text".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "heading")


class Block:
    __slots__ = ("text", "words", "links", "furniture", "article", "heading", "attrs")

    def __init__(self, text, linked, furniture, article, heading, attrs):
        self.text, self.words = text, text.count(" ") + 1
        self.links = min(1.0, linked / max(1, len(text)))
        self.furniture, self.article, self.heading, self.attrs = furniture, article, heading, attrs


def _hint(attrs: str) -> int:
    """-1: furniture, 1: article, 0: neither, from the words in class, id and role."""
    if "=" not in attrs:
        return 0
    words = {w for m in _NAMES.finditer(attrs) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower())}
    return -1 if words & AGAINST else 1 if words & FOR else 0


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # (tag, furniture, article) with what encloses it
    opened: Counter = Counter()  # tags on the stack, by name
    parts: list[tuple[str, bool]] = []
    tag, attrs, own, link, at = "", "", 0, 0, 0

    def flush():
        text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(t for t, a in parts if a)).split()))
            furniture, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            furniture = furniture or own < 0
            out.append(Block(text, linked, furniture, not furniture and (article or own > 0), tag[:1] == "h" and tag[1:].isdigit(), attrs))
        parts.clear()

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            parts.append((page[at:], link > 0))
            break
        if m.start() > at:
            parts.append((page[at:m.start()], link > 0))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, inside = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing:
            if name == "title":
                flush()
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name == "a":
            link = max(0, link - 1) if closing else 1
        elif name == "br":
            parts.append((" ", False))
        elif name in BLOCK:
            flush()
            link = 0 if closing else link
            tag, attrs, own = ("", "", 0) if closing else (name, inside, _hint(inside) if name not in OPEN else 0)
            if name in OPEN:
                if not closing:
                    furniture, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    hint = _hint(inside)
                    furniture = furniture or hint < 0 or name in FURNITURE and not (name == "header" and article)
                    opened[name] += 1
                    stack.append((name, furniture, not furniture and (article or hint > 0 or name in ("article", "main"))))
                elif opened[name]:  # a stray closing tag walks no stack
                    while True:
                        inner = stack.pop()[0]
                        opened[inner] -= 1
                        if inner == name:
                            break
    flush()
    return out


def block_features(found: list[Block]) -> list[tuple[float, ...]]:
    shape = [(float(b.words), b.links) for b in found]
    edge = (0.0, 0.0)
    return [
        (*shape[i], *(shape[i - 1] if i else edge), *(shape[i + 1] if i + 1 < len(found) else edge), float(b.furniture), float(b.article), float(b.heading))
        for i, b in enumerate(found)
    ]


def _words(n: int, salt: int = 0) -> str:
    return " ".join(f"w{(i * 7 + salt) % 23}" for i in range(n))


def labelled_pages() -> list[str]:
    """Pages made by rule; blocks to keep carry ``data-keep``. They vary the lengths of paragraphs and furniture and the page's frame."""
    keep = lambda tag, n: f"<{tag} data-keep>{_words(n)}</{tag}>"
    menu = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">{_words(1 + i % 3, i)}</a></li>' for i in range(n)) + "</ul>"
    pages = []
    for frame, lengths in product(range(4), ((1, 40, 3, 90), (25, 2, 1, 60), (70, 12, 130, 6), (2, 4, 8, 16))):
        story = keep("h1", 3 + lengths[0] % 7) + "".join(keep("p", n) for n in lengths)
        odd = lengths[1]
        if frame == 0:
            page = f"<nav>{menu(6)}</nav><div class='ad'>{_words(odd)}</div><article>{story}</article><footer>{_words(4 + odd)}</footer>"
        elif frame == 1:
            page = (f"<header>{_words(3)}{menu(4)}</header><div class='cookie-notice'><p>{_words(20 + odd)}</p></div><main>{story}"
                    f"<form><p>{_words(6)}</p></form></main><aside><p>{_words(15 + odd)}</p></aside><footer><p>{_words(9)}</p></footer>")
        elif frame == 2:
            page = (f"<div id='menu'>{menu(5)}</div><div class='content'>{story}<div class='comments'><p>{_words(30 + odd)}</p><p>{_words(odd)}</p></div></div>"
                    f"<div class='sidebar'>{_words(12)}{menu(3)}</div>")
        else:  # nothing but counts tells: long, unlinked runs between lists of links
            page = f"{menu(7)}<div>{_words(2)} <a href='/x'>{_words(6)}</a></div>" + "".join(keep("p", n) for n in lengths if n >= 12) + f"{menu(4)}<div><a href='/t'>{_words(3)}</a> {_words(2)}</div>"
        pages.append(f"<html><body>{page}</body></html>")
    return pages


def labelled_table() -> list[tuple[list[float], float]]:
    """(features, keep) of every block of the labelled pages: a small table, the same everywhere."""
    rows = []
    for page in labelled_pages():
        found = blocks(page)
        rows += [(list(f), float("data-keep" in b.attrs)) for f, b in zip(block_features(found), found, strict=True)]
    return rows


def _nodes(node):
    """A Spark ML tree as nested tuples (feature, threshold, left, right) with leaves 0.0 or 1.0."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _nodes(node.leftChild()), _nodes(node.rightChild())


def train(spark: SparkSession, depth: int = 6):
    rows = spark.createDataFrame(labelled_table(), "x array<double>, label double").coalesce(1)
    fit = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(rows.select(array_to_vector("x").alias("features"), "label"))
    return _nodes(fit._java_obj.rootNode())


def keeps(tree, x: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, left, right = tree
        tree = left if x[feature] <= threshold else right
    return tree > 0.5


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, x in zip(found, block_features(found), strict=True) if keeps(tree, x))


def extract(pages: DataFrame, tree=None, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with a column ``out``: the main text, blocks in page order joined by two line ends.

    Character references are decoded, white space inside a block is one space. A null or empty page, or one without a kept
    block, gives an empty text. The whole page is read, however long; unclosed tags and a cut end are fine. Repeated rows are
    read each on their own; an empty table gives no rows. A column called ``out`` is replaced, all others pass through."""
    tree = tree if tree is not None else train(pages.sparkSession)

    def texts(values: pa.Array) -> pa.Array:
        return pa.array([main_text(v.as_py(), tree) if v.is_valid else "" for v in values], pa.string())

    return pages.withColumn(out, F.arrow_udf(texts, "string")(F.col(html_col)))
