"""The main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities.

A page is cut at block tags into flat blocks. A block's features are its words and link density, those of the blocks before
and after it, and where it stands: in a region that its tag or its class names as furniture, in one named as the article, or
on a page that names an article elsewhere. A CART tree, trained on the table below, says which blocks are main text. Where a
page names its regions, these decide, since a reader's comment or a notice reads like a paragraph; where it doesn't, words
and links do. A class names furniture only if all its parts do, so side-effects, legal-history or note-form don't.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batches, short_batches

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "named", "heading")
#: Labelled blocks in the order of FEATURES, then 1 for main text. Links are shares of words; no neighbour counts as 0 words.
LABELLED = """
6 0.0 0 0.0 80 0.0 0 1 1 1  1
9 0.0 0 0.0 60 0.0 0 1 1 1  1
80 0.0 6 0.0 50 0.0 0 1 1 0  1
120 0.05 80 0.0 95 0.0 0 1 1 0  1
1 0.0 90 0.0 70 0.0 0 1 1 0  1
2 0.0 40 0.0 0 0.0 0 1 1 0  1
3 0.0 60 0.0 5 1.0 0 1 1 0  1
45 0.2 12 0.0 30 0.1 0 1 1 0  1
15 1.0 60 0.0 70 0.0 0 1 1 0  1
4 1.0 50 0.1 45 0.0 0 1 1 0  1
30 0.5 50 0.0 30 0.4 0 1 1 0  1
300 0.0 0 0.0 0 0.0 0 1 1 0  1
1 0.0 0 0.0 0 0.0 0 1 1 0  1
8 0.0 9 0.0 7 0.0 0 1 1 0  1
5 0.0 4 0.0 80 0.0 0 1 1 1  1
1 1.0 0 0.0 1 1.0 1 0 1 0  0
1 1.0 1 1.0 1 1.0 1 0 1 0  0
2 1.0 1 1.0 12 0.0 1 0 1 0  0
12 0.0 1 1.0 6 0.0 1 0 1 0  0
25 0.0 90 0.0 0 0.0 1 0 1 0  0
40 0.0 70 0.0 0 0.0 1 0 1 0  0
60 0.0 80 0.0 30 0.0 1 1 1 0  0
10 0.0 60 0.0 50 0.0 1 1 1 0  0
7 0.0 80 0.0 90 0.0 1 1 1 1  0
3 1.0 40 0.0 20 0.0 1 1 1 0  0
90 0.0 80 0.0 60 0.0 1 1 1 0  0
1 0.0 70 0.0 60 0.0 1 1 1 0  0
5 0.0 50 0.0 60 0.0 1 0 0 0  0
70 0.0 50 0.0 60 0.0 1 0 0 0  0
8 1.0 50 0.0 6 1.0 1 0 0 0  0
30 0.0 12 0.0 8 0.0 0 0 1 0  0
12 0.0 0 0.0 40 0.0 0 0 1 0  0
6 0.0 0 0.0 90 0.0 0 0 1 1  0
80 0.0 50 0.0 20 0.0 0 0 1 0  0
1 1.0 1 1.0 1 1.0 0 0 1 0  0
5 1.0 60 0.0 4 1.0 0 0 1 0  0
25 0.0 90 0.0 0 0.0 0 0 1 0  0
90 0.0 70 0.0 60 0.0 0 0 0 0  1
60 0.1 5 0.0 80 0.0 0 0 0 0  1
35 0.0 40 0.0 3 0.0 0 0 0 0  1
20 0.2 30 0.0 60 0.0 0 0 0 0  1
6 0.0 70 0.0 60 0.0 0 0 0 0  1
4 0.0 0 0.0 80 0.0 0 0 0 1  1
7 0.0 40 0.0 60 0.0 0 0 0 1  1
200 0.0 0 0.0 0 0.0 0 0 0 0  1
15 0.0 30 0.0 45 0.0 0 0 0 0  1
1 1.0 0 0.0 1 1.0 0 0 0 0  0
1 1.0 1 1.0 1 1.0 0 0 0 0  0
3 1.0 2 1.0 60 0.0 0 0 0 0  0
5 1.0 70 0.0 4 1.0 0 0 0 0  0
12 0.9 8 1.0 9 1.0 0 0 0 0  0
40 0.9 8 1.0 30 0.8 0 0 0 0  0
3 0.0 2 1.0 3 1.0 0 0 0 0  0
4 0.0 1 1.0 0 0.0 0 0 0 0  0
60 0.0 50 0.0 0 0.0 0 0 0 0  1
45 0.0 0 0.0 0 0.0 0 0 0 0  1
80 0.0 60 0.0 5 1.0 0 0 0 0  1
56 0.0 2 1.0 56 0.0 0 0 0 0  1
40 0.1 45 0.0 12 0.0 0 0 0 0  1
150 0.05 3 1.0 3 1.0 0 0 0 0  1
28 0.0 30 0.0 9 0.0 0 0 0 0  1
70 0.0 8 0.0 35 0.3 0 0 0 0  1
60 0.0 0 0.0 50 0.0 0 0 1 0  0
150 0.0 90 0.0 0 0.0 0 0 1 0  0
40 0.0 60 0.0 45 0.0 0 0 1 0  0
20 0.2 30 0.1 60 0.0 0 0 1 0  0
9 0.0 40 0.0 80 0.0 0 0 1 1  0
200 0.1 3 1.0 2 1.0 0 0 1 0  0
15 1.0 12 1.0 14 1.0 0 0 0 0  0
30 0.8 4 1.0 5 1.0 0 0 0 0  0
2 0.0 1 1.0 1 1.0 0 0 0 0  0
2 1.0 1 1.0 2 1.0 0 0 0 0  0
1 1.0 0 0.0 2 1.0 0 0 0 0  0
3 1.0 2 1.0 1 1.0 0 0 0 0  0
2 1.0 3 1.0 0 0.0 0 0 0 0  0
4 1.0 3 1.0 2 1.0 0 0 0 0  0
1 1.0 2 1.0 60 0.0 0 0 0 0  0
5 1.0 4 1.0 6 1.0 0 0 0 0  0
2 1.0 0 0.0 1 1.0 0 0 0 0  0
6 1.0 5 1.0 4 1.0 0 0 0 0  0
3 1.0 1 1.0 40 0.0 0 0 0 0  0
8 1.0 7 1.0 9 1.0 0 0 0 0  0
14 0.8 12 0.9 10 0.8 0 0 0 0  0
20 0.7 6 1.0 8 1.0 0 0 0 0  0
9 0.7 3 1.0 50 0.0 0 0 0 0  0
16 0.9 70 0.0 12 0.9 0 0 0 0  0
5 0.0 60 0.0 45 0.0 0 0 0 0  1
9 0.0 80 0.0 70 0.0 0 0 0 0  1
12 0.0 55 0.1 30 0.0 0 0 0 0  1
3 0.0 40 0.0 65 0.0 0 0 0 1  1
5 0.0 2 1.0 3 1.0 0 0 0 0  0
8 0.0 1 1.0 1 1.0 0 0 0 0  0
6 0.0 0 0.0 1 1.0 0 0 0 0  0
4 0.0 3 1.0 0 0.0 0 0 0 0  0
10 0.0 4 1.0 2 1.0 0 0 0 0  0
75 0.3 60 0.1 50 0.2 0 0 0 0  1
30 0.3 45 0.0 60 0.1 0 0 0 0  1
110 0.2 2 1.0 70 0.0 0 0 0 0  1
50 0.0 70 0.2 1 1.0 0 0 0 0  1
3 0.0 2 1.0 60 0.0 0 0 0 0  1
2 0.0 60 0.0 62 0.0 0 0 0 0  1
6 0.0 2 1.0 45 0.0 0 0 0 0  1
2 0.0 45 0.0 70 0.0 0 0 0 0  1
4 0.0 1 1.0 80 0.0 0 0 0 0  1
3 0.0 2 1.0 2 1.0 0 0 0 0  0
2 1.0 60 0.0 70 0.0 0 1 1 1  1
2 1.0 60 0.0 80 0.0 0 1 1 0  1
1 1.0 1 1.0 1 1.0 0 1 1 0  1
1 1.0 40 0.0 1 1.0 0 1 1 0  1
3 1.0 80 0.0 90 0.1 0 1 1 0  1
3 1.0 40 0.0 2 1.0 1 1 1 0  0
12 0.0 60 0.0 3 1.0 1 1 1 0  0
60 0.0 50 0.0 4 1.0 1 1 1 0  0
25 0.0 60 0.0 2 1.0 0 0 0 0  1
30 0.0 45 0.0 1 1.0 0 0 0 0  1
60 0.1 50 0.0 2 1.0 0 1 1 0  1
45 0.2 30 0.0 3 1.0 0 1 1 0  1
80 0.3 70 0.0 1 1.0 0 1 1 0  1
25 0.0 60 0.0 1 1.0 0 0 1 0  0
60 0.0 60 0.0 3 1.0 0 0 1 0  0
40 0.1 20 0.0 2 1.0 0 0 1 0  0
"""

#: Elements without text of the page, by tag. Their content up to the closing tag isn't even read as markup.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"])
FURNITURE_TAGS = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "math", "object", "canvas", "audio", "video", "head"])
ARTICLE_TAGS = frozenset(["article", "main"])
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu meta nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that close themselves at the next block, so they are no regions.
LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 option tr td th thead tbody tfoot a b i em strong u s small sub sup font code abbr cite q mark label".split())
#: Words of a class, an id or a role that name furniture, and words that may stand beside them without saying anything.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidepanel aside footer masthead topbar siteheader pageheader cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login searchbox share sharing social related recommended recommendations trending comment comments commentlist replies respond disqus widget widgets toolbar pagination pager skiplink copyright disclaimer complementary contentinfo hidden".split()
)
NEUTRAL = frozenset("site page main primary secondary top bottom left right header head foot side inner outer wrapper wrap container holder box bar area section block list item items group row col column slot banner button buttons link links post posts article articles user reader new your the block text title form search alert notification overlay legal policy js widget js to and of us more follow".split())
#: A class such as has-sidebar says what else is on the page, not what the element is.
ABOUT = frozenset(["has", "with", "no", "without", "is", "not"])
ARTICLE_NAMES = frozenset("article articlebody articletext content maincontent main story post postbody postcontent entry entrycontent".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def names(attributes: str) -> list[set[str]]:
    """For each naming attribute's names, its lower-case parts; a name that says what else there is has none."""
    found = []
    for m in _NAMES.finditer(attributes):
        for name in html.unescape(m[1] or m[2] or m[3] or "").split():
            parts = {x.lower() for x in _PARTS.findall(name)}
            if parts and not parts & ABOUT:
                found.append(parts)
    return found


def names_furniture(parts: set[str]) -> bool:
    """Whether a name says furniture and nothing else."""
    return bool(parts & FURNITURE_NAMES) and parts <= FURNITURE_NAMES | NEUTRAL


def names_article(parts: set[str]) -> bool:
    return bool(parts & ARTICLE_NAMES or "".join(sorted(parts, key=len)) in ARTICLE_NAMES)


@dataclass(slots=True)
class Block:
    text: str
    words: int
    links: float
    furniture: bool
    article: bool
    heading: bool


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in its order, blank ones left out."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    in_link = heading = leaf_furniture = False
    stack: list[tuple[str, int, int, int]] = []  # (tag, furniture, article and mute depth) as they were before the tag
    furniture = article = mute = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), furniture > 0 or leaf_furniture, article > 0, heading))
            pieces, linked = [], 0

    def put(text: str) -> None:
        nonlocal linked
        if mute:
            return
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if in_link:
            linked += len(text.split())

    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            put(page[at:])
            break
        if mark > at:
            put(page[at:mark])
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 2)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = n if end < 0 else end + 1
            continue
        tag = _TAG.match(page, mark)
        if tag is None:
            if page.startswith("</", mark) and page[mark + 2 : mark + 3] not in ("", " "):
                end = page.find(">", mark)
                at = n if end < 0 else end + 1
            else:
                put("<")
                at = mark + 1
            continue
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2].lower(), tag[3]) if tag[2] else (tag[4], tag[5].lower(), tag[6])
        if name in RAW:
            if not closing:
                end = re.compile(f"</{name}[\\s/>]", re.IGNORECASE).search(page, at)
                past = page.find(">", end.end() - 1) if end else -1
                at = n if past < 0 else past + 1
            continue
        if name == "br":
            put(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
            heading = name in HEADINGS and not closing
            leaf_furniture = in_link = False
        if name == "a":
            in_link = not closing
            continue
        if name in VOID:
            continue
        own = names(attributes) if attributes and not closing and name not in ("html", "body") else []
        bad = not closing and (name in FURNITURE_TAGS or any(map(names_furniture, own)) or bool(attributes and _HIDDEN.search(attributes)))
        main = name in ARTICLE_TAGS or any(map(names_article, own))
        if not closing and not article and (name == "header" or not main and any("header" in x and x <= FURNITURE_NAMES | NEUTRAL for x in own)):
            bad = True  # the page's header; an article's own has its title
        if name in LEAVES:
            leaf_furniture = leaf_furniture or (bad and name in BLOCK_TAGS)
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    furniture, article, mute = stack[k][1:]
                    del stack[k:]
                    break
            continue
        if attributes.endswith("/") and name not in BLOCK_TAGS:
            continue
        stack.append((name, furniture, article, mute))
        if name not in BLOCK_TAGS:
            mute += bad  # furniture inside a line is left out without breaking it
            continue
        furniture += bad
        article += not bad and main
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block."""
    named = float(any(b.article and not b.furniture for b in found))
    own = np.array([[b.words, b.links] for b in found], float).reshape(-1, 2)
    blank = np.zeros((1, 2))
    where = np.array([[b.furniture, b.article, named, b.heading] for b in found], float).reshape(-1, 4)
    return np.hstack([own, np.vstack([blank, own[:-1]]) if len(own) else own, np.vstack([own[1:], blank]) if len(own) else own, where])


@dataclass
class Node:
    """Rows with a feature at most `cut` go left; a leaf has no feature and gives `answer`."""

    answer: bool
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A CART tree by Gini impurity; of equally good splits the first feature and the lowest cut."""
    share = y.mean()
    node = Node(bool(share >= 0.5))
    if not depth or share in (0.0, 1.0):
        return node
    best = 2 * share * (1 - share) - 1e-9
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[1:] + values[:-1]) / 2:
            side = x[:, k] <= cut
            gini = sum(2 * p * (1 - p) * m.mean() for m, p in ((side, y[side].mean()), (~side, y[~side].mean())))
            if gini < best - 1e-12:
                best, node.feature, node.cut = gini, k, float(cut)
    if node.feature >= 0:
        side = x[:, node.feature] <= node.cut
        node.left, node.right = grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1)
    return node


def answers(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.feature < 0:
        return np.full(len(x), tree.answer)
    side = x[:, tree.feature] <= tree.cut
    out = np.empty(len(x), bool)
    out[side], out[~side] = answers(tree.left, x[side]), answers(tree.right, x[~side])
    return out


def train(table: str = LABELLED) -> Node:
    rows = np.array([line.split() for line in table.strip().splitlines()], float)
    return grow(rows[:, :-1], rows[:, -1])


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, good in zip(found, answers(tree, features(found)), strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of each page; the text is the main blocks in page order, a line each.

    A null or empty page, and one without main blocks, has an empty text. Pages are read whole and one by one, so repeated
    rows give equal texts and an empty table gives no rows. Columns other than the three named ones are not read.
    """
    short_batches(pages.sparkSession)
    tree = train()
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", tree) for page in batch.column(2).to_pylist()]
            yield as_batches({"id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}, schema)

    chosen = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
