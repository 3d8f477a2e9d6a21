"""HTML main-text extraction from flat text blocks (operator 10).

A page falls into text blocks at its block-level tags.  Each block has its number of words
and its link density, those of its neighbours, and marks of where it stands.  A decision
tree, fitted on the blocks of a few small labelled pages, says which blocks are main text.
One pass over the rows, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Tags whose content is no text, tags without content, tags inside a block.
HIDDEN = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "select", "textarea")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Containers that are never main text, and those that usually hold it.
BOILER_TAGS = frozenset("nav aside footer form menu dialog button fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Words of class, id and role attributes that mark what is not the article, those of
#: them that also name parts of it, and words that name the article or its parts.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription "
    "comment comments respond replies disqus sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs toc footer header masthead topbar share sharing social related recommended recommendation recommendations "
    "login signup search pagination pager copyright legal complementary contentinfo hidden".split()
)
WEAK_WORDS = frozenset("side legal notice notices alert alerts promotion header social search copyright overlay consent".split())
MAIN_WORDS = frozenset("article entry post story content main body text news".split())

#: Attributes: a quote opens a value only after an equals sign.
_ATTRIBUTES = r"((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*)"
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(HIDDEN) + r")\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)" + _ATTRIBUTES + r"(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDES = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")

#: Features of a block, in this order.
FEATURES = ("boiler", "marked", "main", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after", "page_has_main", "page_has_plain")
#: Words of a block that no mark concerns from which a page has plain text.
PLAIN = 12
#: Tags that the next of their kind closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "p": ("p",)}

Block = tuple[str, int, int, bool, int, bool, bool]


def marked(marks: str) -> int:
    """How surely class, id and role say that an element is not the article: 2, 1 (they name a part of an article too, or a weak word) or 0."""
    most = 0
    for mark in marks.lower().split():
        parts = [p for p in re.split(r"[_-]+", mark) if p]
        boiler = [p for p in parts if p in BOILER_WORDS]
        if boiler:
            sure = parts[-1] in BOILER_WORDS - WEAK_WORDS or not any(p in MAIN_WORDS for p in parts) and (len(parts) == 1 or any(p not in WEAK_WORDS for p in boiler))
            most = max(most, 2 if sure else 1)
    return most


def blocks(page: str) -> list[Block]:
    """(text, words, words in links, in boilerplate, marks, in a main container, heading) of each block that has text."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    #: Open elements: tag, boilerplate, marks, main.
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
    link, heading, at = 0, False, 0

    def flush() -> None:
        nonlocal parts
        text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
        if text:
            linked = len(html.unescape(" ".join(p for p, own in parts if own)).split())
            words = len(text.split())
            out.append((text, words, min(linked, words), *stack[-1][1:], heading))
        parts = []

    for m in _PIECE.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], link > 0))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in INLINE:
            if tag == "a":
                link = max(0, link + (-1 if m[2] else 1)) if m[2] or not link else 1
            continue
        flush()
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = not m[2]
        if tag in VOID or tag in ("html", "body"):
            continue
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] not in CLOSES and tag in CLOSES:
                    break  # a stray end tag closes nothing outside of its container
            continue
        while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(tag, ())):
            stack.pop()
        if not (m[4] or "").endswith("/") or tag in CLOSES:
            marks = " ".join(a or b or c for a, b, c in _MARKS.findall(m[4] or ""))
            _, boiler, mark, main = stack[-1]
            own = 0 if tag in MAIN_TAGS else marked(marks)
            main = main or tag in MAIN_TAGS or own < 2 and any(p in MAIN_WORDS for p in re.split(r"[\s_-]+", marks.lower()))
            boiler = boiler or tag in BOILER_TAGS or bool(m[4] and _HIDES.search(m[4])) or tag == "header" and not main
            stack.append((tag, boiler, max(mark, own), main))
            link = 0
    if at < len(page):
        parts.append((page[at:], link > 0))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; beside the first and the last stand empty blocks."""
    n = len(found)
    words = np.zeros(n + 2)
    links = np.zeros(n + 2)
    words[1:-1] = [b[1] for b in found]
    links[1:-1] = [b[2] / b[1] for b in found]
    marks = np.array([b[3:] for b in found], dtype=float).reshape(n, 4)
    main = np.full(n, float(any(b[5] and not b[3] and b[4] < 2 for b in found)))
    plain = np.full(n, float(any(not b[3] and not b[4] and b[1] >= PLAIN and 2 * b[2] < b[1] for b in found)))
    return np.column_stack([marks, words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], main, plain])


_LONG = "This sentence goes on for a good while so that its block has many words, as the legal notes and teasers of real pages often have, and yet it may be none of the main text."
#: The labelled table: small pages, and for each of their blocks whether it is main text.
LABELLED = [
    ("<nav><ul><li><a href=x>Home</a></li><li><a href=y>World news</a></li></ul></nav><article><h1>A title of few words</h1><p>Some text of the article that runs over a number of words and says a thing.</p><p>Yes.</p></article><footer>&copy; 2020 example.org, all about it and more words here</footer>", "00" "111" "0"),
    ("<header><h2>The Daily Example</h2><p>All the news that we could find today</p></header><main><h1>Title</h1><p>First paragraph with <a href=x>a link</a> in it and more words after the link.</p><ul><li><a href=z>One linked item</a></li><li>Another item</li></ul><p>End.</p></main><aside><h3>Most read</h3><p>A teaser for some other story that is long enough to look like text</p></aside>", "00" "11111" "00"),
    ("<div class=menu><a href=a>About us</a> <a href=b>Contact</a></div><div><p>This page has no article element but a long paragraph of plain words that goes on and on, as main text does, for quite a few words more.</p><p>A second long paragraph follows the first one with many more words, none of which is part of any link at all in it.</p></div><div><a href=c>Next page</a></div><div>Copyright</div>", "0" "11" "0" "0"),
    ("<div id=cookie-notice><p>We use cookies to give you the best experience on this site, and you can accept or refuse them.</p></div><article><p>Short.</p><p>Text of the story in a sentence or two, about as long as this one.</p><div class=ad>Buy this now, it is very good and cheap</div><p>More of it.</p></article><div class=comments><p>I do not agree with this article at all, here is why, and at length.</p></div>", "0" "11" "0" "1" "0"),
    ("<form><p>Your name and your address, please, then press the button below</p><button>Send</button></form><article><h2>Head</h2><p><a href=q>A paragraph that is all link</a></p><p>Words and words and words.</p></article><section class=related><p>Related: other stories that you may like to read next</p></section>", "00" "111" "0"),
    ("<div><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div><div><h1>Plain page</h1><p>Its only paragraph holds more than twenty words, all of them outside of links, so that it counts as the text of this page.</p></div><div><a href=4>Privacy</a> <a href=5>Terms</a></div>", "0" "11" "0"),
    ("<p>A page of a single paragraph that has no marks of any kind but quite a number of words in a row, enough to be text.</p><p><a href=w>See all of our other pages</a></p>", "1" "0"),
    ("<article><p>One paragraph", "1"),
    (f"<article><p>A short story.</p></article><aside><p>{_LONG}</p></aside><footer><p>{_LONG}</p><p>{_LONG}</p></footer>", "1" "0" "00"),
    (f"<div class=cookie-banner><p>{_LONG}</p></div><div><p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p></div><div class=comments><p>{_LONG}</p><p>{_LONG}</p></div>", "0" "111" "00"),
    (f"<article><p>{_LONG}</p><p>The end.</p></article><div><p>{_LONG}</p></div>", "11" "0"),
    (f"<div><p>{_LONG}</p></div><main><h2>A head</h2><p>{_LONG}</p></main><div><p>{_LONG}</p></div>", "0" "11" "0"),
    (f"<div><p>{_LONG}</p></div><nav>{_LONG}</nav><p>{_LONG}</p>", "1" "0" "1"),
    ("<nav><a href=a>Menu entry</a></nav><article><h1>Head</h1><p>Yes.</p><p>The last words of a page that breaks off he", "0" "111"),
    ("<ul><li><a href=1>Start</a></li><li><a href=2>Archive</a></li></ul><p>A plain page whose last block is its text, which holds more than twenty words outside of any link and nothing behind it.</p>", "00" "1"),
    ("<main><p><a href=1>All link</a></p></main>", "1"),
    (f"<nav><a href=1>Up</a></nav><section class=legal-news><h1>A judgement</h1><p>{_LONG}</p><p>{_LONG}</p></section>", "0" "111"),
    (f"<div class=story-side><p>{_LONG}</p><p>{_LONG}</p></div><div class=footer>All of it</div>", "11" "0"),
    (f"<article><p>{_LONG}</p><ul><li>A point</li><li class=comment>I hate it, and here is why I do</li></ul><p class=ad>Buy now, it is cheap</p><div class=legal-note>A part of the story, in its own box.</div><p>End.</p></article>", "11" "0" "0" "1" "1"),
    ("<article><p>Text of it.</p><form><p>Mail</p></form><nav>One two three</nav><p>And on it goes</p></article>", "1" "0" "0" "1"),
    (f"<article><p>Text of it.</p><form><p>{_LONG}</p></form></article>", "1" "0"),
    (f"<article><p>Short.</p></article><div class=legal><p>{_LONG}</p></div>", "1" "0"),
    (f"<div><p>{_LONG}</p></div><div class=legal-notice><p>{_LONG}</p></div><div class=story-comments><p>{_LONG}</p></div>", "1" "0" "0"),
    ("<p><a href=1>Up</a></p><p>Short note</p><article><p>Text.</p><p>More text here</p></article><p>Page 3 of 7</p>", "00" "11" "0"),
]


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6) -> None:
        self.value = bool(2 * y.sum() >= len(y)) if len(y) else False
        self.split: tuple[int, float, Tree, Tree] | None = None
        if depth == 0 or len(set(y.tolist())) < 2:
            return
        best = None
        for j in range(x.shape[1]):
            for cut in (np.unique(x[:, j])[1:] + np.unique(x[:, j])[:-1]) / 2:
                low = x[:, j] < cut
                cost = sum(2 * s.sum() * (1 - s.mean()) for s in (y[low], y[~low]))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, j, cut, low)
        if best is not None:
            _, j, cut, low = best
            self.split = (j, float(cut), Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value)
        j, cut, low, high = self.split
        side = x[:, j] < cut
        out = np.empty(len(x), dtype=bool)
        out[side], out[~side] = low(x[side]), high(x[~side])
        return out


def fit(labelled: list[tuple[str, str]] = LABELLED) -> Tree:
    found = [(blocks(page), labels) for page, labels in labelled]
    for got, labels in found:
        if len(got) != len(labels):
            raise ValueError(f"{len(got)} blocks, {len(labels)} labels: {[b[0] for b in got]}")
    return Tree(np.concatenate([features(got) for got, _ in found]), np.array([c == "1" for _, labels in found for c in labels], dtype=float))


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, keep in zip(found, tree(features(found)), strict=True) if keep) if found else ""


SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    A null or empty html, and one without main text, gives an empty text; a page that breaks
    off is read as far as it goes; of equal splits of the tree the first feature counts; a page of
    any length is read whole; repeated rows are read one by one; an empty table gives an empty
    one; other columns are ignored.
    """
    C.tune(pages.sparkSession)
    tree = fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "", tree) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
