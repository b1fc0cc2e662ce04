"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags. Each block has its word count and link density, those of
its neighbours, and marks: inside a main element or not, under an element that is furniture by its tag or by a class
or id that names nothing else, in a heading. A decision tree keeps or drops it. The tree is grown here on the blocks of the small labelled
pages of ``html_pages``, which have main elements or none, and ids and classes that mislead.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, table
from .html_pages import PAGES, expanded

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
#: Attributes in order, each with its whole value, so nothing inside a value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Nothing in these is text of the page.
SILENT = frozenset("head title script style noscript template textarea select button svg math iframe object canvas audio video datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Names of furniture in classes and ids.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer copyright sidebar aside widget related recommended cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login share sharing social comment comments commentlist disqus reply replies respond form search skip toolbar "
    "pagination pager legal disclaimer".split()
)
#: Words that may stand beside them; with any other word, as in ``search-engines``, a name is of the content.
BESIDE = HINTS | frozenset(
    "main page site top bottom left right inner outer box block bar list item items link links section area container wrapper wrap content body row col column "
    "slot unit thread post posts button buttons icon icons text title heading panel group primary secondary global sticky small large media policy".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    zone: int  # 1 in a main element, 0 on a page without one, -1 outside it on a page that has one
    furniture: bool
    heading: bool


@dataclass
class _Open:
    tag: str
    silent: bool = False
    furniture: bool = False
    main: bool = False
    heading: bool = False
    link: bool = False


def _hinted(tag: str, name: str, value: str) -> bool:
    """Whether a class or id names furniture: all words of one of its names are such or may stand beside them."""
    if tag in HEADINGS:
        return False
    for one in [value] if name == "id" else value.split():
        found = {w.lower() for w in _WORDS.findall(one)}
        if found & HINTS and found <= BESIDE:
            return True
    return False


def _opened(tag: str, attributes: str, inside: _Open) -> _Open:
    furniture = inside.furniture or tag in FURNITURE or tag == "header" and not inside.main
    silent, main = inside.silent or tag in SILENT, inside.main or tag in MAIN
    if attributes and tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                furniture |= _hinted(tag, name, value) and not (inside.main and "header" in value.lower())
            elif name == "role":
                furniture |= value.lower() in ROLES
                main |= value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                silent = True
    return _Open(tag, silent, furniture, main, inside.heading or tag in HEADINGS, inside.link or tag == "a")


def blocks(page: str | None) -> list[Block]:
    """The page's flat blocks with text, in order."""
    out: list[Block] = []
    stack = [_Open("")]
    parts: list[str] = []
    linked = 0
    seen_main = False

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                n = len(text.split(" "))
                out.append(Block(text, n, min(1.0, linked / n), int(top.main), top.furniture, top.heading))
        parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].silent:
            text = html.unescape(raw)
            parts.append(text)
            if stack[-1].link:
                linked += len(text.split())

    page, at = page or "", 0
    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                end_block()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK:
            end_block()
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph or item ends here
                if stack[k].tag == "p" or tag == "li" == stack[k].tag or tag in ("td", "th") and stack[k].tag in ("td", "th") or tag in ("dt", "dd") and stack[k].tag in ("dt", "dd"):
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        new = _opened(tag, m[3], stack[-1])
        seen_main |= new.main and not new.furniture
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if not m[3].endswith("/"):
            stack.append(new)
    say(page[at:])
    end_block()
    if seen_main:
        for b in out:
            b.zone = b.zone or -1
    return out


FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "zone", "furniture", "heading")


def features(page: list[Block]) -> np.ndarray:
    none = Block("", 0, 0.0, 0, False, False)
    rows = []
    for i, b in enumerate(page):
        before, after = page[i - 1] if i else none, page[i + 1] if i + 1 < len(page) else none
        rows.append((b.words, b.link_density, before.words, before.link_density, after.words, after.link_density, b.zone, b.furniture, b.heading))
    return np.array(rows, float).reshape(-1, len(FEATURES))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages; a block's first sign is its label."""
    x, y = [], []
    for page in PAGES:
        found = blocks(expanded(page))
        x.append(features(found))
        y += [{"+": 1, "-": 0}[b.text[0]] for b in found]
    return np.concatenate(x), np.array(y, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple:
    """A binary tree by Gini impurity: (feature, threshold, at most, above) or the share of label 1."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            impurity = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), low)
    if best is None:
        return (share,)
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def decide(tree: tuple, row) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


TREE = grow(*labelled())


def main_text(page: str | None, tree: tuple = TREE) -> str:
    found = blocks(page)
    return " ".join(b.text for b, row in zip(found, features(found).tolist(), strict=True) if decide(tree, row))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id and url, the main text (empty if none, also for null) and its code points.

    Blocks keep the page's order and are joined by a blank; repeated pages are done each; other columns are not
    read; no pages give no rows. Rows stay in their partition.
    """
    ship(pages.sparkSession)
    tree = TREE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [main_text(x.as_py(), tree) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
