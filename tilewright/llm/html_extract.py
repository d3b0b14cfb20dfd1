"""Main text of web pages by the distribution of text over line blocks.

1. Markup is stripped in one pass.  Each block element becomes a line; text of
   scripts, styles, forms and page furniture (menus, headers, footers, side
   bars, notices, adverts, reader comments, by element or by class and id) is
   dropped with its element.  References are decoded, white space becomes one
   space, empty lines vanish.
2. Each line weighs the characters of its text outside links, nothing where
   these hold no word.
3. A line's block is the sum of weights over ``window`` lines from it on.  The
   text dives where a whole window is empty, and surges in the stretch up to
   the dive if a block reaches the threshold there: ``threshold`` characters, or
   half the page's heaviest block on pages of little text.
4. The lines from the first to the last of some weight of every such stretch are
   the text, joined by a line feed, lines of links between them included.

An article or main element decides nothing but that a header inside it is text.

Edge cases: null and empty html give an empty text; a page whose lines all have
no weight gives its lines outside links; unclosed elements end with the page, an
unclosed script or style hides the rest, as in browsers, a quote that is never
closed is a character; nothing is cut off by length, and time is linear in it.
Repeated rows are handled alike, a null page_id and url stay null, further
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "page_id long, url string, text string, n_chars long"
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[^\W_]")
NAME_PART = re.compile(r"[a-z]+")
# Fixed values of HTML.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav aside footer form menu dialog select button head".split())
ARTICLE = frozenset(("article", "main"))
#: Class and id words that mark page furniture.
FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr menu modal nav navbar navigation newsletter notice notices overlay popup promo promoted promotion related respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Words in front of them that tell of a page's layout, and words that mark text.
LAYOUT_WORDS = frozenset("has no not with without is hide hides show shows".split())
TEXT_WORDS = frozenset("article body content entry main page post story text".split())
ROLES = frozenset("navigation banner complementary contentinfo search form menu menubar dialog alert".split())


@dataclass
class Line:
    text: str
    weight: int  # characters outside links, if they hold a word
    linked: bool


def marks_furniture(value: str) -> bool:
    """Whether a class or id is furniture: one of its names is, and none is text's.

    A name such as has-sidebar tells of the layout, social-story is a story.
    """
    names = [NAME_PART.findall(name) for name in value.lower().split()]
    if any(parts and parts[-1] in TEXT_WORDS for parts in names):
        return False
    return any(not FURNITURE_WORDS.isdisjoint(parts) and parts[0] not in LAYOUT_WORDS for parts in names)


def is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if "=" not in attributes or name in ("body", "html", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        value = html.unescape(value.strip("\"'"))
        if value.lower() in ROLES if key.lower() == "role" else marks_furniture(value):
            return True
    return False


def to_lines(page: str) -> list[Line]:
    lines: list[Line] = []
    parts: list[str] = []
    plain: list[str] = []  # the parts outside links
    stack: list[tuple[str, bool, bool]] = []  # element, starts furniture, starts an article
    open_names: Counter = Counter()
    hidden = depth = 0

    def add(piece: str) -> None:
        parts.append(piece)
        plain.append(" " if open_names["a"] else piece)

    def end_line() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                outside = " ".join(html.unescape("".join(plain)).split()) if open_names["a"] or plain != parts else text
                lines.append(Line(text, len(outside) if WORD.search(outside) else 0, len(outside) < len(text)))
            parts.clear()
            plain.clear()

    def leave(to: int) -> None:
        nonlocal hidden, depth
        while len(stack) > to:
            name, furniture, article = stack.pop()
            open_names[name] -= 1
            hidden -= furniture
            depth -= article

    at = 0
    while True:
        tag = TAG.search(page, at)
        piece = page[at : tag.start()] if tag else page[at:]
        if piece and not hidden:
            add(piece)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            if tag[0].startswith("<![CDATA[") and not hidden:
                add(tag[0][9:-3])
            continue
        if name in BLOCK:
            end_line()
        elif name == "br" and not hidden:
            add(" ")
        if tag[1]:  # an end tag closes up to its element, if that is open
            if open_names[name]:
                top = len(stack) - 1
                while stack[top][0] != name:
                    top -= 1
                leave(top)
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID:
            if name == "p" and stack and stack[-1][0] == "p":  # a paragraph ends the one before
                leave(len(stack) - 1)
            furniture, article = is_furniture(name, tag[3] or "", depth > 0), name in ARTICLE
            stack.append((name, furniture, article))
            open_names[name] += 1
            hidden += furniture
            depth += article
    end_line()
    return lines


def surges(weights: list[int], window: int, threshold: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches between a surge and the dive behind it."""
    blocks = [sum(weights[i : i + window]) for i in range(len(weights))]
    enough = min(threshold, max(blocks, default=0) / 2)
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(weights):
        if not weights[i]:
            i += 1
            continue
        start, last, heaviest = i, i, 0
        while i < len(weights) and blocks[i]:
            last = i if weights[i] else last
            heaviest = max(heaviest, blocks[i])
            i += 1
        if heaviest >= enough:
            out.append((start, last + 1))
    return out


def main_text(page: str | None, *, window: int = 3, threshold: int = 86) -> str:
    lines = to_lines(page or "")
    found = surges([x.weight for x in lines], window, threshold)
    kept = [x for a, b in found for x in lines[a:b]] if found else [x for x in lines if not x.linked]
    return "\n".join(x.text for x in kept)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, threshold: int = 86) -> DataFrame:
    """page_id, url, text, n_chars for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), window=window, threshold=threshold) for h in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, OUT)
