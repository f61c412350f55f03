"""Main-text extraction by line-block distribution.

Markup is stripped by one scan over the tags: each block element's text becomes a
line (with white space inside joined to one space). A line weighs what text it has,
less twice what of it lies in links, so that lists of links weigh nothing. Over the
lines the weights are summed in sliding windows; the text surges where a window's sum
rises from nothing on a line with weight and dives where it has fallen to nothing. A
stretch between surge and dive is kept when its largest sum reaches the threshold: a
share of the page's largest sum, up to a ceiling, so that short pages keep their text.

What HTML itself says is not the article (nav, footer, aside, form, script, hidden
parts and the like) is left out. What authors say is a weight only: text in <article>
or <main> weighs more, text in elements whose class or id names a menu, an advert or
comments weighs little; both get line blocks of their own, so that an advert beside
a paragraph is judged by itself.

Defined cases: a null or empty page gives an empty text; markup that is never
closed runs to the page's end; a stray "<" is text; repeated rows give repeated
results; other columns are not read. A page of any length is read whole, in time
linear in its length, one page at a time, so memory is bounded by the longest page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines in a window; the threshold's share of the page's largest sum, and its ceiling.
WINDOW, SHARE, CEILING = 3, 0.25, 480.0
#: Factors of text in article elements and of text whose class names something else; the latter's least threshold.
ARTICLE, NAMED, NAMED_LEAST = 8.0, 0.02, 60.0

EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"

# Names of HTML elements by their role, and landmark roles.
RAW = frozenset("script style textarea title iframe xmp".split())
SKIPPED = frozenset("nav footer aside form menu dialog head noscript template svg math canvas object audio video select datalist button".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Elements that a new paragraph-like element closes.
CLOSES = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "td"}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of class and id names for what is mostly not the article; the second only outside article elements.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead toolbar cookie cookies consent notice notices alert popup modal newsletter subscribe signup login search share sharing social related recommended recommendations comment comments replies disqus respond widget widgets pagination pager copyright overlay tags".split()
)
OUTSIDE_NAMES = frozenset("header topbar legal imprint".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NONE = re.compile(r"display\s*:\s*none", re.I)
_BLANK = re.compile(r"\s+")
_PARTS = re.compile(r"[-_]+")


@dataclass
class Line:
    text: str
    weight: float
    block: int  # lines of one number share their windows
    named: bool  # the text's element is named as something else


def _names(value: str, in_article: bool) -> bool:
    """Whether a name of a class or id says what is not the article: as a whole, by its last part, or by the first of two."""
    for name in value.lower().split():
        parts = [p for p in _PARTS.split(name) if p]
        for word in {name, *parts[-1:], *(parts[:1] if len(parts) == 2 else [])}:
            if word in NAMES or (not in_article and word in OUTSIDE_NAMES):
                return True
    return False


def _judged(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is left out, and whether it is named as something else."""
    if name in SKIPPED or (name == "header" and not in_article):
        return True, False
    named = False
    for key, a, b, c in _MARK.findall(attributes) if attributes else ():
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _NONE.search(value)):
            return True, False
        if key == "role" and value.lower() in SKIPPED_ROLES and name not in ("body", "html"):
            return True, False
        if key in ("class", "id") and name not in ("body", "html", "article", "main"):
            named = named or _names(value, in_article)
    return False, named


def lines_of(page: str) -> list[Line]:
    """The text blocks of a page in order; an element that is left out gives a line without text."""
    out: list[Line] = []
    text: list[str] = []
    #: Open elements: name, left out, (block, article, named) around them, the line that one of its own interrupts.
    stack: list[tuple[str, bool, tuple[int, bool, bool], tuple[list[str], int] | None]] = []
    solid: list[int] = []  # where in the stack elements other than inline ones are
    opened: Counter = Counter()
    at = skipped = links = linked = blocks = 0
    where = (0, False, False)

    def end_line() -> None:
        nonlocal linked
        line = _BLANK.sub(" ", html.unescape("".join(text))).strip()
        if line:
            block, article, named = where
            out.append(Line(line, max(0, len(line) - 2 * linked) * (ARTICLE if article else 1.0) * (NAMED if named else 1.0), block, named))
        text.clear()
        linked = 0

    def close(k: int) -> None:
        """Closes open elements down to the k-th."""
        nonlocal skipped, links, linked, where
        while len(stack) > k:
            name, left_out, around, line = stack.pop()
            if around != where:
                end_line()
                where = around
            if line:
                text[:], linked = line
            opened[name] -= 1
            skipped -= left_out
            links -= name == "a"
            if solid and solid[-1] == len(stack):
                solid.pop()

    while m := _TAG.search(page, at):
        if not skipped and m.start() > at:
            part = page[at : m.start()]
            text.append(part)
            linked += len(part) * (links > 0)
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if name not in INLINE and not skipped:
                end_line()
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if name == "br" and not skipped:
            text.append("\n")
        elif name not in INLINE and not skipped:
            end_line()
        if name in ENDS_P or name in CLOSES:
            shut = "p" if name in ENDS_P else CLOSES[name]
            if solid and stack[solid[-1]][0] == shut:
                close(solid[-1])
        if name in VOID or m[3].endswith("/"):
            continue
        left_out, named = _judged(name, m[3], where[1])
        if left_out and not skipped and name not in INLINE:
            out.append(Line("", 0.0, where[0], False))
        if name not in INLINE:
            solid.append(len(stack))
        around, line, article = where, None, name in ("article", "main")
        if not skipped and not left_out and ((article and not where[1]) or (named and not where[2])):
            if name in INLINE:
                line = (text[:], linked)
                text.clear()
                linked = 0
            else:
                end_line()
            blocks += 1
            where = (blocks, where[1] or article, where[2] or named)
        stack.append((name, left_out, around, line))
        opened[name] += 1
        skipped += left_out
        links += name == "a"
        if name in RAW:  # its content is not markup
            end = re.compile(f"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
    if not skipped:
        text.append(page[at:])
    end_line()
    return out


def window_sums(weights: list[float], window: int = WINDOW) -> list[float]:
    """For each line the sum of the window that starts there."""
    return [sum(weights[i : i + window]) for i in range(len(weights))]


def between_surge_and_dive(weights: list[float], window: int = WINDOW) -> list[tuple[int, int, float]]:
    """Stretches [from, to) of lines and their largest sum: each starts where the window's sum rises from
    nothing on a line with weight, and ends where the sum has fallen to nothing."""
    sums, found, i = window_sums(weights, window), [], 0
    while i < len(sums):
        if weights[i] > 0:
            j = i
            while j < len(sums) and sums[j] > 0:
                j += 1
            found.append((i, j, max(sums[i:j])))
            i = j
        else:
            i += 1
    return found


def main_text(page: str | None, window: int = WINDOW, share: float = SHARE, ceiling: float = CEILING) -> str:
    lines = lines_of(page or "")
    blocks: dict[int, list[int]] = {}
    for i, line in enumerate(lines):
        blocks.setdefault(line.block, []).append(i)
    stretches = [(own[a:b], most) for own in blocks.values() for a, b, most in between_surge_and_dive([lines[i].weight for i in own], window)]
    threshold = min(ceiling, share * max((most for _, most in stretches), default=0.0))
    kept = [i for own, most in stretches for i in own if most >= (max(threshold, NAMED_LEAST) if lines[own[0]].named else threshold)]
    return "\n".join(lines[i].text for i in sorted(kept) if lines[i].text)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, EXTRACTED)
