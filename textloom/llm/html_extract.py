"""HTML extraction by line-block distribution.

A page becomes lines: markup, comments, scripts, styles and what is never shown are stripped, and block-level
tags end a line. Each line has a weight: the length of its text outside links (of a heading, all of it), up to FULL; MARKED more
inside the page's <article> or <main>; nothing outside of it, if it has text, and nothing for page furniture (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments), of which neighbouring lines count as one.
Weights are summed over sliding windows of WINDOW lines. Where the sum surges over THRESHOLD, or over half of the page's greatest
sum if that is less, a stretch of text begins; where it dives to nothing, the stretch ends. What lies between
the first surge and the last dive is kept, less furniture. So the distribution drops stray short lines and
links before the text, and lists of links, and what follows them without surging again, after it.

A form, or a wrapper that only its class, id or role makes furniture, may be the page's layout, and then weighs like text.
It does if it holds the <main>; if it holds an <article> with more text than the
page has otherwise; or if the page's densest block of lines lies in it. Wrappers of other
texts (comments, adverts, notices, related stories) do only for a <main>, or for an
<article> on a page without any other text.

Defined results: null or empty html gives the empty text; a page without markup is all
text; broken markup (tags that never close) ends at the end of its container or of the page.
Repeated rows are extracted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

#: Lines in a block.
WINDOW = 3
#: Characters in a block that begin a stretch of text.
THRESHOLD = 80
#: What one line weighs at most by its length, and what it weighs more inside the article: a short line there surges by itself.
FULL, MARKED = 400, THRESHOLD + 1

_BLOCK = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section summary
    table tbody td tfoot th thead title tr ul""".split()
)
#: Elements whose text is never shown as prose.
_RAW = frozenset("script style textarea title noframes xmp iframe noembed".split())
_SKIP = frozenset("head nav footer aside script style noscript template svg math canvas audio video object select button iframe textarea menu dialog title noframes xmp noembed search".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class, id or role that mark furniture: wrappers of other texts than the page's own,
_OTHERS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion footer cookie cookies consent gdpr popup modal overlay
    newsletter subscribe subscription signup login share sharing related recommended recommendations comment comments disqus respond replies reply
    copyright contentinfo outbrain taboola""".split()
)
#: and parts of the page that its layout may be named after.
_FURNITURE = _OTHERS | frozenset(
    """banner nav navbar navigation menu breadcrumb breadcrumbs header masthead sidebar side-bar aside widget widgets notice notices social pagination pager
    toolbar search form legal disclaimer complementary alert skip toc tags""".split()
)
#: Parts of a class that say where furniture is or what shape it has; other parts, such as has- or -wrap, make it another class.
_PLAIN = re.compile(r"site|top|bottom|global|primary|secondary|list|area|box|bar|block|slot|unit|links?|items?|section|posts|articles|stories|\d+(?:x\d+)?")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
#: Furniture never contains what marks the article itself.
_MARKS = frozenset(("article", "main"))


def _words(value: str) -> frozenset[str]:
    """The furniture words of a class, id or role, from tokens that say nothing else."""
    out: set[str] = set()
    for token in value.lower().split():
        if token in _FURNITURE:
            out.add(token)
            continue
        parts = [x for x in re.split(r"[_-]", token) if x]
        named = [x for x in parts if x in _FURNITURE]
        if named and all(x in _FURNITURE or _PLAIN.fullmatch(x) for x in parts):
            out.update(named)
    return frozenset(out)


def _furniture(tag: str, attrs: str) -> tuple[bool, frozenset[str]]:
    """Whether an element is never part of the text, and the words that make it furniture unless it proves to be layout."""
    if tag in _SKIP:
        return True, frozenset()
    words = frozenset(("form",)) if tag == "form" else frozenset()
    if not attrs or tag in ("html", "body") or tag in _MARKS:
        return False, words
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, words
        if name in ("class", "id", "role"):
            words |= _words(value)
    return False, words


class Wrapper:
    """An element that its class, id or role, or its being a form, makes furniture."""

    def __init__(self, words: frozenset[str]):
        self.layout = not words & _OTHERS


class Mark:
    """An <article> or <main> that no other one is around, and the wrappers around it."""

    def __init__(self, tag: str, wrappers: tuple[Wrapper, ...]):
        self.main, self.wrappers = tag == "main", wrappers


#: What is around a piece of an element that is always furniture.
_ALWAYS = (Wrapper(_OTHERS),)
#: A piece of a line: the wrappers around it, its text, and whether that is a link's.
Piece = tuple[tuple[Wrapper, ...], str, bool]
#: Pieces of a line, and the line's mark.
Line = tuple[list[Piece], Mark | None]


def _text(pieces: list[Piece], lifted: frozenset[Wrapper], links: bool = True) -> str:
    return _SPACE.sub(" ", html.unescape("".join(x for wrappers, x, link in pieces if (links or not link) and (not wrappers or lifted.issuperset(wrappers))))).strip()


def parsed(page: str) -> list[Line]:
    """The page's lines."""
    lines: list[Line] = []
    parts: list[Piece] = []
    stack: list[tuple[str, bool, Wrapper | None, bool]] = []  # tag, furniture, wrapper, mark
    wrappers: tuple[Wrapper, ...] = ()
    mark: Mark | None = None
    skip = links = headings = 0

    def end() -> None:
        nonlocal parts
        if any(x and not x.isspace() for _, x, _ in parts):
            lines.append((parts, mark))
        parts = []

    def put(text: str) -> None:
        parts.append((_ALWAYS if skip else wrappers, text, links > 0 and not headings))

    def pop() -> None:
        nonlocal skip, mark, wrappers, links, headings
        tag, bad, wrapper, marked = stack.pop()
        skip -= bad
        links -= tag == "a"
        headings -= tag in _HEADING
        if wrapper:
            wrappers = wrappers[:-1]
        if marked:
            mark = None

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in ("table", "article", "main", "body") and tag not in ("article", "main", "body", "html", "table"):
                return

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            put(text)
        if not found:
            break
        at = found.end()
        if found[1] is not None:
            put(html.escape(found[1], quote=False))
        tag = (found[3] or "").lower()
        if not tag:
            continue
        if found[2]:
            if tag in _BLOCK:
                end()
            if tag == "p" and not any(x[0] == "p" for x in stack):
                continue
            close(tag)
            continue
        attrs = found[4] or ""
        if tag in _BLOCK:
            end()
            # a block ends an open paragraph or item of its kind
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                if stack and stack[-1][0] == tag:
                    pop()
            elif tag != "br":
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "u", "span", "a", "font", "small") and any(x[0] == "p" for x in stack):
                    pop()
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in _VOID or attrs.rstrip().endswith("/") and tag not in _BLOCK:
            continue
        if tag == "body":
            while stack and stack[-1][0] != "html":
                pop()
        bad, words = _furniture(tag, attrs)
        # the heading of an article is its text; that of a page is furniture
        bad = bad or tag == "header" and not mark
        wrapper = Wrapper(words) if words and not bad and not skip else None
        marked = tag in _MARKS and not skip and not mark
        if wrapper:
            wrappers = (*wrappers, wrapper)
        if marked:
            mark = Mark(tag, wrappers)
        stack.append((tag, bad, wrapper, marked))
        skip += bad
        links += tag == "a"
        headings += tag in _HEADING
    end()
    return lines


def page_lines(page: str, lines: list[Line] | None = None, lifted: frozenset[Wrapper] = frozenset()) -> tuple[list[str], list[bool]]:
    """The page's lines, empty where they are furniture, and whether each is in its article."""
    texts, inside, _ = _laid(parsed(page) if lines is None else lines, lifted)
    return texts, inside


def _laid(lines: list[Line], lifted: frozenset[Wrapper]) -> tuple[list[str], list[bool], list[int]]:
    """The lines' texts, whether each is in the article, and its length outside links. Neighbouring lines of furniture are one, without text."""
    texts, inside, lengths, empty = [], [], [], False
    for pieces, mark in lines:
        text = _text(pieces, lifted)
        if text or not empty:
            texts.append(text)
            inside.append(mark is not None and lifted.issuperset(mark.wrappers))
            lengths.append(len(_text(pieces, lifted, False)) if text and any(link for _, _, link in pieces) else len(text))
        empty = not text
    return texts, inside, lengths


def weights(texts: list[str], inside: list[bool], lengths: list[int]) -> list[int]:
    """What each line weighs in the distribution."""
    if any(x and y for x, y in zip(texts, inside, strict=True)):
        return [min(n, FULL) + MARKED if text and y else 0 for text, y, n in zip(texts, inside, lengths, strict=True)]
    return [min(n, FULL) for n in lengths]


def blocks(weight: list[int], window: int = WINDOW) -> list[int]:
    """The sum of each line's weight and those of the next ones in its window."""
    sums = [0, *accumulate(weight)]
    return [sums[min(i + window, len(weight))] - sums[i] for i in range(len(weight))]


def regions(weight: list[int], window: int = WINDOW, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(surge, dive) of every stretch of text: from a block above the threshold to the next of no weight, without lines of no weight at both ends."""
    block, out, i = blocks(weight, window), [], 0
    least = min(threshold, max(block, default=0) / 2)
    while i < len(block):
        if block[i] > least:
            dive = next((j for j in range(i, len(block)) if not block[j]), len(block))
            some = [k for k in range(i, dive) if weight[k]]
            out.append((some[0], some[-1] + 1))
            i = dive
        i += 1
    return out


def _chosen(texts: list[str], inside: list[bool]) -> list[str]:
    """The lines' texts, without those outside the article if it has text."""
    if any(x and y for x, y in zip(texts, inside, strict=True)):
        return [x if y else "" for x, y in zip(texts, inside, strict=True)]
    return texts


def _peak(lengths: list[int], window: int = WINDOW) -> int:
    """The most text in a block of lines."""
    return max((sum(lengths[max(0, i - window + 1) : i + 1]) for i in range(len(lengths))), default=0)


def layout(lines: list[Line]) -> frozenset[Wrapper]:
    """The wrappers that hold the page's text."""
    lifted: frozenset[Wrapper] = frozenset()
    around = {wrappers for pieces, _ in lines for wrappers, _, _ in pieces if wrappers}
    marks: dict[tuple[Wrapper, ...], list[int]] = {}  # lengths of the lines in the marks of each nest
    mains = set()
    for pieces, mark in lines:
        if mark and mark.wrappers:
            marks.setdefault(mark.wrappers, []).append(len(_text(pieces, frozenset(mark.wrappers))))
            if mark.main:
                mains.add(mark.wrappers)
    if not marks and not any(w.layout for wrappers in around for w in wrappers):
        return lifted

    def peaks(apart: tuple[Wrapper, ...] = ()) -> dict[tuple[Wrapper, ...], int]:
        """The densest block of what lies directly in each nest of wrappers that may be layout, apart from the marks of one."""
        groups: dict[tuple[Wrapper, ...], list[int]] = {}
        within = not apart and any(y and x for x, y in zip(*page_lines("", lines, lifted), strict=True))
        for pieces, mark in lines:
            if apart and mark and mark.wrappers == apart or within and not (mark and lifted.issuperset(mark.wrappers)):
                continue
            for wrappers in dict.fromkeys(w for w, _, _ in pieces):
                if not lifted.issuperset(wrappers) and all(w.layout for w in wrappers):
                    groups.setdefault(wrappers, []).append(len(_text([((), x, link) for w, x, link in pieces if w == wrappers], lifted)))
        return {wrappers: _peak(x) for wrappers, x in groups.items() if any(x)}

    def is_page(nest: tuple[Wrapper, ...]) -> bool:
        rest = sum(map(len, _chosen(*page_lines("", lines, frozenset(nest[:-1])))))
        others = max(peaks(nest).values(), default=0)
        if not all(w.layout for w in nest):
            return not rest + others
        return sum(marks[nest]) > rest and _peak(marks[nest]) >= others

    # by its marks: a <main>, or the articles with the most text
    order = sorted((x for x in marks if any(marks[x])), key=lambda x: (x not in mains, -sum(marks[x])))
    plain = [next((x for x in order if all(w.layout for w in x) == kind), ()) for kind in (True, False)]
    nest = order[0] if order and order[0] in mains else next((x for x in plain if x and is_page(x)), ())
    lifted = frozenset(nest)
    # by its densest block
    found = peaks()
    best = max(found, key=found.__getitem__, default=())
    if best and found[best] > _peak([len(x) for x in _chosen(*page_lines("", lines, lifted))]):
        lifted |= frozenset(best)
    return lifted


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks in order, one a line."""
    if not page:
        return ""
    lines = parsed(page)
    texts, inside, lengths = _laid(lines, layout(lines))
    found = regions(weights(texts, inside, lengths)) or regions([len(x) for x in texts])  # a page of nothing but links is text
    if not found:
        return ""
    return "\n".join(x for x in _chosen(texts, inside)[found[0][0] : found[-1][1]] if x)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(arrow_map(each), "page_id long, url string, text string, n_chars long")
