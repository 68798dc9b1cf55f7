"""Articles with comments: cut-off titles, and quotes of earlier comments."""

from __future__ import annotations

import difflib
import re
from collections import Counter

# ---- Fixed values: tags, patterns and bounds ----

TITLE = r"(<\|start_of_articleid=\d+\|>)[^\n]*?…[^\S\n]*\n"
BLOCK = r"(?s)(<\|start_of_comment_articleid=\d+\|>)(.*?)(<\|end_of_comment_articleid=\d+\|>)"
SAID = r".{1,60}?\b(?:said|wrote):\s*"
URL = r"(?i)\s*(?:https?://|www\.)\S+\s*"
BOILERPLATE = r"(?i)\b(?:this (?:comment|post) (?:was|has been) edited|last edited by|edited by\b.*\bon\b|originally posted by)\b"
MIN_CHARS, MIN_WORDS, SIMILAR = 40, 8, 0.85

_TITLE, _BLOCK, _SAID, _URL, _BOILER = (re.compile(p) for p in (TITLE, BLOCK, SAID, URL, BOILERPLATE))


def strip_truncated_titles(text: str) -> str:
    """Without the rest of an article's first line where that ends in an ellipsis."""
    return _TITLE.sub(r"\1", text)


def normal(paragraph: str) -> str:
    return " ".join(paragraph.split()).lower()


def quotable(plain: str, paragraph: str) -> bool:
    """plain: the paragraph, normalised."""
    return len(plain) >= MIN_CHARS and len(plain.split()) >= MIN_WORDS and not _URL.fullmatch(paragraph.strip()) and not _BOILER.search(paragraph)


class Quotes:
    """Finds, among the paragraphs of earlier comments, the one that a paragraph repeats."""

    def __init__(self):
        self.known: list[tuple[int, str, Counter]] = []
        self.first: dict[str, int] = {}

    def source(self, plain: str) -> int | None:
        """The comment whose paragraph is most like it, the first of equals; none below SIMILAR."""
        if plain in self.first:  # only equal texts have a ratio of 1
            return self.first[plain]
        best, found, held = SIMILAR, None, Counter(plain)
        for number, other, counted in self.known:
            # 2 min / sum bounds the ratio, and so do the characters that both hold, as quick_ratio() counts them; so most pairs need no match
            size = len(plain) + len(other)
            if 2.0 * min(len(plain), len(other)) / size < best:
                continue
            if 2.0 * sum([min(n, counted[c]) for c, n in held.items() if c in counted]) / size < best:
                continue
            ratio = difflib.SequenceMatcher(None, plain, other).ratio()
            if ratio > best or ratio == best and found is None:
                best, found = ratio, number
        return found

    def add(self, number: int, plain: str, paragraph: str) -> None:
        if len(plain) >= MIN_CHARS and not _BOILER.search(paragraph):
            self.known.append((number, plain, Counter(plain)))
            self.first.setdefault(plain, number)


def tagged_comment(text: str, number: int, quotes: Quotes) -> str:
    """A comment with its quotes wrapped; then its own paragraphs can be quoted."""
    paragraphs = [(p, normal(p)) for p in text.split("\n")]
    sources = [quotes.source(plain) if quotable(plain, p) else None for p, plain in paragraphs]
    lines: list[str] = []
    open_ref: list[str] | None = None
    number_of = None
    for (p, _), source in zip([*paragraphs, ("", "")], [*sources, None]):
        if source is not None:
            if open_ref is None:  # a heading such as "X wrote:" belongs to the quote
                open_ref, number_of = ([lines.pop()] if lines and _SAID.fullmatch(lines[-1].strip()) else []), source
            open_ref.append(p)
            continue
        if open_ref is not None:
            lines.append(f"<ref id={number_of}>" + "\n".join(open_ref) + "</ref>")
            open_ref = None
        lines.append(p)
    for p, plain in paragraphs:
        quotes.add(number, plain, p)
    return "\n".join(lines[:-1])


def tag_comment_quotes(text: str) -> str:
    """Paragraphs of comments that repeat an earlier comment of their block, wrapped as <ref id=N>."""

    def block(m: re.Match) -> str:
        quotes, number, out = Quotes(), 0, []
        for comment in m[2].split("\n\n"):
            if comment.strip():
                number += 1
                comment = tagged_comment(comment, number, quotes)
            out.append(comment)
        return m[1] + "\n\n".join(out) + m[3]

    return _BLOCK.sub(block, text)


def clean(text: str) -> str:
    return tag_comment_quotes(strip_truncated_titles(text))
