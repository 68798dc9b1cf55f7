"""Repetition in one text: repeated n-grams, token floods, runaway counters and enumerations."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import numpy as np

from .. import charsets as cs

# ---- Fixed values: thresholds ----

MIN_CHARS, ENUM_MIN_CHARS = 200, 100
TEN_GRAM, FIVE_GRAM, COUNTER_GRAM = 0.75, 0.85, 0.55
FLOOD_TOKENS, FLOOD_SHORT, FLOOD_LONG, LONG_TEXT = 20, 0.80, 0.60, 1000
COUNTER_NUMBERS, COUNTER_RUN = 10, 5
ENUM_RUN, ENUM_LINES, ENUM_SHARE = 30, 20, 0.50
#: A line that is only a marker of an enumeration.
ENUM_LINE = (
    r"\s*(?:\d+[.)]"
    r"|[０-９]+[．。）)]"
    r"|[一二三四五六七八九十百千零两]+[、。．.]"
    r"|第[一二三四五六七八九十百千零两\d]+[、，,：:．.]?"
    r"|[（(]\s*[\d一二三四五六七八九十]+\s*[)）]"
    r"|[①-⑳⓫-⓿])\s*"
)

_CJK = re.compile(cs.python_class(cs.CJK_TOKENS))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = frozenset(cs.CJK_PUNCTUATION)
_ENUM = re.compile(ENUM_LINE)
_NUMBER = re.compile(r"\b\d{1,6}\b")


def visible(text: str) -> str:
    """What follows the first </think>, stripped; all of it where there is none."""
    head, mark, tail = text.partition("</think>")
    return (tail if mark else head).strip()


def tokens(text: str) -> list[str]:
    """CJK characters one by one, other text by white space, without tokens of CJK punctuation alone."""
    return [t for t in _CJK.sub(r" \g<0> ", text).split() if not _PUNCTUATION.issuperset(t)]


def joined(some: list[str] | tuple[str, ...]) -> str:
    """Tokens as text: nothing between two CJK characters, else a blank."""
    out = some[0] if some else ""
    for left, right in zip(some, some[1:]):
        out += right if _CJK.match(left) and _CJK.match(right) else f" {right}"
    return out


def ngrams(text: str, n: int, above: float) -> dict | None:
    """The share of n-grams that occur more than once, if it is above a bound; texts of fewer than 3 n tokens have none."""
    words = tokens(text)
    if len(words) < 3 * n:
        return None
    count = Counter(zip(*(words[i:] for i in range(n))))
    total, repeated = count.total(), sum(c for c in count.values() if c > 1)
    if not repeated / total > above:
        return None
    top = max(count, key=count.__getitem__)  # the first seen of the most frequent
    return {"ratio": repeated / total, "total": total, "repeated": repeated, "top": joined(top[:8]) + "...", "top_count": count[top]}


def gram_counts(hashes: list[int], sizes: tuple[int, ...] = (5, 10)) -> dict[str, dict[str, int]]:
    """By size (g5, g10), from 64-bit hashes of a text's tokens: n-grams, those that occur more than once, and the most frequent one's count."""
    codes, out = np.array(hashes, np.int64).view(np.uint64), {}
    for n in sizes:
        total = repeated = most = 0
        if len(codes) >= 3 * n:
            total = len(codes) - n + 1
            grams = np.zeros(total, np.uint64)
            for i in range(n):
                grams = grams * _MIX + codes[i : i + total]
            grams.sort()
            counts = np.diff(np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1], [True]))))
            repeated, most = int(counts[counts > 1].sum()), int(counts.max())
        out[f"g{n}"] = {"total": total, "repeated": repeated, "top_count": most}
    return out


def counter_runs(text: str) -> list[tuple[int, int]]:
    """Spans of the numbers in runs of COUNTER_RUN or more that count up by one."""
    found = list(_NUMBER.finditer(text))
    if len(found) < COUNTER_NUMBERS:
        return []
    out = []
    for _, run in groupby(enumerate(found), key=lambda x: int(x[1].group()) - x[0]):
        run = [m.span() for _, m in run]
        if len(run) >= COUNTER_RUN:
            out += run
    return out


def runaway_counter(text: str) -> dict | None:
    """n-grams of a text whose counters are blanked out."""
    spans = counter_runs(text)
    if not spans:
        return None
    edges = [0, *(e for s in spans for e in s), len(text)]
    return ngrams(" ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), 10, COUNTER_GRAM)


def repeated_ngrams(text: str) -> dict | None:
    """The first that holds of: runaway counter, 10-grams, 5-grams. kind names it."""
    shown = visible(text)
    if len(text) < MIN_CHARS or len(shown) < MIN_CHARS:
        return None
    for kind, find in (("runaway_enum", runaway_counter), ("10gram", lambda t: ngrams(t, 10, TEN_GRAM)), ("5gram", lambda t: ngrams(t, 5, FIVE_GRAM))):
        if r := find(shown):
            return {"kind": kind, **r}
    return None


def token_flood(text: str) -> dict | None:
    """One token that makes up most of a text."""
    shown = visible(text)
    if len(text) < MIN_CHARS or len(shown) < MIN_CHARS:
        return None
    count = Counter(tokens(shown))
    total = count.total()
    if total < FLOOD_TOKENS:
        return None
    top = max(count, key=count.__getitem__)
    if count[top] / total < (FLOOD_LONG if len(shown) > LONG_TEXT else FLOOD_SHORT):
        return None
    return {"kind": "token_flood", "ratio": count[top] / total, "total": total, "repeated": count[top], "top": top[:20], "top_count": count[top]}


def runaway_enum(text: str) -> dict | None:
    """Lines that are nothing but markers: a long run of them, or most of the lines."""
    if len(text) < ENUM_MIN_CHARS:
        return None
    lines = [bool(_ENUM.fullmatch(x)) for x in visible(text).split("\n")]
    if len(lines) < ENUM_LINES:
        return None
    marked, longest = sum(lines), max((sum(1 for _ in run) for is_mark, run in groupby(lines) if is_mark), default=0)
    found = {"kind": "enum_lines", "ratio": marked / len(lines), "total": len(lines), "repeated": marked, "top": None, "top_count": longest}
    if longest >= ENUM_RUN:
        return found
    return {**found, "kind": "enum_share"} if marked >= ENUM_LINES and marked >= ENUM_SHARE * len(lines) else None


CHECKS = (repeated_ngrams, token_flood, runaway_enum)


def reason(found: dict, message: int = 0) -> str:
    """The issue line of a finding."""
    r = found
    where = f"msg[{message}]"
    if r["kind"] == "token_flood":
        return f"repetition_ngram:token_flood {where} token='{r['top']}' ratio={r['ratio']:.2f} ({r['repeated']}/{r['total']} tokens)"
    if r["kind"] == "enum_lines":
        return f"repetition_ngram:runaway_enum {where} consecutive={r['top_count']} total_enum={r['repeated']}/{r['total']} lines"
    if r["kind"] == "enum_share":
        return f"repetition_ngram:runaway_enum {where} ratio={r['ratio']:.2f} ({r['repeated']}/{r['total']} lines)"
    return f"repetition_ngram:{r['kind']} {where} ratio={r['ratio']:.2f} repeated={r['repeated']}/{r['total']} top='{r['top']}' x{r['top_count']}"


def check_messages(record: dict, check) -> str | None:
    """The first finding of a check among a chat record's assistant messages, as an issue line."""
    for i, message in enumerate(record.get("messages", [])):
        content = message.get("content", "")
        if message.get("role") == "assistant" and isinstance(content, str) and (found := check(content)):
            return reason(found, i)
    return None
