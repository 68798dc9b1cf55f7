"""Passages that repeat back to back inside one text.

Candidates are squares (a unit and its copy) and cubes: the smallest unit at the leftmost
place, then on behind it. They are found with whole-array comparisons of the text with
itself, shifted by each unit length, not by back-referencing expressions: a chunk costs
unit lengths times characters at memory speed.

Texts are cut into chunks whose size falls with the length of the text; each is judged alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

from .. import charsets as cs

# ---- Fixed values: chunk sizes by text length, and the rules' literals ----

#: (texts shorter than, chunk size, overlap)
CHUNKS = ((10_000, 10_000, 0), (300_000, 10_000, 1_000), (500_000, 5_000, 200), (800_000, 3_000, 100), (10**14, 1_000, 10))
MIN_REPEATS = 5
#: The shortest long unit: of characters without punctuation (cn), of raw text (en).
LONG_CN, LONG_EN = 250, 4
SPECIAL_UNITS = ("\\\\u0000", "\\\\U0000")
LAUGHTER = ("Ha", "HA", "ha")
ODD_WORDS = ("©", "*", "\n-", "...", ".")
SONG = (" song ", "♫", "♪", "---------------")
MODEL = "sub_dedup_continuous"

_HAN = re.compile(cs.python_class(cs.HAN))
_HAN_RUN = re.compile(rf"({cs.python_class(cs.HAN)})\1{{{MIN_REPEATS - 1}}}")
_HAN_KEPT = re.compile("[一-龥]")
_LATIN = re.compile("[A-Za-z]")
_ALNUM = re.compile(r"[a-zA-Z\d]")
_LATEX = re.compile(r"\\cdots|\\underline")
_CODE = re.compile(r"(?s)```.*?```")
_FORMAT = re.compile("%[ds]")
#: CJK and full-width punctuation, ASCII punctuation but the backslash, white space.
BARE = cs.union(((0x3000, 0x303F), (0xFF00, 0xFFEF)), cs.chars("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"), cs.PY_SPACE)
_BARE = re.compile(cs.python_class(BARE) + "+")
_KEPT = re.compile(cs.python_class(BARE, negated=True))


def is_code(text: str) -> bool:
    return "code::" in text or _CODE.search(text) is not None


def has_target_char(text: str, lang: str) -> bool:
    """Whether a text has Latin letters (en), Han characters (ch), or either (any other name)."""
    return lang != "ch" and _LATIN.search(text) is not None or lang != "en" and _HAN.search(text) is not None


def without_punctuation(text: str) -> str:
    return _BARE.sub("", text)


def kept_positions(text: str) -> list[int]:
    """Where each character of without_punctuation(text) stands in text, and the end."""
    return [m.start() for m in _KEPT.finditer(text)] + [len(text)]


def keep_han(text: str) -> str:
    return "".join(_HAN_KEPT.findall(text))


def keep_latin(text: str) -> str:
    return "".join(_LATIN.findall(text))


def filter_latex(text: str) -> str:
    return _LATEX.sub("", text)


def chunk_shape(length: int) -> tuple[int, int]:
    """(size, overlap) of the chunks of a text of this length."""
    return next(((size, overlap) for below, size, overlap in CHUNKS if length < below), (1000, 10))


def chunks(text: str) -> list[tuple[int, str]]:
    """(offset, chunk)"""
    size, overlap = chunk_shape(len(text))
    return [(i, text[i : i + size]) for i in range(0, len(text), size - overlap)]


def tandems(codes: np.ndarray, shortest: int, longest: int, copies: int) -> list[tuple[int, int]]:
    """(start, unit length) of what repeats back to back ``copies`` times: leftmost, smallest unit first, not overlapping."""
    n = len(codes)
    unit = np.zeros(n, np.int32)
    for size in range(min(longest, n // copies), shortest - 1, -1):
        span = (copies - 1) * size  # so many matches with the text shifted by size
        same = codes[size:] == codes[:-size]
        if np.count_nonzero(same) < span:
            continue
        total = np.zeros(len(same) + 1, np.int32)
        np.cumsum(same, out=total[1:])
        unit[: len(total) - span][total[span:] - total[: len(total) - span] == span] = size
    out, at = [], 0
    for start in np.flatnonzero(unit).tolist():
        if start >= at:
            out.append((start, int(unit[start])))
            at = start + copies * int(unit[start])
    return out


def copies_from(text: str, start: int, unit: str) -> tuple[int, int]:
    """How often a unit follows itself from start on, and where that ends; the last may lack the white space at its end."""
    n, at = 0, start
    while text.startswith(unit, at):
        n, at = n + 1, at + len(unit)
    bare = unit.rstrip()
    lacks = len(unit) - len(bare)
    if lacks and text.startswith(bare, at):
        end = at + len(bare)
        if end == len(text) or text[end : end + lacks].isspace():
            return n + 1, end
    return n, at


def repeats(text: str, longest_short: int) -> list[tuple[int, int, int, int]]:
    """(start, unit end, end, copies): cubes of units up to longest_short, then squares of longer ones; none inside what is listed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    found = tandems(codes, 1, max(min(n // 3, longest_short), 1), 3)
    if n >= longest_short:
        found += tandems(codes, longest_short, max(n // 2, longest_short), 2)
    covered, out = bytearray(n), []
    for start, size in found:
        times, end = copies_from(text, start, text[start : start + size])
        if covered.count(1, start, end) < end - start:
            covered[start:end] = b"\x01" * (end - start)
            out.append((start, start + size, end, times))
    return out


# ---- what lets a chunk through to the search; a chunk that fails has no findings ----


def chars_may_repeat(text: str) -> bool:
    """A Han character five times in a row; or equal neighbouring segments that begin with the same 2 or 10 characters (three of them) or 250 (two)."""
    if _HAN_RUN.search(text):
        return True
    n = len(text)
    for size, needed in ((2, 3), (10, 3), (LONG_CN, 2)):
        last: dict[str, int] = {}
        gaps: dict[str, int] = {}  # from the last place of a key to the one before
        for at in range(n - size + 1):
            key = text[at : at + size]
            before = last.get(key)
            last[key] = at
            if before is None:
                continue
            step = at - before
            # segments of one length, and the last character of the last two, first: nearly all fail there
            if size <= step <= n - at and (needed == 2 or gaps.get(key) == step) and text[at - 1] == text[at + step - 1]:
                first = at - (needed - 1) * step
                if _adjacent(text, (first, before, at) if needed == 3 else (before, at), size) and has_target_char(text[first : first + step], "ch"):
                    return True
            gaps[key] = step
    return False


def words_may_repeat(text: str) -> bool:
    """A word five times in a row, or two equal neighbouring segments that begin with the same two words."""
    words = text.split()
    n, seen = len(words), {}
    for at in range(n - 1):
        word, following = words[at], words[at + 1]
        if word[0] == following[0] and "".join(words[at : at + MIN_REPEATS]) == word * MIN_REPEATS and has_target_char(word, "en"):
            return True
        before = seen.get((word, following))
        seen[word, following] = at
        if before is None:
            continue
        step = at - before
        if 2 <= step <= n - at and words[at - 1] == words[at + step - 1] and _adjacent(words, (before, at), 2) and has_target_char("".join(words[before:at]), "en"):
            return True
    return False


def _adjacent(items, places: tuple[int, ...], least: int) -> bool:
    """Whether the segments that begin at these places, and one of the last one's length behind them, are equal."""
    step = places[-1] - places[-2]
    if step < least or places[-1] + step > len(items):
        return False
    edges = (*places, places[-1] + step)
    return all(items[a:b] == items[b:c] for a, b, c in zip(edges, edges[1:], edges[2:]))


def repeated_phrases(text: str, size: int = 5) -> set[str]:
    """Words six times in a row, and passages of words three times in a row that begin with the same ``size`` words."""
    words, found = text.split(), set()
    seen: dict[str, tuple[int, ...]] = {}
    for at, word in enumerate(words):
        if words[at : at + 6] == [word] * 6 and _LATIN.search(word):
            found.add(word)
        key = " ".join(words[at : at + size])
        places = seen[key] = (*seen.get(key, ()), at)[-3:]
        if len(places) == 3 and _adjacent(words, places, 5) and _LATIN.search("".join(words[places[0] : places[1]])):
            found.add(" ".join(words[places[0] : places[1]]))
    return found


# ---- detection ----


def starts_paragraph(text: str, at: int) -> bool:
    """Whether only white space stands between a place and the line end, or the start, before it."""
    if at < 0 or at > len(text):
        return False
    while at and text[at - 1].isspace():
        if text[at - 1] == "\n":
            return True
        at -= 1
    return at == 0


def past_space(text: str, at: int) -> int:
    while 0 <= at < len(text) and text[at].isspace():
        at += 1
    return at


def _finding(unit: tuple[int, int], mask: tuple[int, int], times: int, n_chars: int, n_words: int, special: bool) -> dict:
    info = {"repeat_text_offset": list(unit), "char_len": n_chars, "word_len": n_words, "is_special": int(special)}
    return {"offset": list(mask), "score": times, "info": info, "model_type": MODEL}


def chinese(text: str) -> list[dict]:
    """Findings in a chunk by characters, punctuation and white space aside."""
    if is_code(text):
        return []
    bare = without_punctuation(text)
    if not chars_may_repeat(bare):
        return []
    place, out = kept_positions(text), []
    for start, unit_end, end, times in repeats(bare, LONG_CN):
        unit, span = bare[start:unit_end], (place[start], place[unit_end])
        mask = (place[unit_end - 1] + 1, place[end - 1] + 1)  # the first occurrence stays
        if times < MIN_REPEATS:
            continue
        if unit in SPECIAL_UNITS:
            out.append(_finding(span, mask, times, len(unit), 0, True))
            continue
        n_han, raw = len(keep_han(unit)), text[slice(*span)]
        bullet = raw.count("\n") == 1 and (raw.startswith("\n*") or raw.startswith("*\n"))
        if not n_han or "|" in raw or bullet:
            continue
        last = place[end - (unit_end - start)]
        if starts_paragraph(text, span[0]) and place[end] != len(text) and not starts_paragraph(text, place[end]):
            mask = (span[0], last)  # the last occurrence leads the sentence on, so that one stays
        out.append(_finding(span, mask, times, n_han, 0, False))
    return out


def _n_words(raw: str) -> int:
    if not re.search(r"\s", raw):
        return 0
    parts = raw.split(" ")
    many = len(parts) >= 5
    return sum(1 for p in parts if p and (many or p in ODD_WORDS or _ALNUM.search(filter_latex(p))))


def english(text: str) -> list[dict]:
    """Findings in a chunk by words."""
    if is_code(text) or any(x in text for x in SONG) or not words_may_repeat(text):
        return []
    out = []
    for start, unit_end, end, times in repeats(text, LONG_EN):
        unit, mask = text[start:unit_end], (unit_end, end)
        if times < MIN_REPEATS:
            continue
        if unit in SPECIAL_UNITS:
            out.append(_finding((start, unit_end), mask, times, len(unit), 0, True))
            continue
        markup = "|" in unit or "</" in unit or "{" in unit and "}" in unit
        if _FORMAT.search(unit) or unit in LAUGHTER or markup or not _LATIN.search(unit):
            continue
        n_words = _n_words(unit)
        if not n_words:
            continue
        last, rest = end - len(unit), past_space(text, end)
        if starts_paragraph(text, past_space(text, start)) and rest != len(text) and not starts_paragraph(text, rest):
            mask = (start, last)
        out.append(_finding((start, unit_end), mask, times, len(keep_latin(unit)), n_words, False))
    return out


def shifted(found: Iterable[dict], by: int) -> list[dict]:
    return [{**f, "offset": [x + by for x in f["offset"]], "info": {**f["info"], "repeat_text_offset": [x + by for x in f["info"]["repeat_text_offset"]]}} for f in found]


def detect(text: str, lang: str) -> list[dict]:
    """Findings over all chunks: by words for ``en``, by characters for anything else."""
    find = english if lang == "en" else chinese
    return [f for at, chunk in chunks(text) for f in shifted(find(chunk), at)]


# ---- offsets in a pair of texts joined by one character ----


def pair_position(offset: int, source_len: int, is_start: bool) -> tuple[int, bool]:
    """An offset in source + separator + target as (offset, whether it lies in source)."""
    if offset < source_len:
        return offset, True
    if offset > source_len:
        return offset - source_len - 1, False
    return (0, False) if is_start else (source_len - 1, True)


def pair_span(whole: bool, source_len: int, target_len: int, start: int, end: int) -> list[tuple[list[int], str]]:
    """A span in source + separator + target as spans of either; whole: the text is no pair."""
    if whole:
        return [([start, end], "content")]
    if not source_len and not target_len:
        return [([0, 0], "src")]
    a, a_source = pair_position(start, source_len, True)
    b, b_source = pair_position(end - 1, source_len, False)
    if not a_source:
        return [([a, b + 1], "tgt")]
    return [([a, b + 1], "src")] if b_source else [([a, source_len], "src"), ([0, b + 1], "tgt")]
