"""Mojibake detection: 21 rules over the lines of a text.

Every rule yields spans on the whole text by one scan; thresholds are taken over the whole
text, results are told by line. No pattern crosses a line end, so a line's share of the
spans is what a scan of the line would find.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

from .. import charsets as cs

# ---- Fixed values: rule names in their order, and the thresholds ----

THRESHOLDS = {"double_enc": 5, "cp1252": 3, "zw_flood": 1, "invis_garbage": 3, "pua": 5, "conditional_zw": 1, "math_symbol_flood": cs.FLOOD_DETECT, "control_format_flood": 3}
RULES = (
    "fffd", "seq", "cscn", "c1_control", "double_enc", "cp1252", "pua", "pua_known_noise", "html_entity", "bidi_control", "decorative_symbol", "decorative_combining", "zw_flood",
    "invis_garbage", "specials", "conditional_zw", "variation_selector", "styled_math_alnum", "abnormal_space", "math_symbol_flood", "control_format_flood",
)


def classes() -> dict[str, cs.Ranges]:
    """The rules that are a class of characters."""
    return {
        "fffd": cs.REPLACEMENT,
        "cscn": cs.UCD.unassigned,
        "c1_control": cs.C1_CONTROLS,
        "pua": cs.PUA,
        "pua_known_noise": cs.PUA_NOISE,
        "bidi_control": cs.BIDI_CONTROL,
        "decorative_symbol": cs.minus(cs.DECORATIVE_SYMBOLS, cs.FORM_SYMBOLS),
        "decorative_combining": cs.DECORATIVE_COMBINING,
        "zw_flood": cs.union(cs.INVISIBLE_GARBAGE, cs.CONDITIONAL_ZERO_WIDTH, cs.INTERLINEAR),
        "invis_garbage": cs.INVISIBLE_GARBAGE,
        "specials": cs.SPECIALS,
        "conditional_zw": cs.CONDITIONAL_ZERO_WIDTH,
        "variation_selector": cs.VARIATION_SELECTORS,
        "styled_math_alnum": cs.STYLED_MATH,
        "abnormal_space": cs.union(cs.SPACES_TO_BLANK, cs.SPACES_TO_DROP),
        "control_format_flood": cs.UCD.format,
    }


class Detector:
    """Compiled rules. thresholds override the defaults; without unassigned, ``cscn`` is left out."""

    def __init__(self, unassigned: bool = True, thresholds: dict[str, int] | None = None):
        self.thresholds = THRESHOLDS | (thresholds or {})
        self.rules = tuple(r for r in RULES if unassigned or r != "cscn")
        self.classes = {r: c for r, c in classes().items() if r in self.rules}
        self.flood = flood = max(self.thresholds["math_symbol_flood"], 1)
        self.symbols = cs.union(cs.UCD.symbols, cs.FLOOD_EXTRA)
        self.patterns = {r: [re.compile(p) for p in found] for r, found in {"seq": ["|".join(cs.GARBLED)], "double_enc": cs.DOUBLE_ENCODED, "cp1252": [cs.CP1252], "html_entity": [cs.HTML_ENTITY]}.items()}
        #: What a text must hold of each: one of the characters that a match begins with.
        self.begins = {"seq": frozenset(g[0] for g in cs.GARBLED), "double_enc": frozenset(map(chr, range(0xC0, 0xF8))), "cp1252": frozenset("ÃÂâð"), "html_entity": frozenset("&")}
        self._owners: dict[str, tuple[str, ...]] = {}
        self._flooding: dict[str, bool] = {}

    def owners(self, char: str) -> tuple[str, ...]:
        """The rules on classes that hold a character; each character is looked up once."""
        told = self._owners.get(char)
        if told is None:
            told = self._owners[char] = tuple(r for r, c in self.classes.items() if _within(c, ord(char)))
        return told

    def _may_flood(self, char: str) -> bool:
        told = self._flooding.get(char)
        if told is None:
            told = self._flooding[char] = _within(self.symbols, ord(char))
        return told

    def places(self, text: str) -> dict[str, list[int]]:
        """By rule, the offsets hit, in order and each once; only rules that hit. Pairs of ``seq`` are not in it."""
        held, out = set(text), {}
        hot = "".join(sorted(c for c in held if c > "\x7f" and self.owners(c)))
        if hot:
            by_char: dict[str, list[int]] = {c: [] for c in hot}
            for m in re.finditer(f"[{hot}]", text):
                by_char[m[0]].append(m.start())
            for c, at in by_char.items():
                for rule in self.owners(c):
                    out.setdefault(rule, []).append(at)
            # several characters of a rule: their offsets in order
            out = {r: found[0] if len(found) == 1 else sorted(chain.from_iterable(found)) for r, found in out.items()}
            out = {r: at for r, at in out.items() if len(at) >= self.thresholds.get(r, 1)}
        for rule, patterns in self.patterns.items():
            if held.isdisjoint(self.begins[rule]):
                continue
            spans = [m.span() for p in patterns for m in p.finditer(text)]
            if spans and len(spans) >= self.thresholds.get(rule, 1):
                at = [k for a, b in spans for k in range(a, b)]
                out[rule] = sorted(set(at)) if len(patterns) > 1 else at
        spans = []
        for c in held:
            if self._may_flood(c) and c * self.flood in text:
                spans += [m.span() for m in re.finditer(f"{re.escape(c)}{{{self.flood},}}", text)]
        if spans:
            out["math_symbol_flood"] = [k for a, b in sorted(spans) for k in range(a, b)]
        return out

    def lines(self, text: str) -> Iterator[tuple[int, int, dict[str, list[int]]]]:
        """(start, end, offsets hit by rule, in the rules' order) of every line that hits; blank lines never do."""
        places = self.places(text)
        paired = [m.start() for m in _PAIR.finditer(text)] if any(c in text for c in cs.GARBLED_PAIR) else []
        if not places and not paired:
            return
        starts = [0, *(m.end() for m in _LINE_END.finditer(text)), len(text) + 1]
        by_line: dict[int, dict[str, list[int]]] = {}
        for rule in self.rules:
            at = places.get(rule, ())
            n, done = len(at), 0
            while done < n:  # the offsets of one line, then those of the next that has any
                line = bisect_right(starts, at[done]) - 1
                upto = bisect_left(at, starts[line + 1], done)
                by_line.setdefault(line, {})[rule] = at[done:upto]
                done = upto
            if rule == "seq":
                for line, run in groupby(paired, key=lambda k: bisect_right(starts, k) - 1):
                    run = list(run)
                    if len({text[k] for k in run}) > 1:
                        mine = by_line.setdefault(line, {})
                        mine["seq"] = sorted({*mine.get("seq", ()), *run})
        for line in sorted(by_line):
            start, end = starts[line], min(starts[line + 1], len(text))
            if not text[start:end].isspace():
                yield start, end, by_line[line]

    def hits(self, text: str) -> list[dict]:
        """Every line that hits, with all rules in their order."""
        out = []
        for start, end, places in self.lines(text):
            detail = {}
            for rule in self.rules:
                n = len(places.get(rule, ()))
                detail[rule] = {"hit_num": n, "hit_ratio": n / (end - start), "hit_positions": _marked(places[rule], start, end) if n else None}
            out.append({"offset": [start, end], "detail": detail})
        return out

    def counts(self, text: str) -> dict[str, int]:
        """Hit characters by rule, over the lines that are not blank; only rules that hit."""
        total: Counter = Counter()
        for _, _, places in self.lines(text):
            for rule, at in places.items():
                total[rule] += len(at)
        return dict(total)


_PAIR, _LINE_END = re.compile(f"[{cs.GARBLED_PAIR}]"), re.compile("\n")


def _within(cls: cs.Ranges, point: int) -> bool:
    i = bisect_right(cls, (point, 0x110000)) - 1
    return i >= 0 and point <= cls[i][1]


def _marked(places: list[int], start: int, end: int) -> str:
    """A digit for each character of a line: 1 where it is hit."""
    mask = bytearray(b"0") * (end - start)
    for k in places:
        mask[k - start] = 49
    return mask.decode()


def script_share(text: str, scripts: cs.Ranges = cs.ZERO_WIDTH_SCRIPTS) -> float:
    """Share of the characters beside white space that belong to scripts."""
    shown = [c for c in text if not c.isspace()]
    return len(re.findall(cs.python_class(scripts), text)) / len(shown) if shown else 0.0


def has_complex_script(text: str) -> bool:
    return re.search(cs.python_class(cs.COMPLEX_SCRIPTS), text) is not None


def is_exotic_combining(char: str) -> bool:
    return ord(char) in cs.points(cs.EXOTIC_COMBINING)


def is_combining_mark(char: str) -> bool:
    return ord(char) in cs.points(cs.minus(cs.UCD.marks, cs.VARIATION_SELECTORS))
