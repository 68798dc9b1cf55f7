"""The cleaning rules one by one, as native expressions.

Each gives what the cleaner gives under that rule alone. Chains of them are not the cleaner:
there, all rules look at the original text (see textloom.operators.clean).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import charsets as cs
from ..kernels.cleaner import forbidden_pattern, single_owners
from .basics import DIGIT, SPACE, held, hits, let, without

_INDENT = cs.java_class(cs.chars(cs.INDENT))
_SELECTOR = cs.java_class(cs.VARIATION_SELECTORS)
_MARK = cs.java_rare(cs.minus(cs.UCD.marks, cs.VARIATION_SELECTORS))
_NOT_SPACE = cs.java_class(cs.PY_SPACE, negated=True)
_GAP = cs.java_class(cs.PY_SPACE, cs.chars(cs.NOISE_SEPARATORS))
#: Stands for a removed run while its neighbours are looked at; a code point that no text holds.
_HOLE = "\ufdd0"
NOISE_RUN = (
    r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])(?=[A-Za-z0-9]*?([A-Za-z0-9])\1{3})"
    rf"([A-Za-z0-9]{{5,128}})(?![A-Za-z0-9])(?:{_GAP}+\2(?![A-Za-z0-9])){{{cs.NOISE_REPEATS - 1},}}+[ \t]*+"
)
#: That a character repeats is told before what it is.
FLOOD = rf"(?s:(?=(.)\1{{{cs.FLOOD_CLEAN - 1}}})){cs.java_class(cs.UCD.symbols, cs.FLOOD_EXTRA)}\1{{{cs.FLOOD_CLEAN - 1},}}"
LINE_END_SPACE = r"[ \t]+(?=\n|\z)"
EXTRA_BLANK_LINES = r"(?<=\n\n)\n+"


def owned(rule: str) -> str:
    """The class of the single characters that a rule edits when it is on alone."""
    return cs.java_class(cs.ranges(ord(c) for c in single_owners([rule])))


def _deleted(rule: str) -> Callable[[Column], Column]:
    return lambda text: without(text, owned(rule))


def styled_math_alnum(text: Column) -> Column:
    """Styled letters and digits as plain ones; unassigned code points of the block go."""
    styled = [chr(p) for p in sorted(cs.points(cs.STYLED_MATH))]
    plain = {c: n for c in styled if (n := unicodedata.normalize("NFKC", c)) != c}
    gone = "".join(c for c in styled if c not in plain)
    return F.translate(held(text), "".join(plain) + gone, "".join(plain.values()))


def abnormal_space(text: Column) -> Column:
    blank, gone = (sorted(cs.points(c)) for c in (cs.SPACES_TO_BLANK, cs.SPACES_TO_DROP))
    return F.translate(held(text), "".join(map(chr, blank + gone)), " " * len(blank))


def line_separator(text: Column) -> Column:
    for old, new in cs.LINE_SEPARATORS.items():
        text = F.replace(held(text), F.lit(old), F.lit(new))
    return text


def emoji_all(text: Column) -> Column:
    """Emoji with what belongs to them: a base before a selector, the key before a key cap."""
    key, either = cs.java_class(cs.KEYCAP_BASES), cs.java_class(cs.TEXT_OR_EMOJI_SELECTORS)
    return without(text, f"{cs.java_class(cs.EMOJI_BASES)}{_SELECTOR}|{key}?{either}?{cs.java_class(cs.KEYCAPS)}|{owned('emoji_all')}")


def pua_contextual(text: Column) -> Column:
    """Private-use characters repaired by their surroundings; in an order in which no repair is another's surroundings."""
    line_start = rf"(?<!{cs.java_class(cs.chars(cs.LINE_ENDS), negated=True)})({_INDENT}*)"
    word = cs.java_rare(cs.UCD.word, cs.chars("_“”\"'"))
    goes_on = rf"{_INDENT}*{cs.java_class(cs.chars(cs.INDENT), cs.chars(chr(13) + chr(10)), negated=True)}"
    # the character comes first and its surroundings after: it is rare, they are not
    steps = [
        (rf"\x{{E010}}(?<=[0-9A-Za-z)\]）】》”’]\x{{E010}})(?={SPACE}{{0,3}}{word})", "．"),
        (rf"\x{{F07E}}(?<=(?:{DIGIT}|[%‰℃°]){SPACE}{{0,11}}\x{{F07E}})(?={SPACE}{{0,11}}{DIGIT})", "~"),
        (r"\x{E011}(?<=[A-Za-z]\x{E011})(?=[A-Za-z])", "-"),
        (r"\x{E10B}(?<=[A-Za-z]\x{E10B})(?=[A-Za-z])", "'"),
        (rf"{line_start}\x{{F0B7}}(?={SPACE})(?={goes_on})", "$1-"),
        (rf"{line_start}\x{{F0B7}}(?={goes_on})", "$1- "),
        (rf"{line_start}\x{{E618}}(?={SPACE})", "$1-"),
        (rf"{line_start}\x{{E618}}", "$1- "),
        (rf"\x{{E618}}(?={SPACE})", "\n-"),
        (r"\x{E618}", "\n- "),
        (r"\x{E1BD}(?=束)", "约"),
        (rf"[\x{{E11A}}-\x{{E11C}}]|{cs.java_class(cs.PUA_NOISE)}", ""),
    ]
    out = held(text)
    for pattern, put in steps:
        out = F.regexp_replace(out, pattern, put)
    return F.when(held(text).rlike(cs.java_class(cs.PUA)), out).otherwise(held(text))


def combining_decoration(text: Column) -> Column:
    return without(text, rf"\A{_MARK}+|{_MARK}{{2,}}")


def html_entity(text: Column) -> Column:
    return without(text, cs.HTML_ENTITY)


def forbidden_strings(text: Column) -> Column:
    return without(text, forbidden_pattern())


def _noise_in(piece: Column) -> Column:
    holed = F.regexp_replace(piece, NOISE_RUN, _HOLE)
    not_space_or_hole = cs.java_class(cs.PY_SPACE, cs.chars(_HOLE), negated=True)
    return F.regexp_replace(F.regexp_replace(holed, f"(?<={not_space_or_hole}){_HOLE}(?={_NOT_SPACE})", " "), _HOLE, "")


def repeated_noise_token(text: Column) -> Column:
    """Runs of suspicious tokens go, outside code fences; a blank stays where a run stood between two words."""
    pieces = F.split(held(text), "```", -1)
    fence = F.lit("`")

    def outside(piece: Column, i: Column) -> Column:  # a fence beside a piece counts as its neighbour
        left, right = F.when(i > 0, fence).otherwise(""), F.when(i < F.size(pieces) - 1, fence).otherwise("")
        made = let(_noise_in(F.concat(left, piece, right)), lambda m: F.substring(m, F.length(left) + 1, F.length(m) - F.length(left) - F.length(right)))
        return F.when(i % 2 == 0, made).otherwise(piece)

    # most texts have no fence, and need no arrays
    fenced = F.array_join(F.transform(pieces, outside), "```")
    return F.when(held(text).contains("```"), F.when(held(text).rlike(NOISE_RUN), fenced).otherwise(held(text))).otherwise(_noise_in(held(text)))


def hex_blob(text: Column) -> Column:
    """Unbroken dumps; wrapped ones need the cleaner."""
    return without(text, cs.HEX_RUN)


def math_symbol_flood(text: Column) -> Column:
    return without(text, FLOOD)


def line_boundary_space(text: Column) -> Column:
    return without(text, LINE_END_SPACE)


def blank_line_collapse(text: Column) -> Column:
    return without(text, EXTRA_BLANK_LINES)


#: Every rule that is exact on its own.
RULES: dict[str, Callable[[Column], Column]] = {
    "variation_selector": _deleted("variation_selector"),
    "styled_math_alnum": styled_math_alnum,
    "abnormal_space": abnormal_space,
    "bidi_control": _deleted("bidi_control"),
    "pua_known_noise": _deleted("pua_known_noise"),
    "pua_contextual": pua_contextual,
    "decorative_symbol": _deleted("decorative_symbol"),
    "decorative_combining": _deleted("decorative_combining"),
    "emoji_all": emoji_all,
    "control_invisible": _deleted("control_invisible"),
    "line_separator": line_separator,
    "html_entity": html_entity,
    "forbidden_strings": forbidden_strings,
    "repeated_noise_token": repeated_noise_token,
    "hex_blob": hex_blob,
    "math_symbol_flood": math_symbol_flood,
    "line_boundary_space": line_boundary_space,
    "blank_line_collapse": blank_line_collapse,
    "combining_decoration": combining_decoration,
    "exotic_combining": _deleted("exotic_combining"),
}


def may_change(text: Column, rules: Iterable[str]) -> Column:
    """False only for texts that no rule changes: what holds no trigger need not leave the JVM."""
    on = list(rules)
    owners = single_owners(on)
    beyond = [cs.ranges(map(ord, owners))] if owners else []
    if "emoji_all" in on:
        beyond += [cs.VARIATION_SELECTORS]
    if "pua_contextual" in on:
        beyond += [cs.PUA]
    if "combining_decoration" in on:
        beyond += [cs.UCD.marks]
    # the first that is found settles it, so what is told at little cost comes first
    found = F.lit(False)
    for rule, pattern in (("html_entity", cs.HTML_ENTITY), ("blank_line_collapse", r"\n\n\n"), ("line_boundary_space", LINE_END_SPACE), ("forbidden_strings", forbidden_pattern())):
        if rule in on:
            found = found | held(text).rlike(pattern)
    if beyond:
        found = found | held(text).rlike(r"[^\x00-\x7F]") & held(text).rlike(cs.java_rare(*beyond))
    for rule, pattern in (("math_symbol_flood", FLOOD), ("repeated_noise_token", NOISE_RUN), ("hex_blob", r"[0-9A-Fa-f](?:[ \t\r\n]*+[0-9A-Fa-f]){63}")):
        if rule in on:
            found = found | held(text).rlike(pattern)
    return found


def changed_chars(rule: str, text: Column) -> Column:
    """Characters that a rule which only deletes removes."""
    return F.length(held(text)) - F.length(RULES[rule](text))


__all__ = ["RULES", "changed_chars", "hits", "may_change", "owned"]
