"""Mojibake rules as native counts. What the detector reports by line adds up to these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import charsets as cs
from ..kernels.mojibake import RULES, THRESHOLDS, classes
from .basics import SPACE, held, hits, lines, matches, total, without

_INSIDE_LINE = cs.java_class(cs.minus(cs.PY_SPACE, cs.chars("\n")))
#: What stands on lines of white space alone; such lines are never reported, though they count for thresholds.
BLANK_LINES = rf"(?<![^\n]){_INSIDE_LINE}+(?=\n|\z)"
FLOOD = rf"(?s:(?=(.)\1{{{cs.FLOOD_DETECT - 1}}})){cs.java_class(cs.UCD.symbols, cs.FLOOD_EXTRA)}\1{{{cs.FLOOD_DETECT - 1},}}"
_PATTERNS = {"cp1252": cs.CP1252, "html_entity": cs.HTML_ENTITY}


def _characters(found: Column) -> Column:
    return total(F.transform(found, lambda m: F.length(m)))


def seq(text: Column) -> Column:
    """Characters of garbled sequences, and of garbled pairs on lines that hold two different ones.

    Characters that both find count once: no sequence that the pairs' characters belong to overlaps
    them in part, so pairs are counted outside the sequences.
    """
    garbled, pair = "|".join(cs.GARBLED), f"[{cs.GARBLED_PAIR}]"

    def of_line(line: Column) -> Column:
        found = matches(line, pair)
        outside = F.size(matches(F.regexp_replace(line, garbled, ""), pair))
        return _characters(matches(line, garbled)) + F.when(F.size(F.array_distinct(found)) > 1, outside).otherwise(0)

    return total(F.transform(lines(text), of_line))


def shown(text: Column) -> Column:
    """A text without what stands on its blank lines."""
    return F.regexp_replace(held(text), BLANK_LINES, "")


def beyond_ascii(text: Column) -> Column:
    """All that rules on classes of characters look at: next to nothing of most texts."""
    return without(text, r"[\x00-\x7F]+")


def class_count(rule: str, rare: Column, rare_shown: Column, thresholds: dict[str, int] | None = None) -> Column:
    """count() of a rule on a class, from beyond_ascii() of a text and of what it shows."""
    cls = cs.java_class(classes()[rule])
    return F.when(hits(rare, cls) >= (THRESHOLDS | (thresholds or {})).get(rule, 1), hits(rare_shown, cls)).otherwise(0).cast("long")


def count(rule: str, text: Column, thresholds: dict[str, int] | None = None) -> Column:
    """Hit characters of a rule over a text's lines that are not blank, as a long."""
    least = (THRESHOLDS | (thresholds or {})).get(rule, 1)
    if rule == "seq":
        return seq(text)
    if rule in classes():
        return class_count(rule, beyond_ascii(text), beyond_ascii(shown(text)), thresholds)
    if rule == "math_symbol_flood":
        return hits(text, FLOOD).cast("long")
    if rule == "double_enc":
        n = sum((F.size(matches(text, p)) for p in cs.DOUBLE_ENCODED), F.lit(0))
        # what two of the patterns cover counts once: their first characters differ, so only inner ones can be shared, and those are no first ones
        covered = sum((_characters(matches(text, p)) for p in cs.DOUBLE_ENCODED), F.lit(0))
        return F.when(n >= least, covered).otherwise(0).cast("long")
    pattern = _PATTERNS[rule]
    n = F.size(matches(text, pattern))
    return F.when(n >= least, hits(text, pattern)).otherwise(0).cast("long")


__all__ = ["BLANK_LINES", "SPACE", "beyond_ascii", "class_count", "count", "seq", "shown"]
