"""Repetition checks inside arrays: tokens, n-grams, floods, counters and enumerations, without a shuffle."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import charsets as cs
from ..kernels import repetition as k
from .basics import DIGIT, MARK, WORD, held, let, matches, most_frequent, runs, stripped, total, words

_CJK = cs.java_class(cs.CJK_TOKENS)
_PUNCTUATION = cs.java_rare(cs.chars(cs.CJK_PUNCTUATION))
NUMBER = rf"(?={DIGIT})(?<!{WORD}){DIGIT}{{1,6}}(?!{WORD})"
#: The enumeration markers, with Python's digits and white space, inside a text: white space must not run on over line ends.
ENUM_IN_TEXT = k.ENUM_LINE
for _numerals in ("一二三四五六七八九十百千零两", "一二三四五六七八九十"):
    for _mixed in (rf"[{_numerals}\d]", rf"[\d{_numerals}]"):
        ENUM_IN_TEXT = ENUM_IN_TEXT.replace(_mixed, f"(?:[{_numerals}]|{DIGIT})")
ENUM_IN_TEXT = ENUM_IN_TEXT.replace(r"\d", DIGIT).replace(r"\s", cs.java_class(cs.minus(cs.PY_SPACE, cs.chars("\n"))))


def visible(text: Column) -> Column:
    """What follows the first </think>, stripped."""
    at = F.instr(held(text), "</think>")
    return stripped(F.when(at > 0, F.substring(held(text), at + len("</think>"), F.length(held(text)))).otherwise(held(text)))


def tokens(text: Column) -> Column:
    spaced = F.regexp_replace(held(text), f"({_CJK})", " $1 ")
    kept = lambda ws: F.filter(ws, lambda t: ~t.rlike(rf"\A{_PUNCTUATION}+\z"))
    return let(words(spaced), lambda ws: F.when(held(text).rlike(_PUNCTUATION), kept(ws)).otherwise(ws))


def token_hashes(tokens: Column) -> Column:
    """A 64-bit hash of each token: a text's tokens are read once, n-grams are of these."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def hash_ngrams(hashes: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of token_hashes(); empty for fewer than 3 n tokens."""

    def of(hs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hs) - (n - 1))
        return F.when(F.size(hs) >= 3 * n, F.transform(starts, lambda i: F.xxhash64(F.slice(hs, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, of)


def ngram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the n-grams; empty for fewer than 3 n tokens."""
    return hash_ngrams(token_hashes(tokens), n)


def ngram_counts(tokens: Column, n: int) -> Column:
    """struct<total, repeated, top_count>: n-grams, those that occur more than once, and the most frequent one's count."""
    return counts_of_hashes(ngram_hashes(tokens, n))


def counts_of_hashes(hashes: Column) -> Column:
    """ngram_counts() from the n-grams' hashes."""

    def of(hs: Column) -> Column:
        n = F.size(hs).cast("long")
        # order does not matter here, so the hashes are sorted bare
        sizes = F.transform(runs(F.sort_array(hs), "bigint"), lambda r: r["n"].cast("long"))
        some = let(sizes, lambda ns: F.struct(n.alias("total"), total(F.filter(ns, lambda x: x > 1)).alias("repeated"), F.array_max(ns).alias("top_count")))
        # most texts repeat none: told by the number of distinct ones, without runs
        none = F.struct(n.alias("total"), F.lit(0).cast("long").alias("repeated"), F.when(n > 0, 1).otherwise(0).cast("long").alias("top_count"))
        return F.when(F.size(F.array_distinct(hs)) < F.size(hs), some).otherwise(none)

    return let(hashes, of)


def top_token(tokens: Column) -> Column:
    """struct<item, first, n> of the most frequent token."""
    return most_frequent(tokens, "string")


def numbers(text: Column) -> Column:
    """Words that are one to six digits, as longs."""
    digits = [chr(p) for p in sorted(cs.points(cs.UCD.digits))]
    ascii_digits = "".join(str(unicodedata.digit(d)) for d in digits)
    return F.transform(matches(text, NUMBER), lambda x: F.translate(x, "".join(digits), ascii_digits).cast("long"))


def in_counters(found: Column) -> Column:
    """How many of these numbers stand in runs of COUNTER_RUN or more that count up by one; none of fewer than COUNTER_NUMBERS."""

    def of(ns: Column) -> Column:
        islands = runs(F.transform(ns, lambda v, i: v - i), "bigint")
        long_runs = F.filter(F.transform(islands, lambda r: r["n"].cast("long")), lambda n: n >= k.COUNTER_RUN)
        return F.when(F.size(ns) >= k.COUNTER_NUMBERS, total(long_runs)).otherwise(0).cast("long")

    return let(found, of)


def enum_lines(text: Column) -> Column:
    """struct<n_lines, marked, longest> of a visible text's enumeration markers.

    Two passes over the text leave a mark for each marked line and the line ends; nothing is done line by line.
    """
    unmarked = F.replace(held(text), F.lit(MARK), F.lit("x"))  # neither makes a line a marker
    marked = F.regexp_replace(unmarked, rf"(\A|\n)(?:{ENUM_IN_TEXT})(?=\n|\z)", f"$1{MARK}")
    bare = F.regexp_replace(marked, rf"[^\n{MARK}]+", "")

    def of(b: Column) -> Column:
        # a run of n markers is n marks and the n - 1 line ends between them
        longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(b, F.lit(rf"{MARK}(?:\n{MARK})*+"), F.lit(0)), F.length)), F.lit(0))
        n = F.length(F.replace(b, F.lit("\n"), F.lit("")))
        return F.struct((F.length(b) - n + 1).cast("long").alias("n_lines"), n.cast("long").alias("marked"), F.floor((longest + 1) / 2).cast("long").alias("longest"))

    return let(bare, of)


def is_token_flood(n_top: Column, n_tokens: Column, n_visible: Column, n_chars: Column) -> Column:
    share = F.when(n_visible > k.LONG_TEXT, k.FLOOD_LONG).otherwise(k.FLOOD_SHORT)
    long_enough = (n_chars >= k.MIN_CHARS) & (n_visible >= k.MIN_CHARS) & (n_tokens >= k.FLOOD_TOKENS)
    return F.coalesce(long_enough & (n_top / n_tokens >= share), F.lit(False))


def is_runaway_enum(found: Column, n_chars: Column) -> Column:
    share = (found["marked"] >= k.ENUM_LINES) & (found["marked"] / found["n_lines"] >= k.ENUM_SHARE)
    return (n_chars >= k.ENUM_MIN_CHARS) & (found["n_lines"] >= k.ENUM_LINES) & ((found["longest"] >= k.ENUM_RUN) | share)
