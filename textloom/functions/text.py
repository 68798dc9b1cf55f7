"""Scalar text functions, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import charsets as cs
from ..kernels import records, subdup
from ..kernels import textops as k
from .basics import DIGIT, SPACE, WORD, held, hits, let, runs, stripped, without, words

_CONTROLS = cs.java_class(k.CONTROLS)
_PUNCTUATION = cs.java_rare(cs.chars("".join(k.PUNCTUATION)))
_HAN, _HAN_KEPT = cs.java_class(cs.HAN), r"[^\x{4E00}-\x{9FA5}]"


def language(text: Column, told: Column | None = None) -> Column:
    """en or cn: what is told (null: nothing), else by the share of Han characters at the text's start."""
    start = F.substring(held(text), 1, records.SAMPLE)
    guess = F.when(hits(start, _HAN) / F.greatest(F.length(start), F.lit(1)) > 0.1, "cn").otherwise("en")
    told = F.lower(held(told if told is not None else F.lit("")))
    return F.when(told.startswith("en"), "en").when(told.rlike("^(zh|cn|ch)"), "cn").otherwise(guess)


def excerpt(text: Column, start: Column, end: Column, around: int = records.CONTEXT) -> Column:
    """struct<offset, text, context_offset, context> of a span, clamped to the text."""
    n = F.length(text)
    a = F.least(F.greatest(start, F.lit(0)), n)
    b = F.least(F.greatest(end, a), n)
    left, right = F.greatest(a - around, F.lit(0)), F.least(b + around, n)
    cut = lambda x, y: F.substring(text, x + 1, y - x)
    return F.struct(F.array(a, b).alias("offset"), cut(a, b).alias("text"), F.array(left, right).alias("context_offset"), cut(left, right).alias("context"))


def issue_type(issue: Column) -> Column:
    return F.substring_index(issue, ":", 1)


def is_code(text: Column) -> Column:
    return held(text).contains("code::") | held(text).rlike("(?s)```.*?```")


def has_script(text: Column, lang: str) -> Column:
    latin, han = held(text).rlike("[A-Za-z]"), held(text).rlike(_HAN)
    return latin if lang == "en" else han if lang == "ch" else latin | han


def keep_han(text: Column) -> Column:
    return without(text, _HAN_KEPT)


def keep_latin(text: Column) -> Column:
    return without(text, "[^a-zA-Z]")


def filter_latex(text: Column) -> Column:
    return without(text, r"\\cdots|\\underline")


def without_punctuation(text: Column) -> Column:
    return without(text, cs.java_class(subdup.BARE))


def chunk_starts(text: Column) -> Column:
    """Offsets of a text's chunks; none for the empty text."""
    n = F.length(held(text))
    shape = F.lit(None)
    for below, size, overlap in reversed(subdup.CHUNKS):
        shape = F.when(n < below, size - overlap).otherwise(shape)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, shape)).otherwise(F.array().cast("array<int>"))


def chunk_size(text: Column) -> Column:
    n, out = F.length(held(text)), F.lit(1000)
    for below, size, _ in reversed(subdup.CHUNKS):
        out = F.when(n < below, size).otherwise(out)
    return out


def longest_word_run(text: Column) -> Column:
    """The longest run of one word after itself."""
    return F.coalesce(F.array_max(F.transform(runs(words(text), "string"), lambda r: r["n"])), F.lit(0)).cast("long")


def replace_unicode_punct(text: Column) -> Column:
    single = {a: b for a, b in k.PUNCTUATION.items() if len(b) == 1}
    text = F.translate(held(text), "".join(single), "".join(single.values()))
    for a, b in k.PUNCTUATION.items():
        if len(b) > 1:  # what is written is never written on again
            text = F.replace(text, F.lit(a), F.lit(b))
    return text


def remove_unicode_punct(text: Column) -> Column:
    return F.translate(held(text), "".join(k.PUNCTUATION), "")


def remove_split_punct(text: Column) -> Column:
    return F.translate(held(text), k.SPLIT_PUNCTUATION, "")


def remove_non_printing_char(text: Column) -> Column:
    return without(text, _CONTROLS)


def normalize_for_dedup(text: Column) -> Column:
    zeroed = F.regexp_replace(F.lower(stripped(text)), DIGIT, "0")
    return F.regexp_replace(without(without(zeroed, _PUNCTUATION), _CONTROLS), f"{SPACE}+", " ")


def slow_normalize_for_dedup(text: Column) -> Column:
    zeroed = F.regexp_replace(F.lower(stripped(text)), DIGIT, "0")
    return without(without(zeroed, _PUNCTUATION), _CONTROLS)


def remove_punctuation(text: Column) -> Column:
    return stripped(without(text, rf"(?:(?!{WORD})(?!{SPACE})(?s:.))+(?=\n?\z)"))


def _clauses(text: Column) -> Column:
    """Pieces that end with a mark, white space collapsed; \\x01 and \\x02 stand for the stops of titles and decimals."""
    t = F.regexp_replace(held(text), "\x01", "")
    t = F.regexp_replace(t, rf"({'|'.join(k.TITLES)})\. ([A-Za-z])", "$1\x01$2")
    t = F.regexp_replace(t, rf"({DIGIT}+)\.({DIGIT}+)", "$1\x02$2")
    ends = cs.java_class(cs.chars(k.SENTENCE_ENDS))
    parts = F.filter(F.split(F.regexp_replace(t, f"({ends}){SPACE}*", "$1\x03"), "\x03", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.regexp_replace(F.replace(p, F.lit("\x01"), F.lit(". ")), f"{SPACE}+", " "))


def sentences(text: Column) -> Column:
    """Sentences and clauses, marks kept, as an array."""
    # a lone mark belongs to what it ends: it is joined without a break
    marked = let(_clauses(text), lambda ps: F.transform(ps, lambda p, i: F.when((i == 0) | (F.length(p) == 1), p).otherwise(F.concat(F.lit("\x03"), p))))
    whole = F.replace(F.array_join(marked, ""), F.lit("\x02"), F.lit("."))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\x03", -1))


def sentence_count(text: Column) -> Column:
    return F.size(sentences(text)).cast("long")


def remove_unprintable(text: Column) -> Column:
    return without(text, cs.java_rare(cs.minus(cs.UCD.unprintable, cs.chars(" "))))


def strip_truncated_titles(text: Column) -> Column:
    return F.regexp_replace(held(text), r"(<\|start_of_articleid=[0-9]+\|>)[^\n]*?…(?:(?!\n)" + SPACE + r")*\n", "$1")
