"""Native functions against the kernels, on texts full of triggers."""

import re
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from textloom import charsets as cs
from textloom.functions import basics, cleaning, mojibake, repetition, text
from textloom.kernels import cleaner, records, subdup, textops
from textloom.kernels import mojibake as mojibake_kernel
from textloom.kernels import repetition as repetition_kernel

from .texts import made

TEXTS = [*made(600), None, ""]


def T():
    return F.col("t")



@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string").repartition(8).cache()
    df.count()
    return df


def same(df, column, fn):
    got = {r.i: r.v for r in df.select("i", column.alias("v")).collect()}
    wrong = [(t, got[i], fn(t or "")) for i, t in enumerate(TEXTS) if got[i] != fn(t or "")]
    assert not wrong, wrong[:2]


@pytest.mark.parametrize("rule", cleaning.RULES)
def test_rules(rows, rule):
    if rule == "hex_blob":
        same(rows, cleaning.RULES[rule](T()), lambda t: re.sub(cs.HEX_RUN, "", t))
    else:
        alone = cleaner.Cleaner([rule])
        same(rows, cleaning.RULES[rule](T()), lambda t: alone(t)[0])


@pytest.mark.parametrize("rules", [cleaner.DEFAULT_RULES, cleaner.ALL_RULES, *[(r,) for r in cleaner.ALL_RULES]])
def test_may_change(rows, rules):
    made_ = cleaner.Cleaner(rules)
    told = {r.i: r.v for r in rows.select("i", cleaning.may_change(T(), rules).alias("v")).collect()}
    assert not [t for i, t in enumerate(TEXTS) if made_(t or "")[1] and not told[i]]


@pytest.mark.parametrize("rule", mojibake_kernel.RULES)
def test_mojibake(rows, rule):
    d = mojibake_kernel.Detector()
    same(rows, mojibake.count(rule, T()), lambda t: d.counts(t).get(rule, 0))


def test_repetition(rows):
    same(rows, repetition.tokens(T()), repetition_kernel.tokens)
    same(rows, repetition.visible(T()), repetition_kernel.visible)

    def grams(t):
        w = repetition_kernel.tokens(t)
        c = Counter(zip(*(w[i:] for i in range(3)))) if len(w) >= 9 else Counter()
        return c.total(), sum(x for x in c.values() if x > 1), max(c.values(), default=0)

    same(rows, repetition.ngram_counts(repetition.tokens(T()), 3), grams)

    def top(t):
        w = repetition_kernel.tokens(t)
        x = max(w, key=Counter(w).__getitem__, default=None)
        return None if x is None else (x, w.index(x), w.count(x))

    same(rows, repetition.top_token(repetition.tokens(T())), top)
    same(rows, repetition.in_counters(repetition.numbers(T())), lambda t: len(repetition_kernel.counter_runs(t)))

    def enum(t):
        flags = [bool(re.fullmatch(repetition_kernel.ENUM_LINE, x)) for x in t.split("\n")]
        return len(flags), sum(flags), max((len(list(g)) for k, g in groupby(flags) if k), default=0)

    same(rows, repetition.enum_lines(T()), enum)


@pytest.mark.parametrize(
    "name", ["replace_unicode_punct", "remove_unicode_punct", "remove_split_punct", "remove_non_printing_char", "normalize_for_dedup", "slow_normalize_for_dedup", "remove_punctuation", "remove_unprintable"]
)
def test_text(rows, name):
    same(rows, getattr(text, name)(T()), getattr(textops, name))


def test_more_text(rows):
    same(rows, text.sentences(T()), textops.split_mix_paragraph)
    same(rows, text.language(T()), lambda t: records.language({}, t))
    same(rows, text.is_code(T()), subdup.is_code)
    same(rows, text.without_punctuation(T()), subdup.without_punctuation)
    same(rows, text.keep_han(T()), subdup.keep_han)
    same(rows, text.keep_latin(T()), subdup.keep_latin)
    same(rows, text.filter_latex(T()), subdup.filter_latex)
    same(rows, text.has_script(T(), "en"), lambda t: subdup.has_target_char(t, "en"))
    same(rows, text.has_script(T(), "any"), lambda t: subdup.has_target_char(t, "any"))
    same(rows, text.chunk_starts(F.repeat(T(), 500)), lambda t: [i for i, _ in subdup.chunks(t * 500)])
    same(rows, text.longest_word_run(T()), lambda t: max((len(list(g)) for _, g in groupby(t.split())), default=0))
    same(rows, F.transform(basics.spans(T(), cs.HTML_ENTITY), lambda s: F.array(s["start"], s["end"])), lambda t: [list(m.span()) for m in re.finditer(cs.HTML_ENTITY, t)])
    shown = rows.where("t is not null").select("i", text.excerpt(T(), F.lit(5), F.lit(9), 3).alias("v")).collect()
    assert all(r.v.asDict() == records.excerpt(TEXTS[r.i], 5, 9, 3) for r in shown)


def test_native_plans_stay_native(rows):
    plan = rows.select(*[f(T()) for f in cleaning.RULES.values()], repetition.tokens(T()), mojibake.count("seq", T()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hash" not in plan
