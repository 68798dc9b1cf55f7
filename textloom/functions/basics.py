"""Building blocks of the native functions: white space as Python has it, counts, runs and spans in arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import charsets as cs

#: Python's white space as a class of the JVM's expressions.
SPACE = cs.java_class(cs.PY_SPACE)
#: Marks a cut; a code point that no text holds.
MARK = "\ufdd1"
DIGIT = cs.java_rare(cs.UCD.digits)
WORD = cs.java_rare(cs.UCD.word, cs.chars("_"))


def held(text: Column) -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    return F.trim(held(text), F.lit("".join(map(chr, sorted(cs.points(cs.PY_SPACE))))))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(held(text), pattern, "")


def hits(text: Column, pattern: str) -> Column:
    """Characters that a pattern covers."""
    return F.length(held(text)) - F.length(without(text, pattern))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern that has no groups of its own."""
    return F.regexp_extract_all(held(text), F.lit(pattern), F.lit(0))


def pieces(text: Column, pattern: str) -> Column:
    """A text split at a pattern. split() compiles its pattern for every row; a replacement by one mark, and a split there, does not."""
    return F.split(F.regexp_replace(held(text), pattern, MARK), MARK, -1)


def words(text: Column) -> Column:
    """Words between Python's white space."""
    return F.filter(pieces(text, f"{SPACE}+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(held(text), "\n", -1)


def spans(text: Column, pattern: str) -> Column:
    """start and end (exclusive) of every match, as an array. The pattern must not match nothing."""
    found = matches(text, pattern)
    gaps = F.slice(pieces(text, pattern), F.lit(1), F.size(found))
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        return F.struct((a + x["size"]).alias("at"), F.array_append(acc["spans"], F.struct(a.alias("start"), (a + x["size"]).alias("end"))).alias("spans"))

    return F.aggregate(both, begin, step, lambda acc: acc["spans"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; inside a lambda, a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(items: Column, kind: str) -> Column:
    """Unbroken runs of equal items, as an array of struct<item, first, n>. kind: the items' type."""
    empty = F.array().cast(f"array<struct<item:{kind},first:int,n:int>>")

    def of(xs: Column) -> Column:
        # a run begins where the item before is another; its length is the distance to the next beginning
        begins = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(xs, i - 1)), i)), lambda i: i.isNotNull())
        return let(begins, lambda at: F.transform(at, lambda p, i: F.struct(F.get(xs, p).alias("item"), p.alias("first"), (F.coalesce(F.get(at, i + 1), F.size(xs)) - p).alias("n"))))

    return F.coalesce(let(items, of), empty)


def counted(items: Column, kind: str) -> Column:
    """Distinct items with their counts and first places, as an array of struct<item, first, n>; by one sort, without a shuffle."""
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("at"))))

    def of(xs: Column) -> Column:
        return F.transform(runs(F.transform(xs, lambda x: x["item"]), kind), lambda r: F.struct(r["item"].alias("item"), F.get(xs, r["first"])["at"].alias("first"), r["n"].alias("n")))

    return let(placed, of)


def most_frequent(items: Column, kind: str) -> Column:
    """struct<item, first, n> of the most frequent item, the first seen of equals; null for none."""
    ranked = F.transform(counted(items, kind), lambda x: F.struct(x["n"].alias("n"), (-x["first"]).alias("back"), x["item"].alias("item")))
    return let(F.array_max(ranked), lambda best: F.when(best.isNotNull(), F.struct(best["item"].alias("item"), (-best["back"]).alias("first"), best["n"].alias("n"))))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)
