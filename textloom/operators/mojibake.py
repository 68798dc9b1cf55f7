"""Mojibake detection over DataFrames: exact hits by line, and native counts.

Defined results: null and empty texts hit nothing; blank lines are never reported, though their
characters count for thresholds over the text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import charsets as cs
from ..functions import mojibake as native
from ..functions.basics import held
from ..kernels.mojibake import RULES, Detector, classes
from .kernel_udfs import kernel

HIT = "struct<offset:array<int>,detail:map<string,struct<hit_num:int,hit_ratio:double,hit_positions:string>>>"


def may_hit(text: Column) -> Column:
    """False only for texts without any hit."""
    by_class = cs.java_rare(*classes().values(), cs.chars("".join(cs.GARBLED) + cs.GARBLED_PAIR), ((0xC0, 0xFF),))
    return held(text).rlike(r"[^\x00-\x7F]") & held(text).rlike(by_class) | held(text).rlike(cs.HTML_ENTITY) | held(text).rlike(native.FLOOD)


def hits(text: Column, unassigned: bool = True, thresholds: dict[str, int] | None = None) -> Column:
    """Every line that hits, with all rules, as array<struct<offset, detail>>."""
    detector = Detector(unassigned, thresholds)

    def one(value: str) -> list[dict]:
        return [{"offset": h["offset"], "detail": list(h["detail"].items())} for h in detector.hits(value)]

    lowered = bool(thresholds) and thresholds.get("math_symbol_flood", cs.FLOOD_DETECT) < cs.FLOOD_DETECT
    run = kernel(one, f"array<{HIT}>")(text if lowered else F.when(may_hit(text), text))
    return F.coalesce(run, F.array().cast(f"array<{HIT}>"))


def line_counts(text: Column) -> Column:
    """Every line that hits and its counts, as array<struct<start, end, rules>>: what hits() tells, without ratios and positions."""
    detector, kind = Detector(), "array<struct<start:int,end:int,rules:array<struct<rule:string,n:int>>>>"

    def one(value: str) -> list[dict]:
        return [{"start": start, "end": end, "rules": [{"rule": r, "n": len(at)} for r, at in places.items()]} for start, end, places in detector.lines(value)]

    return F.coalesce(kernel(one, kind)(F.when(may_hit(text), text)), F.array().cast(kind))


def rule_counts(df: DataFrame, key: str, column: str = "text", rules: tuple[str, ...] = RULES) -> DataFrame:
    """key and one long column for each rule: the characters it hits, natively."""
    text = F.col(f"`{column}`")
    rows = df.select(F.col(f"`{key}`").alias("_key"), text.alias("_text")).withColumn("_rare", native.beyond_ascii(F.col("_text"))).withColumn("_shown", native.beyond_ascii(native.shown(F.col("_text"))))
    made = [(native.class_count(r, F.col("_rare"), F.col("_shown")) if r in classes() else native.count(r, F.col("_text"))).alias(r) for r in rules]
    return rows.select(F.col("_key").alias(key), *made)


#: Lines beyond which their starts are found by a scan outside the JVM.
MANY_LINES = 500


def line_starts(text: str) -> list[int]:
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def windows(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, line_no (from 0), start and end offset and text of every line, its line end included."""
    text = held(F.col(f"`{column}`"))
    rows = df.select(F.col(f"`{key}`").alias("_key"), text.alias("_text"), F.split(text, "\n", -1).alias("_lines"))
    # a line's start is the length of all before it and their line ends: natively for texts of few lines, as each step copies an array, else by one scan
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    native_starts = F.aggregate("_lines", begin, lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")), lambda a: a["starts"])
    many = F.size("_lines") > MANY_LINES
    starts = F.coalesce(kernel(line_starts, "array<int>")(F.when(many, F.col("_text"))), F.when(~many, native_starts))
    rows = rows.select("_key", F.posexplode(F.arrays_zip(F.col("_lines").alias("line"), starts.alias("start"))).alias("line_no", "_x"), F.size("_lines").alias("_n"))
    whole = F.when(F.col("line_no") + 1 < F.col("_n"), F.concat(F.col("_x.line"), F.lit("\n"))).otherwise(F.col("_x.line"))
    return rows.select(F.col("_key").alias(key), "line_no", F.col("_x.start").alias("start"), (F.col("_x.start") + F.length(whole)).alias("end"), whole.alias("window"))
