"""Repetition checks over DataFrames, natively but for the sorting of n-grams; and the exact findings with what they quote.

Defined results: null and empty texts have no findings; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import repetition as native
from ..functions.basics import held
from ..kernels import repetition as k
from .kernel_udfs import kernel, names

GRAMS = "struct<g5:struct<total:long,repeated:long,top_count:long>,g10:struct<total:long,repeated:long,top_count:long>>"
FINDING = "struct<kind:string,ratio:double,total:int,repeated:int,top:string,top_count:int,reason:string>"


def measures(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key and the counts that the checks decide on, one projection, no shuffle."""
    text = held(F.col(f"`{column}`"))
    df = df.select(*names([key]), F.length(text).alias("n_chars"), native.visible(text).alias("_shown"))
    df = df.withColumn("n_visible", F.length("_shown")).withColumn("_tokens", native.tokens(F.col("_shown"))).withColumn("_numbers", native.numbers(F.col("_shown")))
    # n-grams are sorted outside the JVM, which is many times slower on arrays; no texts go there, only a hash of each token
    df = df.withColumn("_grams", kernel(k.gram_counts, GRAMS)(native.token_hashes(F.col("_tokens"))))
    df = df.withColumn("_top", native.top_token(F.col("_tokens"))).withColumn("_enum", native.enum_lines(F.col("_shown")))
    return df.select(
        *names([key]),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("n_visible").cast("long").alias("n_visible"),
        F.size("_tokens").cast("long").alias("n_tokens"),
        F.col("_grams.g10.total").alias("ngrams10"),
        F.col("_grams.g10.repeated").alias("repeated10"),
        F.col("_grams.g10.top_count").alias("top10"),
        F.col("_grams.g5.total").alias("ngrams5"),
        F.col("_grams.g5.repeated").alias("repeated5"),
        F.col("_grams.g5.top_count").alias("top5"),
        F.col("_top.item").alias("top_token"),
        F.coalesce("_top.n", F.lit(0)).cast("long").alias("top_token_count"),
        F.size("_numbers").cast("long").alias("n_numbers"),
        native.in_counters(F.col("_numbers")).alias("n_counter_numbers"),
        F.col("_enum.n_lines").alias("n_lines"),
        F.col("_enum.marked").alias("enum_lines"),
        F.col("_enum.longest").alias("enum_run"),
    )


def flags(measured: DataFrame) -> DataFrame:
    """rows of measures() with ngram_flag (n-grams alone, without the runaway counter), token_flood and runaway_enum."""
    long_enough = (F.col("n_chars") >= k.MIN_CHARS) & (F.col("n_visible") >= k.MIN_CHARS)
    above = lambda n, bound: (F.col(f"ngrams{n}") > 0) & (F.col(f"repeated{n}") / F.greatest(F.col(f"ngrams{n}"), F.lit(1)) > bound)
    enum = F.struct(F.col("n_lines").alias("n_lines"), F.col("enum_lines").alias("marked"), F.col("enum_run").alias("longest"))
    return measured.withColumns(
        {
            "ngram_flag": long_enough & (above(10, k.TEN_GRAM) | above(5, k.FIVE_GRAM)),
            "token_flood": native.is_token_flood(F.col("top_token_count"), F.col("n_tokens"), F.col("n_visible"), F.col("n_chars")),
            "runaway_enum": native.is_runaway_enum(enum, F.col("n_chars")),
        }
    )


def findings(text: Column) -> Column:
    """What the three checks find, as array<struct<kind, ratio, total, repeated, top, top_count, reason>>."""

    def one(value: str) -> list[dict]:
        return [{**found, "reason": k.reason(found)} for check in k.CHECKS if (found := check(value))]

    run = kernel(one, f"array<{FINDING}>")(F.when(F.length(text) >= k.ENUM_MIN_CHARS, text))
    return F.coalesce(run, F.array().cast(f"array<{FINDING}>"))
