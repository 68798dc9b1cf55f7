"""Statistics of cleaning: counts by rule and of rows, in one aggregation with partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cleaning_statistics(cleaned: DataFrame, column: str = "cleaning") -> DataFrame:
    """stat and n of rows that carry with_cleaning()'s struct: total, changed_rows, changed_chars and changed_<rule>."""
    c = F.col(f"`{column}`")
    changed = c["change_count"] > 0
    fixed = F.array(
        F.struct(F.lit("total").alias("stat"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("changed_rows").alias("stat"), F.when(changed, 1).otherwise(0).cast("long").alias("n")),
        F.struct(F.lit("changed_chars").alias("stat"), c["change_count"].cast("long").alias("n")),
    )
    by_rule = F.transform(F.map_entries(c["rule_counts"]), lambda e: F.struct(F.concat(F.lit("changed_"), e["key"]).alias("stat"), e["value"].alias("n")))
    return cleaned.select(F.inline(F.concat(fixed, by_rule))).groupBy("stat").agg(F.sum("n").alias("n"))


def rule_totals(changed: DataFrame, *keys: str) -> DataFrame:
    """Counts by rule, by field and by both, with grouping sets, of rows of changes()."""
    sets = [[], ["rule"], ["field"], ["rule", "field"]]
    return changed.groupingSets([[F.col(c) for c in [*keys, *s]] for s in sets], *[F.col(c) for c in [*keys, "rule", "field"]]).agg(F.count("*").alias("n"))


def codepoint_totals(changed: DataFrame, *keys: str) -> DataFrame:
    """How often each code point was changed, by keys and rule."""
    return changed.groupBy(*keys, "rule", "codepoint").agg(F.count("*").alias("n"))
