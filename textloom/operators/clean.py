"""The multi-rule cleaner over DataFrames.

Texts without any trigger, nearly all of a clean corpus, are told by one native predicate and never
leave the JVM; the rest pass through the exact kernel in Arrow batches. One narrow stage, no shuffle.

Defined results: a null text stays null with no changes; the empty text has none; repeated rows
are cleaned alike; an empty table gives an empty result; all other columns stay, whatever
their names (the result's columns replace columns of the same name).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import may_change
from ..kernels import cleaner as k
from ..kernels.cleaner import Cleaner, parse_rules
from .kernel_udfs import kernel

CHANGE = "struct<field:string,char:string,unicode_escape:string,codepoint:string,name:string,category:string,rule:string,replacement:string,offset:int,reason:string>"
SPAN = "struct<rule:string,field:string,start:int,end:int,count:int,action:string,original_preview:string,replacement_preview:string,codepoint_counts:map<string,int>,reasons:array<string>>"
#: What each detail adds to the result.
DETAILS = {"none": (), "spans": ("spans",), "chars": ("changes",), "both": ("spans", "changes")}


def _result_type(detail: str) -> str:
    more = {"spans": f"spans:array<{SPAN}>", "changes": f"changes:array<{CHANGE}>"}
    return f"struct<{','.join(['cleaned:string', 'change_count:int', 'rule_counts:map<string,long>', *[more[d] for d in DETAILS[detail]]])}>"


def cleaning(text: Column, rules: str | Iterable[str] | None = None, detail: str = "none", field: str = "content") -> Column:
    """struct<cleaned, change_count, rule_counts[, spans][, changes]> of a text column."""
    chosen = parse_rules(rules)
    if detail not in DETAILS:
        raise ValueError(f"detail must be one of: {', '.join(DETAILS)}")
    made, wanted = Cleaner(chosen), DETAILS[detail]

    def one(value: str) -> dict:
        cleaned, edits = made(value)
        by_rule: dict[str, int] = {}
        for rule, _, _ in edits.values():
            by_rule[rule] = by_rule.get(rule, 0) + 1
        out = {"cleaned": cleaned, "change_count": len(edits), "rule_counts": list(by_rule.items())}
        if "spans" in wanted:
            out["spans"] = [{**s, "codepoint_counts": list(s["codepoint_counts"].items())} for s in k.spans(field, value, edits)]
        if "changes" in wanted:
            out["changes"] = [{"field": field, **c} for c in k.changes(value, edits)]
        return out

    kind = _result_type(detail)
    run = kernel(one, kind)(F.when(may_change(text, chosen), text))
    nothing = [text.alias("cleaned"), F.lit(0).alias("change_count"), F.create_map().cast("map<string,long>").alias("rule_counts")]
    nothing += [F.array().cast(f"array<{SPAN if d == 'spans' else CHANGE}>").alias(d) for d in wanted]
    return F.coalesce(run, F.struct(*nothing).cast(kind))


def clean(df: DataFrame, columns: str | Iterable[str] = "text", rules: str | Iterable[str] | None = None) -> DataFrame:
    """df with the named string columns cleaned."""
    for c in [columns] if isinstance(columns, str) else list(columns):
        df = df.withColumn(c, cleaning(F.col(f"`{c}`"), rules)["cleaned"])
    return df


def with_cleaning(df: DataFrame, column: str = "text", rules: str | Iterable[str] | None = None, detail: str = "spans", into: str = "cleaning") -> DataFrame:
    """df with a struct column that holds the cleaned text and its provenance."""
    return df.withColumn(into, cleaning(F.col(f"`{column}`"), rules, detail, column))


def changes(df: DataFrame, key: str, column: str = "text", rules: str | Iterable[str] | None = None) -> DataFrame:
    """One row for each changed character: key and the fields of a change."""
    made = df.select(F.col(f"`{key}`").alias("_key"), cleaning(F.col(f"`{column}`"), rules, "chars", column)["changes"].alias("_c"))
    return made.select(F.col("_key").alias(key), F.inline("_c"))


def spans(df: DataFrame, key: str, column: str = "text", rules: str | Iterable[str] | None = None) -> DataFrame:
    """One row for each unbroken stretch of a rule's changes."""
    made = df.select(F.col(f"`{key}`").alias("_key"), cleaning(F.col(f"`{column}`"), rules, "spans", column)["spans"].alias("_s"))
    return made.select(F.col("_key").alias(key), F.inline("_s"))


def grouped_spans(changed: DataFrame, *keys: str) -> DataFrame:
    """Stretches of consecutive offsets by keys, field and rule, from rows of changes(), natively.

    Rows of one document's rule are ranked by offset; offset minus rank is constant along a stretch.
    """
    from pyspark.sql import Window

    by = [*keys, "field", "rule"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("offset"))
    return changed.withColumn("_island", F.col("offset") - rank).groupBy(*by, "_island").agg(
        F.min("offset").alias("start"),
        (F.max("offset") + 1).alias("end"),
        F.count("*").alias("count"),
        F.sort_array(F.collect_set("reason")).alias("reasons"),
    ).drop("_island")
