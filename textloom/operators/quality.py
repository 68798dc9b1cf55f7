"""Quality reports over DataFrames.

A report is flat enough to filter and group by natively; highlights, whose details differ
by check, are JSON. Failing and passing rows are two complementary filters of one plan.

Defined results: a null text is checked as the empty one and passes; an error inside a check is
an issue of its row; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basics import held
from ..functions.text import language
from ..kernels import records as k
from .kernel_udfs import kernel

REPORT = "struct<issues:array<string>,issue_types:array<string>,highlights:string>"


def checked(text: Column, lang: Column, checks: str | Iterable[str] | None = None, highlights: bool = True) -> Column:
    """struct<issues, issue_types, highlights (JSON; null if not asked for)> of a text."""
    checker = k.Checker(k.parse_checks(checks), highlights)

    def one(value: str, told: str) -> dict:
        try:
            issues, shown = checker(value, told)
        except Exception as error:
            issues, shown = [f"check_error:{str(error)[: k.CHECK_ERROR_CHARS]}"], []
        return {"issues": issues, "issue_types": [k.issue_type(x) for x in issues], "highlights": json.dumps(shown, ensure_ascii=False) if highlights else None}

    return kernel(one, REPORT)(held(text), lang)


def reports(df: DataFrame, column: str = "text", lang: str | None = None, checks: str | Iterable[str] | None = None, excerpt_chars: int = k.BATCH_EXCERPT, highlights: bool = True) -> DataFrame:
    """df with failed, issues, issue_types, highlights, content_len, checked_lang and content_excerpt.

    Highlights are many times the text where much is hit; who does not read them leaves them out, and they are null.
    """
    text = held(F.col(f"`{column}`"))
    told = language(text, F.col(f"`{lang}`") if lang else None)
    out = df.withColumn("checked_lang", told).withColumn("_q", checked(text, F.col("checked_lang"), checks, highlights))
    failed = F.size("_q.issues") > 0
    made = {
        "failed": failed,
        "issues": F.col("_q.issues"),
        "issue_types": F.col("_q.issue_types"),
        "highlights": F.col("_q.highlights"),
        "content_len": F.length(text),
        "content_excerpt": F.when(failed, F.substring(text, 1, excerpt_chars)) if excerpt_chars > 0 else F.lit(None).cast("string"),
    }
    return out.withColumns(made).drop("_q")


def passed(reported: DataFrame) -> DataFrame:
    return reported.where(~F.col("failed"))


def failed(reported: DataFrame) -> DataFrame:
    return reported.where("failed")


def statistics(reported: DataFrame) -> DataFrame:
    """stat and n: total, passed, failed and issue_<type>; issues count once each. Partial sums are made before the shuffle."""
    kinds = reported.select(F.explode(F.concat(F.array(F.lit("total"), F.when(F.col("failed"), "failed").otherwise("passed")), F.transform("issue_types", lambda t: F.concat(F.lit("issue_"), t)))).alias("stat"))
    return kinds.groupBy("stat").agg(F.count("*").alias("n"))


def top_issues(reported: DataFrame, key: str, n: int = 1000) -> DataFrame:
    """The first n failing rows by key."""
    return failed(reported).orderBy(key).limit(n)
