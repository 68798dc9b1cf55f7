"""The operators as SQL functions.

Whatever has a native form is registered as a temporary SQL function over that form's expression, which the optimizer
inlines: nothing of it leaves the JVM. The rest are the kernels as Arrow functions, one call a batch.
Arguments are texts; a null text gives null, or what the native form says of the empty text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import cleaning, repetition, text
from .functions import mojibake as native_mojibake
from .kernels import article, records, subdup, textops
from .kernels import repetition as repetition_kernel
from .kernels.cleaner import DEFAULT_RULES, OPTIONAL_RULES, Cleaner, char_facts, parse_rules, spans
from .kernels.mojibake import RULES as MOJIBAKE_RULES
from .operators.kernel_udfs import kernel
from .operators.mojibake import HIT
from .operators.subdup import FOUND, _row


class RuleSpans:
    """A table function: rule, start, end, action and reasons of a text's changes."""

    def __init__(self):
        self.made: dict[str, Cleaner] = {}

    def eval(self, text: str, rules: str = "all"):
        if text is not None:
            cleaner = self.made.setdefault(rules, Cleaner(parse_rules(rules)))
            for s in spans("content", text, cleaner.edits(text)):
                yield s["rule"], s["start"], s["end"], s["action"], s["reasons"]


def native_functions() -> dict[str, Callable[[Column], Column]]:
    """Functions of one text whose native form is exact."""
    alone = {f"clean_{rule}": make for rule, make in cleaning.RULES.items() if rule not in ("hex_blob", "repeated_noise_token")}
    counts = {f"mojibake_{rule}": (lambda t, rule=rule: native_mojibake.count(rule, t)) for rule in MOJIBAKE_RULES if rule not in ("seq", "double_enc", "cp1252")}
    return {
        **alone,
        **counts,
        "text_language": lambda t: text.language(t),
        "issue_type": text.issue_type,
        "is_code": text.is_code,
        "has_latin": lambda t: text.has_script(t, "en"),
        "has_han": lambda t: text.has_script(t, "ch"),
        "keep_han": text.keep_han,
        "keep_latin": text.keep_latin,
        "filter_latex": text.filter_latex,
        "without_punctuation": text.without_punctuation,
        "replace_unicode_punct": text.replace_unicode_punct,
        "remove_unicode_punct": text.remove_unicode_punct,
        "remove_split_punct": text.remove_split_punct,
        "remove_non_printing_char": text.remove_non_printing_char,
        "normalize_for_dedup": text.normalize_for_dedup,
        "slow_normalize_for_dedup": text.slow_normalize_for_dedup,
        "remove_punctuation": text.remove_punctuation,
        "remove_unprintable": text.remove_unprintable,
        "strip_truncated_titles": text.strip_truncated_titles,
        "visible": repetition.visible,
    }


def kernel_functions() -> dict[str, tuple[Callable, str, int]]:
    """Function, type and number of texts of everything else."""
    from .kernels.mojibake import Detector

    cleaner, detector, checker = Cleaner(DEFAULT_RULES), Detector(), records.Checker(records.CHECKS)
    by_rules: dict[str, Cleaner] = {}

    def cleaned(value: str, rules: str) -> str:
        return by_rules.setdefault(rules, Cleaner(parse_rules(rules)))(value)[0]

    def checked(value: str, lang: str) -> dict:
        issues, shown = checker(value, lang or records.language({}, value))
        return {"failed": bool(issues), "issues": issues, "issue_types": [records.issue_type(x) for x in issues], "highlights": json.dumps(shown, ensure_ascii=False)}

    hits = lambda t: [{"offset": h["offset"], "detail": list(h["detail"].items())} for h in detector.hits(t)]
    passages = lambda t, lang: [_row(f) for f in subdup.detect(t, lang or records.language({}, t))]
    return {
        "clean_text": (lambda t: cleaner(t)[0], "string", 1),
        "clean_text_by": (cleaned, "string", 2),
        "clean_hex_blob": (lambda t: cleaned(t, "hex_blob"), "string", 1),
        "clean_repeated_noise_token": (lambda t: cleaned(t, "repeated_noise_token"), "string", 1),
        "char_infos": (lambda t: [char_facts(c) for c in t], "array<struct<char:string,unicode_escape:string,codepoint:string,name:string,category:string>>", 1),
        "mojibake_counts": (lambda t: list(detector.counts(t).items()), "map<string,int>", 1),
        "mojibake_hits": (hits, f"array<{HIT}>", 1),
        "repetition_reasons": (lambda t: [repetition_kernel.reason(found) for check in repetition_kernel.CHECKS if (found := check(t))], "array<string>", 1),
        "repeated_passages": (passages, f"array<{FOUND}>", 2),
        "repeated_phrases": (lambda t: sorted(subdup.repeated_phrases(t)), "array<string>", 1),
        "check_text": (checked, "struct<failed:boolean,issues:array<string>,issue_types:array<string>,highlights:string>", 2),
        "strip_accents": (textops.strip_accents, "string", 1),
        "normalize_text": (textops.normalize, "string", 1),
        "normalize_spacing": (lambda t: textops.normalize_spacing_for_tok(t), "string", 1),
        "split_sentences": (textops.split_mix_paragraph, "array<string>", 1),
        "tag_comment_quotes": (article.tag_comment_quotes, "string", 1),
        "clean_article": (article.clean, "string", 1),
    }


def expression(spark: SparkSession, make: Callable[[Column], Column]) -> tuple[str, str]:
    """The SQL of a native form over a text ``t``, and its type."""
    df = spark.createDataFrame([], "t string").select(make(F.col("t")).alias("x"))
    return df._jdf.queryExecution().analyzed().expressions().head().child().sql(), df.schema[0].dataType.simpleString()


def rules(spark: SparkSession):
    """kind, name, place and by_default of every cleaning rule and check."""
    rows = [("rule", r, i, True) for i, r in enumerate(DEFAULT_RULES)] + [("rule", r, i + len(DEFAULT_RULES), False) for i, r in enumerate(OPTIONAL_RULES)]
    rows += [("check", c, i, True) for i, c in enumerate(records.CHECKS)] + [("detector", r, i, True) for i, r in enumerate(MOJIBAKE_RULES)]
    return spark.createDataFrame(rows, "kind string, name string, place int, by_default boolean")


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Register SQL functions under their names, and the rules as a view, with a prefix; returns the functions' names."""
    made = []
    for name, make in native_functions().items():
        body, kind = expression(spark, make)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURNS {kind} RETURN {body}")
        made.append(name)
    for name, (fn, kind, n) in kernel_functions().items():
        spark.udf.register(prefix + name, kernel(fn, kind).udf(n))
        made.append(name)
    spark.udtf.register(prefix + "rule_spans", F.udtf(RuleSpans, returnType="rule string, start int, end int, action string, reasons array<string>"))
    rules(spark).createOrReplaceTempView(f"{prefix}textloom_rules")
    return [prefix + n for n in [*made, "rule_spans"]]
