"""Passages repeated back to back inside a text, over DataFrames.

Texts are cut into their chunks first, so that one very long text is many rows; chunks without
what a finding needs never leave the JVM. Results are by document and chunk.

Defined results: null and empty texts have no chunks and no findings; an empty table gives
an empty result; findings in the overlap of two chunks are reported for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_size, chunk_starts, has_script, is_code, language
from ..kernels import subdup as k
from .kernel_udfs import kernel

FOUND = "struct<start:int,end:int,unit_start:int,unit_end:int,repeats:int,char_len:int,word_len:int,is_special:boolean>"


def _row(f: dict) -> dict:
    (a, b), (c, d), info = f["offset"], f["info"]["repeat_text_offset"], f["info"]
    return {"start": a, "end": b, "unit_start": c, "unit_end": d, "repeats": f["score"], "char_len": info["char_len"], "word_len": info["word_len"], "is_special": bool(info["is_special"])}


def chunks(df: DataFrame, key: str, column: str = "text", lang: Column | None = None) -> DataFrame:
    """key, lang, chunk (from 0), at and part of every chunk."""
    text = F.col(f"`{column}`")
    starts = chunk_starts(text)
    size, step = chunk_size(text), F.coalesce(F.get(starts, F.lit(1)), F.length(text))
    rows = df.select(F.col(f"`{key}`").alias("_key"), (language(text) if lang is None else lang).alias("lang"), text.alias("_text"), size.alias("_size"), F.greatest(step, F.lit(1)).alias("_step"))
    # one scan cuts a text into steps; a chunk is a step and, where chunks overlap, the beginning of the next one
    pieces = F.regexp_extract_all("_text", F.concat(F.lit("(?s).{1,"), F.col("_step").cast("string"), F.lit("}")), F.lit(0))
    rows = rows.select("_key", "lang", "_size", "_step", pieces.alias("_p"))
    whole = F.transform("_p", lambda p, i: F.concat(p, F.substring(F.coalesce(F.get("_p", i + 1), F.lit("")), F.lit(1), F.greatest(F.col("_size") - F.col("_step"), F.lit(0)))))
    rows = rows.select("_key", "lang", "_step", F.posexplode(whole).alias("chunk", "part"))
    return rows.select(F.col("_key").alias(key), "lang", "chunk", (F.col("chunk") * F.col("_step")).alias("at"), "part")


def found_in(part: Column, lang: Column) -> Column:
    """Findings in a chunk, as array<struct>; offsets from the chunk's start."""

    def one(value: str, language: str) -> list[dict]:
        return [_row(f) for f in (k.english if language == "en" else k.chinese)(value)]

    # a Latin finding needs a letter and white space, a Han one a Han character; code has none
    can = F.when(lang == "en", has_script(part, "en") & part.rlike(r"\s")).otherwise(has_script(part, "ch") | part.contains("\\\\u0000") | part.contains("\\\\U0000")) & ~is_code(part)
    run = kernel(one, f"array<{FOUND}>")(F.when(can, part), lang)
    return F.coalesce(run, F.array().cast(f"array<{FOUND}>"))


def findings(df: DataFrame, key: str, column: str = "text", lang: Column | None = None) -> DataFrame:
    """key, lang and a finding's fields, one row each; offsets are the text's."""
    parts = chunks(df, key, column, lang)
    rows = parts.select(F.col(f"`{key}`").alias("_key"), "lang", "at", F.explode(found_in(F.col("part"), F.col("lang"))).alias("f"))
    moved = [(F.col("at") + F.col(f"f.{c}")).alias(c) for c in ("start", "end", "unit_start", "unit_end")]
    return rows.select(F.col("_key").alias(key), "lang", *moved, "f.repeats", "f.char_len", "f.word_len", "f.is_special")


def deduplicated(df: DataFrame, key: str, column: str = "text", lang: Column | None = None) -> DataFrame:
    """df with what findings mask cut out of the text column; rows are told apart by key."""
    masks = findings(df, key, column, lang).groupBy(key).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_masks")).withColumnRenamed(key, "_key")
    text = F.col(f"`{column}`")
    joined = df.join(masks, df[f"`{key}`"].eqNullSafe(masks["_key"]), "left")
    # masks may overlap: what is kept runs from the furthest end so far to the next start
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate(
        "_masks",
        begin,
        lambda a, m: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(m["start"] - a["at"], F.lit(0)))).alias("out"), F.greatest(a["at"], m["end"]).alias("at")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return joined.withColumn(column, F.coalesce(cut, text)).select(*[F.col(f"`{c}`") for c in df.columns])
