"""The queries: each operator over the driver's tables, on whole tables and whole texts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import charsets as cs
from ..functions import basics, cleaning, text
from ..functions import mojibake as native_mojibake
from ..functions import repetition as native_repetition
from ..kernels import repetition as repetition_kernel
from ..kernels import subdup as subdup_kernel
from ..operators import article, clean, mojibake, quality, repetition, stats, subdup
from ..operators.kernel_udfs import kernel
from .noise import NOISES, noisy

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer splits than there are cores, such as a file of a single row group, is dealt out over the cores.

    Larger inputs have a split for each block and stay where they lie: nothing is shuffled for them.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local session without one has a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="textloom-")
    return f"{folder.rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"


def digest(df: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """key, characters before and after, and a digest of the cleaned text."""
    rows = df.select(F.col(key), before.alias("_before")).withColumn("_after", after)
    return rows.select(key, F.length("_before").cast("long").alias("n_before"), F.length("_after").cast("long").alias("n_after"), F.md5("_after").alias("cleaned_md5"))


def rule_query(rule: str) -> Query:
    """A cleaning rule on documents with that rule's noise."""
    return lambda spark, sf: digest(documents(spark, sf), "doc_id", noisy(F.col("text"), rule), cleaning.RULES[rule](F.col("_before")))


def page_query(rule: str) -> Query:
    return lambda spark, sf: digest(table(spark, sf, "pages"), "page_id", F.col("html"), cleaning.RULES[rule](F.col("_before")))


def clean_repeated_noise(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.col("text"), F.lit(" a11111"), F.repeat(F.lit(" B7777777"), 6))
    return digest(documents(spark, sf), "doc_id", made, cleaning.repeated_noise_token(F.col("_before")))


def clean_hex_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.col("text"), F.lit(" "), F.md5("text"), F.lit(" "), F.sha2("text", 256), F.lit(" 0x"), F.sha2("text", 256))
    return digest(documents(spark, sf), "doc_id", made, cleaning.hex_blob(F.col("_before")))


def clean_hex_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    """Dumps wrapped over lines, by the cleaner."""
    made = F.concat(F.col("text"), F.lit(" zz "), F.sha2("text", 256), F.lit("\n"), F.sha2("text", 256), F.lit("\n"), F.md5("text"))
    return digest(documents(spark, sf), "doc_id", made, clean.cleaning(F.col("_before"), "hex_blob")["cleaned"])


#: Whole tokens first, so that characters put in later do not break them.
ALL_NOISE = ("control_invisible", "bidi_control", "abnormal_space", "pua_known_noise", "decorative_symbol", "decorative_combining", "line_separator", "html_entity", "math_symbol_flood")


def clean_text_full(spark: SparkSession, sf: str) -> DataFrame:
    """All default rules at once, on documents with every kind of noise."""
    kinds = [n for n in cleaning.RULES if n in NOISES and n not in ("combining_decoration", "exotic_combining")]
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), *kinds).alias("text"))
    made = clean.with_cleaning(rows, "text", detail="none")
    return made.select("doc_id", F.md5("cleaning.cleaned").alias("cleaned_md5"), F.col("cleaning.change_count").cast("long").alias("n_changes"), F.size("cleaning.rule_counts").cast("long").alias("n_rules"))


def clean_all_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaner under all default rules on documents with nine kinds of noise, whose rules take turns on a text."""
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), *ALL_NOISE).alias("text"))
    made = clean.with_cleaning(rows, "text", detail="none")
    return made.select("doc_id", F.length("text").cast("long").alias("n_before"), F.length("cleaning.cleaned").cast("long").alias("n_after"), F.md5("cleaning.cleaned").alias("cleaned_md5"))


def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaner's default rules on pages: entities and markup residues go, then line ends and blank lines are mended."""
    made = clean.with_cleaning(table(spark, sf, "pages"), "html", detail="none")
    return made.select("page_id", F.length("html").cast("long").alias("n_before"), F.length("cleaning.cleaned").cast("long").alias("n_after"), F.md5("cleaning.cleaned").alias("cleaned_md5"))


def clean_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cleaning_statistics(clean.with_cleaning(table(spark, sf, "pages"), "html", detail="none"))


def rule_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of changes by rule: from single changes, by gaps and islands."""
    changed = clean.changes(table(spark, sf, "pages"), "page_id", "html", "html_entity")
    return clean.grouped_spans(changed, "page_id").select("page_id", "rule", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "count")


def rule_totals(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rule_totals(clean.changes(table(spark, sf, "pages"), "page_id", "html", "html_entity,forbidden_strings"))


def codepoint_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How often each code point of an entity was removed."""
    return stats.codepoint_totals(clean.changes(table(spark, sf, "pages"), "page_id", "html", "html_entity")).select("rule", "codepoint", "n")


def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaner's spans with previews, reasons and code point counts."""
    rows = clean.spans(table(spark, sf, "pages"), "page_id", "html")
    return rows.select("page_id", "rule", "start", "end", "count", "action", "original_preview", "replacement_preview", F.to_json("codepoint_counts").alias("codepoints"), F.array_join("reasons", ",").alias("reasons"))


# ---- mojibake ----

MOJIBAKE_NOISE = ("fffd", "double_enc", "c1_control", "pua", "specials", "seq", "control_format_flood", "pua_known_noise", "bidi_control", "decorative_symbol", "variation_selector", "abnormal_space")


def moji_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), *MOJIBAKE_NOISE).alias("text"))
    rules = tuple(r for r in native_mojibake.RULES if r not in ("cscn", "math_symbol_flood", "seq", "double_enc", "cp1252"))
    return mojibake.rule_counts(rows, "doc_id", rules=rules)


def moji_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on sequences: garbled pairs and literals by line, double encodings, Windows-1252."""
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), "seq", "double_enc").alias("text"))
    return mojibake.rule_counts(rows, "doc_id", rules=("seq", "double_enc", "cp1252"))


def moji_floods(spark: SparkSession, sf: str) -> DataFrame:
    """Unassigned code points, and floods of one symbol."""
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), "flood", "cscn").alias("text"))
    return mojibake.rule_counts(rows, "doc_id", rules=("cscn", "math_symbol_flood"))


def moji_html_entity(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.rule_counts(table(spark, sf, "pages"), "page_id", "html", ("html_entity",))


def moji_window_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that hold replacement characters."""
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), "fffd").alias("text"))
    n = basics.hits(F.col("window"), cs.java_class(cs.REPLACEMENT)).cast("long")
    found = mojibake.windows(rows, "doc_id").withColumn("hit_num", n).where("hit_num > 0")
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "hit_num")


def moji_full_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every line that hits, and its counts by rule, by the exact detector."""
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), *MOJIBAKE_NOISE).alias("text"))
    rows = rows.select("doc_id", F.inline(mojibake.line_counts(F.col("text"))))
    told = F.array_join(F.transform("rules", lambda r: F.concat(r["rule"], F.lit("="), r["n"].cast("string"))), ",")
    return rows.select("doc_id", "start", "end", told.alias("rules"))


# ---- repetition ----


def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.size(native_repetition.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def ngram_query(n: int) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        counts = native_repetition.ngram_counts(native_repetition.tokens(native_repetition.visible(F.col("text"))), n)
        return documents(spark, sf).select("doc_id", counts.alias("c")).select("doc_id", "c.total", "c.repeated", "c.top_count")

    return run


def token_flood(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent token of each document, the first seen of equals, and whether it floods it."""
    rows = repetition.flags(repetition.measures(documents(spark, sf), "doc_id"))
    return rows.select("doc_id", "n_tokens", "top_token", "top_token_count", "token_flood")


def runaway_counter(spark: SparkSession, sf: str) -> DataFrame:
    shown = native_repetition.visible(noisy(F.col("text"), "enum"))
    rows = documents(spark, sf).select("doc_id", native_repetition.numbers(shown).alias("numbers"))
    return rows.select("doc_id", F.size("numbers").cast("long").alias("n_numbers"), native_repetition.in_counters(F.col("numbers")).alias("n_counter_numbers"))


def runaway_enum(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), "enum").alias("text"))
    rows = rows.select("doc_id", F.length("text").alias("n_chars"), native_repetition.enum_lines(native_repetition.visible(F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.n_lines", "e.marked", "e.longest", native_repetition.is_runaway_enum(F.col("e"), F.col("n_chars")).alias("runaway"))


def rep_ngram_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose 10-grams or 5-grams mostly repeat."""
    rows = repetition.flags(repetition.measures(documents(spark, sf), "doc_id"))
    return rows.select("doc_id", "ngrams10", "repeated10", "ngrams5", "repeated5", F.col("ngram_flag").alias("flagged"))


def conv_assistant_repetition(spark: SparkSession, sf: str) -> DataFrame:
    """Repetition in assistants' turns."""
    turns = table(spark, sf, "conversations").where("role = 'assistant'").withColumn("key", F.struct("conv_id", "turn"))
    rows = repetition.flags(repetition.measures(turns, "key"))
    return rows.select("key.conv_id", "key.turn", "n_tokens", "repeated5", "top_token_count", F.col("ngram_flag").alias("flagged"))


def repetition_findings(spark: SparkSession, sf: str) -> DataFrame:
    """What the exact checks find, with what they quote."""
    rows = documents(spark, sf).select("doc_id", F.explode(repetition.findings(F.col("text"))).alias("f"))
    return rows.select("doc_id", "f.kind", "f.repeated", "f.total", "f.top", "f.top_count", "f.reason")


# ---- passages inside a text ----


def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.size(text.chunk_starts(F.col("text"))).cast("long").alias("n_chunks"), text.chunk_size(F.col("text")).cast("long").alias("chunk_size"))


def word_run_max(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", text.longest_word_run(F.col("text")).alias("longest_run"))


def _found(df: DataFrame, lang: Column) -> DataFrame:
    return subdup.findings(df, "doc_id", lang=lang).drop("lang")


def subdedup_en(spark: SparkSession, sf: str) -> DataFrame:
    return _found(documents(spark, sf), F.lit("en"))


def subdedup_cn(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), "han").alias("text"))
    return _found(rows, F.lit("cn"))


#: Units for texts made to repeat: Latin of one and of two words, Han without and with a mark.
MADE_UNITS = ("lorem ", "ipsum dolor ", "你好吗", "天，地")


def subdedup_made(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in texts made of a beginning, or none, a unit up to eleven times, and an end."""
    unit = F.get(F.array(*[F.lit(u) for u in MADE_UNITS]), (F.col("doc_id") % 4).cast("int"))
    latin = F.col("doc_id") % 4 < 2
    begin = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.when(latin, "Lead in. ").otherwise("前文。"))
    made = F.concat(begin, F.repeat(unit, (F.col("doc_id") % 11 + 1).cast("int")), F.when(latin, "goes on").otherwise("后文"))
    rows = documents(spark, sf).select("doc_id", made.alias("text"), F.when(latin, "en").otherwise("cn").alias("told"))
    return subdup.findings(rows, "doc_id", lang=F.col("told")).drop("lang")


def subdedup_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without what the findings mask."""
    rows = subdup.deduplicated(documents(spark, sf), "doc_id")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and their answers: lengths, and a span of both."""
    turns = table(spark, sf, "conversations")
    ask = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("ask"), F.col("text").alias("source"))
    answer = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("ask"), F.col("text").alias("target"))
    pairs = ask.join(answer, ["conv_id", "ask"]).select("conv_id", "ask", F.length("source").alias("n"), F.length("target").alias("m"))
    # where the middle half of the joined text lies
    return pairs.withColumns({"start": F.floor((F.col("n") + F.col("m")) / 4), "end": F.ceil((F.col("n") + F.col("m")) * 3 / 4)})


def pair_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where the middle half of a question and its answer, joined by one character, begins and ends, as offsets in either."""

    def ends(p: dict) -> dict:
        (a, a_source), (b, b_source) = subdup_kernel.pair_position(p["start"], p["n"], True), subdup_kernel.pair_position(p["end"] - 1, p["n"], False)
        return {"start_in": "src" if a_source else "tgt", "start": a, "end_in": "src" if b_source else "tgt", "end": b + 1}

    made = kernel(ends, "struct<start_in:string,start:long,end_in:string,end:long>")(F.struct("n", "m", "start", "end"))
    return _pairs(spark, sf).select("conv_id", F.col("ask").alias("turn"), made.alias("p")).select("conv_id", "turn", "p.*")


def pair_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The same middle half as one span of either text, or as one of each."""

    def parts(p: dict) -> list[dict]:
        return [{"side": side, "start": a, "end": b} for (a, b), side in subdup_kernel.pair_span(False, p["n"], p["m"], p["start"], p["end"])]

    made = kernel(parts, "array<struct<side:string,start:long,end:long>>")(F.struct("n", "m", "start", "end"))
    return _pairs(spark, sf).select("conv_id", F.col("ask").alias("turn"), F.inline(made))


# ---- text functions ----


def scalar(make: Callable[[Column], Column], name: str, *noises: str) -> Query:
    return lambda spark, sf: documents(spark, sf).select("doc_id", noisy(F.col("text"), *noises).alias("text")).select("doc_id", make(F.col("text")).alias(name))


def hashed(make: Callable[[Column], Column], *noises: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), *noises).alias("text")).select("doc_id", make(F.col("text")).alias("out"))
        return rows.select("doc_id", F.length("out").cast("long").alias("n_chars"), F.md5("out").alias("out_md5"))

    return run


def lang_route(spark: SparkSession, sf: str) -> DataFrame:
    """Language from the column where it says en or Chinese, else from the text's start."""
    rows = documents(spark, sf).select("doc_id", "lang", noisy(F.col("text"), "han").alias("text"))
    return rows.select("doc_id", text.language(F.col("text"), F.col("lang")).alias("told"), text.language(F.col("text")).alias("guessed"))


def has_script(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), "han").alias("text"))
    return rows.select("doc_id", text.has_script(F.col("text"), "en").alias("latin"), text.has_script(F.col("text"), "ch").alias("han"), F.length(text.keep_han(F.col("text"))).cast("long").alias("n_han"))


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """The first mention of a number with what stands around it."""
    at = F.expr("regexp_instr(text, '[0-9]+')") - 1
    found = F.regexp_extract("text", "[0-9]+", 0)
    rows = documents(spark, sf).where(F.col("text").rlike("[0-9]")).select("doc_id", text.excerpt(F.col("text"), at, at + F.length(found)).alias("e"))
    return rows.select("doc_id", F.col("e.text").alias("number"), F.get("e.offset", F.lit(0)).cast("long").alias("start"), F.get("e.context_offset", F.lit(1)).cast("long").alias("context_end"), F.md5("e.context").alias("context_md5"))


def text_kernels(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that need Unicode tables: accents, full normal forms, tokenizer spacing."""
    from ..kernels import textops

    made = kernel(lambda t: {"accents": textops.strip_accents(t), "normal": textops.normalize(t), "spaced": textops.normalize_spacing_for_tok(t)}, "struct<accents:string,normal:string,spaced:string>")
    rows = documents(spark, sf).select("doc_id", made(F.col("text")).alias("k"))
    return rows.select("doc_id", F.md5("k.accents").alias("accents_md5"), F.md5("k.normal").alias("normal_md5"), F.md5("k.spaced").alias("spaced_md5"))


# ---- articles ----


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation as an article with a cut-off title; its turns as comments, each followed by one that quotes it."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    comments = F.array_join(F.transform("t", lambda x: F.concat(F.regexp_replace(x["text"], r"\n\n+", "\n"), F.lit("\n\nsomeone wrote:\n"), F.regexp_replace(x["text"], r"\n\n+", "\n"))), "\n\n")
    parts = [F.format_string("<|start_of_articleid=%d|>A title that was cut off…\nBody\n<|start_of_comment_articleid=%d|>", "conv_id", "conv_id"), comments, F.format_string("<|end_of_comment_articleid=%d|>", "conv_id")]
    return turns.select("conv_id", F.concat(*parts).alias("content"))


def article_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _articles(spark, sf).select("conv_id", text.strip_truncated_titles(F.col("content")).alias("out"))
    return rows.select("conv_id", F.length("out").cast("long").alias("n_chars"), F.md5("out").alias("out_md5"))


def article_quotes(spark: SparkSession, sf: str) -> DataFrame:
    rows = article.clean(_articles(spark, sf)).select("conv_id", F.col("content").alias("out"))
    return rows.select("conv_id", F.size(F.regexp_extract_all("out", F.lit("<ref id=[0-9]+>"), F.lit(0))).cast("long").alias("n_quotes"), F.md5("out").alias("out_md5"))


# ---- quality runs ----


def qc_stats(spark: SparkSession, sf: str) -> DataFrame:
    """All checks over the documents: how many pass, and issues by type."""
    return quality.statistics(quality.reports(documents(spark, sf), "text", "lang", highlights=False))


def repetition_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of the repetition check on documents that fail it: issues, excerpt, and where the first quoted passage stands."""
    rows = quality.failed(quality.reports(documents(spark, sf), "text", checks="repetition", excerpt_chars=100))
    at = F.get_json_object("highlights", "$[0].offset[0]").cast("long")
    return rows.select("doc_id", F.array_join("issues", "|").alias("issues"), F.array_join("issue_types", "|").alias("types"), F.col("content_len").cast("long").alias("content_len"), F.md5("content_excerpt").alias("excerpt_md5"), at.alias("at"))


def mojibake_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Issue lines of the mojibake check: characters hit, the four rules that hit most, and the first three lines."""
    rows = documents(spark, sf).select("doc_id", noisy(F.col("text"), *MOJIBAKE_NOISE).alias("text"))
    return quality.failed(quality.reports(rows, "text", checks="mojibake", highlights=False)).select("doc_id", F.array_join("issues", "|").alias("issues"))


def pass_fail_split(spark: SparkSession, sf: str) -> DataFrame:
    """Passing and failing documents by the n-gram check, with their characters."""
    rows = repetition.flags(repetition.measures(documents(spark, sf), "doc_id")).withColumn("failed", F.col("ngram_flag") | F.col("token_flood") | F.col("runaway_enum"))
    return rows.groupBy("failed").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


def issue_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A top-k report: the 20 documents of most repeated 5-grams."""
    rows = repetition.measures(documents(spark, sf), "doc_id").select("doc_id", "ngrams5", "repeated5")
    return rows.orderBy(F.desc("repeated5"), "doc_id").limit(20)


def issue_types(spark: SparkSession, sf: str) -> DataFrame:
    """Issues by type, language and source, with subtotals."""
    rows = quality.reports(documents(spark, sf), "text", "lang", highlights=False).select("lang", "source", F.explode("issue_types").alias("issue"))
    return rows.cube("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("issue").alias("n_types"))


def clean_then_check(spark: SparkSession, sf: str) -> DataFrame:
    """The mojibake check on cleaned pages, some of which hold replacement characters, that the cleaner leaves."""
    rows = table(spark, sf, "pages").select("page_id", noisy(F.col("html"), "fffd").alias("html"))
    checked = quality.reports(clean.clean(rows, "html"), "html", checks="mojibake", highlights=False)
    return checked.groupBy("failed").agg(F.count("*").alias("n_pages"), F.sum("page_id").alias("ids"))


# ---- sources and streams ----


def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as JSON lines, read with their line numbers, cleaned with provenance, and told by line."""
    from ..sources import jsonl

    path = shared_path(spark, "jsonl")
    table(spark, sf, "pages").select(F.to_json(F.struct("page_id", F.col("html").alias("content"))).alias("value")).write.text(path)
    lines = jsonl.read_lines(spark, path)
    done = lines.select("line_no", jsonl.cleaned_line(F.col("line_no"), F.col("raw"), add_meta=True).alias("c"))
    record = F.from_json("c.line", "page_id long, content string, meta struct<cleaning_v6: struct<line_no: long, change_count: long>>")
    done = done.select("line_no", record.alias("r"))
    told = F.col("r.meta.cleaning_v6")
    return done.select("r.page_id", (F.col("line_no") == told["line_no"]).alias("same_line"), told["change_count"].alias("change_count"), F.length("r.content").cast("long").alias("n_after"))


def check_run(spark: SparkSession, sf: str) -> DataFrame:
    """A check run over lines of JSON, some of them broken: what its sinks hold, each line once."""
    from ..sources import jsonl

    path, out = shared_path(spark, "check-in"), shared_path(spark, "check-out")
    broken = F.when(F.col("doc_id") % 50 == 7, F.lit("{")).otherwise("")
    documents(spark, sf).select(F.concat(broken, F.to_json(F.struct("doc_id", "lang", "text"))).alias("value")).write.text(path)
    jsonl.check_jsonl(spark, path, out, "repetition", passed_output=f"{out}/passed", failed_output=f"{out}/failed")
    held = spark.read.text(f"{out}/passed").select(F.lit("passed").alias("sink"), "value").unionByName(spark.read.text(f"{out}/failed").select(F.lit("failed").alias("sink"), "value"))
    lines = held.select("sink", F.from_json("value", "doc_id long, text string").alias("r")).select("sink", "r.doc_id", F.md5("r.text").alias("text_md5"))
    bad = spark.read.text(f"{out}/issues.jsonl").select(F.from_json("value", "line_no long, bad_json boolean").alias("r")).where("r.bad_json")
    return lines.unionByName(bad.agg(F.count("*").alias("doc_id")).select(F.lit("bad_json").alias("sink"), "doc_id", F.lit("").alias("text_md5")))


def clean_run(spark: SparkSession, sf: str) -> DataFrame:
    """A clean run over lines of JSON: the summary's counters, and the lines it wrote, in their order."""
    from ..sources import jsonl

    path, out = shared_path(spark, "clean-in"), shared_path(spark, "clean-out")
    table(spark, sf, "pages").select(F.to_json(F.struct("page_id", F.col("html").alias("content"))).alias("value")).write.text(path)
    summary = jsonl.clean_jsonl(spark, path, out, rules="html_entity,forbidden_strings")
    lines = spark.read.text(out).select(F.from_json("value", "page_id long, content string").alias("r"))
    told = lines.select(F.lit("page").alias("kind"), F.col("r.page_id").cast("string").alias("name"), F.length("r.content").cast("long").alias("n"))
    return told.unionByName(spark.createDataFrame([("stat", k, v) for k, v in summary["stats"].items()], "kind string, name string, n long"))


def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a stream through the cleaner, all that is there, into a table."""
    from ..streaming import streams

    out = shared_path(spark, "stream")
    docs = documents(spark, sf)
    folder = shared_path(spark, "stream-in")
    docs.select("doc_id", noisy(F.col("text"), "control_invisible", "emoji_all").alias("text")).write.parquet(folder)
    stream = streams.read_table(spark, folder, docs.select("doc_id", "text").schema)
    query = streams.start(clean.clean(stream, "text").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5")), out, f"{out}-checkpoint")
    query.awaitTermination()
    return spark.read.schema("doc_id long, n_chars long, text_md5 string").parquet(out)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by host: how much of them is entities and markup residues, natively, in one aggregation."""
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    rows = table(spark, sf, "pages").select(
        host.alias("host"),
        F.length("html").cast("long").alias("n_chars"),
        cleaning.changed_chars("html_entity", F.col("html")).cast("long").alias("n_entity"),
        cleaning.changed_chars("forbidden_strings", F.col("html")).cast("long").alias("n_residue"),
    )
    return rows.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n_chars").alias("n_chars"), F.sum("n_entity").alias("n_entity"), F.sum("n_residue").alias("n_residue"))


#: Rules whose query is the rule's native form on documents with its noise.
NOISY_RULES = {
    "clean_control_invisible": "control_invisible",
    "clean_bidi": "bidi_control",
    "clean_variation_selector": "variation_selector",
    "clean_styled_math": "styled_math_alnum",
    "clean_abnormal_space": "abnormal_space",
    "clean_pua_noise": "pua_known_noise",
    "clean_pua_contextual": "pua_contextual",
    "clean_decorative": "decorative_symbol",
    "clean_combining": "decorative_combining",
    "clean_emoji": "emoji_all",
    "clean_exotic_combining": "exotic_combining",
    "clean_combining_decoration": "combining_decoration",
    "clean_line_separator": "line_separator",
    "clean_line_boundary": "line_boundary_space",
    "clean_blank_lines": "blank_line_collapse",
    "clean_math_flood": "math_symbol_flood",
    "clean_forbidden_documents": "forbidden_strings",
    "clean_entity_documents": "html_entity",
}

QUERIES: dict[str, Query] = {
    "flagship": flagship,
    **{name: rule_query(rule) for name, rule in NOISY_RULES.items()},
    "clean_html_entity": page_query("html_entity"),
    "clean_forbidden": page_query("forbidden_strings"),
    "clean_repeated_noise": clean_repeated_noise,
    "clean_hex_contiguous": clean_hex_contiguous,
    "clean_hex_wrapped": clean_hex_wrapped,
    "clean_text_full": clean_text_full,
    "clean_all_rules": clean_all_rules,
    "clean_pages": clean_pages,
    "clean_stats": clean_stats,
    "rule_spans": rule_spans,
    "rule_totals": rule_totals,
    "codepoint_totals": codepoint_totals,
    "provenance": provenance,
    "moji_class_counts": moji_class_counts,
    "moji_patterns": moji_patterns,
    "moji_floods": moji_floods,
    "moji_html_entity": moji_html_entity,
    "moji_window_hits": moji_window_hits,
    "moji_full_report": moji_full_report,
    "token_count": token_count,
    "ngram10_ratio": ngram_query(10),
    "ngram5_ratio": ngram_query(5),
    "token_flood": token_flood,
    "runaway_counter": runaway_counter,
    "runaway_enum": runaway_enum,
    "rep_ngram_flag": rep_ngram_flag,
    "conv_assistant_repetition": conv_assistant_repetition,
    "repetition_findings": repetition_findings,
    "chunk_counts": chunk_counts,
    "word_run_max": word_run_max,
    "subdedup_en": subdedup_en,
    "subdedup_cn": subdedup_cn,
    "subdedup_made": subdedup_made,
    "subdedup_cut": subdedup_cut,
    "pair_offsets": pair_offsets,
    "pair_spans": pair_spans,
    "lang_route": lang_route,
    "has_script": has_script,
    "excerpts": excerpts,
    "is_code": scalar(text.is_code, "is_code", "code"),
    "strip_punct_len": scalar(lambda t: F.length(text.without_punctuation(t)).cast("long"), "n_chars", "punctuation"),
    "sentence_count": scalar(text.sentence_count, "n_sentences"),
    "keep_english": hashed(text.keep_latin),
    "normalize_for_dedup": hashed(text.normalize_for_dedup, "punctuation"),
    "slow_normalize_for_dedup": hashed(text.slow_normalize_for_dedup, "punctuation"),
    "replace_unicode_punct": hashed(text.replace_unicode_punct, "punctuation"),
    "remove_unicode_punct": hashed(text.remove_unicode_punct, "punctuation"),
    "remove_split_punct": hashed(text.remove_split_punct, "punctuation"),
    "remove_non_printing_char": hashed(text.remove_non_printing_char, "c1_control"),
    "remove_punctuation": hashed(text.remove_punctuation),
    "remove_unprintable": hashed(text.remove_unprintable, "c1_control", "control_invisible"),
    "filter_latex": hashed(text.filter_latex),
    "text_kernels": text_kernels,
    "article_titles": article_titles,
    "article_quotes": article_quotes,
    "qc_stats": qc_stats,
    "repetition_reports": repetition_reports,
    "mojibake_reports": mojibake_reports,
    "pass_fail_split": pass_fail_split,
    "issue_topk": issue_topk,
    "issue_types": issue_types,
    "clean_then_check": clean_then_check,
    "jsonl_round_trip": jsonl_round_trip,
    "clean_run": clean_run,
    "check_run": check_run,
    "stream_clean": stream_clean,
}

__all__ = ["QUERIES", "repetition_kernel"]
