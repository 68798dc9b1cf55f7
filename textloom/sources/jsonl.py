"""Lines of JSON: cleaned, checked and written in their order, with run summaries.

Lines carry their number. The text source has none, so it is made from what a split knows:
the count of lines in each split of a file gives, by prefix sum, the number each
split begins at. That takes one more pass over the files, which reads no columns but
positions, and a broadcast of one row for each split, so lines stay where they lie.

Lines are rewritten by Python's json inside Arrow batches, as the JVM's variants would re-order
keys and re-write numbers. A run is one pass: counters are observed while lines are written, and lines go to their sinks
in one job. Where splits were handed out in the order of the files, as they are for one file, part files are in order as they
stand; else, such as for files of many sizes, lines are sorted by their numbers first.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels import records as k
from ..kernels.cleaner import RecordCleaner, parse_rules
from ..operators.kernel_udfs import kernel
from .paths import check_output, default_output, default_passed_output, move_folder

CLEANED = "struct<line:string,bad_json:boolean,changed:boolean,changed_fields:int,rule_counts:map<string,long>,meta_row:boolean,example:string>"
CHECKED = "struct<failed:boolean,bad_json:boolean,issue_types:array<string>,report:string>"
ISSUE_ROWS, EXAMPLES = 1000, 20


def _splits(rows: DataFrame) -> DataFrame:
    """_file, _block, the first row id and number of lines of every split."""
    return rows.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))


def _rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line_no (from 1, over all files in order of their paths) and raw; rows stay in their partitions."""
    rows = _rows(spark, path)
    splits = _splits(rows)
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_file", "_block", (base - F.col("_first") + 1).alias("_shift"))
    # bounded: a row of some hundred bytes for each split of the files
    return rows.join(F.broadcast(splits), ["_file", "_block"]).select((F.col("_id") + F.col("_shift")).alias("line_no"), "raw")


def in_order(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether the splits lie in the partitions in the order of the files."""
    before = F.lag("_first").over(Window.orderBy("_file", "_block"))
    return _splits(_rows(spark, path)).select((F.col("_first") < before).alias("late")).where("late").isEmpty()


def ordered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """read_lines() with partitions in the order of the lines: sorted, before anything is made of them, only where splits are not."""
    lines = read_lines(spark, path)
    return lines if in_order(spark, path) else lines.orderBy("line_no")


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """The lines as text part files, in the order they lie in."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def cleaned_line(line_no: Column, raw: Column, fields=None, rules=None, add_meta: bool = False, meta_detail: str = "spans", max_meta_spans: int = 0, max_meta_changes: int = 500) -> Column:
    """struct<line, bad_json, changed, changed_fields, rule_counts, meta_row, example> of a line of JSON."""
    made = k.LineCleaner(RecordCleaner(k.parse_fields(fields), parse_rules(rules), meta_detail, max_meta_spans, max_meta_changes), add_meta)

    def one(text: str, number: int) -> dict:
        out = made(number, text)
        return {**out, "rule_counts": list(out["rule_counts"].items())}

    return kernel(one, CLEANED)(raw, line_no)


def checked_line(line_no: Column, raw: Column, checks=None, excerpt_chars: int = k.BATCH_EXCERPT) -> Column:
    """struct<failed, bad_json, issue_types, report (JSON)> of a line of JSON."""
    made = k.LineChecker(k.parse_checks(checks), excerpt_chars)

    def one(text: str, number: int) -> dict:
        out = made(number, text)
        return {"failed": out["failed"], "bad_json": out.get("bad_json", False), "issue_types": out.get("issue_types", []), "report": json.dumps(out, ensure_ascii=False)}

    return kernel(one, CHECKED)(raw, line_no)


def counters(rules: tuple[str, ...]) -> list[Column]:
    """Aggregates over rows that carry cleaned_line()'s struct as ``c``: one for each counter of a run under these rules."""
    n = lambda x: F.sum(F.when(x, 1).otherwise(0))
    sums = {"total": F.count("*"), "bad_json": n(F.col("c.bad_json")), "changed_rows": n(F.col("c.changed")), "changed_fields": F.sum("c.changed_fields"), "meta_rows": n(F.col("c.meta_row"))}
    sums["changed_chars"] = F.sum(F.aggregate(F.map_values("c.rule_counts"), F.lit(0).cast("long"), lambda a, x: a + x))
    sums |= {f"changed_{rule}": F.sum(F.element_at("c.rule_counts", F.lit(rule))) for rule in rules}
    return [F.coalesce(value, F.lit(0)).cast("long").alias(name) for name, value in sums.items()]


def clean_jsonl(
    spark: SparkSession, source: str, output: str | None = None, fields=None, rules=None, dry_run: bool = False, max_examples: int = EXAMPLES, add_meta: bool = False, meta_detail: str = "spans", max_meta_spans: int = 0, max_meta_changes: int = 500
) -> dict:
    """Clean a file, or folder, of JSON lines into a folder of text parts; returns the run's summary.

    The summary's issue rows and examples are the first by line number: a bounded report.
    """
    output = output or default_output(source)
    check_output(source, output, dry_run)
    rules = parse_rules(rules)
    lines = ordered_lines(spark, source)
    done = lines.select("line_no", cleaned_line(F.col("line_no"), F.col("raw"), fields, rules, add_meta, meta_detail, max_meta_spans, max_meta_changes).alias("c"))
    seen = Observation()
    watched = done.observe(seen, *counters(rules))
    if dry_run:
        watched.write.format("noop").mode("overwrite").save()
    else:
        write_lines(watched.select("c.line"), output)
    stats = {name: n for name, n in seen.get.items() if n}

    def first(rows: DataFrame, n: int) -> list:
        """The first rows by line number: as lines are in order, the first partitions are enough."""
        return rows.limit(n).collect() if stats.get("changed_rows") or stats.get("bad_json") else []

    issue_rows = [r[0] for r in first(done.where("c.changed").select("line_no"), ISSUE_ROWS)]
    examples = [json.loads(r[0]) for r in first(done.where("c.example is not null").select("c.example", "line_no"), max_examples)]
    return {
        "input": source,
        "output": "" if dry_run else output,
        "format": "jsonl",
        "dry_run": dry_run,
        "fields": list(k.parse_fields(fields)),
        "rules": list(parse_rules(rules)),
        "add_cleaning_meta": add_meta,
        "meta_detail": meta_detail,
        "max_meta_changes": max_meta_changes,
        "max_meta_spans": max_meta_spans,
        "stats": stats,
        "issue_rows": issue_rows,
        "examples": examples,
    }


def check_jsonl(
    spark: SparkSession, source: str, output_dir: str, checks: str | Iterable[str] | None = None, excerpt_chars: int = k.BATCH_EXCERPT, limit: int = 0, passed_output: str | None = None, write_passed: bool = True, failed_output: str | None = None
) -> dict:
    """Check a file of JSON lines: reports of failing lines, the passing and the failing lines, and a summary."""
    began = time.time()
    lines = ordered_lines(spark, source)
    if limit:
        lines = lines.where(F.col("line_no") <= limit)
    passed_output = (passed_output or default_passed_output(source)) if write_passed else ""
    if passed_output:
        check_output(source, passed_output)
    issues = f"{output_dir.rstrip('/')}/issues.jsonl"
    sinks = {"issues": issues, "passed": passed_output, "failed": failed_output}
    done = lines.select("line_no", "raw", checked_line(F.col("line_no"), F.col("raw"), checks, excerpt_chars).alias("c"))
    seen = Observation()
    n = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")
    done = done.observe(seen, F.count("*").alias("total"), n(F.col("c.failed")).alias("failed"), n(~F.col("c.failed")).alias("passed"), n(F.col("c.bad_json")).alias("bad_json"))
    # a line goes to one sink or to two; all are written in one job
    to = lambda sink, value, when: F.when(when, F.struct(F.lit(sink).alias("sink"), F.col(value).alias("value")))
    goes = [to("issues", "c.report", F.col("c.failed")), to("passed", "raw", ~F.col("c.failed")), to("failed", "raw", F.col("c.failed") & ~F.col("c.bad_json"))]
    rows = done.select("line_no", F.inline(F.array_compact(F.array(*[g for g, path in zip(goes, sinks.values(), strict=True) if path]))))
    whole = f"{output_dir.rstrip('/')}/_lines-{uuid.uuid4().hex}"
    rows.sortWithinPartitions("sink", "line_no").select("sink", "value").write.partitionBy("sink").text(whole)
    for sink, path in sinks.items():
        if path:
            move_folder(spark, f"{whole}/sink={sink}", path)
    move_folder(spark, whole, None)
    stats = {name: n for name, n in seen.get.items() if n}
    kinds = F.explode(F.from_json("value", "issue_types array<string>")["issue_types"])
    for r in spark.read.text(issues).select(kinds.alias("kind")).groupBy("kind").count().collect():  # a row for each kind of issue
        stats[f"issue_{r['kind']}"] = r["count"]
    seconds = time.time() - began
    return {
        "input": source,
        "output_dir": output_dir,
        "issues_path": issues,
        "passed_output": passed_output,
        "failed_records_output": failed_output or "",
        "config": {"checks": sorted(k.parse_checks(checks)), "mode": "strict_full_text", "excerpt_chars": excerpt_chars},
        "stats": stats,
        "issue_reasons": {s.removeprefix("issue_"): n for s, n in stats.items() if s.startswith("issue_")},
        "elapsed_seconds": round(seconds, 3),
        "records_per_second": round(stats.get("total", 0) / seconds, 3) if seconds else 0,
    }


def clean_and_check_jsonl(spark: SparkSession, source: str, output: str | None = None, when: str = "after", qc_dir: str | None = None, checks=None, **options) -> dict:
    """Clean, and check the input, the output or both; the summary says where the reports are."""
    if when not in ("none", "before", "after", "both"):
        raise ValueError("when must be one of: none, before, after, both")
    if when != "none" and options.get("dry_run"):
        raise ValueError("a dry run writes no output to check")
    output = output or default_output(source)
    base, runs = qc_dir or f"{output}.qc", {}

    def check(name: str, path: str) -> None:
        folder = f"{base}/{name}" if when == "both" else base
        check_jsonl(spark, path, folder, checks, write_passed=False, failed_output=f"{folder}/failed_records.jsonl")
        runs[name] = {"input": path, "output_dir": folder, "issues": f"{folder}/issues.jsonl", "failed_records": f"{folder}/failed_records.jsonl"}

    if when in ("before", "both"):
        check("before", source)
    summary = clean_jsonl(spark, source, output, **options)
    if when in ("after", "both"):
        check("after", output)
    return {**summary, "qc": runs} if when != "none" else summary


def article_line(raw: Column) -> Column:
    """A line of JSON with its content's titles and quotes cleaned; a line that is no JSON is an error."""
    from ..kernels import article

    def one(text: str) -> str:
        record = json.loads(text)
        record["content"] = article.clean(record.get("content", ""))
        return json.dumps(record, ensure_ascii=False)

    return kernel(one, "string")(raw)


def clean_articles(spark: SparkSession, source: str, output: str | None = None, pattern: str = "ars_*.jsonl") -> dict:
    """Clean a folder's article files into a folder of its own; empty lines go. The commit protocol makes the result whole or absent."""
    output = output or source.rstrip("/") + "_cleaned"
    check_output(source, output)
    lines = ordered_lines(spark, f"{source.rstrip('/')}/{pattern}").where("raw <> ''")
    write_lines(lines.select(article_line(F.col("raw")).alias("line")), output)
    return {"input": source, "output": output, "records": spark.read.text(output).count()}


def clean_stream(lines: Iterable[str], out, fields=None, rules=None, add_meta: bool = False, meta_detail: str = "spans", max_meta_spans: int = 0, max_meta_changes: int = 500) -> dict[str, int]:
    """Clean lines, such as those of standard input, one by one into a text stream, without Spark; returns the counters."""
    made = k.LineCleaner(RecordCleaner(k.parse_fields(fields), parse_rules(rules), meta_detail, max_meta_spans, max_meta_changes), add_meta)
    stats = {"total": 0, "bad_json": 0, "changed_rows": 0}
    for number, line in enumerate(lines, 1):
        done = made(number, line)
        stats["total"] += 1
        stats["bad_json"] += done["bad_json"]
        stats["changed_rows"] += done["changed"]
        out.write(done["line"] + "\n")
    return stats


def stdin_lines(stream=None):
    """Lines of a byte stream (standard input): UTF-8 with replacement, without carriage returns and outer line ends."""
    import sys

    for line in stream if stream is not None else sys.stdin.buffer:
        yield line.decode("utf-8", "replace").replace("\r", "").strip("\n")
