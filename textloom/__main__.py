"""python -m textloom clean | check | articles | serve"""

from __future__ import annotations

import argparse
import json
import sys
from contextlib import nullcontext

from .kernels import records
from .kernels.cleaner import parse_rules
from .progress import Progress
from .sources import jsonl, paths, xlsx

_PATH, _FLAG = {"default": None}, {"action": "store_true"}


def _choice(*values: str, default: str | None = None) -> dict:
    return {"choices": values, "default": default}


def _number(default: int | None) -> dict:
    return {"type": int, "default": default}


#: Options by command: the parameter that takes one where it is not the option's own name, and how to read it.
OPTIONS: dict[str, dict[str, dict]] = {
    "clean": {
        "input": {"required": True, "help": "a file or folder; - reads lines from standard input and writes to standard output"},
        "output": _PATH | {"help": "default: <input>.cleaned.<ext>"},
        "format": _choice("jsonl", "xlsx"),
        "summary": _PATH | {"help": "where to write the summary as JSON"},
        "sheet": _PATH,
        "rules": {"default": None, "type": parse_rules, "help": "comma-separated; default: the default rules"},
        "fields": {"default": "content", "type": records.parse_fields},
        "dry-run": _FLAG,
        "max-examples": _number(jsonl.EXAMPLES),
        "add-cleaning-meta": _FLAG | {"dest": "add_meta"},
        "meta-detail": _choice("spans", "chars", "both", default="spans"),
        "max-meta-changes": _number(500),
        "max-meta-spans": _number(0),
        "qc": _choice("none", "before", "after", "both", default="none"),
        "qc-checks": {"default": None, "type": records.parse_checks},
        "qc-output-dir": _PATH,
        "progress": {"type": float, "default": 0, "help": "tell progress every so many seconds"},
    },
    "check": {
        "input": {"required": True},
        "output-dir": {"required": True},
        "checks": {"default": None, "type": records.parse_checks},
        "excerpt-chars": _number(records.BATCH_EXCERPT),
        "limit": _number(0) | {"help": "only the first N lines"},
        "passed-output": _PATH,
        "failed-records-output": _PATH | {"dest": "failed_output"},
        "no-passed-output": {"action": "store_false", "dest": "write_passed"},
        "progress": {"type": float, "default": 0},
    },
    "articles": {"src": {"required": True}, "dst": _PATH, "pattern": {"default": "ars_*.jsonl"}, "progress": {"type": float, "default": 0}},
    "serve": {"host": {"default": "127.0.0.1"}, "port": _number(8000), "max-body-bytes": _number(None)},
}
_CLEANING = ("fields", "rules", "dry_run", "max_examples")
_META = ("add_meta", "meta_detail", "max_meta_spans", "max_meta_changes")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom", description="Clean and check text corpora with Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    for command, options in OPTIONS.items():
        sub = commands.add_parser(command)
        for name, how in options.items():
            sub.add_argument(f"--{name}", **how)
    return top


def _some(args: argparse.Namespace, names: tuple[str, ...]) -> dict:
    return {n: getattr(args, n) for n in names}


def run(args: argparse.Namespace, spark=None) -> dict | None:
    if args.command == "serve":
        from .serve import MAX_BODY, server

        server(args.host, args.port, args.max_body_bytes or MAX_BODY).serve_forever()
        return None
    if args.command == "clean" and args.input == "-":
        stats = jsonl.clean_stream(jsonl.stdin_lines(), sys.stdout, args.fields, args.rules, **_some(args, _META))
        paths.write_summary({"input": "-", "stats": stats}, args.summary)
        return None
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("textloom").getOrCreate()
    with Progress(spark, args.progress) if args.progress > 0 else nullcontext():
        return _run(args, spark)


def _run(args: argparse.Namespace, spark) -> dict:
    if args.command == "articles":
        return jsonl.clean_articles(spark, args.src, args.dst, args.pattern)
    if args.command == "check":
        summary = jsonl.check_jsonl(spark, args.input, args.output_dir, **_some(args, ("checks", "excerpt_chars", "limit", "passed_output", "write_passed", "failed_output")))
        paths.write_summary(summary, f"{args.output_dir}/summary.json")
        return summary
    if paths.infer_format(args.input, args.format) == "xlsx":
        if args.qc != "none":
            raise ValueError("--qc is for JSON lines only")
        summary = xlsx.clean_xlsx(spark, args.input, args.output, sheet=args.sheet, **_some(args, _CLEANING))
    else:
        summary = jsonl.clean_and_check_jsonl(spark, args.input, args.output, args.qc, args.qc_output_dir, args.qc_checks, **_some(args, _CLEANING + _META))
    paths.write_summary(summary, args.summary)
    return summary


def main(argv: list[str] | None = None) -> None:
    summary = run(parser().parse_args(argv))
    if summary is not None:
        print(json.dumps(summary, ensure_ascii=False, indent=2), flush=True)


if __name__ == "__main__":
    main()
