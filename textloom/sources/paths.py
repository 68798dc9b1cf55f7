"""Formats and paths, decided before a plan is built."""

from __future__ import annotations

import json
import os


def infer_format(path: str, explicit: str | None = None) -> str:
    """explicit, else by the path's extension in any case."""
    kind = explicit or os.path.splitext(path)[1].lower().lstrip(".")
    if kind not in ("jsonl", "xlsx"):
        raise ValueError(f"cannot infer format from path: {path}")
    return kind


def default_output(path: str) -> str:
    """<base>.cleaned<ext>"""
    base, ext = os.path.splitext(path)
    return f"{base}.cleaned{ext}"


def default_passed_output(path: str) -> str:
    """<base>_filtered<ext>, by default of the kind jsonl."""
    base, ext = os.path.splitext(os.path.abspath(path))
    return f"{base}_filtered{ext or '.jsonl'}"


def check_output(source: str, output: str | None, dry_run: bool = False) -> None:
    """An output must not be the input."""
    if output and not dry_run and os.path.abspath(source) == os.path.abspath(output):
        raise ValueError("the output must be different from the input")


def write_summary(summary: dict, path: str | None) -> None:
    """Pretty JSON with a line end; folders are made."""
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as out:
            out.write(json.dumps(summary, ensure_ascii=False, indent=2) + "\n")


def move_folder(spark, source: str, target: str | None) -> None:
    """Put a folder in another's place; one that isn't there leaves an empty folder, and no target only deletes it."""
    conf, make = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = make(source)
    system = old.getFileSystem(conf)
    if target is None:
        system.delete(old, True)
        return
    new = make(target)
    system.delete(new, True)
    system.mkdirs(new.getParent())
    if not (system.exists(old) and system.rename(old, new)):
        system.mkdirs(new)
