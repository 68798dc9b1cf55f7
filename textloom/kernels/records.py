"""Whole records: cleaning with provenance, quality reports, and both on lines of JSON."""

from __future__ import annotations

import copy
import json
import re
from collections import Counter
from collections.abc import Iterable, Sequence

from . import cleaner, mojibake, repetition, subdup
from .cleaner import RecordCleaner, attach, char_facts, parse_rules, split_names

# ---- Fixed values: field names, checks and sizes ----

DEFAULT_FIELDS = ("content",)
TEXT_FIELDS = ("content", "text", "tgt")
CHECKS = ("mojibake", "repetition", "dedup")
CONTEXT, EXCERPT, BATCH_EXCERPT, MAX_CHARS, MAX_PASSAGES, SAMPLE = 120, 120, 500, 50, 20, 2000
ERROR_CHARS, CHECK_ERROR_CHARS, EXAMPLE_CHANGES = 200, 500, 20


def parse_fields(value: str | Iterable[str] | None) -> tuple[str, ...]:
    return split_names(value) or DEFAULT_FIELDS


def parse_checks(value: str | Iterable[str] | None) -> tuple[str, ...]:
    """Check names, in any case; nothing, or ``all``, means all."""
    names = tuple(n.lower() for n in split_names(value))
    if not names or "all" in names:
        return CHECKS
    if unknown := set(names) - set(CHECKS):
        raise ValueError(f"unknown check(s): {','.join(sorted(unknown))}")
    return names


def text_of(record: dict) -> tuple[str, str]:
    """The first text field that holds a string, and its name."""
    return next(((record[f], f) for f in TEXT_FIELDS if isinstance(record.get(f), str)), ("", TEXT_FIELDS[0]))


def language(record: dict, text: str) -> str:
    """en or cn: what the record says, else by the share of Han characters at the text's start."""
    meta = record.get("meta")
    told = str((meta.get("lang") if isinstance(meta, dict) else None) or record.get("lang") or "").lower()
    if told.startswith("en"):
        return "en"
    if told.startswith(("zh", "cn", "ch")):
        return "cn"
    start = text[:SAMPLE]
    return "cn" if sum("\u4e00" <= c <= "\u9fff" for c in start) / max(len(start), 1) > 0.1 else "en"


def excerpt(text: str, start: int, end: int, around: int = CONTEXT) -> dict:
    """A span of a text, clamped to it, with what stands around."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    a, b = max(start - around, 0), min(end + around, len(text))
    return {"offset": [start, end], "text": text[start:end], "context_offset": [a, b], "context": text[a:b]}


def issue_type(issue: str) -> str:
    return issue.partition(":")[0]


class Checker:
    """Compiled checks over one text."""

    def __init__(self, checks: Sequence[str] = CHECKS, highlights: bool = True):
        self.checks, self.highlights = tuple(checks), highlights
        self.detector = mojibake.Detector() if "mojibake" in checks else None

    def __call__(self, text: str, lang: str) -> tuple[list[str], list[dict]]:
        """Issue lines and highlights; none of the latter if they are not asked for."""
        issues, shown = [], []
        for check, find in (("mojibake", self._mojibake), ("repetition", self._repetition), ("dedup", self._dedup)):
            if check in self.checks:
                lines, found = find(text, lang)
                issues += lines
                shown += found
        return issues, shown

    def _mojibake(self, text: str, lang: str) -> tuple[list[str], list[dict]]:
        total: Counter = Counter()
        shown = []
        lines: list[list[int]] = []
        for start, end, places in self.detector.lines(text):
            mine = Counter({r: len(at) for r, at in places.items()})
            total.update(mine)
            lines.append([start, end])
            if not self.highlights:
                continue
            told: dict[int, str] = {}  # the first rule that hits a character tells it
            for rule, at in places.items():
                for k in at:
                    if len(told) < MAX_CHARS:
                        told.setdefault(k, rule)
            facts = [{"index": i, "repr": repr(text[i]), **char_facts(text[i]), "rule": r} for i, r in told.items()]
            why = "mojibake rules: " + ",".join(f"{r}={n}" for r, n in mine.most_common())
            shown.append({**excerpt(text, start, end), "rule": "mojibake", "reason": why, "detail": {"rules": dict(mine), "chars": facts}})
        if not lines:
            return [], []
        top = ",".join(f"{r}={n}" for r, n in total.most_common(4))
        return [f"mojibake:hit_chars={total.total()} rules={top} offsets={lines[:3]}"], shown

    @staticmethod
    def _repetition(text: str, lang: str) -> tuple[list[str], list[dict]]:
        issues, shown = [], []
        for check in repetition.CHECKS:
            if not (found := check(text)):
                continue
            issue = repetition.reason(found)
            # what an issue line quotes ends at its first quotation mark
            quoted = re.search(r"top='([^']+?)\.\.\.'|token='([^']+)'", issue)
            wanted = (quoted[1] or quoted[2]).strip() if quoted else ""
            at = text.find(wanted) if wanted else -1
            where = excerpt(text, at, at + len(wanted)) if at >= 0 else {"offset": None, "text": "", "context_offset": None, "context": ""}
            issues.append(issue)
            shown.append({**where, "rule": issue_type(issue), "reason": issue, "detail": {}})
        return issues, shown

    def _dedup(self, text: str, lang: str) -> tuple[list[str], list[dict]]:
        found = subdup.detect(text, lang)
        if not found:
            return [], []
        shown = []
        for f in found[:MAX_PASSAGES] if self.highlights else ():
            unit = text[slice(*f["info"]["repeat_text_offset"])]
            why = f"continuous duplicate lang={lang} repeat_num={f['score']} repeat_text={unit!r}"
            shown.append({**excerpt(text, *f["offset"]), "rule": subdup.MODEL, "reason": why, "detail": f})
        first = json.dumps(found[0], ensure_ascii=False, separators=(",", ":"))
        return [f"{subdup.MODEL}:count={len(found)} lang={lang} first={first}"], shown


def report(record: dict, checker: Checker, line_no: int, excerpt_chars: int, tolerant: bool = False) -> dict:
    """The quality report of a record. tolerant: an error in a check is an issue."""
    text, field = text_of(record)
    lang = language(record, text)
    try:
        issues, shown = checker(text, lang)
    except Exception as error:
        if not tolerant:
            raise
        issues, shown = [f"check_error:{str(error)[:CHECK_ERROR_CHARS]}"], []
    meta = record.get("meta")
    out = {
        "line_no": line_no,
        "failed": bool(issues),
        "issues": issues,
        "issue_types": [issue_type(x) for x in issues],
        "highlights": shown,
        "text_field": field,
        "content_len": len(text),
        "lang": lang,
        "meta": meta if isinstance(meta, dict) else {},
    }
    if excerpt_chars > 0 and issues:
        out["content_excerpt"] = text[:excerpt_chars]
    return out


def _object(record) -> dict:
    if not isinstance(record, dict):
        raise TypeError("record must be a JSON object")
    return record


def clean_record(record: dict, fields=None, rules=None, add_meta: bool = True, meta_detail: str = "spans", max_meta_spans: int = 0, max_meta_changes: int = 500, line_no: int = 1) -> dict:
    """{record, cleaning}: the cleaned copy of a record and the provenance, which is attached to it unless add_meta is off."""
    made = RecordCleaner(parse_fields(fields), parse_rules(rules), meta_detail, int(max_meta_spans), int(max_meta_changes))
    out = copy.deepcopy(_object(record))
    new, _, meta = made(out, int(line_no))
    out.update(new)
    if add_meta:
        attach(out, meta)
    return {"record": out, "cleaning": meta}


def check_record(record: dict, checks=None, excerpt_chars: int = EXCERPT, line_no: int = 1) -> dict:
    """The quality report of a record, under the checks named."""
    chosen = parse_checks(checks)
    out = report(_object(record), Checker(chosen), int(line_no), max(0, int(excerpt_chars)))
    return {**out, "checks": sorted(set(chosen))}


def clean_and_check(record: dict, fields=None, rules=None, checks=None, add_meta: bool = True, meta_detail: str = "spans", max_meta_spans: int = 0, max_meta_changes: int = 500, excerpt_chars: int = EXCERPT, line_no: int = 1) -> dict:
    """{record, cleaning, quality}: the report is on the cleaned record."""
    out = clean_record(record, fields, rules, add_meta, meta_detail, max_meta_spans, max_meta_changes, line_no)
    return {**out, "quality": check_record(out["record"], checks, excerpt_chars, line_no)}


def catalog() -> dict:
    """The rules, checks and defaults there are."""
    return {
        "default_cleaning_rules": list(cleaner.DEFAULT_RULES),
        "optional_legacy_rules": list(cleaner.OPTIONAL_RULES),
        "qc_checks": list(CHECKS),
        "defaults": {"fields": list(DEFAULT_FIELDS), "add_meta": True, "meta_detail": "spans"},
    }


# ---- lines of JSON ----


class LineCleaner:
    """Cleans a line of JSON; what is no JSON passes unchanged, and so does what is no object."""

    def __init__(self, records: RecordCleaner, add_meta: bool = False):
        self.records, self.add_meta = records, add_meta

    def __call__(self, line_no: int, line: str) -> dict:
        """line, bad_json, changed, changed_fields, rule_counts, meta_row and example (JSON, or None)."""
        out = {"line": line, "bad_json": False, "changed": False, "changed_fields": 0, "rule_counts": {}, "meta_row": False, "example": None}
        try:
            record = json.loads(line)
        except Exception as error:
            return {**out, "bad_json": True, "example": json.dumps({"line_no": line_no, "error": f"bad_json:{str(error)[:ERROR_CHARS]}"}, ensure_ascii=False)}
        if isinstance(record, dict):
            new, touched, meta = self.records(record, line_no)
            record.update(new)
            if touched:
                some = self.records.listed(touched)[:EXAMPLE_CHANGES]
                out |= {"changed": True, "changed_fields": len(touched), "rule_counts": meta["rule_counts"]}
                out["example"] = json.dumps({"line_no": line_no, "change_count": meta["change_count"], "changes": some}, ensure_ascii=False)
            if self.add_meta:
                attach(record, meta)
                out["meta_row"] = True
        out["line"] = json.dumps(record, ensure_ascii=False)
        return out


class LineChecker:
    """Reports on a line of JSON."""

    def __init__(self, checks: Sequence[str] = CHECKS, excerpt_chars: int = BATCH_EXCERPT):
        self.checker, self.excerpt_chars = Checker(checks), excerpt_chars

    def __call__(self, line_no: int, line: str) -> dict:
        try:
            record = json.loads(line)
        except Exception as error:
            return {"line_no": line_no, "failed": True, "bad_json": True, "issues": [f"bad_json:{str(error)[:ERROR_CHARS]}"]}
        try:
            return report(_object(record), self.checker, line_no, self.excerpt_chars, tolerant=True)
        except Exception as error:
            return {"line_no": line_no, "failed": True, "issues": [f"worker_error:{str(error)[:CHECK_ERROR_CHARS]}"], "issue_types": ["worker_error"]}
