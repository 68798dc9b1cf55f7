"""The multi-rule text cleaner with full provenance.

A rule set is compiled once into a Cleaner. Every rule finds its spans on the ORIGINAL text
and the first to claim an offset owns it, so that removing a character never builds
a new target. Only the last two rules (white space at line ends, blank lines) look at
what the others leave. Edits are kept by offset as (rule, replacement, reason).

Defined results: the empty text has no edits; a text without any trigger is returned as it is.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

from .. import charsets as cs

# ---- Fixed values: rule names in their order, and the names in a record's provenance ----

DEFAULT_RULES = (
    "variation_selector", "styled_math_alnum", "abnormal_space", "bidi_control", "pua_known_noise", "pua_contextual", "decorative_symbol", "decorative_combining", "emoji_all",
    "control_invisible", "line_separator", "html_entity", "forbidden_strings", "repeated_noise_token", "hex_blob", "math_symbol_flood", "line_boundary_space", "blank_line_collapse",
)
OPTIONAL_RULES = ("combining_decoration", "exotic_combining")
ALL_RULES = DEFAULT_RULES + OPTIONAL_RULES
META_VERSION, META_SCHEMA, META_KEY, META_FALLBACK_KEY = "v6.0", "compact_by_rule_v1", "cleaning_v6", "_cleaning_v6"
DEFAULT_MAX_CHANGES = 500
PREVIEW = 120

#: What rules on single characters claim, in order of precedence: the first class that holds a character has it.
SINGLE = (
    ("variation_selector", cs.VARIATION_SELECTORS),
    ("bidi_control", cs.BIDI_CONTROL),
    ("decorative_combining", cs.DECORATIVE_COMBINING),
    ("pua_known_noise", cs.PUA_NOISE),
    (None, cs.FORM_SYMBOLS),
    ("decorative_symbol", cs.DECORATIVE_SYMBOLS),
    ("emoji_all", cs.EMOJI_SYMBOLS + cs.EMOJI_ATTACHMENTS),
    ("control_invisible", cs.CONTROL_INVISIBLE),
    ("line_separator", cs.chars("".join(cs.LINE_SEPARATORS))),
    ("styled_math_alnum", cs.STYLED_MATH),
    ("exotic_combining", cs.EXOTIC_COMBINING),
    ("abnormal_space", cs.SPACES_TO_BLANK + cs.SPACES_TO_DROP),
)
#: Who inherits a class when its own rule is off.
HEIRS = (("decorative_symbol", "emoji_all", cs.EMOJI_SYMBOLS), ("bidi_control", "control_invisible", cs.CONTROL_INVISIBLE))


def parse_rules(value: str | Iterable[str] | None) -> tuple[str, ...]:
    """Rule names from a comma list or a sequence; nothing means the defaults, ``all`` the defaults and any optional rules named."""
    names = split_names(value)
    if unknown := {n for n in names if n.lower() != "all"} - set(ALL_RULES):
        raise ValueError(f"unknown cleaning rule(s): {','.join(sorted(unknown))}; valid: {','.join(sorted(ALL_RULES))}")
    if not names:
        return DEFAULT_RULES
    if any(n.lower() == "all" for n in names):
        return DEFAULT_RULES + tuple(dict.fromkeys(n for n in names if n in OPTIONAL_RULES))
    return names


def split_names(value: str | Iterable[str] | None) -> tuple[str, ...]:
    if value is None:
        return ()
    if not isinstance(value, (str, list, tuple, set, frozenset)):
        raise TypeError("expected a comma-separated string or a list of names")
    parts = value.split(",") if isinstance(value, str) else map(str, value)
    return tuple(p for p in (x.strip() for x in parts) if p)


def replacement_of(rule: str, char: str) -> str:
    """What a rule on single characters puts in the place of one."""
    if rule == "line_separator":
        return cs.LINE_SEPARATORS[char]
    if rule == "abnormal_space":
        return " " if ord(char) in cs.points(cs.SPACES_TO_BLANK) else ""
    if rule == "styled_math_alnum":
        plain = unicodedata.normalize("NFKC", char)
        return "" if plain == char else plain
    return ""


def single_owners(rules: Iterable[str]) -> dict[str, str]:
    """The rule that edits each single character under a rule set."""
    on, owner = set(rules), {}
    for rule, cls in SINGLE:
        for p in cs.points(cls):
            owner.setdefault(p, rule)
    for rule, heir, cls in HEIRS:
        if rule not in on:
            for p in cs.points(cls):
                if owner.get(p) == rule:
                    owner[p] = heir
    return {chr(p): r for p, r in owner.items() if r in on}


Edit = tuple[str, str, str]
Spans = Iterator[tuple[int, int, str, str]]  # start, end, replacement of the first character, reason


class Contextual:
    """Private-use characters that are repaired where their surroundings tell what they were."""

    _FORWARD = 12

    def __init__(self):
        space, digit = cs.python_class(cs.PY_SPACE), cs.python_class(cs.UCD.digits)
        word = cs.python_class(cs.UCD.word, cs.chars("_“”\"'"))
        self.any = re.compile("[\ue010\ue011\ue10b\ue11a-\ue11c\ue1bd\ue618\uf04a\uf07e\uf0b7\uf8ff]")
        self.line_start = re.compile(f"(?<![^{cs.LINE_ENDS}])[{cs.INDENT}]*")
        self.goes_on = re.compile(f"[{cs.INDENT}]*[^{cs.INDENT}\r\n]")
        letter = re.compile("[A-Za-z]")
        #: character: (window and pattern on the left, on the right, replacement, reason)
        self.between = {
            "\uf07e": (12, re.compile(f"(?:{digit}|[%‰℃°]){space}*\\Z"), 12, re.compile(f"{space}*{digit}"), "~", "pua_f07e_numeric_range"),
            "\ue010": (1, re.compile(r"[0-9A-Za-z)\]）】》”’]"), 4, re.compile(f"{space}*{word}"), "．", "pua_e010_dot"),
            "\ue011": (1, letter, 1, letter, "-", "pua_e011_name_hyphen"),
            "\ue10b": (1, letter, 1, letter, "'", "pua_e10b_apostrophe"),
            "\ue1bd": (0, re.compile(""), 1, re.compile("束"), "约", "pua_e1bd_yue"),
        }
        self.dropped = dict.fromkeys("\ue11a\ue11b\ue11c", "pua_ebook_footnote_marker") | dict.fromkeys("\uf8ff\uf04a", "pua_known_noise")

    def __call__(self, text: str) -> Spans:
        starts = None
        for m in self.any.finditer(text):
            at, char = m.start(), m.group()
            if char in self.dropped:
                yield at, at + 1, "", self.dropped[char]
            elif char in self.between:
                back, left, ahead, right, put, reason = self.between[char]
                if left.search(text[max(0, at - back) : at]) and right.match(text[at + 1 : at + 1 + ahead]):
                    yield at, at + 1, put, reason
            else:  # a bullet
                if starts is None:
                    starts = {x.end() for x in self.line_start.finditer(text)}
                bullet = "-" if text[at + 1 : at + 2].isspace() else "- "
                if char == "\ue618":
                    yield at, at + 1, bullet if at in starts else "\n" + bullet, "pua_e618_bullet"
                elif at in starts and self.goes_on.match(text, at + 1):
                    yield at, at + 1, bullet, "pua_f0b7_list_bullet"


class NoiseTokens:
    """One suspicious token (letters, digits and a run of one character in it), five times or more in a row outside code fences."""

    def __init__(self):
        gap = cs.python_class(cs.PY_SPACE, cs.chars(cs.NOISE_SEPARATORS))
        self.run = re.compile(f"({cs.NOISE_TOKEN})(?:{gap}+\\1(?![A-Za-z0-9])){{{cs.NOISE_REPEATS - 1},}}[ \t]*")
        self.suspicious = re.compile(r"(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]*?([A-Za-z0-9])\1{3}")
        self.token = re.compile(r"[A-Za-z0-9]+")

    def __call__(self, text: str) -> Spans:
        for m in self.run.finditer(text):
            start, end = m.span()
            if not self.suspicious.match(m.group(1)) or text.count("```", 0, start) % 2:
                continue
            glued = start > 0 and end < len(text) and not text[start - 1].isspace() and not text[end].isspace()
            repeats = sum(1 for t in self.token.finditer(m.group()))
            yield start, end, " " if glued else "", f"repeat_count={repeats}"


class HexBlobs:
    """Dumps of hexadecimal digits, in one run or wrapped over lines."""

    _LINE = re.compile(r"\r?\n")
    _BLANK = re.compile(r"[ \t\r\n]+")

    def __init__(self):
        self.run, self.wrapped = re.compile(cs.HEX_RUN), re.compile(cs.HEX_WRAPPED)

    def __call__(self, text: str) -> Spans:
        for m in self.run.finditer(text):
            yield *m.span(), "", "long_hex_blob"
        for m in self.wrapped.finditer(text):
            per_line = [len(self._BLANK.sub("", x)) for x in self._LINE.split(m.group())]
            digits = sum(per_line)
            if digits >= 64 and digits >= 0.95 * len(m.group()) and max(per_line) >= 64:
                yield *m.span(), "", "long_hex_blob"


class Pattern:
    """Spans of a pattern, deleted."""

    def __init__(self, pattern: str, reason: str = "matched"):
        self.pattern, self.reason = re.compile(pattern), reason

    def __call__(self, text: str) -> Spans:
        for m in self.pattern.finditer(text):
            yield *m.span(), "", self.reason


class Floods:
    """Four or more of one symbol in a row. Only symbols that a text holds so often are searched: the class of all has hundreds of ranges."""

    def __init__(self):
        self.symbols = cs.union(cs.UCD.symbols, cs.FLOOD_EXTRA)
        self.told: dict[str, bool] = {}

    def _is_symbol(self, char: str) -> bool:
        told = self.told.get(char)
        if told is None:
            i = bisect_right(self.symbols, (ord(char), 0x110000)) - 1
            told = self.told[char] = i >= 0 and ord(char) <= self.symbols[i][1]
        return told

    def __call__(self, text: str) -> Spans:
        for char in set(text):
            if self._is_symbol(char) and char * cs.FLOOD_CLEAN in text:
                for m in re.finditer(f"{re.escape(char)}{{{cs.FLOOD_CLEAN},}}", text):
                    yield *m.span(), "", "matched"


def forbidden_pattern() -> str:
    # no literal begins another or overlaps one, so one alternation finds what separate searches would
    return "|".join([*map(re.escape, cs.FORBIDDEN_STRINGS), cs.LITERAL_ESCAPE])


def _marks() -> cs.Ranges:
    return cs.minus(cs.UCD.marks, cs.VARIATION_SELECTORS)


#: The rules that look at the original text after the single characters, in their order.
SPAN_RULES: tuple[tuple[str, Callable[[], Callable[[str], Spans]]], ...] = (
    ("pua_contextual", Contextual),
    ("combining_decoration", lambda: Pattern(rf"\A{cs.python_class(_marks())}+|(?<={cs.python_class(_marks(), negated=True)}){cs.python_class(_marks())}{{2,}}")),
    ("forbidden_strings", lambda: Pattern(forbidden_pattern())),
    ("repeated_noise_token", NoiseTokens),
    ("hex_blob", HexBlobs),
    ("html_entity", lambda: Pattern(cs.HTML_ENTITY)),
    ("math_symbol_flood", Floods),
)
#: The rules that look at what is left: (rule, reason, pattern of what goes).
LEFT_RULES = (
    ("line_boundary_space", "line_boundary", r"[ \t]+(?=\n|\Z)"),
    ("blank_line_collapse", "collapse_extra_lf", r"(?<=\n\n)\n+"),
)


class Rendered:
    """The text under some edits, and where each of its characters comes from."""

    def __init__(self, text: str, edits: dict[int, Edit]):
        self.keys, self.at, parts, size, last = sorted(edits), [], [], 0, 0
        for k in self.keys:
            put = edits[k][1]
            parts += [text[last:k], put]
            size += k - last
            self.at.append(size)
            size += len(put)
            last = k + 1
        parts.append(text[last:])
        self.text, self._edits = "".join(parts), edits

    def origin(self, pos: int) -> tuple[int, int]:
        """Offset in the original text, and the position inside what stands for that offset."""
        i = bisect_right(self.at, pos) - 1
        if i < 0:
            return pos, 0
        inside = pos - self.at[i]
        size = len(self._edits[self.keys[i]][1])
        return (self.keys[i], inside) if inside < size else (self.keys[i] + 1 + inside - size, 0)


class Cleaner:
    """A compiled rule set."""

    def __init__(self, rules: Iterable[str] = DEFAULT_RULES):
        self.rules = tuple(rules)
        on = set(self.rules)
        owners = single_owners(on)
        self.singles = {c: (r, replacement_of(r, c), "matched") for c, r in owners.items()}
        self.single = re.compile(cs.python_class(cs.ranges(map(ord, owners)))) if owners else None
        selectors, bases = cs.python_class(cs.VARIATION_SELECTORS), cs.python_class(cs.EMOJI_BASES)
        emoji = "emoji_all" in on
        self.selected = re.compile(f"{bases}(?={selectors})") if emoji else None
        self.keycap = re.compile(f"({cs.python_class(cs.KEYCAP_BASES)})?({cs.python_class(cs.TEXT_OR_EMOJI_SELECTORS)})?{cs.python_class(cs.KEYCAPS)}") if emoji else None
        self.spans = [(r, make()) for r, make in SPAN_RULES if r in on]
        self.left = [(r, why, re.compile(p)) for r, why, p in LEFT_RULES if r in on]

    def _claimed(self, text: str) -> dict[int, Edit]:
        edits: dict[int, Edit] = {}
        if self.single is not None and not text.isascii():
            for m in self.single.finditer(text):
                edits[m.start()] = self.singles[m.group()]
        if self.selected is not None and not text.isascii():
            for m in self.selected.finditer(text):
                edits.setdefault(m.end(), ("emoji_all", "", "emoji_variation_selector"))
                edits.setdefault(m.start(), ("emoji_all", "", "emoji_variation_base"))
            for m in self.keycap.finditer(text):
                if m.group(2):
                    edits.setdefault(m.start(2), ("emoji_all", "", "keycap_variation_selector"))
                if m.group(1):
                    edits.setdefault(m.start(1), ("emoji_all", "", "keycap_base"))
        for rule, find in self.spans:
            for start, end, put, reason in find(text):
                for k in range(start, end):
                    edits.setdefault(k, (rule, put if k == start else "", reason))
        return edits

    def edits(self, text: str) -> dict[int, Edit]:
        """What happens at each offset that changes."""
        edits = self._claimed(text)
        for rule, reason, pattern in self.left:
            shown = Rendered(text, edits)
            gone: dict[int, set[int]] = {}
            for m in pattern.finditer(shown.text):
                for pos in range(*m.span()):
                    k, inside = shown.origin(pos)
                    gone.setdefault(k, set()).add(inside)
            for k, positions in gone.items():
                if k in edits:  # an earlier rule put it there and stays the owner
                    owner, put, why = edits[k]
                    edits[k] = (owner, "".join(c for i, c in enumerate(put) if i not in positions), why if reason in why else f"{why}+{reason}")
                else:
                    edits[k] = (rule, "", reason)
        return edits

    def __call__(self, text: str) -> tuple[str, dict[int, Edit]]:
        """The cleaned text and its edits."""
        edits = self.edits(text)
        return (Rendered(text, edits).text if edits else text), edits


def char_facts(char: str) -> dict[str, str]:
    return {
        "char": char,
        "unicode_escape": char.encode("unicode_escape").decode("ascii"),
        "codepoint": f"U+{ord(char):04X}",
        "name": unicodedata.name(char, "<unnamed>"),
        "category": unicodedata.category(char),
    }


def changes(text: str, edits: dict[int, Edit]) -> list[dict]:
    """One entry for each changed character, in order."""
    return [{**char_facts(text[k]), "rule": edits[k][0], "replacement": repr(edits[k][1]), "offset": k, "reason": edits[k][2]} for k in sorted(edits)]


def clean_text(text: str, rules: Iterable[str] = DEFAULT_RULES) -> tuple[str, list[dict]]:
    """The cleaned text and its changes, under freely chosen rules."""
    cleaned, edits = Cleaner(rules)(text)
    return cleaned, changes(text, edits)


# ---- Provenance ----


def preview(text: str) -> str:
    return text if len(text) <= PREVIEW else f"{text[: PREVIEW // 2]}...{text[-(PREVIEW // 2) :]}"


def spans(field: str, text: str, edits: dict[int, Edit]) -> list[dict]:
    """Unbroken stretches of one rule's edits, by rule and offset; each names its rule."""
    order = sorted(edits, key=lambda k: (edits[k][0], k))
    out = []
    for (rule, _), run in groupby(enumerate(order), key=lambda x: (edits[x[1]][0], x[1] - x[0])):
        at = [k for _, k in run]
        put = "".join(edits[k][1] for k in at)
        out.append(
            {
                "rule": rule,
                "field": field,
                "start": at[0],
                "end": at[-1] + 1,
                "count": len(at),
                "action": "replace" if put else "delete",
                "original_preview": preview(text[at[0] : at[-1] + 1]),
                "replacement_preview": preview(put),
                "codepoint_counts": dict(Counter(f"U+{ord(text[k]):04X}" for k in at)),
                "reasons": sorted({edits[k][2] for k in at}),
            }
        )
    return out


def by_rule(found: Sequence[dict], max_spans: int = 0) -> dict[str, dict]:
    """Spans under their rules, with counts over all and at most max_spans kept of each (0: all)."""
    out: dict[str, dict] = {}
    for rule, run in groupby(sorted(found, key=lambda s: (s["rule"], s["field"], s["start"])), key=lambda s: s["rule"]):
        mine = list(run)
        fields: Counter = Counter()
        for s in mine:
            fields[s["field"]] += s["count"]
        kept = [{k: v for k, v in s.items() if k != "rule"} for s in (mine[:max_spans] if max_spans else mine)]
        out[rule] = {"count": sum(fields.values()), "field_counts": dict(fields), "span_count": len(mine), "spans_truncated": len(kept) < len(mine), "spans": kept}
    return out


class RecordCleaner:
    """Cleans named string fields of a record and says what it did."""

    def __init__(self, fields: Sequence[str], rules: Sequence[str], detail: str = "spans", max_spans: int = 0, max_changes: int = DEFAULT_MAX_CHANGES):
        if detail not in ("spans", "chars", "both"):
            raise ValueError("meta_detail must be one of: spans, chars, both")
        self.fields, self.cleaner, self.detail, self.max_spans = tuple(fields), Cleaner(rules), detail, max_spans
        self.max_changes = DEFAULT_MAX_CHANGES if max_changes < 0 else max_changes

    def __call__(self, record: dict, line_no: int) -> tuple[dict[str, str], list[tuple[str, str, dict[int, Edit]]], dict]:
        """New values by field; (field, text, edits) of each changed field; the provenance."""
        new, touched = {}, []
        for field in self.fields:
            text = record.get(field)
            if isinstance(text, str):
                cleaned, edits = self.cleaner(text)
                if edits:
                    new[field] = cleaned
                    touched.append((field, text, edits))
        by_rule_count = Counter(edits[k][0] for _, _, edits in touched for k in sorted(edits))
        by_field = {field: len(edits) for field, _, edits in touched}
        meta = {
            "version": META_VERSION,
            "schema": META_SCHEMA,
            "line_no": line_no,
            "changed": bool(touched),
            "fields": list(self.fields),
            "rules": list(self.cleaner.rules),
            "changed_fields": sorted(by_field),
            "change_count": sum(by_field.values()),
            "rule_counts": dict(by_rule_count),
            "field_counts": by_field,
        }
        if self.detail in ("spans", "both"):
            meta["by_rule"] = by_rule([s for x in touched for s in spans(*x)], self.max_spans)
        if self.detail in ("chars", "both"):
            every = self.listed(touched)
            meta["changes_truncated"] = 0 < self.max_changes < len(every)
            meta["changes"] = every[: self.max_changes] if self.max_changes else every
        return new, touched, meta

    @staticmethod
    def listed(touched: list[tuple[str, str, dict[int, Edit]]]) -> list[dict]:
        return [{"field": field, **c} for field, text, edits in touched for c in changes(text, edits)]


def attach(record: dict, meta: dict) -> None:
    """Put the provenance under the record's meta object, or beside a meta that is none."""
    if record.get("meta") is None:
        record["meta"] = {META_KEY: meta}
    elif isinstance(record["meta"], dict):
        record["meta"][META_KEY] = meta
    else:
        record[META_FALLBACK_KEY] = meta
