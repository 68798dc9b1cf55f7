"""The queries in SQL (DuckDB's), where SQL can say them.

Its regular expressions know no look-around and no back-references, so what needs them is said
with groups, lists or windows here.
"""

from __future__ import annotations

import unicodedata

from .. import charsets as cs
from ..functions.cleaning import owned
from ..kernels import textops
from ..kernels.cleaner import PREVIEW
from ..kernels.mojibake import RULES, THRESHOLDS, classes
from .noise import literal, noisy_sql
from .queries import ALL_NOISE, MADE_UNITS, MOJIBAKE_NOISE, NOISY_RULES

SPACE, DIGITS = r"[\s\x{0B}]", "[0-9]"


def removed(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {literal(pattern)}, '', 'g')"


def swapped(text: str, pattern: str, put: str) -> str:
    return f"regexp_replace({text}, {literal(pattern)}, {literal(put)}, 'g')"


def digest(table: str, key: str, before: str, after: str) -> str:
    """after speaks of ``b``."""
    return f"SELECT {key}, length(b)::BIGINT AS n_before, length(a)::BIGINT AS n_after, md5(a) AS cleaned_md5 FROM (SELECT {key}, b, {after} AS a FROM (SELECT {key}, {before} AS b FROM {table}))"


def _styled() -> str:
    styled = [chr(p) for a, b in cs.STYLED_MATH for p in range(a, b + 1)]
    plain = [unicodedata.normalize("NFKC", c) for c in styled]
    keep = [(s, p) for s, p in zip(styled, plain) if s != p]
    gone = cs.java_class(cs.ranges(ord(s) for s, p in zip(styled, plain) if s == p))
    return removed(f"translate(b, {literal(''.join(s for s, _ in keep))}, {literal(''.join(p for _, p in keep))})", gone)


_MARKS = cs.java_class(cs.minus(cs.UCD.marks, cs.VARIATION_SELECTORS))
_NOT_MARKS = cs.java_class(cs.minus(cs.UCD.marks, cs.VARIATION_SELECTORS), negated=True)
#: The symbols of the driver's texts that may flood.
_FLOODS = "|".join(rf"\x{{{ord(c):X}}}{{4,}}" for c in "+<=>|~¬±×÷¦©®°═")

#: A rule's result on ``b``.
RULE_SQL = {
    **{r: removed("b", owned(r)) for r in ("control_invisible", "bidi_control", "variation_selector", "pua_known_noise", "decorative_symbol", "decorative_combining", "exotic_combining")},
    "styled_math_alnum": _styled(),
    "abnormal_space": removed(swapped("b", r"[\x{A0}\x{2003}\x{3000}]", " "), r"[\x{202F}\x{2009}]"),
    # the noise puts these between letters, and bullets at the beginning of lines
    "pua_contextual": swapped(
        swapped(swapped(swapped("b", r"([A-Za-z])\x{E011}([A-Za-z])", r"\1-\2"), r"([A-Za-z])\x{E10B}([A-Za-z])", r"\1'\2"), r"(^|\n)([ \t]*)\x{F0B7}(\s)([ \t]*[^ \t\r\n])", r"\1\2-\3\4"),
        r"(^|\n)([ \t]*)\x{F0B7}([^\s])",
        r"\1\2- \3",
    ),
    "emoji_all": removed("b", rf"{cs.java_class(cs.EMOJI_BASES)}{cs.java_class(cs.VARIATION_SELECTORS)}|[#*0-9]?[\x{{FE0E}}\x{{FE0F}}]?[\x{{20E3}}\x{{20E4}}]|{owned('emoji_all')}"),
    "combining_decoration": swapped(removed("b", f"^{_MARKS}+"), f"({_NOT_MARKS}){_MARKS}{{2,}}", r"\1"),
    "line_separator": f"replace(replace(b, {literal(chr(0x2028))}, chr(10)), {literal(chr(0x2029))}, chr(10) || chr(10))",
    "line_boundary_space": swapped("b", r"[ \t]+(\n|$)", r"\1"),
    "blank_line_collapse": "regexp_replace(b, '\\n{3,}', chr(10) || chr(10), 'g')",
    "math_symbol_flood": removed("b", _FLOODS),
    "html_entity": removed("b", cs.HTML_ENTITY),
    "forbidden_strings": removed("b", "|".join(s.replace("|", r"\|") for s in cs.FORBIDDEN_STRINGS)),
}

ORACLES: dict[str, str] = {name: digest("documents", "doc_id", noisy_sql("text", rule), RULE_SQL[rule]) for name, rule in NOISY_RULES.items()}
ORACLES |= {
    "clean_html_entity": digest("pages", "page_id", "html", RULE_SQL["html_entity"]),
    "clean_forbidden": digest("pages", "page_id", "html", RULE_SQL["forbidden_strings"]),
    # the run stands at the end, so all of it goes and the blank before it stays
    "clean_repeated_noise": digest("documents", "doc_id", "text || ' a11111' || repeat(' B7777777', 6)", "left(b, length(b) - 6 * 9 + 1)"),
    "clean_hex_contiguous": digest(
        "documents", "doc_id", "text || ' ' || md5(text) || ' ' || sha256(text) || ' 0x' || sha256(text)", swapped("b", r"(^|[^A-Za-z0-9])[0-9A-Fa-f]{64,}([^A-Za-z0-9]|$)", r"\1\2")
    ),
    "clean_hex_wrapped": digest("documents", "doc_id", "text || ' zz ' || sha256(text) || chr(10) || sha256(text) || chr(10) || md5(text)", "left(b, length(b) - 162)"),
    "clean_pages": "SELECT page_id, length(html)::BIGINT AS n_before, length(c)::BIGINT AS n_after, md5(c) AS cleaned_md5 FROM (SELECT page_id, html, "
    + "regexp_replace({}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS c FROM pages)".format(swapped(removed(removed("html", "|".join(s.replace("|", r"\|") for s in cs.FORBIDDEN_STRINGS)), cs.HTML_ENTITY), r"[ \t]+(\n|$)", r"\1")),
}

_TAKEN_TURNS = "b"
for _rule in ("html_entity", "math_symbol_flood", "decorative_combining", "pua_known_noise", "control_invisible", "bidi_control", "decorative_symbol", "line_separator", "abnormal_space", "line_boundary_space", "blank_line_collapse"):
    _TAKEN_TURNS = RULE_SQL[_rule].replace("(b,", f"({_TAKEN_TURNS},", 1)
ORACLES["clean_all_rules"] = digest("documents", "doc_id", noisy_sql("text", *ALL_NOISE), _TAKEN_TURNS)


def _spans(rule: str, pattern: str) -> str:
    """The stretches of one rule's matches on pages, with what they hold."""
    return f"""SELECT page_id, '{rule}' AS rule, min(stop - size)::BIGINT AS start, max(stop)::BIGINT AS "end", sum(size)::BIGINT AS count, string_agg(found, '' ORDER BY i) AS found FROM (
        SELECT page_id, i, found, size, sum(gap + size) OVER (PARTITION BY page_id ORDER BY i) AS stop, sum(CASE WHEN gap > 0 OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS island FROM (
        SELECT page_id, i, f[i] AS found, length(f[i]) AS size, length(gaps[i]) AS gap FROM (SELECT page_id, f, gaps, unnest(range(1, len(f) + 1)) AS i FROM (
        SELECT page_id, regexp_extract_all(html, {literal(pattern)}) AS f, string_split_regex(html, {literal(pattern)}) AS gaps FROM pages)))) GROUP BY page_id, island"""


_FORBIDDEN = "|".join(s.replace("|", r"\|") for s in cs.FORBIDDEN_STRINGS)


def _page(text: str) -> str:
    """A cleaned page."""
    return swapped(swapped(removed(removed(text, _FORBIDDEN), cs.HTML_ENTITY), r"[ \t]+(\n|$)", r"\1"), r"\n{3,}", "\n\n")


_E, _F = f"length({removed('html', cs.HTML_ENTITY)})", f"length({RULE_SQL['forbidden_strings'].replace('(b,', '(html,', 1)})"
ORACLES |= {
    "flagship": f"""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n_pages, sum(length(html))::BIGINT AS n_chars, sum(length(html) - {_E})::BIGINT AS n_entity,
        sum(length(html) - {_F})::BIGINT AS n_residue FROM pages GROUP BY 1""",
    "clean_stats": f"""WITH p AS (SELECT length(html) - {_E} AS e, length(html) - {_F} AS f FROM pages)
        SELECT 'total' AS stat, count(*)::BIGINT AS n FROM p UNION ALL SELECT 'changed_rows', count(*) FILTER (e + f > 0)::BIGINT FROM p
        UNION ALL SELECT 'changed_chars', sum(e + f)::BIGINT FROM p UNION ALL SELECT 'changed_html_entity', sum(e)::BIGINT FROM p UNION ALL SELECT 'changed_forbidden_strings', sum(f)::BIGINT FROM p""",
    # entities side by side make one stretch: gaps and islands over their starts
    "rule_spans": f"""WITH m AS (SELECT page_id, regexp_extract_all(html, {literal(cs.HTML_ENTITY)}) AS found, string_split_regex(html, {literal(cs.HTML_ENTITY)}) AS gaps FROM pages),
        x AS (SELECT page_id, unnest(range(1, len(found) + 1)) AS i, found, gaps FROM m WHERE len(found) > 0),
        s AS (SELECT page_id, i, length(gaps[i]) AS gap, length(found[i]) AS size FROM x),
        o AS (SELECT page_id, i, gap, size, sum(gap + size) OVER (PARTITION BY page_id ORDER BY i) AS stop, sum(CASE WHEN gap > 0 OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS island FROM s)
        SELECT page_id, 'html_entity' AS rule, min(stop - size)::BIGINT AS start, max(stop)::BIGINT AS "end", sum(size)::BIGINT AS count FROM o GROUP BY page_id, island""",
    "rule_totals": f"""WITH p AS (SELECT 'html_entity' AS rule, 'html' AS field, sum(length(html) - {_E})::BIGINT AS n FROM pages UNION ALL SELECT 'forbidden_strings', 'html', sum(length(html) - {_F})::BIGINT FROM pages)
        SELECT rule, field, sum(n)::BIGINT AS n FROM p GROUP BY GROUPING SETS ((), (rule), (field), (rule, field))""",
    "codepoint_totals": f"""WITH c AS (SELECT unnest(string_split(array_to_string(regexp_extract_all(html, {literal(cs.HTML_ENTITY)}), ''), '')) AS ch FROM pages)
        SELECT 'html_entity' AS rule, printf('U+%04X', unicode(ch)) AS codepoint, count(*)::BIGINT AS n FROM c WHERE ch <> '' GROUP BY 2""",
}

ORACLES["provenance"] = f"""WITH s AS ({_spans("html_entity", cs.HTML_ENTITY)} UNION ALL {_spans("forbidden_strings", _FORBIDDEN)}),
    c AS (SELECT page_id, rule, start, ch, count(*) AS n, min(i) AS first FROM (SELECT page_id, rule, start, unnest(string_split(found, '')) AS ch, unnest(range(0, length(found))) AS i FROM s) GROUP BY ALL),
    j AS (SELECT page_id, rule, start, '{{' || string_agg(printf('"U+%04X":%d', unicode(ch), n), ',' ORDER BY first) || '}}' AS codepoints FROM c GROUP BY page_id, rule, start)
    SELECT page_id, rule, start, "end", count, 'delete' AS action, CASE WHEN length(found) <= {PREVIEW} THEN found ELSE left(found, {PREVIEW // 2}) || '...' || right(found, {PREVIEW // 2}) END AS original_preview,
    '' AS replacement_preview, codepoints, 'matched' AS reasons FROM s JOIN j USING (page_id, rule, start)"""

# ---- mojibake ----


def _hits(text: str, pattern: str) -> str:
    return f"(length({text}) - length({removed(text, pattern)}))"


def _class_counts() -> str:
    parts = []
    for rule in RULES:
        if rule in ("cscn", "math_symbol_flood", "seq", "double_enc", "cp1252"):
            continue
        pattern = cs.HTML_ENTITY if rule == "html_entity" else cs.java_class(classes()[rule])
        parts.append(f"(CASE WHEN {_hits('t', pattern)} >= {THRESHOLDS.get(rule, 1)} THEN {_hits('shown', pattern)} ELSE 0 END)::BIGINT AS {rule}")
    blank = cs.java_class(cs.PY_SPACE)
    shown = f"array_to_string(list_filter(string_split(t, chr(10)), lambda x: length({removed('x', blank)}) > 0), chr(10))"
    return f"SELECT doc_id, {', '.join(parts)} FROM (SELECT doc_id, t, {shown} AS shown FROM (SELECT doc_id, {noisy_sql('text', *MOJIBAKE_NOISE)} AS t FROM documents))"


_UNASSIGNED = cs.java_class(cs.minus(cs.UCD.unassigned, ((0xD800, 0xDFFF),)))
_LONG_FLOODS = _FLOODS.replace("{4,}", "{8,}")
_GARBLED, _PAIR = "|".join(cs.GARBLED), f"[{cs.GARBLED_PAIR}]"


def _covered(text: str, pattern: str) -> str:
    return f"length(array_to_string(regexp_extract_all({text}, {literal(pattern)}), ''))"


def _full_report() -> str:
    """Counts of every rule on every line; rules with a threshold count over the whole text first."""
    n = lambda text, pattern: f"len(regexp_extract_all({text}, {literal(pattern)}))"
    count, whole = {}, {}
    for rule in RULES:
        if rule in classes():
            pattern = _UNASSIGNED if rule == "cscn" else cs.java_class(classes()[rule])
            count[rule], whole[rule] = _hits("line", pattern), _hits("t", pattern)
        elif rule == "seq":
            count[rule] = f"{_covered('line', _GARBLED)} + CASE WHEN len(list_distinct(regexp_extract_all(line, {literal(_PAIR)}))) > 1 THEN {n(removed('line', _GARBLED), _PAIR)} ELSE 0 END"
            whole[rule] = "1"
        elif rule == "double_enc":
            count[rule], whole[rule] = (" + ".join(f(x, p) for p in cs.DOUBLE_ENCODED) for f, x in ((_covered, "line"), (n, "t")))
        else:
            pattern = {"cp1252": cs.CP1252, "html_entity": cs.HTML_ENTITY, "math_symbol_flood": _LONG_FLOODS}[rule]
            count[rule], whole[rule] = _covered("line", pattern), n("t", pattern)
    least = {r: 1 if r == "math_symbol_flood" else THRESHOLDS.get(r, 1) for r in RULES}
    told = ", ".join(f"CASE WHEN {r}_on AND {r} > 0 THEN '{r}=' || {r} END" for r in RULES)
    return f"""WITH d AS (SELECT doc_id, {noisy_sql("text", *MOJIBAKE_NOISE)} AS t FROM documents),
        a AS (SELECT doc_id, string_split(t, chr(10)) AS l, {", ".join(f"({w}) >= {least[r]} AS {r}_on" for r, w in whole.items())} FROM d),
        x AS (SELECT * EXCLUDE (l), unnest(l) AS line, unnest(range(0, len(l))) AS line_no, len(l) AS n FROM a),
        o AS (SELECT *, length(line) + CASE WHEN line_no + 1 < n THEN 1 ELSE 0 END AS size FROM x),
        h AS (SELECT doc_id, size, sum(size) OVER (PARTITION BY doc_id ORDER BY line_no) AS stop, line, {", ".join(f"({c})::BIGINT AS {r}" for r, c in count.items())}, {", ".join(f"{r}_on" for r in RULES)} FROM o),
        r AS (SELECT doc_id, stop - size AS start, stop, concat_ws(',', {told}) AS rules FROM h WHERE length({removed("line", cs.java_class(cs.PY_SPACE))}) > 0)
        SELECT doc_id, start::BIGINT AS start, stop::BIGINT AS "end", rules FROM r WHERE rules <> ''"""


ORACLES |= {
    "moji_full_report": _full_report(),
    "moji_floods": f"SELECT doc_id, {_hits('shown', _UNASSIGNED)}::BIGINT AS cscn, {_covered('t', _LONG_FLOODS)}::BIGINT AS math_symbol_flood FROM (SELECT doc_id, t, array_to_string(list_filter(string_split(t, chr(10)), lambda x: length({removed('x', cs.java_class(cs.PY_SPACE))}) > 0), chr(10)) AS shown FROM (SELECT doc_id, {noisy_sql('text', 'flood', 'cscn')} AS t FROM documents))",
    "moji_class_counts": _class_counts(),
    "moji_patterns": f"""WITH d AS (SELECT doc_id, {noisy_sql("text", "seq", "double_enc")} AS t FROM documents),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
        s AS (SELECT doc_id, sum({_covered("x", _GARBLED)} + CASE WHEN len(list_distinct(regexp_extract_all(x, {literal(_PAIR)}))) > 1 THEN len(regexp_extract_all({removed("x", _GARBLED)}, {literal(_PAIR)})) ELSE 0 END)::BIGINT AS seq FROM l GROUP BY 1)
        SELECT doc_id, seq,
        (CASE WHEN {" + ".join(f"len(regexp_extract_all(t, {literal(p)}))" for p in cs.DOUBLE_ENCODED)} >= 5 THEN {" + ".join(_covered("t", p) for p in cs.DOUBLE_ENCODED)} ELSE 0 END)::BIGINT AS double_enc,
        (CASE WHEN len(regexp_extract_all(t, {literal(cs.CP1252)})) >= 3 THEN {_covered("t", cs.CP1252)} ELSE 0 END)::BIGINT AS cp1252
        FROM d JOIN s USING (doc_id)""",
    "moji_html_entity": f"SELECT page_id, {_hits('html', cs.HTML_ENTITY)}::BIGINT AS html_entity FROM pages",
    "moji_window_hits": f"""WITH d AS (SELECT doc_id, string_split({noisy_sql("text", "fffd")}, chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS line_no, len(l) AS n FROM d),
        w AS (SELECT doc_id, line_no, line, length(line) + CASE WHEN line_no + 1 < n THEN 1 ELSE 0 END AS size FROM x),
        o AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY line_no) AS stop FROM w)
        SELECT doc_id, line_no::BIGINT AS line_no, (stop - size)::BIGINT AS start, stop::BIGINT AS "end", (length(line) - length(replace(line, {literal(chr(0xFFFD))}, '')))::BIGINT AS hit_num
        FROM o WHERE contains(line, {literal(chr(0xFFFD))})""",
}

# ---- repetition ----

_PUNCT = "[" + cs.CJK_PUNCTUATION + "]+"


def _tokens(text: str) -> str:
    spaced = swapped(text, f"({cs.java_class(cs.CJK_TOKENS)})", r" \1 ")
    return f"list_filter(string_split_regex({spaced}, {literal(SPACE + '+')}), lambda x: x <> '' AND NOT regexp_full_match(x, {literal(_PUNCT)}))"


def _shown(text: str) -> str:
    return removed(text, rf"^{SPACE}+|{SPACE}+$")


def _ngrams(source: str, n: int, name: str) -> str:
    """CTE: key, n-gram totals, of a CTE with key and w."""
    return f"""{name} AS (SELECT key, sum(c)::BIGINT AS total, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS repeated, max(c)::BIGINT AS top_count FROM (
        SELECT key, g, count(*) AS c FROM (SELECT key, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: list_slice(w, i, i + {n - 1}))) AS g FROM {source} WHERE len(w) >= {3 * n}) GROUP BY key, g) GROUP BY key)"""


def _measures(table: str, key: str, where: str = "TRUE") -> str:
    return f"""t AS (SELECT {key} AS key, length(text) AS n_chars, length({_shown("text")}) AS n_visible, {_tokens(_shown("text"))} AS w FROM {table} WHERE {where}),
        {_ngrams("t", 5, "five")}, {_ngrams("t", 10, "ten")},
        m AS (SELECT t.key, n_chars, n_visible, len(w)::BIGINT AS n_tokens, coalesce(ten.total, 0) AS ngrams10, coalesce(ten.repeated, 0) AS repeated10, coalesce(five.total, 0) AS ngrams5, coalesce(five.repeated, 0) AS repeated5,
        n_chars >= 200 AND n_visible >= 200 AND (coalesce(ten.repeated / ten.total, 0) > 0.75 OR coalesce(five.repeated / five.total, 0) > 0.85) AS flagged
        FROM t LEFT JOIN five ON five.key = t.key LEFT JOIN ten ON ten.key = t.key),
        c AS (SELECT key, x, count(*) AS n, min(i) AS first FROM (SELECT key, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM t) GROUP BY key, x),
        top AS (SELECT key, arg_max(x, (n, -first)) AS top_token, max(n)::BIGINT AS top_token_count FROM c GROUP BY key)"""


_FLOOD = "(coalesce(n_chars >= 200 AND n_visible >= 200 AND n_tokens >= 20 AND top_token_count / n_tokens >= CASE WHEN n_visible > 1000 THEN 0.6 ELSE 0.8 END, FALSE))"
_ENUM = (
    r"\s*([0-9]+[.)]|[０-９]+[．。）)]|[一二三四五六七八九十百千零两]+[、。．.]|第[一二三四五六七八九十百千零两0-9]+[、，,：:．.]?|[（(]\s*[0-9一二三四五六七八九十]+\s*[)）]|[\x{2460}-\x{2473}\x{24EB}-\x{24FF}])\s*"
)


def _enum_lines(text: str) -> str:
    """CTEs up to e: doc_id, n_lines, marked and longest."""
    return f"""d AS (SELECT doc_id, length({text}) AS n_chars, string_split({_shown(text)}, chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM d),
        f AS (SELECT doc_id, i, regexp_full_match(line, {literal(_ENUM)}) AS hit FROM x),
        g AS (SELECT doc_id, hit, i - row_number() OVER (PARTITION BY doc_id, hit ORDER BY i) AS island FROM f),
        r AS (SELECT doc_id, hit, count(*) AS n FROM g GROUP BY doc_id, hit, island),
        e AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (hit), 0)::BIGINT AS marked, coalesce(max(n) FILTER (hit), 0)::BIGINT AS longest FROM r GROUP BY doc_id)"""


_RUNAWAY = "(n_chars >= 100 AND n_lines >= 20 AND (longest >= 30 OR (marked >= 20 AND marked / n_lines >= 0.5)))"
_WORDS = f"list_filter(string_split_regex(text, {literal(SPACE + '+')}), lambda x: x <> '')"

def _top_grams(n: int) -> str:
    """CTE s<n>: key, totals and the first seen of the most frequent n-grams."""
    return f"""s{n} AS (SELECT key, sum(n) AS total, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS repeated, arg_max(gram, (n, -first)) AS gram, max(n) AS top_count FROM (
        SELECT key, gram, count(*) AS n, min(i) AS first FROM (SELECT key, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: list_slice(w, i, i + {n - 1}))) AS gram, unnest(range(1, len(w) - {n - 2})) AS i FROM t WHERE len(w) >= {3 * n})
        GROUP BY key, gram) GROUP BY key)"""


_GRAM_SHARE = {10: 0.75, 5: 0.85}
_FOUND_GRAMS = " UNION ALL ".join(f"SELECT key, {n} AS size, total, repeated, array_to_string(gram[:8], ' ') || '...' AS top, top_count FROM s{n} WHERE repeated / total > {share}" for n, share in _GRAM_SHARE.items())
ORACLES["repetition_findings"] = f"""WITH {_measures("documents", "doc_id")}, {_enum_lines("text")}, {_top_grams(10)}, {_top_grams(5)}, grams AS ({_FOUND_GRAMS}),
    best AS (SELECT grams.* FROM grams JOIN m ON m.key = grams.key WHERE n_chars >= 200 AND n_visible >= 200 QUALIFY row_number() OVER (PARTITION BY grams.key ORDER BY size DESC) = 1),
    q AS (SELECT key, size || 'gram' AS kind, repeated::BIGINT AS repeated, total::BIGINT AS total, top, top_count::BIGINT AS top_count,
        printf('repetition_ngram:%dgram msg[0] ratio=%.2f repeated=%d/%d top=''%s'' x%d', size, repeated / total, repeated::BIGINT, total::BIGINT, top, top_count) AS reason FROM best
        UNION ALL SELECT m.key, 'token_flood', top_token_count, n_tokens, left(top_token, 20), top_token_count,
        printf('repetition_ngram:token_flood msg[0] token=''%s'' ratio=%.2f (%d/%d tokens)', left(top_token, 20), top_token_count / n_tokens, top_token_count, n_tokens) FROM m JOIN top ON top.key = m.key WHERE {_FLOOD}
        UNION ALL SELECT e.doc_id, CASE WHEN longest >= 30 THEN 'enum_lines' ELSE 'enum_share' END, marked, n_lines, NULL, longest,
        CASE WHEN longest >= 30 THEN printf('repetition_ngram:runaway_enum msg[0] consecutive=%d total_enum=%d/%d lines', longest, marked, n_lines)
        ELSE printf('repetition_ngram:runaway_enum msg[0] ratio=%.2f (%d/%d lines)', marked / n_lines, marked, n_lines) END FROM e JOIN d USING (doc_id) WHERE {_RUNAWAY})
    SELECT key AS doc_id, kind, repeated, total, top, top_count, reason FROM q"""
ORACLES["repetition_reports"] = f"""WITH q AS ({ORACLES["repetition_findings"]}), k AS (SELECT *, CASE WHEN kind LIKE '%gram' THEN 1 WHEN kind = 'token_flood' THEN 2 ELSE 3 END AS place FROM q),
    i AS (SELECT doc_id, string_agg(reason, '|' ORDER BY place) AS issues, string_agg('repetition_ngram', '|') AS types, first(reason ORDER BY place) AS one FROM k GROUP BY doc_id),
    w AS (SELECT *, trim(regexp_extract(one, {literal(r"top='([^']+?)\.\.\.'")}, 1) || regexp_extract(one, {literal("token='([^']+)'")}, 1)) AS quoted FROM i)
    SELECT doc_id, issues, types, length(text)::BIGINT AS content_len, md5(left(text, 100)) AS excerpt_md5, (CASE WHEN quoted <> '' AND contains(text, quoted) THEN strpos(text, quoted) - 1 END)::BIGINT AS "at" FROM w JOIN documents USING (doc_id)"""
# most frequent rules first, of equals the one met first
ORACLES["mojibake_reports"] = f"""WITH f AS ({ORACLES["moji_full_report"]}),
    u AS (SELECT doc_id, start, unnest(string_split(rules, ',')) AS r, unnest(range(0, len(string_split(rules, ',')))) AS i FROM f),
    n AS (SELECT doc_id, split_part(r, '=', 1) AS rule, sum(split_part(r, '=', 2)::BIGINT)::BIGINT AS n, min((start, i)) AS first FROM u GROUP BY doc_id, rule),
    t AS (SELECT doc_id, sum(n)::BIGINT AS total, list(rule || '=' || n ORDER BY n DESC, first) AS rules FROM n GROUP BY doc_id),
    o AS (SELECT doc_id, list('[' || start || ', ' || "end" || ']' ORDER BY start) AS spans FROM f GROUP BY doc_id)
    SELECT doc_id, 'mojibake:hit_chars=' || total || ' rules=' || array_to_string(rules[:4], ',') || ' offsets=[' || array_to_string(spans[:3], ', ') || ']' AS issues FROM t JOIN o USING (doc_id)"""
ORACLES["check_run"] = f"""WITH {_measures("documents", "doc_id")}, {_enum_lines("text")},
    q AS (SELECT m.key AS doc_id, flagged OR {_FLOOD.replace("n_chars", "m.n_chars")} OR {_RUNAWAY.replace("n_chars", "m.n_chars")} AS failed FROM m LEFT JOIN top ON top.key = m.key JOIN e ON e.doc_id = m.key)
    SELECT CASE WHEN failed THEN 'failed' ELSE 'passed' END AS sink, doc_id, md5(text) AS text_md5 FROM q JOIN documents USING (doc_id) WHERE doc_id % 50 <> 7
    UNION ALL SELECT 'bad_json', count(*), '' FROM documents WHERE doc_id % 50 = 7"""

ORACLES |= {
    "token_count": f"SELECT doc_id, len({_tokens('text')})::BIGINT AS n_tokens FROM documents",
    **{
        f"ngram{n}_ratio": f"WITH t AS (SELECT doc_id AS key, {_tokens(_shown('text'))} AS w FROM documents), {_ngrams('t', n, 'g')} SELECT t.key AS doc_id, coalesce(total, 0) AS total, coalesce(repeated, 0) AS repeated, coalesce(top_count, 0) AS top_count FROM t LEFT JOIN g ON g.key = t.key"
        for n in (5, 10)
    },
    "token_flood": f"WITH {_measures('documents', 'doc_id')} SELECT m.key AS doc_id, n_tokens, top_token, coalesce(top_token_count, 0) AS top_token_count, {_FLOOD} AS token_flood FROM m LEFT JOIN top ON top.key = m.key",
    "rep_ngram_flag": f"WITH {_measures('documents', 'doc_id')} SELECT key AS doc_id, ngrams10, repeated10, ngrams5, repeated5, flagged FROM m",
    "conv_assistant_repetition": "WITH {} SELECT m.key.conv_id AS conv_id, m.key.turn AS turn, n_tokens, repeated5, coalesce(top_token_count, 0) AS top_token_count, flagged FROM m LEFT JOIN top ON top.key = m.key".format(
        _measures("conversations", "{'conv_id': conv_id, 'turn': turn}", "role = 'assistant'")
    ),
    # words of letters, digits and underscores that are one to six digits; islands of equal value minus rank
    "runaway_counter": f"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all({noisy_sql("text", "enum")}, '[\\pL\\pN_]+'), lambda x: regexp_full_match(x, '[0-9]{{1,6}}')) AS v FROM documents),
        x AS (SELECT doc_id, len(v) AS n_numbers, unnest(v)::BIGINT AS v, unnest(range(0, len(v))) AS i FROM d WHERE len(v) >= 10),
        b AS (SELECT doc_id, i, CASE WHEN v = lag(v) OVER (PARTITION BY doc_id ORDER BY i) + 1 THEN 0 ELSE 1 END AS new FROM x),
        r AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
        n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id, run),
        s AS (SELECT doc_id, sum(n) FILTER (n >= 5) AS n FROM n GROUP BY doc_id)
        SELECT d.doc_id, len(v)::BIGINT AS n_numbers, coalesce(s.n, 0)::BIGINT AS n_counter_numbers FROM d LEFT JOIN s USING (doc_id)""",
    "runaway_enum": f"WITH {_enum_lines(noisy_sql('text', 'enum'))} SELECT doc_id, n_lines, marked, longest, {_RUNAWAY} AS runaway FROM e JOIN d USING (doc_id)",
    "pass_fail_split": f"""WITH {_measures("documents", "doc_id")}, {_enum_lines("text")}
        SELECT failed, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM (SELECT m.n_chars, flagged OR {_FLOOD.replace("n_chars", "m.n_chars")} OR {_RUNAWAY.replace("n_chars", "m.n_chars")} AS failed
        FROM m LEFT JOIN top ON top.key = m.key JOIN e ON e.doc_id = m.key) GROUP BY failed""",
    "issue_topk": f"WITH {_measures('documents', 'doc_id')} SELECT key AS doc_id, ngrams5, repeated5 FROM m ORDER BY repeated5 DESC, key LIMIT 20",
    "chunk_counts": """SELECT doc_id, (CASE WHEN n = 0 THEN 0 ELSE (n + step - 1) // step END)::BIGINT AS n_chunks, size::BIGINT AS chunk_size FROM (SELECT doc_id, n,
        CASE WHEN n < 300000 THEN 10000 WHEN n < 500000 THEN 5000 WHEN n < 800000 THEN 3000 ELSE 1000 END AS size,
        CASE WHEN n < 10000 THEN 10000 WHEN n < 300000 THEN 9000 WHEN n < 500000 THEN 4800 WHEN n < 800000 THEN 2900 ELSE 990 END AS step FROM (SELECT doc_id, length(text) AS n FROM documents))""",
    "word_run_max": f"""WITH x AS (SELECT doc_id, unnest(w) AS v, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
        g AS (SELECT doc_id, i, CASE WHEN v = lag(v) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM x),
        r AS (SELECT doc_id, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
        n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id, run), m AS (SELECT doc_id, max(n) AS n FROM n GROUP BY doc_id)
        SELECT doc_id, coalesce(m.n, 0)::BIGINT AS longest_run FROM documents LEFT JOIN m USING (doc_id)""",
    "pair_offsets": """WITH a AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn - 1 AS turn, length(text) AS m FROM conversations WHERE role = 'assistant'),
        p AS (SELECT conv_id, turn, n, floor((n + m) / 4)::BIGINT AS s, ceil((n + m) * 3 / 4)::BIGINT AS e FROM a JOIN b USING (conv_id, turn))
        SELECT conv_id, turn, CASE WHEN s < n THEN 'src' ELSE 'tgt' END AS start_in, (CASE WHEN s = n THEN 0 WHEN s < n THEN s ELSE s - n - 1 END)::BIGINT AS start,
        CASE WHEN e - 1 <= n THEN 'src' ELSE 'tgt' END AS end_in, (CASE WHEN e - 1 = n THEN n WHEN e - 1 < n THEN e ELSE e - n - 1 END)::BIGINT AS "end" FROM p""",
    # a text that begins with the unit keeps its last copy, any other its first; the blank before a Latin unit is the first character that repeats
    "subdedup_made": f"""WITH m AS (SELECT doc_id, doc_id % 4 AS kind, doc_id % 11 + 1 AS k, doc_id % 3 = 0 AS bare, [{", ".join(map(literal, MADE_UNITS))}][doc_id % 4 + 1] AS u FROM documents),
        p AS (SELECT *, length(u) AS n, CASE WHEN bare THEN 0 WHEN kind < 2 THEN 8 ELSE 3 END AS s FROM m WHERE k >= 5)
        SELECT doc_id, (CASE WHEN bare THEN 0 ELSE s + n END)::BIGINT AS start, (s + k * n - CASE WHEN bare THEN n ELSE 0 END)::BIGINT AS "end", s::BIGINT AS unit_start, (s + n)::BIGINT AS unit_end, k::BIGINT AS repeats,
        length(replace(replace(u, ' ', ''), '，', ''))::BIGINT AS char_len, (CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END)::BIGINT AS word_len, FALSE AS is_special FROM p""",
    "pair_spans": """WITH a AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn - 1 AS turn, length(text) AS m FROM conversations WHERE role = 'assistant'),
        p AS (SELECT conv_id, turn, n, m, floor((n + m) / 4)::BIGINT AS s, ceil((n + m) * 3 / 4)::BIGINT AS e FROM a JOIN b USING (conv_id, turn))
        SELECT conv_id, turn, 'src' AS side, s AS start, least(e, n)::BIGINT AS "end" FROM p WHERE s < n
        UNION ALL SELECT conv_id, turn, 'tgt', greatest(s - n - 1, 0)::BIGINT, (e - n - 1)::BIGINT FROM p WHERE e > n + 1""",
}

# ---- text functions ----

_HAN = r"[\x{4E00}-\x{9FFF}]"


def _documents(make: str, *noises: str) -> str:
    """make speaks of ``t``."""
    return f"SELECT doc_id, length(o)::BIGINT AS n_chars, md5(o) AS out_md5 FROM (SELECT doc_id, {make} AS o FROM (SELECT doc_id, {noisy_sql('text', *noises)} AS t FROM documents))"


_KEYS = "".join(textops.PUNCTUATION)
_SINGLE = {a: b for a, b in textops.PUNCTUATION.items() if len(b) == 1}
_CONTROL = r"[\x{00}-\x{1F}\x{7F}-\x{9F}]"
_TOLD = "CASE WHEN lower(lang) LIKE 'en%' THEN 'en' WHEN regexp_matches(lower(lang), '^(zh|cn|ch)') THEN 'cn' ELSE {} END"
_GUESS = f"CASE WHEN len(regexp_extract_all(left(t, 2000), '{_HAN}')) / greatest(length(left(t, 2000)), 1) > 0.1 THEN 'cn' ELSE 'en' END"
_FULL_PUNCT = "".join(rf"\x{{{ord(c):X}}}" for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")
_CLAUSE = swapped(
    swapped(swapped("t", rf"({'|'.join(textops.TITLES)})\. ([A-Za-z])", "\\1\x01\\2"), r"([0-9]+)\.([0-9]+)", "\\1\x02\\2"), rf"([{textops.SENTENCE_ENDS}]){SPACE}*", "\\1\x03"
)


def _multi(text: str) -> str:
    for a, b in textops.PUNCTUATION.items():
        if len(b) > 1:
            text = f"replace({text}, {literal(a)}, {literal(b)})"
    return text


def _spaced(text: str) -> str:
    put = lambda t, table: t if not table else put(f"replace({t}, {literal(table[0][0])}, {literal(table[0][1])})", table[1:])
    text = swapped(put(text, textops.SPACING_FIRST), r"\) ([.!:?;,])", r"\\)\1")
    text = swapped(put(text, textops.SPACING_BRACKETS), "([0-9]) %", r"\1\\%")
    text = put(put(text, textops.SPACING_STOPS), textops.SPACING_QUOTES)
    return swapped(swapped(text, '"([,.]+)', r"\1\\" + '"'), "([0-9]) ([0-9])", r"\1.\2")


_NORMAL = removed(_multi(f"translate({swapped(f'strip_accents(lower({_shown("text")}))', '[0-9]', '0')}, {literal(''.join(_SINGLE))}, {literal(''.join(_SINGLE.values()))})"), _CONTROL)

ORACLES |= {
    "text_kernels": f"SELECT doc_id, md5(strip_accents(text)) AS accents_md5, md5({_NORMAL}) AS normal_md5, md5({_spaced('text')}) AS spaced_md5 FROM documents",
    "lang_route": f"SELECT doc_id, {_TOLD.format(_GUESS)} AS told, {_GUESS} AS guessed FROM (SELECT doc_id, lang, {noisy_sql('text', 'han')} AS t FROM documents)",
    "has_script": rf"SELECT doc_id, regexp_matches(t, '[A-Za-z]') AS latin, regexp_matches(t, '{_HAN}') AS han, len(regexp_extract_all(t, '[\x{{4E00}}-\x{{9FA5}}]'))::BIGINT AS n_han FROM (SELECT doc_id, {noisy_sql('text', 'han')} AS t FROM documents)",
    "excerpts": """WITH d AS (SELECT doc_id, text, regexp_extract(text, '[0-9]+') AS number, length(regexp_extract(text, '^[^0-9]*')) AS s FROM documents WHERE regexp_matches(text, '[0-9]')),
        o AS (SELECT *, greatest(s - 120, 0) AS a, least(s + length(number) + 120, length(text)) AS b FROM d)
        SELECT doc_id, number, s::BIGINT AS start, b::BIGINT AS context_end, md5(substring(text, a + 1, b - a)) AS context_md5 FROM o""",
    "is_code": f"SELECT doc_id, contains(t, 'code::') OR regexp_matches(t, '(?s)```.*```') AS is_code FROM (SELECT doc_id, {noisy_sql('text', 'code')} AS t FROM documents)",
    "strip_punct_len": rf"SELECT doc_id, length({removed('t', rf'[\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FFEF}}{_FULL_PUNCT}\s\x{{0B}}]')})::BIGINT AS n_chars FROM (SELECT doc_id, {noisy_sql('text', 'punctuation')} AS t FROM documents)",
    "sentence_count": f"SELECT doc_id, len(list_filter(p, lambda x, i: i = 1 OR length({swapped('x', SPACE + '+', ' ')}) <> 1))::BIGINT AS n_sentences FROM (SELECT doc_id, list_filter(string_split({_CLAUSE.replace('(t,', '(text,')}, chr(3)), lambda x: x <> '') AS p FROM documents)",
    "keep_english": _documents(removed("t", "[^a-zA-Z]")),
    "normalize_for_dedup": _documents(swapped(removed(f"translate({swapped(f'lower({_shown("t")})', r'\pN', '0').replace(chr(92) + 'pN', chr(92) + 'p{Nd}')}, {literal(_KEYS)}, '')", _CONTROL), SPACE + "+", " "), "punctuation"),
    "slow_normalize_for_dedup": _documents(removed(f"translate({swapped(f'lower({_shown("t")})', chr(92) + 'p{Nd}', '0')}, {literal(_KEYS)}, '')", _CONTROL), "punctuation"),
    "replace_unicode_punct": _documents(_multi(f"translate(t, {literal(''.join(_SINGLE))}, {literal(''.join(_SINGLE.values()))})"), "punctuation"),
    "remove_unicode_punct": _documents(removed("t", f"[{_KEYS}]"), "punctuation"),
    "remove_split_punct": _documents(removed("t", r"[,.?!;。！？；，\[\]():#=|/-]"), "punctuation"),
    "remove_non_printing_char": _documents(removed("t", _CONTROL), "c1_control"),
    "remove_punctuation": _documents(_shown(removed("t", r"[^\pL\pN_\s\x{0B}]+$"))),
    "remove_unprintable": _documents(removed("t", r"[\pC\p{Zl}\p{Zp}\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}]"), "c1_control", "control_invisible"),
    "filter_latex": _documents(removed("t", r"\\cdots|\\underline")),
    "article_titles": """WITH t AS (SELECT conv_id, string_agg(regexp_replace(text, '\\n\\n+', chr(10), 'g') || chr(10) || chr(10) || 'someone wrote:' || chr(10) || regexp_replace(text, '\\n\\n+', chr(10), 'g'), chr(10) || chr(10) ORDER BY turn) AS c FROM conversations GROUP BY conv_id),
        o AS (SELECT conv_id, '<|start_of_articleid=' || conv_id || '|>Body' || chr(10) || '<|start_of_comment_articleid=' || conv_id || '|>' || c || '<|end_of_comment_articleid=' || conv_id || '|>' AS o FROM t)
        SELECT conv_id, length(o)::BIGINT AS n_chars, md5(o) AS out_md5 FROM o""",
    # replacement characters stay in a cleaned page; whatever else the check looks for, these pages do not hold
    "clean_then_check": f"""SELECT failed, count(*) AS n_pages, sum(page_id)::BIGINT AS ids FROM (SELECT page_id, regexp_matches({_page("t")}, {literal("|".join([chr(0xFFFD), cs.HTML_ENTITY, _LONG_FLOODS]))}) AS failed
        FROM (SELECT page_id, {noisy_sql("html", "fffd")} AS t FROM pages)) GROUP BY failed""",
    "clean_run": f"""WITH p AS (SELECT page_id, length(html) - {_E} AS e, length(html) - {_F} AS f, length({removed(removed("html", _FORBIDDEN), cs.HTML_ENTITY)}) AS n FROM pages)
        SELECT 'page' AS kind, page_id::VARCHAR AS name, n::BIGINT AS n FROM p UNION ALL SELECT 'stat', 'total', count(*) FROM p UNION ALL SELECT 'stat', 'changed_rows', count(*) FROM p WHERE e + f > 0
        UNION ALL SELECT 'stat', 'changed_fields', count(*) FROM p WHERE e + f > 0 UNION ALL SELECT 'stat', 'changed_chars', sum(e + f)::BIGINT FROM p
        UNION ALL SELECT 'stat', 'changed_html_entity', sum(e)::BIGINT FROM p UNION ALL SELECT 'stat', 'changed_forbidden_strings', sum(f)::BIGINT FROM p""",
    "jsonl_round_trip": f"""WITH c AS (SELECT page_id, html, {removed(removed("html", "|".join(s.replace("|", chr(92) + "|") for s in cs.FORBIDDEN_STRINGS)), cs.HTML_ENTITY)} AS c FROM pages),
        e AS (SELECT page_id, html, regexp_replace({swapped("c", r"[ \t]+(\n|$)", r"\1")}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS e FROM c)
        SELECT page_id, TRUE AS same_line, (length(html) - length(e))::BIGINT AS change_count, length(e)::BIGINT AS n_after FROM e""",
    "stream_clean": "SELECT doc_id, length(o)::BIGINT AS n_chars, md5(o) AS text_md5 FROM (SELECT doc_id, {} AS o FROM (SELECT doc_id, {} AS t FROM documents))".format(
        swapped(removed(removed("t", rf"5\x{{FE0F}}\x{{20E3}}|{owned('emoji_all')}|[\x{{FE0F}}\x{{200B}}\x{{FEFF}}\x{{AD}}]"), _FLOODS), r"[ \t]+(\n|$)", r"\1"), noisy_sql("text", "control_invisible", "emoji_all")
    ),
}
