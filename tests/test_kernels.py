"""Kernels against asserted cases, and against plain forms of what they compute."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom import charsets as cs
from textloom.kernels import article, cleaner, mojibake, records, repetition, subdup, textops

from .texts import ATOMS, made

TOKEN = "a111111111"


@pytest.mark.parametrize(
    "text, rules, expected",
    [
        ("Lead.\n\n" + " ".join([TOKEN] * 5) + " 1. Introduction", None, "Lead.\n\n1. Introduction"),
        ("Before " + " ".join([TOKEN] * 4) + " After", None, "Before " + " ".join([TOKEN] * 4) + " After"),
        ("Before " + ", ".join(["B7777777"] * 5) + " After", None, "Before After"),
        ("x" + ", ".join(["B7777777"] * 5) + " After", "repeated_noise_token", "x" + ", ".join(["B7777777"] * 5) + " After"),
        ("x," + ",".join(["B7777777"] * 5) + "y", "repeated_noise_token", "x," + ",".join(["B7777777"] * 5) + "y"),
        ("x," + ",".join(["B7777777"] * 5) + " y", "repeated_noise_token", "x, y"),
        *[("Before " + " ".join([w] * 5) + " After", "repeated_noise_token", "Before " + " ".join([w] * 5) + " After") for w in ("very", "2024", "00000000", "abc12345")],
        ("value=0x" + "ab" * 50, "repeated_noise_token", "value=0x" + "ab" * 50),
        ("```text\n" + " ".join([TOKEN] * 5) + "\n```", "repeated_noise_token", "```text\n" + " ".join([TOKEN] * 5) + "\n```"),
        ("5\ufe0f\u20e3", None, ""),
        ("✔", None, "✔"),
        ("✔\ufe0f", None, ""),
        ("#\ufe0f\u20e3", "emoji_all", ""),
        ("\U0001d7d8\U0001d455", None, "0"),
        ("a\u00a0b\u3000c\u2009d", None, "a b cd"),
        ("a\u00a0\nb", None, "a\nb"),
        ("\u200e", "control_invisible", ""),
        ("\u200d", "control_invisible", "\u200d"),
        ("★", "emoji_all", ""),
        ("\uf0b7item", None, "- item"),
        ("\uf0b7 item", None, "- item"),
        ("3\uf07e5", None, "3~5"),
        ("A\ue010b", None, "A．b"),
        (f"a{chr(0xE618)}b\n{chr(0xE618)}c", "pua_contextual", "a\n- b\n- c"),
        ("a\u2029\n\nb", None, "a\n\nb"),
        ("x &amp; y", None, "x  y"),
        ("<b\u200br>", None, "<br>"),
        ("\\n ", None, ""),
        ("\\nabla", None, "\\nabla"),
        ("0" * 63, None, "0" * 63),
        ("dump " + "0123456789abcdef" * 4, None, "dump"),
        ("dump " + "0123456789abcdef" * 4 + "\n" + "ab" * 5, None, "dump"),
        ("a===b", None, "a===b"),
        ("a====b", None, "ab"),
        ("e\u0301", "combining_decoration", "e\u0301"),
        ("e\u0301\u0302", "combining_decoration", "e"),
        ("\u0301e", "combining_decoration", "e"),
        ("第一段\u2028第二段\u2029第三段\ufeff第四段", None, "第一段\n第二段\n\n第三段第四段"),
        ("✓ □ ☑ ▪【\ufe0f】", None, "✓ □ ☑ 【】"),
        ("", None, ""),
    ],
)
def test_cleaned(text, rules, expected):
    assert cleaner.clean_text(text, cleaner.parse_rules(rules))[0] == expected


def test_provenance():
    text = "Lead.\n\n" + " ".join([TOKEN] * 5) + " 1. Introduction"
    out = records.clean_record({"content": text, "meta": {"k": 1}}, fields=["content"], rules=["all"])
    meta = out["record"]["meta"]["cleaning_v6"]
    assert out["record"]["meta"]["k"] == 1 and meta["rule_counts"] == {"repeated_noise_token": 55} and meta["schema"] == "compact_by_rule_v1"
    span = meta["by_rule"]["repeated_noise_token"]["spans"][0]
    assert (span["start"], span["end"], span["reasons"], span["action"]) == (7, 62, ["repeat_count=5"], "delete")
    assert records.clean_record({"content": "a\u00a0\nb"})["cleaning"]["by_rule"]["abnormal_space"]["spans"][0]["reasons"] == ["matched+line_boundary"]
    assert "_cleaning_v6" in records.clean_record({"content": "x", "meta": "text"})["record"]
    many = {"content": "&amp; x " * 30}
    cut = records.clean_record(many, meta_detail="both", max_meta_spans=3, max_meta_changes=10)["cleaning"]
    rule = cut["by_rule"]["html_entity"]
    assert rule["span_count"] == 30 and len(rule["spans"]) == 3 and rule["spans_truncated"] and len(cut["changes"]) == 10 and cut["changes_truncated"]
    change = records.clean_record({"content": "\u00a0"}, meta_detail="chars", rules="abnormal_space")["cleaning"]["changes"][0]
    assert change["codepoint"] == "U+00A0" and change["replacement"] == "' '" and change["name"] == "NO-BREAK SPACE" and change["field"] == "content"


def test_rule_names():
    assert cleaner.parse_rules("all,exotic_combining,bidi_control") == cleaner.DEFAULT_RULES + ("exotic_combining",)
    assert cleaner.parse_rules(" bidi_control , html_entity ") == ("bidi_control", "html_entity") and cleaner.parse_rules("") == cleaner.DEFAULT_RULES
    for wrong in ("nothing", ["all", "nothing"]):
        with pytest.raises(ValueError):
            cleaner.parse_rules(wrong)
    with pytest.raises(TypeError):
        cleaner.parse_rules(3)
    assert records.parse_checks("ALL") == records.CHECKS and records.parse_checks(["dedup"]) == ("dedup",)
    with pytest.raises(TypeError):
        records.clean_record("text")
    with pytest.raises(ValueError):
        records.clean_record({}, meta_detail="x")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ATOMS), max_size=30).map("".join))
def test_cleaner_invariants(text):
    made_ = cleaner.Cleaner()
    cleaned, edits = made_(text)
    assert all(0 <= k < len(text) for k in edits) and "\n\n\n" not in cleaned and not re.search(r"[ \t](\n|\Z)", cleaned)
    owners = set(cleaner.single_owners(cleaner.DEFAULT_RULES)) - {"\u2028", "\u2029"}
    assert not owners & set(cleaned)
    assert "".join(edits[i][1] if i in edits else c for i, c in enumerate(text)) == cleaned
    spans = cleaner.spans("f", text, edits)
    assert sum(s["count"] for s in spans) == len(edits) == sum(s["end"] - s["start"] for s in spans)


@pytest.mark.parametrize(
    "text, hits",
    [
        ("Ã©" * 2, {}),
        ("Ã©" * 3, {"cp1252": 6}),
        ("Ã©" * 5, {"double_enc": 10, "cp1252": 10}),
        ("=" * 7, {}),
        ("=" * 8, {"math_symbol_flood": 8}),
        ("a\n\u00a0\nb", {}),
        ("锛", {}),
        ("锛鐨", {"seq": 2}),
        ("锛\n鐨", {}),
        ("x�", {"fffd": 1}),
        ("\u200bx", {"zw_flood": 1, "conditional_zw": 1}),
        ("\ufeffx", {"zw_flood": 1}),
        ("\ue000" * 4 + "x", {}),
        ("\ue000" * 5 + "x", {"pua": 5}),
        ("&amp;\u0378", {"html_entity": 5, "cscn": 1}),
    ],
)
def test_mojibake(text, hits):
    found = mojibake.Detector().counts(text)
    found.pop("control_format_flood", None)
    assert found == hits


def test_mojibake_hits():
    d = mojibake.Detector()
    hit = d.hits("ok\nx�y\n")[0]
    assert hit["offset"] == [3, 7] and hit["detail"]["fffd"] == {"hit_num": 1, "hit_ratio": 0.25, "hit_positions": "0100"} and hit["detail"]["seq"]["hit_positions"] is None
    assert list(hit["detail"]) == list(mojibake.RULES)
    assert "cscn" not in mojibake.Detector(unassigned=False).hits("�")[0]["detail"]
    assert mojibake.Detector(thresholds={"pua": 1}).counts("\ue000") == {"pua": 1}
    assert mojibake.script_share("ab اب") == 0.5 and mojibake.has_complex_script("ཀ") and not mojibake.has_complex_script("a")
    assert mojibake.is_exotic_combining("\u1ab0") and mojibake.is_combining_mark("\u0301") and not mojibake.is_combining_mark("\ufe0f")


def test_repetition():
    ten, flood = records.check_record({"content": "ha " * 100}, "repetition")["issues"]
    assert ten.startswith("repetition_ngram:10gram msg[0] ratio=1.00 repeated=91/91 top='ha ha") and ten.endswith("x91")
    assert flood == "repetition_ngram:token_flood msg[0] token='ha' ratio=1.00 (100/100 tokens)"
    assert records.check_record({"content": "\n".join(f"{i}." for i in range(1, 41))})["issues"] == ["repetition_ngram:runaway_enum msg[0] consecutive=40 total_enum=40/40 lines"]
    mixed = "\n".join(x for i in range(22) for x in (f"({i})", "text"))
    assert repetition.runaway_enum(mixed)["kind"] == "enum_share"
    counter = " ".join(f"item {i} is listed in the ledger under the heading of all that is" for i in range(40))
    assert repetition.repeated_ngrams(counter)["kind"] == "runaway_enum"
    assert repetition.tokens("ab你好 c。 。") == ["ab", "你", "好", "c。"] and repetition.visible("<think>x</think> y ") == "y"
    chat = {"messages": [{"role": "user", "content": "ha " * 100}, {"role": "assistant", "content": "ha " * 100}]}
    assert "msg[1]" in repetition.check_messages(chat, repetition.token_flood) and repetition.check_messages(chat, repetition.runaway_enum) is None


def squares_by_expression(text, long_unit):
    """Back-referencing expressions that say what tandems() computes."""
    short = max(min(len(text) // 3, long_unit), 1)
    out = [(m.start(), len(m[1])) for m in re.finditer(rf"(?s)(.{{1,{short}}}?)\1\1", text)]
    if len(text) >= long_unit:
        out += [(m.start(), len(m[1])) for m in re.finditer(rf"(?s)(.{{{long_unit},{max(len(text) // 2, long_unit)}}}?)\1", text)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n", max_size=60), st.integers(1, 8))
def test_tandems(text, long_unit):
    import numpy as np

    codes, n = np.frombuffer(text.encode("utf-32-le"), np.uint32), len(text)
    found = subdup.tandems(codes, 1, max(min(n // 3, long_unit), 1), 3)
    if n >= long_unit:
        found += subdup.tandems(codes, long_unit, max(n // 2, long_unit), 2)
    assert found == squares_by_expression(text, long_unit)


def test_subdup():
    found = lambda text, lang: [(f["offset"], f["score"], f["info"]["repeat_text_offset"], f["info"]["char_len"], f["info"]["word_len"]) for f in subdup.detect(text, lang)]
    assert found("你好吗" * 4, "cn") == [] and found("你好吗" * 5, "cn") == [([3, 15], 5, [0, 3], 3, 0)]
    assert found("foo bar " * 5, "en") == [([8, 40], 5, [0, 8], 6, 2)] and found("foo bar " * 4, "en") == []
    assert found("foo bar " * 5 + "goes on", "en") == [([0, 32], 5, [0, 8], 6, 2)]  # the last one leads on
    assert found("x. foo bar " + "foo bar " * 5 + "goes on", "en")[0][0] == [10, 50]
    assert found("你，好，" * 5, "cn") == [([3, 19], 5, [0, 4], 2, 0)]
    for quiet in ("```x```" + "foo bar " * 6, " song " + "foo bar " * 6, "a|b " * 6, "{x y} " * 6, "%d x " * 6, "hahahahahaha"):
        assert found(quiet, "en") == []
    assert found("abc" * 9, "cn") == [] and found("", "en") == []
    text = "x" * 9990 + " " + "foo bar " * 6
    assert [f[0] for f in found(text, "en")] == [[9998, 10038]]  # the second chunk sees it whole
    assert [subdup.chunk_shape(n) for n in (0, 9999, 10_000, 299_999, 300_000, 500_000, 800_000)] == [(10_000, 0)] * 2 + [(10_000, 1000)] * 2 + [(5000, 200), (3000, 100), (1000, 10)]
    assert subdup.repeated_phrases("no no no no no no") == {"no"} and subdup.repeated_phrases("a b c d e " * 3) == {"a b c d e"}
    assert subdup.pair_span(False, 5, 5, 3, 9) == [([3, 5], "src"), ([0, 3], "tgt")] and subdup.pair_span(False, 5, 5, 6, 9) == [([0, 3], "tgt")]
    assert subdup.pair_span(True, 5, 5, 3, 9) == [([3, 9], "content")] and subdup.pair_span(False, 0, 0, 0, 0) == [([0, 0], "src")] and subdup.pair_span(False, 5, 5, 1, 6) == [([1, 5], "src")]


def test_articles():
    quote = "this is a paragraph of some length that another comment repeats"
    text = f"<|start_of_articleid=3|>A cut title… \nBody\n<|start_of_comment_articleid=3|>{quote} once\n\n\nBob wrote:\n{quote} twice\nand an answer\n\nlast edited by {quote}<|end_of_comment_articleid=3|>"
    out = article.clean(text)
    assert out.startswith("<|start_of_articleid=3|>Body") and f"<ref id=1>Bob wrote:\n{quote} twice</ref>\nand an answer" in out and out.count("<ref") == 1
    assert article.clean("plain … text\n") == "plain … text\n"
    assert article.quotable(article.normal("https://x.y/" + "z" * 60), "https://x.y/" + "z" * 60) is False


def test_textops():
    assert textops.split_mix_paragraph("Mr. Smith paid 4.12, then left... OK!") == ["Mr. Smith paid 4.12,", "then left...", "OK!"]
    assert textops.split_mix_paragraph("One, two.", keep_delimiter=False) == ["One", "two"] and textops.split_mix_paragraph("") == []
    assert textops.replace_unicode_punct("，—…１") == ',' + " - " + "..." + '"' and textops.remove_unicode_punct("a，b") == "ab" and textops.remove_split_punct("a-b/c|d") == "abcd"
    assert textops.strip_accents("résumé") == "resume" and textops.remove_non_printing_char("a\n\x85b") == "ab" and textops.remove_unprintable("a\u200b\nb ") == "ab "
    assert textops.normalize(" Élan 12，x ") == "elan 00,x" and textops.normalize("  ") == "" and textops.slow_normalize_for_dedup("É 1，") == "é 0"
    assert textops.normalize_for_dedup("  A  B\n1。 ") == "a b0" and textops.remove_punctuation("end?! ") == "end?!" and textops.remove_punctuation("end?!") == "end"
    assert textops.normalize_spacing_for_tok('a(b). "x", 5 % 1 2') == 'a (b\\). "x,\\" 5\\% 1.2'
    assert textops.normalize_spacing_for_tok("1 2", "de") == "1,2" and textops.normalize_spacing_for_tok("« x »", "fr") == '"x"'


def test_records():
    assert records.language({"lang": "EN-us"}, "你" * 9) == "en" and records.language({"meta": {"lang": "zh"}, "lang": "en"}, "a") == "cn" and records.language({"lang": "de"}, "你a") == "cn"
    assert records.text_of({"content": 3, "text": ""}) == ("", "text") and records.text_of({}) == ("", "content")
    report = records.check_record({"text": "x &amp; y"}, "mojibake")
    assert report["failed"] and report["issue_types"] == ["mojibake"] and report["text_field"] == "text" and report["content_excerpt"] == "x &amp; y" and report["checks"] == ["mojibake"]
    assert report["issues"] == ["mojibake:hit_chars=5 rules=html_entity=5 offsets=[[0, 9]]"] and len(report["highlights"][0]["detail"]["chars"]) == 5
    both = records.clean_and_check({"content": "x &amp; y"})
    assert not both["quality"]["failed"] and both["record"]["content"] == "x  y"
    lines = records.LineCleaner(cleaner.RecordCleaner(("content",), cleaner.DEFAULT_RULES))
    assert lines(1, "{bad")["bad_json"] and lines(1, "{bad")["line"] == "{bad" and lines(1, "[1]")["line"] == "[1]" and lines(1, '{"n":1.10,"content":"é"}')["line"] == '{"n": 1.1, "content": "é"}'
    checker = records.LineChecker()
    assert checker(1, "[1]")["issue_types"] == ["worker_error"] and "issue_types" not in checker(1, "{bad") and not checker(1, "{}")["failed"]


def test_classes():
    assert cs.PY_SPACE == cs.ranges(p for p in range(0x110000) if chr(p).isspace())
    assert cs.UCD.digits == cs.ranges(p for p in range(0x110000) if re.match(r"\d", chr(p)))
    assert cs.union(cs.UCD.word, cs.chars("_")) == cs.ranges(p for p in range(0x110000) if re.match(r"\w", chr(p)))
    assert len(made(5)) == 5
