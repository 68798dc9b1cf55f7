"""DataFrame operators, sources, streams, SQL functions, the server and the command line."""

import json
import random
import threading
import time
import urllib.error
import urllib.request
import zipfile

import pytest
from pyspark.sql import functions as F

import textloom
from textloom import __main__ as command
from textloom import registry, serve
from textloom.kernels import article as article_kernel
from textloom.kernels import cleaner, mojibake as mojibake_kernel, records, subdup as subdup_kernel
from textloom.operators import article, clean, mojibake, quality, repetition, stats, subdup
from textloom.sources import jsonl, paths, xlsx
from textloom.streaming import streams

from .texts import made

TEXTS = [*made(150, seed=5), None, "", "foo bar " * 6, "你好吗" * 6, "clean text"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "en", "own") for i, t in enumerate(TEXTS)], "i long, text string, lang string, cleaning string").repartition(4).cache()


def test_clean(rows):
    want = {i: (None if t is None else cleaner.Cleaner()(t)[0]) for i, t in enumerate(TEXTS)}
    out = clean.clean(rows)
    assert out.columns == rows.columns and {r.i: r.text for r in out.collect()} == want
    full = clean.with_cleaning(rows, detail="both").collect()
    for r in full:
        if r.text is None:
            assert r.cleaning.cleaned is None and r.cleaning.change_count == 0
            continue
        _, edits = cleaner.Cleaner()(r.text)
        assert r.cleaning.change_count == len(edits) == sum(r.cleaning.rule_counts.values())
        assert [(s.rule, s.start, s.end, s.reasons) for s in r.cleaning.spans] == [(s["rule"], s["start"], s["end"], s["reasons"]) for s in cleaner.spans("text", r.text, edits)]
        assert [c.asDict() for c in r.cleaning.changes] == [{"field": "text", **c} for c in cleaner.changes(r.text, edits)]
    assert clean.clean(rows.where("false")).count() == 0
    with pytest.raises(ValueError):
        clean.cleaning(F.col("text"), detail="x")


def test_spans_by_two_ways(rows):
    changed = clean.changes(rows, "i")
    one = sorted((r.i, r.rule, r.start, r.end, r["count"], tuple(r.reasons)) for r in clean.grouped_spans(changed, "i").collect())
    assert one == sorted((r.i, r.rule, r.start, r.end, r["count"], tuple(r.reasons)) for r in clean.spans(rows, "i").collect())
    totals = {r.stat: r.n for r in stats.cleaning_statistics(clean.with_cleaning(rows, detail="none")).collect()}
    assert totals["total"] == len(TEXTS) and totals["changed_chars"] == changed.count() == sum(n for s, n in totals.items() if s.startswith("changed_") and s not in ("changed_chars", "changed_rows"))
    assert stats.codepoint_totals(changed).agg(F.sum("n")).first()[0] == totals["changed_chars"]


def test_mojibake(rows):
    d = mojibake_kernel.Detector()
    found = {r.i: r.h for r in rows.select("i", mojibake.hits(F.col("text")).alias("h")).collect()}
    for i, t in enumerate(TEXTS):
        assert [(h.offset, {k: v.asDict() for k, v in h.detail.items()}) for h in found[i]] == [(h["offset"], h["detail"]) for h in d.hits(t or "")]
    counts = {r.i: r.asDict() for r in mojibake.rule_counts(rows, "i").collect()}
    assert all({k: v for k, v in counts[i].items() if v and k != "i"} == {k: v for k, v in d.counts(t or "").items() if v} for i, t in enumerate(TEXTS))
    for i, t in enumerate(TEXTS):
        if t:
            got = sorted((r.line_no, r.start, r.end, r.window) for r in mojibake.windows(rows.where(F.col("i") == i), "i").collect()) if i < 12 else None
            assert got is None or "".join(x[3] for x in got) == t and all(t[a:b] == w for _, a, b, w in got)


def test_repetition(spark):
    texts = ["ha " * 100, "\n".join(f"{i}." for i in range(1, 41)), "a b c d e f g " * 20, "x", None, " ".join(f"w{i}" for i in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = {r.i: [(f.kind, f.repeated, f.total, f.top, f.reason) for f in r.f] for r in df.select("i", repetition.findings(F.col("text")).alias("f")).collect()}
    from textloom.kernels import repetition as k

    for i, t in enumerate(texts):
        want = [f for check in k.CHECKS if (f := check(t or ""))]
        assert found[i] == [(f["kind"], f["repeated"], f["total"], f["top"], k.reason(f)) for f in want]
    flags = {r.i: (r.ngram_flag, r.token_flood, r.runaway_enum) for r in repetition.flags(repetition.measures(df, "i")).collect()}
    assert flags == {i: (bool(k.ngrams(k.visible(t or ""), 10, 0.75) or k.ngrams(k.visible(t or ""), 5, 0.85)) and len(t or "") >= 200, bool(k.token_flood(t or "")), bool(k.runaway_enum(t or ""))) for i, t in enumerate(texts)}


def test_subdup(spark, rows):
    texts = [*TEXTS, "x" * 9990 + " " + "foo bar " * 6, ("新闻。" * 7 + "\n") * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for lang in ("en", "cn"):
        got = sorted((r.i, r.start, r.end, r.unit_start, r.unit_end, r.repeats, r.char_len, r.word_len) for r in subdup.findings(df, "i", lang=F.lit(lang)).collect())
        want = sorted((i, *f["offset"], *f["info"]["repeat_text_offset"], f["score"], f["info"]["char_len"], f["info"]["word_len"]) for i, t in enumerate(texts) for f in subdup_kernel.detect(t or "", lang))
        assert got == want and got
    cut = {r.i: r.text for r in subdup.deduplicated(df, "i", lang=F.lit("en")).collect()}
    for i, t in enumerate(texts):
        gone = {p for f in subdup_kernel.detect(t or "", "en") for p in range(*f["offset"])}
        assert cut[i] == (None if t is None else "".join(c for p, c in enumerate(t) if p not in gone))


def test_quality(rows):
    out = quality.reports(rows, "text", "lang").cache()
    checker = records.Checker()
    for r in out.collect():
        assert r.issues == checker(r.text or "", "en")[0] and r.failed == bool(r.issues) and json.loads(r.highlights) == json.loads(json.dumps(checker(r.text or "", "en")[1]))
    assert quality.passed(out).count() + quality.failed(out).count() == len(TEXTS)
    n = {r.stat: r.n for r in quality.statistics(out).collect()}
    assert n["total"] == len(TEXTS) == n["passed"] + n["failed"] and quality.top_issues(out, "i", 3).count() == 3


def test_articles(spark):
    quote = "this is a paragraph of some length that another comment repeats"
    texts = ["<|start_of_articleid=1|>t…\nx", f"<|start_of_comment_articleid=1|>{quote}\n\n{quote} too<|end_of_comment_articleid=1|>", None, "", "plain"]
    out = article.clean(spark.createDataFrame(list(enumerate(texts)), "i long, content string")).collect()
    assert {r.i: r.content for r in out} == {i: (None if t is None else article_kernel.clean(t)) for i, t in enumerate(texts)}


def test_jsonl(spark, tmp_path):
    raw = [json.dumps({"id": i, "content": t}, ensure_ascii=False) for i, t in enumerate(["a\u00a0b", "fine", "x &amp; y"] * 400)] + ["{bad", "[1]", '{"meta":"m","content":"\u200b"}', "ha " * 3]
    (tmp_path / "in.jsonl").write_text("\n".join(raw) + "\n", encoding="utf-8")
    source = str(tmp_path / "in.jsonl")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        numbered = {r.line_no: r.raw for r in jsonl.read_lines(spark, source).collect()}
        assert numbered == {i: x for i, x in enumerate(raw, 1)}
        summary = jsonl.clean_and_check_jsonl(spark, source, when="both", add_meta=True, max_examples=3)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    out = str(tmp_path / "in.cleaned.jsonl")
    assert summary["output"] == out and summary["stats"]["total"] == len(raw) and summary["stats"]["bad_json"] == 2 and summary["stats"]["changed_rows"] == 801 and summary["stats"]["meta_rows"] == 1201
    assert summary["issue_rows"][:3] == [1, 3, 4] and len(summary["examples"]) == 3 and set(summary["qc"]) == {"before", "after"}
    again = [r.value for r in spark.read.text(out).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()]
    made_ = records.LineCleaner(cleaner.RecordCleaner(("content",), cleaner.DEFAULT_RULES), True)
    assert sorted(again) == sorted(made_(i, x)["line"] for i, x in enumerate(raw, 1))
    parts = [p.read_text(encoding="utf-8") for p in sorted((tmp_path / "in.cleaned.jsonl").glob("part-*"))]
    assert len(parts) > 1 and "".join(parts).splitlines() == [made_(i, x)["line"] for i, x in enumerate(raw, 1)]
    check = jsonl.check_jsonl(spark, source, str(tmp_path / "qc"), failed_output=str(tmp_path / "failed"))
    assert check["stats"] == {"total": len(raw), "failed": 804, "passed": 400, "bad_json": 2, "issue_mojibake": 801, "issue_worker_error": 1} and check["issue_reasons"]["mojibake"] == 801
    assert spark.read.text(str(tmp_path / "in_filtered.jsonl")).count() == 400 and spark.read.text(str(tmp_path / "failed")).count() == 802
    assert jsonl.check_jsonl(spark, source, str(tmp_path / "qc2"), limit=5, write_passed=False)["stats"]["total"] == 5
    assert "".join(p.read_text() for p in sorted((tmp_path / "in_filtered.jsonl").glob("part-*"))).splitlines() == [x for x in raw if '"fine"' in x]
    assert not list((tmp_path / "qc").glob("_lines*")) and check["passed_output"].endswith("in_filtered.jsonl")
    dry = jsonl.clean_jsonl(spark, source, dry_run=True)
    assert dry["output"] == "" and dry["stats"]["changed_rows"] == 801
    with pytest.raises(ValueError):
        jsonl.clean_jsonl(spark, source, source)
    assert [*jsonl.stdin_lines([b"a\r\n", b"\xff\n"])] == ["a", "�"]


def test_lines_stay_where_they_lie(spark, tmp_path):
    """No line is shuffled: only what splits know is. Files of several sizes are out of order and sorted."""
    (tmp_path / "in.jsonl").write_text("".join(f'{{"content": "{i}"}}\n' for i in range(3000)))
    path = str(tmp_path / "in.jsonl")
    done = jsonl.read_lines(spark, path).select(jsonl.cleaned_line(F.col("line_no"), F.col("raw"))["line"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in plan and "BroadcastHashJoin" in plan and jsonl.in_order(spark, path)
    for name, n in (("a", 5), ("b", 900), ("c", 40)):
        (tmp_path / f"x-{name}.jsonl").write_text("".join(f'{{"content": "{name}{i}"}}\n' for i in range(n)))
    summary = jsonl.clean_jsonl(spark, str(tmp_path / "x-*.jsonl"), str(tmp_path / "many"))
    assert summary["stats"] == {"total": 945} and summary["examples"] == summary["issue_rows"] == []
    lines = "".join(p.read_text() for p in sorted((tmp_path / "many").glob("part-*"))).splitlines()
    assert lines == [f'{{"content": "{name}{i}"}}' for name, n in (("a", 5), ("b", 900), ("c", 40)) for i in range(n)]
    empty = tmp_path / "empty.jsonl"
    empty.write_text("")
    assert jsonl.clean_jsonl(spark, str(empty))["stats"] == {} and jsonl.check_jsonl(spark, str(empty), str(tmp_path / "e"))["stats"] == {}


def test_progress(spark, capsys):
    from textloom.progress import Progress

    with Progress(spark, 0.05):
        spark.range(0, 400, 1, 8).rdd.mapPartitions(lambda x: (time.sleep(0.2), x)[1]).count()
    told = capsys.readouterr().err
    assert "[progress] tasks=" in told and "eta=" in told


def test_standard_input(monkeypatch, capsys, tmp_path):
    import io
    import types

    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(b'{"content": "a &amp; b"}\r\n{bad\n')))
    assert command.run(command.parser().parse_args(["clean", "--input", "-", "--summary", str(tmp_path / "s.json")])) is None
    assert capsys.readouterr().out == '{"content": "a  b"}\n{bad\n'
    assert json.loads((tmp_path / "s.json").read_text())["stats"] == {"total": 2, "bad_json": 1, "changed_rows": 1}


def test_long_texts_are_cut_in_one_scan(spark):
    rnd = random.Random(2)
    for n in (0, 1, 8_999, 9_000, 9_999, 10_000, 10_001, 27_500, 310_000, 801_000):
        t = "".join(rnd.choices("ab \n😀é", k=n))
        df = spark.createDataFrame([(1, t)], "i long, text string")
        got = [(r.at, r.part) for r in subdup.chunks(df, "i").orderBy("chunk").collect()]
        assert got == [(at, part) for at, part in subdup_kernel.chunks(t)]
        lines = t.split("\n")
        starts = [sum(len(x) + 1 for x in lines[:k]) for k in range(0, len(lines), max(1, len(lines) // 50))]
        windows = {r.line_no: r.start for r in mojibake.windows(df, "i").collect()}
        assert [windows[k] for k in range(0, len(lines), max(1, len(lines) // 50))] == starts and len(windows) == len(lines)


def test_article_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/ars_1.jsonl").write_text('{"content":"<|start_of_articleid=1|>t…\\nx"}\n\n{"id":2}\n', encoding="utf-8")
    (tmp_path / "src/other.jsonl").write_text("{}\n")
    summary = jsonl.clean_articles(spark, str(tmp_path / "src"))
    assert summary["records"] == 2 and sorted(r[0] for r in spark.read.text(summary["output"]).collect()) == ['{"content": "<|start_of_articleid=1|>x"}', '{"id": 2, "content": ""}']


def book(path, rows):
    cell = lambda c, r, v: f'<c r="{c}{r}" t="s"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{c}{r}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>' if isinstance(v, str) else f'<c r="{c}{r}"><v>{v}</v></c>'
    sheet = "".join(f'<row r="{r}">' + "".join(cell("AB"[i], r, v) for i, v in enumerate(values)) + "</row>" for r, values in enumerate(rows, 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>content</t></si><si><r><t>a</t></r><r><t>\u200bb</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/styles.xml", "<styles/>")


def test_xlsx(spark, tmp_path):
    source = str(tmp_path / "in.xlsx")
    book(source, [[0, "other"], [1, "x\u200b"], ["fine", "y"], [2.5, "z"], ["p &amp;amp; q", "w"]])
    df = xlsx.read_xlsx(spark, source)
    assert df.columns == ["_row", "content", "other"] and [tuple(r) for r in df.orderBy("_row").collect()][0] == (2, "a\u200bb", "x\u200b")
    summary = xlsx.clean_xlsx(spark, source)
    assert summary["stats"] == {"total": 4, "changed_fields": 2, "changed_chars": 6, "changed_control_invisible": 1, "changed_html_entity": 5, "changed_rows": 2} and summary["issue_rows"] == [2, 5] and summary["sheet"] == "One"
    after = {r._row: (r.content, r.other) for r in xlsx.read_xlsx(spark, summary["output"], "One").collect()}
    assert after == {2: ("ab", "x\u200b"), 3: ("fine", "y"), 4: ("2.5", "z"), 5: ("p  q", "w")}
    assert zipfile.ZipFile(summary["output"]).read("xl/styles.xml") == b"<styles/>"
    with pytest.raises(ValueError):
        xlsx.clean_xlsx(spark, source, fields="none")
    assert xlsx.clean_xlsx(spark, source, dry_run=True, rules="bidi_control")["stats"] == {"total": 4}


def test_paths(tmp_path):
    assert paths.infer_format("a.JSONL") == "jsonl" and paths.infer_format("a", "xlsx") == "xlsx" and paths.default_output("/x/a.jsonl") == "/x/a.cleaned.jsonl" and paths.default_passed_output("/x/a") == "/x/a_filtered.jsonl"
    with pytest.raises(ValueError):
        paths.infer_format("a.csv")
    paths.write_summary({"é": 1}, str(tmp_path / "d/s.json"))
    assert (tmp_path / "d/s.json").read_text(encoding="utf-8") == '{\n  "é": 1\n}\n'


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"content":"x &amp; y"}\n{bad\n', encoding="utf-8")
    lines = streams.read_lines(spark, str(tmp_path / "in"))
    streams.start(streams.cleaned(lines), str(tmp_path / "out"), str(tmp_path / "cp"), "text").awaitTermination()
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"content": "x  y"}', "{bad"]
    seen = []
    streams.start(streams.checked(lines), "", str(tmp_path / "cp2"), each=lambda df, _: seen.extend(df.collect())).awaitTermination()
    assert sorted(r.failed for r in seen) == [True, True]


def test_sql_functions(spark, rows):
    names = registry.register(spark, "tl_")
    assert len(names) == len(set(names)) > 60
    row = spark.sql("select tl_clean_text('a&amp;b') a, tl_normalize_for_dedup('A 1') b, tl_clean_html_entity('&lt;x') c, tl_is_code('code::') d, tl_issue_type('a:b:c') e, tl_clean_text(null) f, tl_split_sentences('A b. Cd') g").first()
    assert tuple(row) == ("ab", "a 0", "x", True, "a", None, ["A b.", "Cd"])
    spans = spark.sql("select * from tl_rule_spans('x &amp; y', 'html_entity')").collect()
    assert [tuple(r) for r in spans] == [("html_entity", 2, 7, "delete", ["matched"])]
    row = spark.sql("select tl_check_text('x &amp; y', 'en').issue_types a, tl_repeated_passages(repeat('foo bar ', 5), 'en')[0].repeats b, tl_clean_text_by('a&amp;b<br>', 'html_entity') c, tl_char_infos('é')[0].name d, tl_repetition_reasons(repeat('ha ', 100))[0] e").first()
    assert (row.a, row.b, row.c, row.d) == (["mojibake"], 5, "ab<br>", "LATIN SMALL LETTER E WITH ACUTE") and "10gram" in row.e
    assert {r.name for r in spark.sql("select name from tl_textloom_rules where kind = 'rule' and not by_default").collect()} == {"combining_decoration", "exotic_combining"}
    # native functions say what the column forms say, and stay native
    rows.createOrReplaceTempView("tl_rows")
    native = registry.native_functions()
    some = ["clean_emoji_all", "clean_pua_contextual", "clean_combining_decoration", "mojibake_pua", "mojibake_math_symbol_flood", "remove_unprintable", "remove_punctuation", "text_language", "replace_unicode_punct"]
    told = spark.sql(f"select {', '.join(f'tl_{n}(text) {n}' for n in some)} from tl_rows")
    assert "Python" not in told._jdf.queryExecution().executedPlan().toString() and "Arrow" not in told._jdf.queryExecution().executedPlan().toString()
    assert told.collect() == rows.select(*[native[n](F.col("text")).alias(n) for n in some]).collect()


def test_server():
    made_ = serve.server(port=0, max_body=1000)
    threading.Thread(target=made_.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{made_.server_port}"

    def ask(path, payload=None):
        body = None if payload is None else payload if isinstance(payload, bytes) else json.dumps(payload).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, body)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert ask("/health")[1]["status"] == "ok" and ask("/v1/rules")[1]["default_cleaning_rules"][0] == "variation_selector" and ask("/x")[0] == 404
    record = {"content": "x &amp; y"}
    assert ask("/v1/clean", {"record": record, "add_meta": False})[1]["record"] == {"content": "x  y"}
    assert ask("/v1/check", {"record": record, "checks": "mojibake"})[1]["failed"] and not ask("/v1/clean-and-check", {"record": record})[1]["quality"]["failed"]
    assert ask("/v1/clean", {"record": 1})[0] == 400 and ask("/v1/clean", b"{")[0] == 400 and ask("/v1/clean", {"record": {}, "rules": "no"})[0] == 400 and ask("/v1/no", {"record": {}})[0] == 404
    assert ask("/v1/clean", {"record": {"content": "x" * 2000}})[0] == 400
    made_.shutdown()


def test_command_line(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"content":"x &amp; y"}\n', encoding="utf-8")
    args = command.parser().parse_args(["clean", "--input", str(tmp_path / "in.jsonl"), "--summary", str(tmp_path / "s.json"), "--qc", "after", "--rules", "html_entity"])
    assert command.run(args, spark)["stats"]["changed_html_entity"] == 5 and json.loads((tmp_path / "s.json").read_text())["rules"] == ["html_entity"]
    args = command.parser().parse_args(["check", "--input", str(tmp_path / "in.jsonl"), "--output-dir", str(tmp_path / "qc"), "--no-passed-output"])
    assert command.run(args, spark)["stats"]["failed"] == 1 and (tmp_path / "qc/summary.json").exists()
    assert textloom.clean_record({"content": "&amp;"})["record"]["content"] == "" and callable(textloom.check_record) and callable(textloom.clean_and_check)
