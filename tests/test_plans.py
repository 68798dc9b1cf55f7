"""Every query that SQL can say, against SQL."""

import decimal
import hashlib
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textloom.operators import subdup
from textloom.plans import oracles, queries
from textloom.plans.noise import NOISES

from . import plain as plain_

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SMALL}/{f}')")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in oracles.ORACLES:
        assert got and (name in PLAIN or name == "clean_text_full")  # the last is held against the kernel's invariants and clean_all_rules against SQL
        return
    found = sql.execute(oracles.ORACLES[name])
    named = [d[0] for d in found.description]
    assert sorted(named) == columns
    order = [named.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


#: Queries that SQL can't say, each held row for row against tests/plain.py below.
PLAIN = ("subdedup_en", "subdedup_cn", "subdedup_cut", "article_quotes", "qc_stats", "issue_types")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("name, lang", [("subdedup_en", "en"), ("subdedup_cn", "cn")])
def test_passages_by_row(spark, docs, name, lang):
    shown = [(r.doc_id, r.text) for r in docs]
    if lang == "cn":
        shown = [(d, t.replace(*NOISES["han"][0])) for d, t in shown]
    want = sorted((d, *f) for d, t in shown for f in plain_.passages(t, lang))
    cols = ["doc_id", "start", "end", "unit_start", "unit_end", "repeats", "char_len", "word_len", "is_special"]
    assert sorted(map(tuple, queries.QUERIES[name](spark, SMALL).select(cols).collect())) == want and want


def test_han_passages_by_row(spark):
    """Texts made to repeat, in both languages, with and without paragraphs that lead on."""
    rnd = random.Random(7)
    units = ["你好吗", "你，好！", "天", "foo bar ", "word ", "* item\n", "ha ", "一 二\n", "|你好", "a b c d e f. "]
    texts = ["".join(rnd.choice(["前文。", "Lead in. ", "", "\n"]) + rnd.choice(units) * rnd.randrange(1, 8) + rnd.choice(["后文", "goes on", "", "\n\n", "。"]) for _ in range(rnd.randrange(1, 4))) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for lang in ("en", "cn"):
        found = subdup.findings(df, "doc_id", lang=F.lit(lang)).drop("lang").collect()
        want = sorted((i, *f) for i, t in enumerate(texts) for f in plain_.passages(t, lang))
        assert sorted(map(tuple, found)) == want and len(want) > 20


def test_cut_by_row(spark, docs):
    want = []
    for r in docs:
        t = plain_.cut(r.text, [f[:2] for f in plain_.passages(r.text, plain_.language(r.text))])
        want.append((r.doc_id, len(t), md5(t)))
    assert sorted(map(tuple, queries.QUERIES["subdedup_cut"](spark, SMALL).select("doc_id", "n_chars", "text_md5").collect())) == sorted(want)


def test_quotes_by_row(spark):
    turns = {}
    for r in sorted(spark.read.parquet(f"{SMALL}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append(re.sub(r"\n\n+", "\n", r.text))
    want = []
    for conv, texts in turns.items():
        body = plain_.quotes("\n\n".join(f"{t}\n\nsomeone wrote:\n{t}" for t in texts))
        out = f"<|start_of_articleid={conv}|>Body\n<|start_of_comment_articleid={conv}|>{body}<|end_of_comment_articleid={conv}|>"
        want.append((conv, len(re.findall("<ref id=[0-9]+>", out)), md5(out)))
    got = queries.QUERIES["article_quotes"](spark, SMALL).select("conv_id", "n_quotes", "out_md5").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(x[1] for x in want) > 50


def test_check_counters_by_row(spark, sql, docs):
    """Repetition by SQL, mojibake by SQL's counts on the texts as they are, passages by the plain form."""
    repeated = {r[0] for r in sql.execute(oracles.ORACLES["repetition_findings"]).fetchall()}
    by_kind = {}
    for r in sql.execute(oracles.ORACLES["repetition_findings"]).fetchall():
        by_kind.setdefault(r[0], []).append("repetition_ngram")
    garbled = oracles.ORACLES["moji_full_report"].replace(oracles.noisy_sql("text", *queries.MOJIBAKE_NOISE), "text")
    garbled = {r[0] for r in sql.execute(garbled).fetchall()}
    stat, cube = Counter(), Counter()
    kinds = {}
    for r in docs:
        types = (["mojibake"] if r.doc_id in garbled else []) + by_kind.get(r.doc_id, [])
        if next(iter(plain_.passages(r.text, plain_.language(r.text, r.lang))), None):
            types.append("sub_dedup_continuous")
        stat.update(["total", "failed" if types else "passed", *(f"issue_{t}" for t in types)])
        for lang in (r.lang, None):
            for source in (r.source, None):
                cube[lang, source] += len(types)
                kinds.setdefault((lang, source), set()).update(types)
    assert {r.stat: r.n for r in queries.QUERIES["qc_stats"](spark, SMALL).collect()} == dict(stat) and repeated
    got = {(r.lang, r.source): (r.n, r.n_types) for r in queries.QUERIES["issue_types"](spark, SMALL).collect()}
    assert got == {k: (n, len(kinds[k])) for k, n in cube.items() if n}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(oracles.ORACLES) <= set(queries.QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_is_pruned(spark):
    plan = queries.flagship(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1 and "ReadSchema: struct<url:string,html:string>" in plan
