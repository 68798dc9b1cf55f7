"""The detector's lines and counts without positions, and reports without highlights."""

from pyspark.sql import functions as F

from textloom.kernels import mojibake as mojibake_kernel
from textloom.kernels import records
from textloom.operators import mojibake, quality


def test_line_counts_are_those_of_hits(spark):
    texts = ["z�z\n\n​wä¸ 锛鐨\n \u0085 \n========== x", "plain", "", None, "锛鐨\n锛", "" * 4 + "&amp;", "Ã©" * 6 + "\nÂ£"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", mojibake.hits(F.col("text")).alias("h"), mojibake.line_counts(F.col("text")).alias("c"))
    for r in df.collect():
        assert [(c.start, c.end, {x.rule: x.n for x in c.rules}) for c in r.c] == [(h.offset[0], h.offset[1], {k: v.hit_num for k, v in h.detail.items() if v.hit_num}) for h in r.h]


def test_reports_without_highlights(spark):
    df = spark.createDataFrame([(1, "a�b"), (2, "ab"), (3, "lorem " * 9)], "i long, text string")
    full, bare = ({r.i: r for r in quality.reports(df, "text", highlights=h).collect()} for h in (True, False))
    assert all(bare[i].issues == full[i].issues and bare[i].issue_types == full[i].issue_types and bare[i].highlights is None for i in full)
    made = records.Checker(highlights=False)
    assert made("a�b", "en") == (records.Checker()("a�b", "en")[0], [])


def test_detector_looks_each_character_up_once(monkeypatch):
    d = mojibake_kernel.Detector()
    seen = []
    monkeypatch.setattr(mojibake_kernel, "_within", lambda cls, p, f=mojibake_kernel._within: seen.append((cls, p)) or f(cls, p))
    d.counts("é中�" * 500)
    n = len(seen)
    d.counts("é中�" * 500)
    assert len(seen) == n < 100
