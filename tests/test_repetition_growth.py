"""Enumerations and n-grams without work for each line or n-gram in the JVM."""

import re

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import repetition as native
from textloom.kernels import repetition
from textloom.plans import queries

SMALL = "/root/testdata/sf0.001"


def test_enum_lines_are_not_taken_line_by_line(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(native.enum_lines(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    texts = ["1.\n 2. \n\n3.\nx\n4.\r\n(五)", "", "\n", "1.", "\ufdd1\n1.\n\ufdd1 2.", "1.\n\u2028\n2.", "1.\v\n１。\n第三、\n①", "1.\n" * 40 + "end"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", native.enum_lines(F.col("t")).alias("e")).collect():
        flags = [bool(re.fullmatch(repetition.ENUM_LINE, x)) for x in r.t.split("\n")]
        longest = max(map(len, re.findall("1+", "".join("01"[f] for f in flags))), default=0)
        assert (r.e.n_lines, r.e.marked, r.e.longest) == (len(flags), sum(flags), longest), r.t


def test_gram_counts():
    rng = np.random.default_rng(2)
    for n in (0, 3, 14, 15, 29, 30, 200):
        tokens = [int(x) for x in rng.integers(-4, 4, n)] if n % 2 else [7] * n
        for size, found in repetition.gram_counts([t * 0x123456789ABCDEF % 2**63 for t in tokens]).items():
            k = int(size[1:])
            grams = [tuple(tokens[i : i + k]) for i in range(n - k + 1)] if n >= 3 * k else []
            counts = [grams.count(g) for g in grams]
            assert found == {"total": len(grams), "repeated": sum(c > 1 for c in counts), "top_count": max(counts, default=0)}


def test_ngrams_are_not_sorted_in_the_jvm(spark):
    assert "sort_array" not in queries.QUERIES["rep_ngram_flag"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
