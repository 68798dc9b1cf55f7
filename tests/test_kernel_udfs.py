"""Kernels over columns: computed once, a few rows at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import kernel_udfs
from textloom.plans import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["mojibake_reports", "rule_totals", "codepoint_totals", "rule_spans", "provenance", "issue_types"])
def test_kernels_run_once(spark, name):
    """Filters on what a kernel tells, and generators over it, must not make Spark compute it a second time below them."""
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_kernel_takes_few_rows_at_a_time(spark):
    """No more rows than ROWS are Python objects at once, and results are sent as they grow."""
    seen = []
    call = kernel_udfs.kernel(lambda t: seen.append(t) or t * 1000, "string")
    call(F.lit("x"))
    sizes = [len(a) for a in call.udf(1).func(iter([pa.array(["x" * 100] * 300), pa.array([None, "y"])]))]
    assert len(sizes) > 2 and sum(sizes) == 302 and len(seen) == 301
    df = spark.range(5000).repartition(3).select("id", kernel_udfs.kernel(lambda i: i + 1, "long")(F.col("id")).alias("n"))
    assert df.where("n = id + 1").count() == 5000
