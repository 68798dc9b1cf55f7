"""Noise tokens and floods."""

from pyspark.sql import functions as F

from textloom.functions import cleaning
from textloom.kernels import cleaner


def test_noise_in_and_out_of_fences(spark):
    df = spark.createDataFrame([("a b1111 b1111 b1111 b1111 b1111 c",), ("```b1111 b1111 b1111 b1111 b1111```",), ("",), (None,)], "t string")
    made = df.select("t", cleaning.repeated_noise_token(F.col("t")).alias("c"))
    assert [r.c for r in made.collect()] == [cleaner.Cleaner(("repeated_noise_token",))(r.t or "")[0] for r in df.collect()]


def test_floods_search_no_class():
    assert not hasattr(dict(cleaner.SPAN_RULES)["math_symbol_flood"](), "pattern")
    assert cleaner.clean_text("a====b###|||||", ("math_symbol_flood",))[0] == "ab###"
