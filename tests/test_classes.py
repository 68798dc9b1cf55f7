"""Classes of many ranges, told by a tree."""

import re

import pytest
from pyspark.sql import functions as F

from textloom import charsets as cs


@pytest.mark.parametrize("cls", [cs.minus(cs.UCD.unprintable, cs.chars(" ")), cs.UCD.word, cs.UCD.digits])
def test_rare_classes(spark, cls):
    """No class asks many ranges in a row, and all characters are told as the ranges tell them."""
    written = cs.java_rare(cls)
    assert max(len(re.findall(r"\\x\{[0-9A-F]+\}|[\U00010000-\U0010FFFF]", c)) for c in re.findall(r"\[[^\]]*\]", written)) <= 20
    points = [p for p in [*range(0x3400), *range(0x3400, 0x110000, 7)] if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    told = {r.p for r in rows.where(F.col("c").rlike(written)).select("p").collect()}
    assert told == cs.points(cls) & set(points)
