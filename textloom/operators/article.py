"""Articles with comments, over DataFrames.

Defined results: null texts stay null; texts without tags stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_truncated_titles
from ..kernels import article as k
from .kernel_udfs import kernel


def tag_comment_quotes(text: Column) -> Column:
    """Quotes of earlier comments wrapped as <ref id=N>; only texts that hold a comment block leave the JVM."""
    has_block = text.contains("<|start_of_comment_articleid=") & text.contains("<|end_of_comment_articleid=")
    return F.coalesce(kernel(k.tag_comment_quotes, "string")(F.when(has_block, text)), text)


def clean(df: DataFrame, column: str = "content") -> DataFrame:
    """df with cut-off titles gone and quotes tagged in a column."""
    text = F.col(f"`{column}`")
    return df.withColumn(column, tag_comment_quotes(F.when(text.isNotNull(), strip_truncated_titles(text))))
