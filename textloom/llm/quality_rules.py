"""Quality rules: a threshold table compiled into one native Spark projection.

Nothing here leaves the JVM: a text becomes counts (length, symbols, stop words, lines)
by built-in functions, and each rule is a comparison of two counts, so the whole
table is one projection without a shuffle. No floating point is involved.

Defined results: a null or empty text has no words and fails the base rules; repeated
rows are judged alike; an empty table gives an empty result; columns of the input
other than those named are not read (``judge`` keeps them, see there).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, word_array

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The most frequent function words of the languages the corpus is written in.
STOP_WORDS = tuple(
    """the of and to in is it that for on with as was be at by this are or from an not but he they his her we you
    de la le et les des un une que qui en du pour dans est sur par au pas ce il elle ne se plus avec son
    der die und das von zu den mit ist nicht ein eine sich auf für im dem es als auch an werden aus
    el los las y lo con para una del al como más pero sus o este sí porque esta""".split()
)


@dataclass(frozen=True)
class Rule:
    """Keeps a text if left_factor * left <op> right_factor * right, on whole counts."""

    name: str
    left_factor: int
    left: str
    op: str
    right_factor: int
    right: str

    def passes(self) -> Column:
        a, b = self.left_factor * F.col(self.left), self.right_factor * F.col(self.right)
        return a <= b if self.op == "<=" else a >= b


#: The base rules reject short texts and texts that mostly repeat themselves.
BASE = (
    Rule("min_words", 1, "n_words", ">=", 50, "one"),
    Rule("repeated_words", 100, "n_repeat_words", "<=", 50, "n_words"),
)
#: The method's own table. Ratios of ordinary prose lie far inside every bound.
TABLE = (
    Rule("mean_word_min", 1, "word_chars", ">=", 2, "n_words"),
    Rule("mean_word_max", 1, "word_chars", "<=", 12, "n_words"),
    Rule("symbol_ratio", 10, "n_symbols", "<=", 1, "n_words"),
    Rule("exclamations", 5, "n_exclaims", "<=", 1, "n_words"),
    Rule("upper_ratio", 10, "n_upper", "<=", 3, "word_chars"),
    Rule("stop_words", 50, "n_stop_words", ">=", 1, "n_words"),
    Rule("duplicate_lines", 2, "n_dup_lines", "<=", 1, "n_lines"),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(text: Column, pattern: str) -> Column:
    """How many characters of a class a text has: by its length without their runs, so that neither few nor many make an array."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at these sorted starts."""
    steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of COUNTS and TABLE, as longs."""
    held = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", word_array(F.col(text))).withColumn("_n", F.size("_w"))
    # windows are compared by a 64-bit hash of their three words
    window = F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.withColumn("_h", F.when(F.col("_n") >= 3, F.slice(window, 1, F.col("_n") - 2)).otherwise(F.array().cast("array<bigint>")))
    marked = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), marked))
    twice = F.expr("filter(_s, (x, i) -> (i > 0 and get(_s, i - 1).h = x.h) or get(_s, i + 1).h = x.h)")
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    lines = F.filter(F.split(held, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = df.withColumn("_l", lines)
    stop = F.filter("_w", lambda w: F.btrim(F.lower(w), F.lit(".,;:!?\"'()*$&%#")).isin(*STOP_WORDS))
    made = {
        "one": F.lit(1),
        "n_words": F.col("_n"),
        "word_chars": F.length(F.concat_ws("", "_w")),
        "n_symbols": _count(held, f"[{SYMBOLS}]"),
        "n_exclaims": _count(held, "!"),
        "n_upper": _count(held, "[A-Z]"),
        "n_stop_words": F.size(stop),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(_covered(F.col("_p")), F.lit(0)),
    }
    # filters on counts must not move below, where each would expand to nested array functions: a generator stops them
    counts = F.array(F.struct(*[v.cast("long").alias(k) for k, v in made.items()]))
    return df.select(*docs.columns, F.inline(counts))


def judged(docs: DataFrame, base: tuple[Rule, ...] = BASE, table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the names of the failed rules, one row for each row of docs."""
    df = counted(docs.select("doc_id", "text"))
    holds = lambda rules: F.forall(F.array(*[r.passes() for r in rules]), lambda x: x) if rules else F.lit(True)
    failed = F.filter(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in base + table]), lambda x: x.isNotNull())
    return df.select("doc_id", *COUNTS, (~holds(base)).alias("base_failed"), holds(base + table).alias("kept"), failed.alias("failed_rules"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns they came with, whatever their names."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("text", F.col("row")["text"])
    df = counted(inner)
    passes = [r.passes() for r in BASE + TABLE]
    for p in passes:
        df = df.filter(p)
    return df.select("row.*")

