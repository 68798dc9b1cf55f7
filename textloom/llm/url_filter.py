"""URL filter: host-suffix and path-prefix expressions, joined by short hash prefixes.

Each URL is expanded into the expressions that a rule could be written as: every suffix of
its host at a dot, with every prefix of its path that is as long as some rule's path.
Expressions meet rules in an equi-join on the first four bytes of a SHA-256 digest; the full
digest then confirms the match, and the longest rule wins. A rule whose path is longer than
MAX_PATH meets URLs by its first MAX_PATH characters and is then compared whole. All native: no user functions.

Defined results: a null URL, or one without ``://``, has an empty host and path and
fits no rule; a URL that no rule fits gets the default verdict, ``allow``. Rows of equal
page_id and URL are judged alike and all stay. Ties of equal length go to the longer host,
then to ``block``. An empty table, or an empty rule table, is fine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
#: Hex digits of the digest that the join runs on: four bytes.
SHORT = 8
#: An expression's path is at most this long, so a URL has a bounded number of them; the rest of a longer rule's path is compared with the URL's.
MAX_PATH = 2048
#: Rules are broadcast up to this many; a larger table is joined by a shuffle.
BROADCAST_RULES = 100_000


def lowered(host: Column) -> Column:
    """A host with A-Z lower-cased and every other character as it is."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: from there up to ``? #`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lowered(host), path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judged(pages: DataFrame, rules: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule and verdict for each row of pages.

    rules: verdict, host, path; its rows are de-duplicated, ``block`` first.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    digest = lambda host, path: F.sha2(F.concat_ws("\x00", host, path), 256)
    rules = rules.select("verdict", lowered(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).where("r_host is not null and r_path is not null")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))  # block > allow
    start = F.substring("r_path", 1, MAX_PATH)
    rules = rules.withColumn("digest", digest(F.col("r_host"), start)).withColumn("short", F.substring("digest", 1, SHORT))
    # bounded: a path has at most MAX_PATH lengths
    shape = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length(start))).alias("lengths")).first()
    lengths = F.array(*[F.lit(n) for n in shape["lengths"]]).cast("array<int>")
    host, path = host_and_path(F.col(url))
    df = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    # one row for each distinct host and path: what hot hosts repeat is expanded once
    urls = df.groupBy("host", "path").agg(F.lit(1).alias("_one")).drop("_one")
    dots = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.array_join(F.slice(dots, i, F.size(dots)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    made = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: digest(h, p))))
    digests = urls.select("host", "path", F.explode(made).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    few = F.broadcast(rules) if shape["n"] <= BROADCAST_RULES else rules
    hits = digests.alias("u").join(few.alias("r"), "short").where("u.digest = r.digest and startswith(u.path, r.r_path)")
    weight = F.struct((F.length("r_host") + F.length("r_path")).alias("both"), F.length("r_host").alias("on_host"), F.col("r_verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy("u.host", "u.path").agg(F.max(weight).alias("best"))
    df = df.join(best, ["host", "path"], "left")
    return df.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(DEFAULT)).alias("verdict"))
