"""The queries of the training-data operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extract, line_dedup, mixing, near_dedup, quality_rules, sharding, substring_dedup, token_files, url_filter
from .common import dealt, table


#: The contract of op8: 3-word shingles, similarity 0.85.
SHINGLE_WORDS, SHINGLE_PERCENT = 3, 85


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(dealt(table(spark, sf_dir, "documents")), digest=True)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(dealt(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(dealt(table(spark, sf_dir, "documents"))).withColumn("failed_rules", F.array_join("failed_rules", ","))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(dealt(table(spark, sf_dir, "documents")), SHINGLE_WORDS, SHINGLE_PERCENT)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"), digest=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_extract": op4_html_extract,
    "op5_url_filter": op5_url_filter,
    "op6_token_files": op6_token_files,
    "op7_sharding": op7_sharding,
    "op8_near_dedup": op8_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWERED = f"translate(coalesce(text, ''), '{quality_rules.UPPER}', '{quality_rules.UPPER.lower()}')"
_BLANK = r"[\x20\x09-\x0D]"


def _least(rule: quality_rules.Rule) -> str:
    return f"{rule.left_factor} * {rule.left} {rule.op} {rule.right_factor} * {rule.right}"


def _quality_sql() -> str:
    """The rule tables as SQL over the same counts."""
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    count = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    failed = ", ".join(f"CASE WHEN NOT ({_least(r)}) THEN '{r.name}' END" for r in quality_rules.BASE + quality_rules.TABLE)
    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_BLANK}+', '', 'g') <> '') AS l FROM w),
        g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2))) AS g, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
        m AS (SELECT w.doc_id, 1 AS one, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({count(quality_rules.SYMBOLS)})::BIGINT AS n_symbols, {count("!")} AS n_exclaims,
            {count(quality_rules.UPPER)} AS n_upper, len(list_filter(w, lambda x: trim(lower(x), '.,;:!?"''()*$&%#') IN ({stop}))) AS n_stop_words, len(l) AS n_lines,
            (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({" AND ".join(_least(r) for r in quality_rules.BASE)}) AS base_failed,
            {" AND ".join(_least(r) for r in quality_rules.BASE + quality_rules.TABLE)} AS kept, concat_ws(',', {failed}) AS failed_rules FROM m"""


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)

#: The files, the extraction, the tilings, the ring and the knapsack are not for SQL; the tests hold those operators against plain Python.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) AS g, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13),
        m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op3_quality_rules": _quality_sql(),
    "op5_url_filter": rf"""WITH r (verdict, r_host, r_path) AS (VALUES {_RULES}),
        u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), '{quality_rules.UPPER}', '{quality_rules.UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        b AS (SELECT n, arg_max(r_host || r_path, length(r_host || r_path) * 1000 + length(r_host)) AS rule, arg_max(verdict, length(r_host || r_path) * 1000 + length(r_host)) AS verdict
            FROM h JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, '{url_filter.DEFAULT}') AS verdict FROM h LEFT JOIN b USING (n)""",
    "op8_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWERED)} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE_WORDS} THEN [hash(w)]
            ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: hash(list_slice(w, i, i + {SHINGLE_WORDS - 1})))) END AS s FROM w),
        x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p WHERE 100 * c >= {SHINGLE_PERCENT} * (n + m - c)),
        both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
        top AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN top USING (doc_id)""",
    "op9_line_dedup": rf"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM l),
        k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{quality_rules.UPPER}', '{quality_rules.UPPER.lower()}') AS k FROM x),
        c AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= {line_dedup.MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
        o AS (SELECT doc_id, count(*) AS n, count(*) FILTER (last IS NULL OR last = doc_id) AS stays, string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR last = doc_id) AS kept FROM k LEFT JOIN c USING (k) GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_lines, (n - stays)::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM o""",
}
