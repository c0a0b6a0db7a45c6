"""The operators as named queries over the driver tables, whole tables and production parameters."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import licenses
from tessera.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, module: str, function: str) -> Query:
    """``function`` of an operator's module, applied to a whole table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"tessera.llm.{module}"), function)(table(spark, sf_dir, name))

    return run


def _decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": _on("documents", "tokencount", "token_counts"),
        "op2_language_id": _on("documents", "langid", "identify"),
        "op3_repeats": _on("documents", "repeats", "remove_repeats"),
        "op4_decontamination": _decontaminate,
        "op5_exact_topk": _on("embeddings", "topk", "top_k"),
        "op6_pii": _on("documents", "pii", "report"),
        "op7_license_scan": _on("documents", "licenses", "scan"),
        "op7_license_notices": _on("documents", "licenses", "notices"),
        "op8_source_mixing": _on("documents", "mixing", "mix_report"),
        "op9_main_text": _on("pages", "maintext", "extract"),
        "op10_near_duplicates": _on("documents", "neardup", "groups"),
    }


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


#: Shingles as texts; every pair that shares one is counted, and links are followed to the smallest document.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w
), e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS sh FROM s), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p WHERE 100 * c >= 75 * (na + nb - c) UNION ALL SELECT y, x FROM p WHERE 100 * c >= 75 * (na + nb - c)
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id AS doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY 1) ON s.doc_id = x
"""

#: All 200-byte strings by digest; bytes as pairs of hexadecimal digits.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT *, CAST(len(h) // 2 AS BIGINT) AS n FROM d), w AS (
  SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(n - 199)) AS p FROM n WHERE n >= 200)
), t AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1), g AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM t)
), r AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY 1, 2), k AS (
  SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY 1
)
SELECT n.doc_id AS doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(a) + 2), lambda i: substr(h, 2 * coalesce(b[i - 1], 0) + 1, 2 * (coalesce(a[i], n) - coalesce(b[i - 1], 0)))), '') END)) AS kept_sha256
FROM n LEFT JOIN k ON n.doc_id = k.doc_id
"""


def _main_text_sql() -> str:
    """For pages of the one form of the table: an article of headings and paragraphs with little markup."""
    t = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
    t = f"regexp_replace({t}, '<br ?/?>', ' ', 'g')"
    t = f"regexp_replace({t}, '</?(h[1-6]|p)( [^>]*)?>', chr(1), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        t = f"replace({t}, '&{name};', '{c}')"
    blocks = f"list_filter(list_transform(string_split({t}, chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
    return f"SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, url, array_to_string({blocks}, chr(10) || chr(10)) AS text FROM pages)"


def oracle_sql() -> dict[str, str]:
    return {"op3_repeats": REPEATS_SQL, "op5_exact_topk": TOPK_SQL, "op7_license_scan": licenses.oracle(), "op9_main_text": _main_text_sql(), "op10_near_duplicates": NEAR_SQL}
