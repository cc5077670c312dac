"""Queries over the training-data operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, langid, near_dedup, quality_rules, sentencepieces, substring_dedup, token_counts, toxicity, url_filter
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, span_no, start_char, end_char, lang, n_words): the language spans of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.spans(docs, langid.fit(docs))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that is a near or exact copy of one that stays."""
    return near_dedup.duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_grade_1, p_grade_2, severity) of every document that is rejected as toxic."""
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece_ids, n_pieces, decoded) of every document."""
    coded = sentencepieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), sentencepieces.read_model(), decoded=True)
    return coded.select("doc_id", "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_pieces"), "decoded")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_word, end_word, source_ids) of every passage that documents of lesser ids hold too."""
    return substring_dedup.repeats(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, statistics, rule_no, rule, keep) of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, content, n_lines, n_content_lines, threshold) of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, score, p_reject, rejected) of every page's URL."""
    return url_filter.score(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.read_ranks())


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_char, end_char, item_ids) of every span that holds benchmark phrases."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_near_dedup": op2_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_extraction": op7_html_extraction,
    "op8_url_filter": op8_url_filter,
    "op9_token_counts": op9_token_counts,
    "op10_decontaminate": op10_decontaminate,
}

#: Whole benchmark items as runs of words joined to the documents' runs. The others can't be said in SQL: each is tested against brute force, a library, round trips or held-out accuracy.
_OP10 = r"""WITH texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 1, item_id, text FROM benchmark WHERE item_id IS NOT NULL),
 runs AS (SELECT kind, id, row_number() OVER (PARTITION BY kind, id) AS copy, regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+') AS r FROM texts),
 cells AS (SELECT kind, id, copy, unnest(r) AS x, unnest(range(len(r))) AS k FROM runs),
 placed AS (SELECT *, sum(length(x)) OVER (PARTITION BY kind, id, copy ORDER BY k) AS stop FROM cells),
 words AS (SELECT kind, id, copy, lower(x) AS w, CAST(stop - length(x) AS BIGINT) AS b, CAST(stop AS BIGINT) AS e, row_number() OVER (PARTITION BY kind, id, copy ORDER BY k) AS p FROM placed WHERE regexp_matches(x, '^[\p{L}\p{N}\p{M}]')),
 ahead AS (SELECT kind, id, copy, p, b, lead(e, 4) OVER s AS e5, lead(e, 5) OVER s AS e6, lead(e, 6) OVER s AS e7, lead(e, 7) OVER s AS e8, count(*) OVER (PARTITION BY kind, id, copy) AS n,
   concat_ws(' ', w, lead(w, 1) OVER s, lead(w, 2) OVER s, lead(w, 3) OVER s, lead(w, 4) OVER s) AS g5, lead(w, 5) OVER s AS w6, lead(w, 6) OVER s AS w7, lead(w, 7) OVER s AS w8
   FROM words WINDOW s AS (PARTITION BY kind, id, copy ORDER BY p)),
 grams AS (SELECT kind, id, copy, p, b, z.size AS size, n, CASE z.size WHEN 5 THEN e5 WHEN 6 THEN e6 WHEN 7 THEN e7 ELSE e8 END AS e,
   CASE z.size WHEN 5 THEN g5 WHEN 6 THEN g5 || ' ' || w6 WHEN 7 THEN g5 || ' ' || w6 || ' ' || w7 ELSE g5 || ' ' || w6 || ' ' || w7 || ' ' || w8 END AS g FROM ahead, (SELECT unnest([5, 6, 7, 8]) AS size) z),
 phrases AS (SELECT DISTINCT id AS item, size, g FROM grams WHERE kind = 1 AND e IS NOT NULL AND g IS NOT NULL AND size = least(n, 8)),
 hits AS (SELECT d.id, d.copy, d.p AS first, d.p + d.size - 1 AS last, d.b, d.e, q.item FROM grams d JOIN phrases q ON d.g = q.g AND d.size = q.size WHERE d.kind = 0 AND d.e IS NOT NULL),
 marked AS (SELECT *, CASE WHEN first > max(last) OVER w + 1 OR b > max(e) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM hits WINDOW w AS (PARTITION BY id, copy ORDER BY first, last, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 spans AS (SELECT *, sum(fresh) OVER (PARTITION BY id, copy ORDER BY first, last, item) AS k FROM marked)
SELECT id AS doc_id, min(b) AS start_char, max(e) AS end_char, list(DISTINCT item ORDER BY item) AS item_ids FROM spans GROUP BY id, copy, k"""

ORACLES: dict[str, str] = {"op10_decontaminate": _OP10}
