"""Queries over training text and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.llm import boilerplate, langid, leakage, lookalike, pieces, scanfix, tokenise
from inkgrove.session import checked_broadcast
from inkgrove.sources.tables import table


def vocabulary_file(name: str) -> str:
    """Where the public tokenizers lie: the folder is a parameter (INKGROVE_TOKENIZERS)."""
    return os.path.join(os.environ.get("INKGROVE_TOKENIZERS", "/opt/tokenizers"), name)


def splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.judged_blocks(table(spark, d, "parse_results")).where("not main").select("parse_id", "block_no")


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each web page."""
    return boilerplate.main_bodies(table(spark, d, "parse_results"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scanfix.scan_noise(table(spark, d, "parse_results"))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every pdf result as continuous paragraphs with the printed words."""
    return scanfix.repaired_texts(table(spark, d, "parse_results"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut_kinds(table(spark, d, "parse_results"), table(spark, d, "provenance_spans"), table(spark, d, "size_limits"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "parse_results"), table(spark, d, "provenance_spans"), table(spark, d, "size_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    heads = lookalike.same_looking_headers(table(spark, d, "table_entries"), table(spark, d, "table_columns"), table(spark, d, "header_labels"))
    texts = lookalike.same_looking_pairs(table(spark, d, "parse_results"), "parse_id", "markdown")
    heads = heads.select(F.lit("header").alias("scope"), F.col("label_id").cast("bigint").alias("left_id"), F.col("column_id").alias("right_id"))
    return heads.unionByName(texts.select(F.lit("markdown").alias("scope"), "left_id", "right_id"))


def p5_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers in their consistent form."""
    heads = table(spark, d, "table_entries").select("entry_id", F.explode(F.map_entries("headers")).alias("h"))
    return heads.select("entry_id", F.col("h.value.column_index").alias("column_index"), lookalike.consistent_text(F.col("h.key")).alias("header"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode_corpus(table(spark, d, "documents"), vocabulary_file("byte_bpe_50k.tiktoken"), splitting_pattern())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """Where in the original text the leaked passages stand, one row a passage."""
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id", "first", "last")


def p7_by_suite(spark: SparkSession, d: str) -> DataFrame:
    """Affected documents and leaked items of each suite."""
    items = table(spark, d, "eval_items").select("item_id", F.coalesce("suite", F.lit("")).alias("suite"))
    return p7_found(spark, d).join(checked_broadcast(items, 1_000_000), "item_id").groupBy("suite").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("item_id").alias("items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = langid.language_segments(table(spark, d, "documents"), table(spark, d, "lang_codes"), only_doubtful=True)
    return found.where("lang is not null").select("doc_id", "seg_no", "lang")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """All documents' segments with their lines and confidence."""
    return langid.language_segments(table(spark, d, "documents"), table(spark, d, "lang_codes"))


QUERIES = {"p2_found": p2_found, "p2_bodies": p2_bodies, "p3_found": p3_found, "p3_texts": p3_texts, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_headers": p5_headers, "p6_ids": p6_ids, "p7_found": p7_found, "p7_passages": p7_passages, "p7_by_suite": p7_by_suite, "p8_found": p8_found, "p8_segments": p8_segments}

_LEAKS = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), wanted AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL
), passages AS (
  SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS p FROM wanted
), found AS (
  SELECT DISTINCT doc_id, item_id
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS p FROM words) JOIN passages USING (p)
)
"""

SQL = {
    "p4_found": r"""
WITH whole AS (
  SELECT parse_id, markdown, max_bytes, strlen(markdown) AS n FROM parse_results JOIN size_limits USING (doc_format) WHERE markdown IS NOT NULL
), ranges AS (SELECT DISTINCT parse_id, coalesce(span_no, -2) AS span_no, out_start, out_end FROM provenance_spans
), items AS (
  SELECT parse_id, -1 AS span_no, markdown AS item, max_bytes FROM whole WHERE parse_id NOT IN (SELECT parse_id FROM provenance_spans WHERE parse_id IS NOT NULL) AND n > max_bytes
  UNION ALL
  SELECT parse_id, span_no, decode(unhex(substr(hex(encode(markdown)), CAST(2 * out_start + 1 AS BIGINT), CAST(2 * (out_end - out_start) AS BIGINT)))) AS item, max_bytes
  FROM whole JOIN ranges USING (parse_id) WHERE 0 <= out_start AND out_start < out_end AND out_end <= n AND out_end - out_start > max_bytes
)
SELECT parse_id, span_no::INTEGER AS span_no, CASE WHEN list_max(list_transform(string_split_regex(regexp_replace(item, '([。！？])', '\1 ', 'g'), '[ \t\r\n]'), lambda x: strlen(x))) > max_bytes THEN 'hard' ELSE 'soft' END AS cut
FROM items
""",
    "p7_found": _LEAKS + "SELECT doc_id, item_id FROM found",
    "p7_by_suite": _LEAKS + "SELECT coalesce(suite, '') AS suite, count(DISTINCT doc_id) AS documents, count(DISTINCT item_id) AS items FROM found JOIN eval_items USING (item_id) GROUP BY 1",
}
