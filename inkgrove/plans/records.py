"""Queries over raw records and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.operators.records import load_cells, load_records, rejected
from inkgrove.sources.tables import table


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_records(table(spark, d, "csv_records"), table(spark, d, "table_entries"), table(spark, d, "table_columns"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(_loaded(spark, d))


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid records' cells, as they load under their tables' headers."""
    return load_cells(table(spark, d, "csv_records"), table(spark, d, "table_entries"), table(spark, d, "table_columns"))


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    """Records by table and outcome."""
    loaded = _loaded(spark, d).select("entry_id", F.coalesce("reason", F.lit("valid")).alias("outcome"))
    return loaded.groupBy("entry_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p1_found": p1_found, "p1_rows": p1_rows, "p1_summary": p1_summary}

#: Every record with its reason and, where it is valid, its cells: each is a delimiter and a field.
_CHECKED = r"""
WITH spec AS (
  SELECT entry_id, list(kind ORDER BY column_index) AS kinds, list(required ORDER BY column_index) AS needed
  FROM table_columns GROUP BY entry_id
), body AS (
  SELECT r.raw_id, r.entry_id, r.line_no, regexp_replace(r.raw, '\r$', '') AS raw, coalesce(e.delimiter, ',') AS d, e.column_count, s.kinds, s.needed
  FROM csv_records r LEFT JOIN table_entries e USING (entry_id) LEFT JOIN spec s USING (entry_id)
), shaped AS (
  SELECT *, CASE WHEN d = '|' THEN '[|]' ELSE d END AS p, d || raw AS s FROM body
), cut AS (
  SELECT *, regexp_full_match(s, '(' || p || '("([^"]|"")*"|[^"' || d || '][^' || d || ']*|))*', 's') AS closed,
    list_transform(regexp_extract_all(s, p || '("([^"]|"")*"|[^"' || d || '][^' || d || ']*|)', 0, 's'), lambda x: x[2:]) AS quoted
  FROM shaped
), cells AS (
  SELECT *, list_transform(quoted, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS fields FROM cut
), checked AS (
  SELECT *, CASE
    WHEN raw IS NULL OR trim(raw, ' ') = '' THEN 'empty'
    WHEN NOT closed THEN 'quoting'
    WHEN len(fields) <> column_count THEN 'column_count'
    WHEN len(list_filter(list_zip(list_transform(fields, lambda x: trim(x, ' ')), kinds, needed), lambda c: CASE
      WHEN c[1] = '' THEN c[3]
      WHEN c[2] = 'integer' THEN NOT regexp_full_match(c[1], '[+-]?[0-9]+')
      WHEN c[2] = 'decimal' THEN NOT regexp_full_match(c[1], '[+-]?[0-9]+([.][0-9]+)?')
      WHEN c[2] = 'date' THEN NOT regexp_full_match(c[1], '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR try_cast(c[1] AS DATE) IS NULL
      WHEN c[2] = 'boolean' THEN c[1] NOT IN ('TRUE', 'FALSE')
      ELSE false END)) > 0 THEN 'invalid_value'
    END AS reason
  FROM cells
)
"""

SQL = {
    "p1_found": _CHECKED + "SELECT raw_id, reason FROM checked WHERE reason IS NOT NULL",
    "p1_summary": _CHECKED + "SELECT entry_id, coalesce(reason, 'valid') AS outcome, count(*) AS n FROM checked GROUP BY ALL",
    "p1_rows": _CHECKED
    + """, names AS (
  SELECT entry_id, h.value.column_index AS column_index, min(h.key) AS header
  FROM (SELECT entry_id, unnest(map_entries(headers)) AS h FROM table_entries) GROUP BY ALL
), flat AS (
  SELECT raw_id, entry_id, line_no, unnest(range(len(fields)))::INTEGER AS column_index, unnest(fields) AS value FROM checked WHERE reason IS NULL
)
SELECT raw_id, entry_id, line_no, column_index, coalesce(header, 'column_' || (column_index + 1)) AS header, value
FROM flat LEFT JOIN names USING (entry_id, column_index)""",
}
