"""Queries that parse: containers are built from the tables' rows and read back, so SQL knows the result."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.functions.detect import format_column
from inkgrove.functions.text import absolute
from inkgrove.operators import corpus, engine
from inkgrove.session import checked_broadcast, ship, spread
from inkgrove.sources import generate as g
from inkgrove.sources.tables import table

#: Rows of a generated file: files are cut by key, so none grows with the table.
FILE_ROWS = 500


def built(make, *columns: Column) -> Column:
    """Bytes that a function makes of each row's values."""

    @F.pandas_udf(T.BinaryType())
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([bytes(make(*row)) for row in zip(*series)])

    return run(*columns)


def files_of(df: DataFrame, key: str, columns: list[str], rows: int = FILE_ROWS) -> DataFrame:
    """file_no, rows (sorted array of structs): a table cut into files of so many keys."""
    body = F.array_sort(F.collect_list(F.struct(*columns)))
    return df.groupBy(F.floor(F.col(key) / rows).cast("bigint").alias("file_no")).agg(body.alias("rows"))


def _csv_files(spark: SparkSession, d: str, name: str, key: str, columns: list[str], delimiter: str = ",", rows: int = FILE_ROWS) -> DataFrame:
    ship(spark)
    make = lambda body: g.csv_file([columns, *[[r[c] for c in columns] for r in body]], delimiter)
    files = files_of(table(spark, d, name), key, columns, rows)
    return files.select("file_no", F.concat(F.lit(f"{name}-"), F.col("file_no"), F.lit(".csv")).alias("source"), built(make, F.col("rows")).alias("content"))


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def csv_round_trip(spark, d):
    parsed = engine.parse(_csv_files(spark, d, "customer", "c_custkey", CUSTOMER), doc_id="file_no", limit=10**9)
    return engine.table_cells(parsed).select(F.col("doc_id").cast("bigint").alias("file_no"), F.col("row_no").cast("bigint").alias("row_no"), "header", "value")


def csv_row_range(spark, d):
    parsed = engine.parse(_csv_files(spark, d, "part", "p_partkey", ["p_partkey", "p_name", "p_brand"], ";"), doc_id="file_no", rows="10:20")
    return engine.table_cells(parsed).select(F.col("doc_id").cast("bigint").alias("file_no"), F.col("row_no").cast("bigint").alias("row_no"), "header", "value")


def csv_limit_columns(spark, d):
    parsed = engine.parse(_csv_files(spark, d, "part", "p_partkey", ["p_partkey", "p_name", "p_brand"], "|"), doc_id="file_no", offset=3, limit=7, columns=["p_brand"])
    return engine.table_cells(parsed).select(F.col("doc_id").cast("bigint").alias("file_no"), F.col("row_no").cast("bigint").alias("row_no"), "header", "value")


def csv_entries(spark, d):
    """Declared shape of previewed files: range, delimiter, rows shown, warning."""
    parsed = engine.parse(_csv_files(spark, d, "part", "p_partkey", ["p_partkey", "p_name", "p_brand"], "\t"), doc_id="file_no")
    t = engine.tables(parsed)
    return t.select(F.col("doc_id").cast("bigint").alias("file_no"), F.col("range").alias("cell_range"), "delimiter", "column_count", F.col("row_range.first_row").alias("first_row"), F.col("row_range.last_row").alias("last_row"), "truncated", F.array_join("warnings", ";").alias("warnings"))


def csv_markdown(spark, d):
    parsed = engine.parse(_csv_files(spark, d, "orders", "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"], rows=4800), doc_id="file_no", mode="document")
    return parsed.select(F.col("doc_id").cast("bigint").alias("file_no"), F.md5("markdown").alias("markdown_md5"), F.col("stats.output_bytes").alias("output_bytes"))


def csv_markdown_tables(spark, d):
    """Tables of CSV files as Markdown again, heads in column order."""
    parsed = engine.parse(_csv_files(spark, d, "part", "p_partkey", ["p_partkey", "p_name", "p_brand"]), doc_id="file_no", limit=10**9)
    return corpus.tables_markdown(parsed).select(F.col("doc_id").cast("bigint").alias("file_no"), F.md5("markdown").alias("markdown_md5"))


def xlsx_round_trip(spark, d):
    """Typed cells of suppliers: whole numbers, decimals, texts, truth values and days."""
    ship(spark)

    def make(rows):
        body = [[int(r["s_suppkey"]), r["s_name"], float(r["s_acctbal"]), bool(r["s_acctbal"] > 0), ("date", 45000 + int(r["s_nationkey"]))] for r in rows]
        return g.xlsx({"Suppliers": [["key", "name", "balance", "positive", "checked"], *body], "Empty": []})

    files = files_of(table(spark, d, "supplier"), "s_suppkey", ["s_suppkey", "s_name", "s_acctbal", "s_nationkey"])
    files = files.select("file_no", F.lit("s.xlsx").alias("source"), built(make, F.col("rows")).alias("content"))
    parsed = engine.parse(files, doc_id="file_no", limit=10**9)
    return engine.table_cells(parsed).select(F.col("doc_id").cast("bigint").alias("file_no"), F.col("row_no").cast("bigint").alias("row_no"), "header", "value")


def xlsx_header_detection(spark, d):
    """Workbooks with a title and a note above the header, one a region."""
    ship(spark)

    def make(region, rows):
        body = [[int(r["n_nationkey"]), r["n_name"], r["n_name"].lower()] for r in rows]
        return g.xlsx({"Cover": [["only", "this"], ["a", "b"]], region: [[f"Nations of {region}"], [None, "checked", "twice"], [], ["Key", "Name", "Lower"], *body]})

    n, r = table(spark, d, "nation"), table(spark, d, "region")
    files = n.join(checked_broadcast(r, 1000), n.n_regionkey == r.r_regionkey).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    files = files.select(F.col("r_regionkey").alias("region_key"), F.lit("r.xlsx").alias("source"), built(make, F.col("r_name"), F.col("rows")).alias("content"))
    t = engine.tables(engine.parse(files, doc_id="region_key"))
    return t.where("table_no = 1").select(
        F.col("doc_id").cast("bigint").alias("region_key"), "sheet", "title", "header_row", F.col("range").alias("cell_range"), F.col("preamble.row").alias("note_row"),
        F.col("row_range.first_row").alias("first_row"), F.col("row_range.last_row").alias("last_row"), F.array_join("workbook_sheets", ",").alias("sheets"),
    )


def _items(spark, d):
    """item_id, text: the words of every document that has some, as no format has marks for them."""
    ship(spark)
    words = F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 .,]+", " "), " +", " "))
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), words.alias("text")).where("text <> ''")


#: The same in SQL.
ITEMS = "(SELECT doc_id AS item_id, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 .,]+', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents WHERE trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 .,]+', ' ', 'g'), ' +', ' ', 'g')) <> '')"


def _rendered(spark, d, make, source: str, **options) -> DataFrame:
    """item_id, markdown of containers made of the test items."""
    items = _items(spark, d).select("item_id", F.lit(source).alias("source"), built(make, F.col("item_id"), F.col("text")).alias("content"))
    return engine.parse(spread(items), doc_id="item_id", **options)


def _out(parsed):
    return parsed.select(F.col("doc_id").cast("bigint").alias("item_id"), "format", "markdown")


def html_render(spark, d):
    def make(i, t):
        return f"<html><body><nav>skip</nav><article><h1>Item {i}</h1><p><b>Start<br><p>{t}<p>{t[:20].strip()} <a href='../x?q=1'>more</a></p><table><tr><th>a<th>b<tr><td>{i}<td>x|y</table></article></body></html>".encode()

    return _out(_rendered(spark, d, make, "https://site.example/a/b/page.html"))


def docx_render(spark, d):
    make = lambda i, t: g.docx([("h", 2, f"Item {i}"), ("p", t), ("list", "first"), ("list", "second"), ("table", [["a", "b"], [str(i), "x|y"]]), ("image", "one.png")], {"one.png": b"\x89PNG"})
    return _out(_rendered(spark, d, make, "i.docx"))


def pptx_render(spark, d):
    make = lambda i, t: g.pptx([{"texts": [f"Item {i}", t], "table": [["a", "b"], [str(i), "y"]], "notes": ["said"]}, {"texts": ["end"], "images": ["one.png"]}], {"one.png": b"\x89PNG"})
    return _out(_rendered(spark, d, make, "i.pptx"))


def epub_render(spark, d):
    return _out(_rendered(spark, d, lambda i, t: g.epub([f"<h1>Item {i}</h1><p>{t}</p>", "<ol><li>one</li><li>two</li></ol>"]), "i.epub"))


def ipynb_render(spark, d):
    return _out(_rendered(spark, d, lambda i, t: g.notebook([("markdown", f"# Item {i}"), ("code", f"x = {i}\nprint(x)"), ("raw", "no"), ("markdown", t)]), "i.ipynb"))


def pdf_render(spark, d):
    """Two pages an item with page provenance: one row a page."""

    def make(i, t):
        words = t.split()
        lines = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
        return g.pdf([[(50, 60 + 12 * k, x) for k, x in enumerate(lines)], [(50, 60, f"Item {i}")]], height=792 + 12 * len(lines))

    parsed = _rendered(spark, d, make, "i.pdf", provenance="page")
    return engine.pages(parsed).select(F.col("doc_id").cast("bigint").alias("item_id"), "page", F.regexp_replace("text", r"\s+", " ").alias("words"))


def pdf_page_slice(spark, d):
    make = lambda i, t: g.pdf([[(50, 60, f"page {k} of item {i}")] for k in range(1, 5)])
    return _out(_rendered(spark, d, make, "i.pdf", pages="2:3"))


def pdf_two_columns(spark, d):
    """Two interleaved columns of a page come out one after the other, with a warning."""
    make = lambda i, t: g.pdf([[x for k in range(4) for x in ((50, 60 + 20 * k, f"left {k} of {i}"), (350, 60 + 20 * k, f"right {k} of {i}"))]])
    parsed = _rendered(spark, d, make, "i.pdf")
    return parsed.select(F.col("doc_id").cast("bigint").alias("item_id"), "markdown", F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("codes"))


def pdf_table_recovery(spark, d):
    make = lambda i, t: g.pdf([[(50, 60 + 12 * k, f"r{k}  {i}  x|{k}") for k in range(4)]])
    return _out(_rendered(spark, d, make, "i.pdf"))


def container_warnings(spark, d):
    """Warnings and media of generated containers by format and code."""
    ship(spark)

    def make(i):
        merged = '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>m</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
        if i % 4 == 0:
            return g.docx([("p", f"n{i}"), ("xml", merged), ("image", "a.png")], {"a.png": b"x"})
        if i % 4 == 1:
            return g.pptx([{"texts": [f"n{i}"], "images": ["a.png"]}, {"texts": ["x"]}], {"a.png": b"x"})
        if i % 4 == 2:
            return g.pdf([[(50, 60, f"n{i}")], []], images=2)
        curves = "0 0 m " + "10 10 20 20 30 0 c " * 25 + "S\n"
        return g.pdf([[(50, 60, f"n{i}")]], {0: curves})

    n = table(spark, d, "nation").select("n_nationkey", F.lit("x").alias("source"), built(make, F.col("n_nationkey")).alias("content"))
    w = engine.warnings(engine.parse(n, doc_id="n_nationkey"))
    return w.groupBy("code", F.coalesce("loc_kind", F.lit("")).alias("loc_kind"), F.coalesce("loc_number", F.lit(0)).alias("loc_number")).agg(F.count(F.lit(1)).alias("n"))


def broken_inputs(spark, d):
    """Damaged, foreign and oversized inputs end as errors with stable codes."""
    rows = [
        (1, "a.docx", b"not a zip"), (2, "a.pdf", b"%PDF-1.4 nothing here"), (3, "a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest"), (4, "a.bin", b"\x00\x01\x02"),
        (5, "a.ipynb", b"{broken"), (6, "a.txt", b"x" * 5000), (7, "a.txt", None), (8, "a.xlsx", b"PK\x03\x04broken"), (9, "a.epub", g.archive({"mimetype": "application/epub+zip"})),
        (10, "a.txt", b"fine"), (11, "a.pdf", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\ntrailer << /Root 1 0 R /Encrypt 2 0 R >>"), (12, "a.docx", g.archive({"word/document.xml": b"<a>" + b"A" * 5_000_000})),
    ]
    df = spark.createDataFrame(rows, "id int, source string, content binary")
    return engine.errors(engine.parse(df, doc_id="id", max_parse_bytes=4000)).select(F.col("doc_id").cast("int").alias("id"), "code")


def input_budget(spark, d):
    """Documents over a size limit fail before parsing, the rest come through."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.lit("a.txt").alias("source"), F.encode("text", "UTF-8").alias("content"))
    parsed = engine.parse(docs, doc_id="doc_id", max_parse_bytes=2000)
    return parsed.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("error.code", F.lit("ready")).alias("outcome"), F.col("stats.input_bytes").alias("input_bytes"))


def detect_documents(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", format_column(F.encode("text", "UTF-8"), F.col("file_path")).alias("format"))


def parse_documents(spark, d):
    """The repository files through detection and parsing: results by format and outcome."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("file_path").alias("source"), F.encode("text", "UTF-8").alias("content"))
    parsed = engine.parse(docs, doc_id="doc_id", mode="document")
    return parsed.groupBy("format", F.coalesce("error.code", F.lit("ready")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("stats.input_bytes").alias("input_bytes"))


def media_round_trip(spark, d):
    """Pictures taken out of containers by the links in their text."""
    ship(spark)
    n = table(spark, d, "nation").select("n_nationkey", F.lit("x.docx").alias("source"), built(lambda k: g.docx([("p", "x"), ("image", "a.png")], {"a.png": f"picture {k}".encode()}), F.col("n_nationkey")).alias("content"))
    links = engine.media(engine.parse(n, doc_id="n_nationkey")).select(F.col("doc_id").cast("int").alias("n_nationkey"), "uri")
    both = n.join(links, "n_nationkey")
    return both.select("n_nationkey", F.regexp_replace("uri", r"^[a-z]+://", "").alias("link"), engine.extract_media(F.col("content"), F.col("uri")).cast("string").alias("data"))


def csv_delimiters(spark, d):
    """Delimiters by their counts: nations written with each of four."""
    ship(spark)
    marks = F.explode(F.create_map(*[F.lit(x) for kv in enumerate((",", "\t", ";", "|"), 1) for x in kv])).alias("id", "mark")
    rows = table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    make = lambda mark, body: g.csv_file([["key", "name"], *[[r["n_nationkey"], r["n_name"]] for r in body]], mark)
    files = rows.select("rows", marks).select("id", F.lit("n.csv").alias("source"), built(make, F.col("mark"), F.col("rows")).alias("content"))
    return engine.tables(engine.parse(files, doc_id="id")).select(F.col("doc_id").cast("int").alias("id"), "delimiter", F.col("range").alias("cell_range"))


def links_absolute(spark, d):
    """Links of web results, of every kind, made absolute by their page's address.

    Each of a result's own links is also taken below the folder, as a query and as a place in it.
    """
    ship(spark)
    rows = table(spark, d, "parse_results").where("doc_format in ('html', 'url') and markdown is not null and source like 'http%'")
    own = rows.select("parse_id", "source", F.explode(F.array_distinct(F.regexp_extract_all("markdown", F.lit(r"\]\(([^)\s]*)\)"), F.lit(1)))).alias("own"))
    name = F.regexp_replace("own", r"\A[/#?]+", "")
    links = own.select("parse_id", "source", F.explode(F.array_distinct(F.array("own", name, F.concat(F.lit("../"), name), F.concat(F.lit("./"), name), F.concat(F.lit("?q="), name), F.concat(F.lit("#"), name), F.concat(F.lit("//cdn.example/"), name)))).alias("link")).distinct()

    @F.arrow_udf(T.StringType())
    def full(base: pa.Array, link: pa.Array) -> pa.Array:
        return pa.array([absolute(b, x) for b, x in zip(base.to_pylist(), link.to_pylist())], pa.string())

    return spread(links).select("parse_id", "link", full("source", "link").alias("address"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_round_trip, csv_row_range, csv_limit_columns, csv_entries, csv_markdown, csv_markdown_tables, csv_delimiters, links_absolute, xlsx_round_trip, xlsx_header_detection, html_render, docx_render, pptx_render,
        epub_render, ipynb_render, pdf_render, pdf_page_slice, pdf_two_columns, pdf_table_recovery, container_warnings, broken_inputs, input_budget, detect_documents, parse_documents, media_round_trip,
    )
}

_CELLS = "SELECT file_no, row_no, unnest(h) AS header, unnest(v) AS value FROM rows"
_PARTS = "SELECT (p_partkey // 500)::BIGINT AS file_no, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey, p_name, p_brand) + 1 AS row_no, p_partkey::VARCHAR AS k, p_name, p_brand FROM part"
_ITEM = f"WITH i AS (SELECT item_id, text AS t FROM {ITEMS}) "
SQL = {
    "csv_round_trip": """
WITH rows AS (SELECT (c_custkey // 500)::BIGINT AS file_no, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) + 1 AS row_no,
  ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'] AS h, [c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment] AS v FROM customer) """
    + _CELLS,
    "csv_row_range": f"WITH p AS ({_PARTS}), rows AS (SELECT file_no, row_no, ['p_partkey', 'p_name', 'p_brand'] AS h, [k, p_name, p_brand] AS v FROM p WHERE row_no BETWEEN 10 AND 20) " + _CELLS,
    "csv_limit_columns": f"WITH p AS ({_PARTS}) SELECT file_no, row_no, 'p_brand' AS header, p_brand AS value FROM p WHERE row_no - 2 >= 3 AND row_no - 2 < 10",
    "csv_entries": f"""WITH p AS ({_PARTS}), f AS (SELECT file_no, count(*) AS n FROM p GROUP BY 1)
SELECT file_no, 'A1:C' || (n + 1) AS cell_range, chr(9) AS delimiter, 3::INTEGER AS column_count, 2::BIGINT AS first_row, (least(n, 100) + 1)::BIGINT AS last_row, n > 100 AS truncated,
  CASE WHEN n > 100 THEN 'preview limited to first 100 data rows out of ' || n ELSE '' END AS warnings FROM f""",
    "csv_markdown": """
WITH o AS (SELECT (o_orderkey // 4800)::BIGINT AS file_no, row_number() OVER (PARTITION BY o_orderkey // 4800 ORDER BY o_orderkey) AS r, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' || chr(10) AS line FROM orders
), t AS (SELECT file_no, count(*) AS n, '| o_orderkey | o_orderstatus | o_orderpriority |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, '' ORDER BY r) FILTER (r <= 999) AS body FROM o GROUP BY 1
), m AS (SELECT file_no, body || CASE WHEN n > 999 THEN chr(10) || '_(truncated at 1000 rows)_' || chr(10) ELSE '' END AS markdown FROM t)
SELECT file_no, md5(markdown) AS markdown_md5, strlen(markdown)::BIGINT AS output_bytes FROM m""",
    "csv_markdown_tables": f"""WITH p AS ({_PARTS})
SELECT file_no, md5('| p_partkey | p_name | p_brand |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || k || ' | ' || p_name || ' | ' || p_brand || ' |', chr(10) ORDER BY row_no)) AS markdown_md5 FROM p GROUP BY 1""",
    "xlsx_round_trip": """
WITH rows AS (SELECT (s_suppkey // 500)::BIGINT AS file_no, row_number() OVER (PARTITION BY s_suppkey // 500 ORDER BY s_suppkey) + 1 AS row_no, ['key', 'name', 'balance', 'positive', 'checked'] AS h,
  [s_suppkey::VARCHAR, s_name, CASE WHEN s_acctbal = floor(s_acctbal) THEN s_acctbal::BIGINT::VARCHAR ELSE s_acctbal::VARCHAR END, upper((s_acctbal > 0)::VARCHAR), strftime(DATE '1899-12-30' + (45000 + s_nationkey)::INTEGER, '%Y-%m-%d')] AS v FROM supplier) """
    + _CELLS,
    "xlsx_header_detection": """
SELECT r_regionkey::BIGINT AS region_key, r_name AS sheet, 'Nations of ' || r_name AS title, 4::INTEGER AS header_row, 'A1:C' || (4 + count(*)) AS cell_range, 2::INTEGER AS note_row, 5::BIGINT AS first_row, (4 + count(*))::BIGINT AS last_row, 'Cover,' || r_name AS sheets
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
    "html_render": _ITEM
    + r"""SELECT item_id, 'html' AS format, '# Item ' || item_id || chr(10) || chr(10) || '**Start**' || chr(10) || chr(10) || '**' || trim(regexp_replace(t, '\s+', ' ', 'g')) || '**' || chr(10) || chr(10) || '**' || trim(substr(t, 1, 20)) || ' [more](https://site.example/a/x?q=1)**' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || item_id || ' | x\|y |' || chr(10) AS markdown FROM i""",
    "docx_render": _ITEM
    + r"""SELECT item_id, 'docx' AS format, '## Item ' || item_id || chr(10) || chr(10) || trim(t) || chr(10) || chr(10) || '- first' || chr(10) || chr(10) || '- second' || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || item_id || ' | x\|y |' || chr(10) || chr(10) || '![DOCX image 1](grove://docx/part/word/media/one.png)' || chr(10) AS markdown FROM i""",
    "pptx_render": _ITEM
    + r"""SELECT item_id, 'pptx' AS format, '## Slide 1' || chr(10) || chr(10) || 'Item ' || item_id || chr(10) || chr(10) || trim(t) || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || item_id || ' | y |' || chr(10) || chr(10) || 'Notes:' || chr(10) || chr(10) || 'said' || chr(10) || chr(10) || '## Slide 2' || chr(10) || chr(10) || 'end' || chr(10) || chr(10) || '![PPTX image 1 (slide 2)](grove://pptx/part/ppt/media/one.png)' || chr(10) AS markdown FROM i""",
    "epub_render": _ITEM
    + r"""SELECT item_id, 'epub' AS format, '## Chapter 1' || chr(10) || chr(10) || '# Item ' || item_id || chr(10) || chr(10) || trim(regexp_replace(t, '\s+', ' ', 'g')) || chr(10) || chr(10) || '## Chapter 2' || chr(10) || chr(10) || '1. one' || chr(10) || chr(10) || '2. two' || chr(10) AS markdown FROM i""",
    "ipynb_render": _ITEM
    + r"""SELECT item_id, 'ipynb' AS format, '# Item ' || item_id || chr(10) || chr(10) || '```python' || chr(10) || 'x = ' || item_id || chr(10) || 'print(x)' || chr(10) || '```' || chr(10) || chr(10) || trim(t) || chr(10) AS markdown FROM i""",
    "pdf_render": _ITEM
    + r"""SELECT item_id, 1::INTEGER AS page, '## Page 1 ' || trim(regexp_replace(t, '\s+', ' ', 'g')) AS words FROM i UNION ALL SELECT item_id, 2, '## Page 2 Item ' || item_id FROM i""",
    "pdf_page_slice": _ITEM
    + r"""SELECT item_id, 'pdf' AS format, '## Page 2' || chr(10) || chr(10) || 'page 2 of item ' || item_id || chr(10) || chr(10) || '## Page 3' || chr(10) || chr(10) || 'page 3 of item ' || item_id || chr(10) AS markdown FROM i""",
    "pdf_two_columns": _ITEM
    + r"""SELECT item_id, '## Page 1' || chr(10) || chr(10) || array_to_string([s || ' ' || k || ' of ' || item_id for s in ['left'] for k in [0, 1, 2, 3]], chr(10)) || chr(10) || array_to_string(['right ' || k || ' of ' || item_id for k in [0, 1, 2, 3]], chr(10)) || chr(10) AS markdown, 'pdf_multi_column_reading_order' AS codes FROM i""".replace(
        "[s || ' ' || k || ' of ' || item_id for s in ['left'] for k in [0, 1, 2, 3]]", "['left ' || k || ' of ' || item_id for k in [0, 1, 2, 3]]"
    ),
    "pdf_table_recovery": _ITEM
    + r"""SELECT item_id, 'pdf' AS format, '## Page 1' || chr(10) || chr(10) || '| r0 | ' || item_id || ' | x\|0 |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(['| r' || k || ' | ' || item_id || ' | x\|' || k || ' |' for k in [1, 2, 3]], chr(10)) || chr(10) AS markdown FROM i""",
    "container_warnings": """
WITH w AS (
  SELECT n_nationkey AS k, unnest(CASE n_nationkey % 4 WHEN 0 THEN [{'c': 'merged_table_structure_not_preserved', 'l': '', 'n': 0}, {'c': 'embedded_visuals_omitted', 'l': '', 'n': 0}]
    WHEN 1 THEN [{'c': 'embedded_visuals_omitted', 'l': 'slide', 'n': 1}]
    WHEN 2 THEN [{'c': 'embedded_visuals_omitted', 'l': 'page', 'n': 1}, {'c': 'pdf_page_no_text_layer', 'l': 'page', 'n': 2}]
    ELSE [{'c': 'vector_graphics_omitted', 'l': 'page', 'n': 1}] END) AS x FROM nation)
SELECT x.c AS code, x.l AS loc_kind, x.n::INTEGER AS loc_number, count(*) AS n FROM w GROUP BY ALL""",
    "broken_inputs": """
SELECT * FROM (VALUES (1, 'invalid_container'), (2, 'invalid_container'), (3, 'legacy_or_encrypted_office'), (4, 'unsupported_format'), (5, 'parse_failed'), (6, 'parse_budget_exceeded'), (7, 'parse_failed'),
  (8, 'invalid_container'), (9, 'invalid_container'), (11, 'encrypted_pdf'), (12, 'parse_budget_exceeded')) AS t(id, code)""",
    "input_budget": "SELECT doc_id, CASE WHEN strlen(text) > 2000 THEN 'parse_budget_exceeded' ELSE 'ready' END AS outcome, strlen(text)::BIGINT AS input_bytes FROM documents WHERE text IS NOT NULL",
    "media_round_trip": "SELECT n_nationkey, 'docx/part/word/media/a.png' AS link, 'picture ' || n_nationkey AS data FROM nation",
}
SQL["csv_delimiters"] = "SELECT id, CASE id WHEN 1 THEN ',' WHEN 2 THEN chr(9) WHEN 3 THEN ';' ELSE '|' END AS delimiter, 'A1:B' || (SELECT count(*) + 1 FROM nation) AS cell_range FROM (VALUES (1), (2), (3), (4)) AS t(id)"
SQL["links_absolute"] = r"""
WITH o AS (SELECT parse_id, source, unnest(list_distinct(regexp_extract_all(markdown, '\]\(([^)\s]*)\)', 1))) AS own FROM parse_results WHERE doc_format IN ('html', 'url') AND source LIKE 'http%'
), n AS (SELECT *, regexp_replace(own, '^[/#?]+', '') AS name FROM o
), l AS (SELECT DISTINCT parse_id, source, unnest([own, name, '../' || name, './' || name, '?q=' || name, '#' || name, '//cdn.example/' || name]) AS link FROM n
), p AS (SELECT *, regexp_extract(source, '^https?://[^/?#]*') AS root, regexp_extract(source, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(path, '/[^/]*$', '') AS dir FROM l)
SELECT parse_id, link, CASE WHEN link = '' OR link[1] = '#' OR starts_with(link, '//') OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
  WHEN link[1] = '/' THEN root || link WHEN link[1] = '?' THEN root || CASE WHEN path = '' THEN '/' ELSE path END || link
  WHEN starts_with(link, '../') THEN root || regexp_replace(dir, '/[^/]*$', '') || link[3:] WHEN starts_with(link, './') THEN root || dir || link[2:]
  ELSE root || dir || '/' || link END AS address FROM p"""
_KINDS = """CASE lower(regexp_extract(regexp_extract(regexp_extract(file_path, '^[^?#]*'), '[^/]*$'), '\\.([^.]*)$', 1))
  WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'xlsx' THEN 'xlsx' WHEN 'xlsm' THEN 'xlsx'
  WHEN 'pptx' THEN 'pptx' WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'csv' WHEN 'ipynb' THEN 'ipynb' WHEN 'epub' THEN 'epub'
  WHEN 'txt' THEN 'text' WHEN 'log' THEN 'text' WHEN 'rs' THEN 'text' WHEN 'py' THEN 'text' WHEN 'js' THEN 'text' WHEN 'ts' THEN 'text' WHEN 'go' THEN 'text' WHEN 'json' THEN 'text' WHEN 'yaml' THEN 'text'
  WHEN 'yml' THEN 'text' WHEN 'toml' THEN 'text' WHEN 'xml' THEN 'text' WHEN 'sh' THEN 'text' WHEN 'c' THEN 'text' WHEN 'cpp' THEN 'text' WHEN 'h' THEN 'text' WHEN 'java' THEN 'text'
  ELSE CASE WHEN text IS NULL OR contains(substr(text, 1, 4096), chr(0)) OR substr(hex(encode(text)), 8193, 1) IN ('8', '9', 'A', 'B') THEN NULL ELSE 'text' END END"""
SQL["detect_documents"] = f"SELECT doc_id, {_KINDS} AS format FROM documents"
SQL["parse_documents"] = f"""
WITH f AS (SELECT {_KINDS} AS format, strlen(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL)
SELECT format, CASE WHEN format IS NULL THEN 'unsupported_format' ELSE 'ready' END AS outcome, count(*) AS n, sum(n)::BIGINT AS input_bytes FROM f GROUP BY ALL"""
