"""Queries over one feature of a format, of limits or of results each, on files made of the tables' rows."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove import sinks
from inkgrove.functions import markdown as md
from inkgrove.operators import corpus, engine, evidence
from inkgrove.options import ParseOptions
from inkgrove.plans.parsing import CUSTOMER, ITEMS, _csv_files, _items, _rendered, built, files_of
from inkgrove.schema import ParseError
from inkgrove.session import ship, spread
from inkgrove.sources import generate as g
from inkgrove.sources.tables import table

PART = ["p_partkey", "p_name", "p_brand"]


def _file_no(parsed):
    return F.col("doc_id").cast("bigint").alias("file_no")


# ---- tables ----


def csv_ragged(spark, d):
    """Short rows, line breaks and quotes in cells, blanks around them."""
    ship(spark)

    def make(rows):
        out = ["key,name,brand"]
        for r in rows:
            k, name = int(r["p_partkey"]), r["p_name"]
            line = [str(k), f'"{name}\r\nnew ""line"""' if k % 5 == 0 else name]
            if k % 3:
                line.append(r["p_brand"])
            out.append(",".join(line))
        return ("\r\n".join(out) + "\r\n").encode()

    files = files_of(table(spark, d, "part"), "p_partkey", PART)
    files = files.select("file_no", F.lit("p.csv").alias("source"), built(make, F.col("rows")).alias("content"))
    cells = engine.table_cells(engine.parse(files, doc_id="file_no", limit=10**9))
    return cells.select(_file_no(cells), F.col("row_no").cast("bigint").alias("row_no"), "header", "value")


def csv_missing_column(spark, d):
    """A column that isn't there is an error that names those that are."""
    parsed = engine.parse(_csv_files(spark, d, "part", "p_partkey", PART), doc_id="file_no", columns=["p_name", "nope"])
    e = parsed.select(_file_no(parsed), "error.code", "error.reason")
    return e.select("file_no", "code", (F.contains("reason", F.lit("nope")) & F.contains("reason", F.lit("p_brand"))).alias("named"))


def csv_empty(spark, d):
    """Files without a record: one entry without a range or columns."""
    files = table(spark, d, "nation").select(F.col("n_nationkey").alias("file_no"), F.lit("e.csv").alias("source"), F.encode(F.repeat(F.lit("\n"), (F.col("n_nationkey") % 3).cast("int")), "UTF-8").alias("content"))
    t = engine.tables(engine.parse(files, doc_id="file_no"))
    return t.select(_file_no(t), F.col("range").alias("cell_range"), "column_count", "truncated")


def xlsx_markdown(spark, d):
    """Workbooks as Markdown: every sheet with its name, blank rows left out."""
    ship(spark)
    make = lambda rows: g.xlsx({"One": [["key", "name"], *[x for r in rows for x in ([int(r["s_suppkey"]), r["s_name"]], [None, None])]], "Two": []})
    files = files_of(table(spark, d, "supplier"), "s_suppkey", ["s_suppkey", "s_name"])
    parsed = engine.parse(files.select("file_no", F.lit("s.xlsx").alias("source"), built(make, F.col("rows")).alias("content")), doc_id="file_no", mode="document")
    return parsed.select(_file_no(parsed), F.md5("markdown").alias("markdown_md5"))


def gfm_sizes(spark, d):
    """Sizes of Markdown tables before they are made."""
    ship(spark)

    @F.arrow_udf("bigint")
    def size(bodies: pa.Array) -> pa.Array:
        return pa.array([md.gfm_size([["name", "brand"], *[[r["p_name"], r["p_brand"]] for r in body]]) for body in bodies.to_pylist()], pa.int64())

    return files_of(table(spark, d, "part"), "p_partkey", PART).select("file_no", size("rows").alias("bytes"))


def tables_flat(spark, d):
    """All tables of all files in one envelope, then as rows again: nothing is left out."""
    parsed = engine.parse(_csv_files(spark, d, "nation", "n_nationkey", ["n_nationkey", "n_name"], rows=5), doc_id="source", limit=10**9)
    text = sinks.tables_report(parsed, 1 << 30)
    found = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", "tables array<struct<source: string, rows: array<map<string, string>>>>")["tables"]).alias("x"))
    return found.select("x.source", F.explode("x.rows").alias("r")).select("source", F.col("r")["n_name"].alias("n_name"))


def table_envelopes(spark, d):
    """The envelope of each file, read back as JSON."""
    parsed = engine.parse(_csv_files(spark, d, "customer", "c_custkey", CUSTOMER), doc_id="file_no", limit=10**9)
    e = sinks.envelope(parsed)
    number = lambda path: F.get_json_object("json", path).cast("bigint")
    return e.select(_file_no(e), F.get_json_object("json", "$.schema_version").isNotNull().alias("versioned"), number("$.tables[0].column_count").alias("columns"), number("$.tables[0].row_range.last_row").alias("last_row"), F.get_json_object("json", "$.truncated").alias("truncated"))


# ---- names, kinds, texts ----


def format_names(spark, d):
    """Names of formats as an option; addresses have none."""
    ship(spark)

    def one(name):
        try:
            return ParseOptions.of(format=name).format
        except ParseError as e:
            return e.code

    run = F.arrow_udf(lambda a: pa.array([one(x) for x in a.to_pylist()], pa.string()), T.StringType())
    names = table(spark, d, "size_limits").select(F.explode(F.array("doc_format", F.upper("doc_format"), F.concat("doc_format", F.lit("x")))).alias("name"))
    return names.select("name", run("name").alias("outcome"))


MAGICS = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF89a", b"RIFF\x00\x00\x00\x00WEBP", b"<svg ", b"other"]


def image_types(spark, d):
    """Kinds of pictures by their first bytes."""
    ship(spark)
    from inkgrove.functions.detect import image_type

    run = F.arrow_udf(lambda a: pa.array([image_type(MAGICS[x % len(MAGICS)] + b"rest") for x in a.to_pylist()], pa.string()), T.StringType())
    return table(spark, d, "customer").select("c_custkey", run("c_custkey").alias("kind"))


def markdown_verbatim(spark, d):
    """Markdown stays as it is, from a file or by the content type of an address."""
    ship(spark)
    docs = table(spark, d, "documents").where("text is not null")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a.md").otherwise("https://a.example/x").alias("source"), F.when(F.col("doc_id") % 2 == 1, "text/markdown; charset=utf-8").alias("kind"), F.encode("text", "UTF-8").alias("content"))
    parsed = engine.parse(rows, doc_id="doc_id", content_type="kind")
    return parsed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "format", F.md5("markdown").alias("text_md5"))


# ---- pages and documents ----


def html_blocks(spark, d):
    """Loose text, lists, pictures, quotes and preformatted text of pages."""

    def make(i, t):
        return f"<body><div>loose<p>Item {i}</p></div><ul><li>one<ul><li>in</li></ul><li>two</ul><ol><li>a<li>b</ol><p><img alt='p' src='/i.png'><img alt='d' src='data:x'><img src='data:x'></p><blockquote><p>said</p></blockquote><pre>\n x\n  y\n</pre></body>".encode()

    parsed = _rendered(spark, d, make, "https://site.example/a/page.html")
    return parsed.select(F.col("doc_id").cast("bigint").alias("item_id"), "markdown")


NUMBERING = '<w:numbering xmlns:w="{w}"><w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="9"/></w:num></w:numbering>'


def docx_marks(spark, d):
    """Numbered and nested lists, notes, links, bold and italic runs, cells of several paragraphs."""
    run = lambda t, p="": f'<w:r>{f"<w:rPr>{p}</w:rPr>" if p else ""}<w:t xml:space="preserve">{t}</w:t></w:r>'
    item = lambda t, level: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="3"/></w:numPr></w:pPr>{run(t)}</w:p>'

    def make(i, t):
        line = f'<w:p>{run("plain ")}{run("strong ", "<w:b/>")}{run("both", "<w:b/><w:i/>")}{run(" ")}{run("slant", "<w:i/>")}<w:hyperlink r:id="web">{run(" site")}</w:hyperlink>{run(" end")}<w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
        cell = f"<w:tbl><w:tr><w:tc><w:p>{run('a')}</w:p><w:p>{run('b')}</w:p></w:tc><w:tc><w:p>{run(str(i))}</w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
        return g.docx([("xml", item("first", 0)), ("xml", item("inner", 1)), ("xml", item("second", 0)), ("xml", line), ("xml", cell)], notes={"2": f"Note {i}"}, parts={"word/numbering.xml": NUMBERING.format(w=g.W_SPACE)})

    parsed = _rendered(spark, d, make, "a.docx")
    return parsed.select(F.col("doc_id").cast("bigint").alias("item_id"), "markdown")


def pdf_fonts(spark, d):
    """Compressed pages in a two-byte font with its own characters: words by the map to Unicode."""

    def make(i, t):
        letters = sorted(set(t))
        code = {c: k + 3 for k, c in enumerate(letters)}
        cmap = "begincmap\n%d beginbfchar\n%s\nendbfchar\nendcmap" % (len(code), "\n".join(f"<{k:04x}> <{c.encode('utf-16-be').hex()}>" for c, k in code.items()))
        words, lines = t.split(" "), []
        height = 800 + 14 * (len(words) // 6)
        for k in range(0, len(words), 6):
            shown = "".join(f"{code[c]:04x}" for c in " ".join(words[k : k + 6]))
            lines.append(f"BT /F2 8 Tf 1 0 0 1 40 {height - 52 - 14 * (k // 6)} Tm <{shown}> Tj ET")
        return g.pdf_objects(zlib.compress("\n".join(lines).encode()), cmap, height)

    parsed = _rendered(spark, d, make, "a.pdf")
    return parsed.select(F.col("doc_id").cast("bigint").alias("item_id"), F.regexp_replace(F.regexp_replace("markdown", r"\A## Page 1\s+", ""), r"\s+", "").alias("letters"))


def pdf_pictures(spark, d):
    """Pictures of PDF files and pages with drawings, taken out in one pass: kind, width and height."""
    ship(spark)
    make = lambda k: g.pdf([[(50, 60, f"n{k}")]], {0: "0 0 m " + "10 10 20 20 30 0 c " * 25 + "S\n"} if k % 2 else None, images=0 if k % 2 else k % 3 + 1)
    files = table(spark, d, "nation").select("n_nationkey", F.lit("a.pdf").alias("source"), built(make, F.col("n_nationkey")).alias("content"))
    m = engine.parsed_media(files, doc_id="n_nationkey")
    png = F.substring("data", 2, 3).cast("string") == "PNG"
    side = lambda at: F.when(png, F.conv(F.hex(F.substring("data", at, 4)), 16, 10).cast("int"))
    return m.select(F.col("doc_id").cast("int").alias("n_nationkey"), F.when(png, "png").otherwise("svg").alias("kind"), side(17).alias("width"), side(21).alias("height"))


def pdf_work(spark, d):
    """Pages with so many lines under a limit of operations."""
    ship(spark)
    make = lambda k: g.pdf([[(50, 60 + 12 * i, f"l{i}") for i in range(k + 1)]])
    files = table(spark, d, "nation").select("n_nationkey", F.lit("a.pdf").alias("source"), built(make, F.col("n_nationkey")).alias("content"))
    parsed = engine.parse(files, doc_id="n_nationkey", max_work_units=60)
    return parsed.select(F.col("doc_id").cast("int").alias("n_nationkey"), F.coalesce("error.code", F.lit("ready")).alias("outcome"))


def provenance_gate(spark, d):
    """Spans only where they are asked for and there are pages."""
    ship(spark)
    n = table(spark, d, "nation").select("n_nationkey", built(lambda k: g.pdf([[(50, 60, f"n{k}")]]) if k % 2 else b"text", F.col("n_nationkey")).alias("content"), F.when(F.col("n_nationkey") % 2 == 1, "a.pdf").otherwise("a.txt").alias("source"))
    on, off = (engine.parse(n, doc_id="n_nationkey", provenance=x).select(F.col("doc_id").cast("int").alias("n_nationkey"), F.lit(x).alias("asked"), F.size("provenance").alias("spans"), "provenance") for x in ("page", "off"))
    both = on.unionByName(off)
    return both.select("n_nationkey", "asked", F.when(F.col("provenance").isNotNull(), F.col("spans")).alias("spans"))


# ---- results ----


def planted_layers(spark, d):
    """Results whose text shows marks of an unreliable layer, some of them planted here."""
    rows = table(spark, d, "parse_results").where("markdown is not null")
    marks = F.when(F.col("parse_id") % 7 == 0, "�").when(F.col("parse_id") % 7 == 1, "\x02").when(F.col("parse_id") % 7 == 2, "GLYPH<1> glyph<2>").when(F.col("parse_id") % 7 == 3, "one glyph<3> only").when(F.col("parse_id") % 7 == 4, "\x85").otherwise("")
    return rows.withColumn("text", F.concat("markdown", marks)).where(corpus.suspicious_text(F.col("text"))).select("parse_id")


def rendered_suites(spark, d):
    """One text of each suite's items under their names; an empty one says so."""
    ship(spark)
    items = table(spark, d, "eval_items").select(F.coalesce("suite", F.lit("none")).alias("suite"), F.struct("item_id", F.when(F.col("item_id") % 5 == 0, "").otherwise(F.col("text")).alias("text")).alias("x"))

    @F.arrow_udf("string")
    def text(groups: pa.Array) -> pa.Array:
        return pa.array([md.rendered([(str(x["item_id"]), "text", x["text"]) for x in group]) for group in groups.to_pylist()], pa.string())

    return items.groupBy("suite").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("suite", F.md5(text("xs")).alias("text_md5"))


def default_modes(spark, d):
    """Tables as JSON if nothing else comes in, else Markdown."""
    csv = _csv_files(spark, d, "nation", "n_nationkey", ["n_nationkey", "n_name"], rows=5).select("source", "content")
    text = _items(spark, d).select(F.lit("a.txt").alias("source"), F.encode("text", "UTF-8").alias("content"))
    one = lambda name, files: engine.default_mode(engine.parse(files)).select(F.lit(name).alias("inputs"), "mode")
    return one("tables", csv).unionByName(one("both", csv.unionByName(text))).unionByName(one("none", csv.limit(0)))


def listed_failures(spark, d):
    """The first failures by source, as a report lists them."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("repo", F.lit("/"), "file_path", F.lit(".txt")).alias("source"), F.encode("text", "UTF-8").alias("content"))
    f = engine.failures(engine.parse(docs, doc_id="doc_id", max_parse_bytes=6000))
    return f.select("source", F.col("doc_id").cast("bigint").alias("doc_id"), "code")


def agent_bodies(spark, d):
    """Documents cut for an agent at a whole character, with facts below."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.lit("a.md").alias("source"), F.encode("text", "UTF-8").alias("content"))
    b = corpus.agent_bodies(engine.parse(docs, doc_id="doc_id"), 500)
    return b.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("body").alias("body_md5"))


def relinked_media(spark, d):
    """Links to media as links of a service."""
    items = _items(spark, d)
    text = F.concat("text", F.lit(" ![a](grove://pdf/obj/"), F.col("item_id").cast("string"), F.lit("/0) [b](https://x.example/y)"))
    return items.select("item_id", F.md5(corpus.relinked(text, "/m?u=")).alias("text_md5"))


def extracted_texts(spark, d):
    """Text of every result: Markdown, or tables as a name and JSON lines."""
    text = _items(spark, d).select(F.concat(F.lit("i"), "item_id").alias("name"), F.lit("a.txt").alias("source"), F.encode("text", "UTF-8").alias("content"))
    csv = _csv_files(spark, d, "nation", "n_nationkey", ["n_nationkey", "n_name"], rows=5).select(F.col("source").alias("name"), "source", "content")
    t = corpus.extracted_text(engine.parse(text.unionByName(csv), doc_id="name", limit=10**9))
    return t.select(F.col("doc_id").alias("name"), F.md5("text").alias("text_md5"))


def ready_sources(spark, d):
    """Inputs by their state."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.encode("text", "UTF-8").alias("content"))
    m = corpus.manifest(engine.parse(docs, max_parse_bytes=3000, format="text"))
    return corpus.by_status(m, "error").select(F.col("source").cast("bigint").alias("doc_id"), F.col("error").alias("code")).unionByName(corpus.by_status(m, "ready").select(F.col("source").cast("bigint").alias("doc_id"), F.lit("ready").alias("code")))


def token_counts(spark, d):
    """Tokens of each item by a counter that is given (words between blanks)."""
    ship(spark)
    return corpus.token_counts(_items(spark, d), lambda texts: [len(t.split(" ")) for t in texts], "item_id").select("item_id", "tokens")


def claims_rechecked(spark, d):
    """A second look lets claims without evidence become partial, never more."""
    o = table(spark, d, "orders").where("o_orderkey % 100 = 0")
    claims = o.select("o_orderkey", F.element_at(F.array(F.lit("supported"), F.lit("partial"), F.lit("unsupported")), (F.col("o_orderkey") / 100 % 3 + 1).cast("int")).alias("verdict"), (F.col("o_custkey") % 2 == 0).alias("located"))
    second = o.where("o_custkey % 3 = 0").select("o_orderkey", (F.col("o_custkey") % 6 != 3).alias("second_located"))
    r = evidence.rechecked(evidence.gated(claims), second, "o_orderkey")
    return r.select("o_orderkey", "verdict", "final_verdict", "evidence_kind")


def answers_json(spark, d):
    """Objects out of a model's talk."""
    o = table(spark, d, "orders").where("o_orderkey % 100 = 0")
    text = F.concat(F.lit("Sure, here:\n```json\n{\"key\": "), F.col("o_orderkey").cast("string"), F.lit(", \"inner\": {\"s\": \""), "o_orderstatus", F.lit("\"}}\n```\nDone."))
    return o.select("o_orderkey", evidence.json_of(text, "key bigint, inner struct<s: string>").alias("j")).select("o_orderkey", F.col("j.key").alias("key"), F.col("j.inner.s").alias("status"))


def sql_functions(spark, d):
    """The functions of the SQL surface over test items."""
    from inkgrove import sql

    sql.register(spark)
    _items(spark, d).createOrReplaceTempView("inkgrove_items")
    return spark.sql(
        "SELECT item_id, detect_format(encode(i.text, 'UTF-8'), 'a.md', NULL) AS format, md5(decode_text(encode(i.text, 'UTF-8'))) AS text_md5, absolute_url('https://a.example/b/c', concat('d', item_id)) AS address, locate_quote(i.text, substring(i.text, 3, 20)).start AS start, md5(parse_markdown(encode(i.text, 'UTF-8'), 'a.md')) AS markdown_md5, c.index AS index"
        " FROM inkgrove_items i, LATERAL chunks(concat(i.text, '\\n\\n', item_id)) c"
    )


QUERIES = {
    f.__name__: f
    for f in (
        csv_ragged, csv_missing_column, csv_empty, xlsx_markdown, gfm_sizes, tables_flat, table_envelopes, format_names, image_types, markdown_verbatim, html_blocks, docx_marks, pdf_fonts, pdf_pictures, pdf_work,
        provenance_gate, planted_layers, rendered_suites, default_modes, listed_failures, agent_bodies, relinked_media, extracted_texts, ready_sources, token_counts, claims_rechecked, answers_json, sql_functions,
    )
}

_SUITES = "SELECT coalesce(suite, 'none') AS suite, item_id, CASE WHEN item_id % 5 = 0 THEN '' ELSE text END AS text FROM eval_items"
SQL = {
    "csv_ragged": """
WITH p AS (SELECT p_partkey // 500 AS file_no, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) + 1 AS row_no, p_partkey AS k, p_name, p_brand FROM part)
SELECT file_no, row_no, 'key' AS header, k::VARCHAR AS value FROM p
UNION ALL SELECT file_no, row_no, 'name', CASE WHEN k % 5 = 0 THEN p_name || chr(10) || 'new "line"' ELSE p_name END FROM p
UNION ALL SELECT file_no, row_no, 'brand', CASE WHEN k % 3 = 0 THEN '' ELSE p_brand END FROM p""",
    "csv_missing_column": "SELECT DISTINCT p_partkey // 500 AS file_no, 'parse_failed' AS code, true AS named FROM part",
    "csv_empty": "SELECT n_nationkey::BIGINT AS file_no, NULL::VARCHAR AS cell_range, 0 AS column_count, false AS truncated FROM nation",
    "xlsx_markdown": """
SELECT s_suppkey // 500 AS file_no, md5('## Sheet: One' || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || s_name || ' |' || chr(10), '' ORDER BY s_suppkey) || chr(10) || '## Sheet: Two' || chr(10)) AS markdown_md5
FROM supplier GROUP BY 1""",
    "gfm_sizes": "SELECT p_partkey // 500 AS file_no, (strlen('| name | brand |' || chr(10) || '| --- | --- |' || chr(10)) + sum(strlen('| ' || replace(p_name, '|', '\\|') || ' | ' || replace(p_brand, '|', '\\|') || ' |' || chr(10))))::BIGINT AS bytes FROM part GROUP BY 1",
    "tables_flat": "SELECT 'nation-' || (n_nationkey // 5) || '.csv' AS source, n_name FROM nation",
    "table_envelopes": "SELECT c_custkey // 500 AS file_no, true AS versioned, 5::BIGINT AS columns, (count(*) + 1)::BIGINT AS last_row, 'false' AS truncated FROM customer GROUP BY 1",
    "format_names": """
WITH n AS (SELECT unnest([doc_format, upper(doc_format), doc_format || 'x']) AS name FROM size_limits)
SELECT name, CASE WHEN lower(name) IN ('html', 'pdf', 'docx', 'markdown', 'epub', 'text', 'pptx', 'ipynb', 'xlsx', 'csv') THEN lower(name) ELSE 'unsupported_format' END AS outcome FROM n""",
    "image_types": "SELECT c_custkey, ['image/png', 'image/jpeg', 'image/gif', 'image/webp', 'image/svg+xml', 'application/octet-stream'][c_custkey % 6 + 1] AS kind FROM customer",
    "markdown_verbatim": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'url' END AS format, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "html_blocks": r"SELECT item_id, concat_ws(chr(10), 'Item ' || item_id, '', '- one', '', '- two', '', '1. a', '', '2. b', '', '![p](https://site.example/i.png)[image: d]', '', '> said', '', '```', ' x', '  y', '```', '') AS markdown FROM " + ITEMS,
    "docx_marks": r"SELECT item_id, concat_ws(chr(10), '1. first', '', '  - inner', '', '2. second', '', 'plain **strong** ***both*** *slant* [site](https://example.com/x) end[^2]', '', '| a<br>b | ' || item_id || ' |', '| --- | --- |', '', '[^2]: Note ' || item_id, '') AS markdown FROM " + ITEMS,
    "pdf_fonts": r"SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS letters FROM " + ITEMS,
    "pdf_pictures": """
SELECT n_nationkey, 'png' AS kind, 2 AS width, 2 AS height FROM nation, range(3) t(i) WHERE n_nationkey % 2 = 0 AND i <= n_nationkey % 3
UNION ALL SELECT n_nationkey, 'svg', NULL, NULL FROM nation WHERE n_nationkey % 2 = 1""",
    "pdf_work": "SELECT n_nationkey, CASE WHEN 5 * (n_nationkey + 1) > 60 THEN 'work_budget_exceeded' ELSE 'ready' END AS outcome FROM nation",
    "provenance_gate": "SELECT n_nationkey, asked, CASE WHEN asked = 'page' AND n_nationkey % 2 = 1 THEN 1 END AS spans FROM nation, (VALUES ('page'), ('off')) t(asked)",
    "planted_layers": r"""
WITH t AS (SELECT parse_id, markdown || CASE parse_id % 7 WHEN 0 THEN chr(65533) WHEN 1 THEN chr(2) WHEN 2 THEN 'GLYPH<1> glyph<2>' WHEN 3 THEN 'one glyph<3> only' WHEN 4 THEN chr(133) ELSE '' END AS text FROM parse_results WHERE markdown IS NOT NULL)
SELECT parse_id FROM t WHERE regexp_matches(text, '[\x{FFFD}\x00-\x08\x0E-\x1B\x7F-\x{84}\x{86}-\x{9F}]') OR len(regexp_extract_all(lower(text), 'glyph<')) >= 2""",
    "rendered_suites": f"""
WITH s AS ({_SUITES}), b AS (SELECT suite, item_id, CASE WHEN trim(text) = '' THEN '> [!NOTE]' || chr(10) || '> No text was found in ' || item_id || ' (format text; the body is empty).' || chr(10) WHEN suffix(text, chr(10)) THEN text ELSE text || chr(10) END AS body FROM s)
SELECT suite, md5(string_agg('# Source: ' || item_id || chr(10) || chr(10) || body, chr(10) ORDER BY item_id)) AS text_md5 FROM b GROUP BY 1""",
    "default_modes": "SELECT * FROM (VALUES ('tables', 'json'), ('both', 'md'), ('none', 'md')) t(inputs, mode)",
    "listed_failures": """
SELECT source, doc_id, code FROM (SELECT repo || '/' || file_path || '.txt' AS source, doc_id, CASE WHEN text IS NULL THEN 'parse_failed' ELSE 'parse_budget_exceeded' END AS code FROM documents WHERE text IS NULL OR strlen(text) > 6000)
ORDER BY source, doc_id::VARCHAR LIMIT 20""",
    "agent_bodies": f"""
WITH h AS (SELECT doc_id, text, coalesce({", ".join(f"try(decode(unhex(substr(hex(encode(text)), 1, {2 * (500 - j)}))))" for j in range(4))}) AS head FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN strlen(text) > 500 THEN head || chr(10) || '[cut]' ELSE text END || chr(10) || '---' || chr(10) || 'format: markdown' || chr(10) || 'pages: -') AS body_md5 FROM h""",
    "relinked_media": "SELECT item_id, md5(coalesce(text, '') || ' ![a](/m?u=grove%3A%2F%2Fpdf/obj/' || item_id || '/0) [b](https://x.example/y)') AS text_md5 FROM " + ITEMS,
    "extracted_texts": """
SELECT 'i' || item_id AS name, md5(coalesce(text, '')) AS text_md5 FROM """ + ITEMS + """
UNION ALL SELECT name, md5('# ' || name || chr(10) || string_agg('{"n_name":"' || n_name || '","n_nationkey":"' || n_nationkey || '"}', chr(10) ORDER BY n_nationkey)) FROM (SELECT 'nation-' || (n_nationkey // 5) || '.csv' AS name, * FROM nation) GROUP BY name""",
    "ready_sources": "SELECT doc_id, CASE WHEN text IS NULL THEN 'parse_failed' WHEN strlen(text) > 3000 THEN 'parse_budget_exceeded' ELSE 'ready' END AS code FROM documents",
    "token_counts": "SELECT item_id, len(string_split(coalesce(text, ''), ' '))::BIGINT AS tokens FROM " + ITEMS,
    "claims_rechecked": """
WITH c AS (SELECT o_orderkey, ['supported', 'partial', 'unsupported'][o_orderkey // 100 % 3 + 1] AS verdict, o_custkey % 2 = 0 AS located, o_custkey % 3 = 0 AND o_custkey % 6 <> 3 AS again FROM orders WHERE o_orderkey % 100 = 0)
SELECT o_orderkey, verdict, CASE WHEN verdict = 'unsupported' THEN 'unsupported' WHEN located THEN verdict WHEN again THEN 'partial' ELSE 'unsupported' END AS final_verdict, CASE WHEN verdict <> 'unsupported' AND (located OR again) THEN 'quote' ELSE 'none' END AS evidence_kind FROM c""",
    "answers_json": "SELECT o_orderkey, o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderkey % 100 = 0",
    "sql_functions": r"""
WITH t AS (SELECT item_id, text FROM """ + ITEMS + r"""), c AS (SELECT *, unnest(range(len(list_filter(string_split_regex(text || chr(10) || chr(10) || item_id, '\n{2,}'), lambda x: trim(x) <> ''))))::INTEGER AS index FROM t)
SELECT item_id, 'markdown' AS format, md5(text) AS text_md5, 'https://a.example/b/d' || item_id AS address, nullif(instr(text, trim(substr(text, 3, 20))), 0)::INTEGER - 1 AS start, md5(text) AS markdown_md5, index FROM c""",
}
