"""Parsers, engine, corpus and evidence on small inputs."""

import io
import json
import os
import subprocess
import sys
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkgrove import sinks, sql
from inkgrove.functions import markdown as md
from inkgrove.functions.charset import decoded, decoded_text
from inkgrove.functions.detect import detect, extension, image_type
from inkgrove.functions.text import absolute, squeezed
from inkgrove.operators import corpus, engine, evidence
from inkgrove.options import ParseOptions, number_range
from inkgrove.parsers import dispatch, html, pdf, tables
from inkgrove.parsers.pdf_objects import Lexer, Pdf, lzw, predicted
from inkgrove.parsers.pdf_text import CMap, glyph_text, recovered_tables
from inkgrove.schema import ERROR_CODES, WARNING_CODES, ParseError
from inkgrove.sources import generate as g
from inkgrove.sources.files import inside, read_files
from inkgrove.streaming.files import arrivals, parse_stream


def parsed(data, source="x", **o):
    return dispatch.parse(data, source, None, ParseOptions.of(**o))


# ---- options, detection, text ----


def test_options():
    assert number_range(" 2 : 5 ") == (2, 5)
    for bad in ("0:3", "5:2", "3", "a:b"):
        with pytest.raises(ValueError):
            number_range(bad)
    with pytest.raises(ValueError):
        ParseOptions.of(rows="1:2", limit=3)
    with pytest.raises(ParseError):
        ParseOptions.of(format="url")
    assert ParseOptions.of(format="TSV").format == "csv"


def test_detection_order():
    assert detect(b"%PDF-1.4", "x.txt") == "pdf"
    assert detect(b"<html>", "https://a.example/x?y=1.pdf") == "url"
    assert detect(b"<html>", "https://a.example/x.html#t") == "html"
    assert detect(b"{}", "https://a.example/x.html", "application/json") == "text"
    assert detect(g.docx([("p", "x")]), "x.bin") == "docx" and detect(g.epub(["<p>x</p>"])) == "epub"
    assert detect(g.xlsx({"a": [["x"]]})) == "xlsx" and detect(g.pptx([{"texts": ["x"]}])) == "pptx"
    assert detect(b"abc", "noext") == "text" and detect(b"\x00", "x.rs") == "text"
    assert extension("a/b.c/d.TAR.Gz?x.y#z") == "Gz" and extension("a.b/c") == ""
    for data, code in ((b"\x00", "unsupported_format"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "legacy_or_encrypted_office")):
        with pytest.raises(ParseError) as e:
            detect(data, "x.bin")
        assert e.value.code == code


def test_decoding():
    assert decoded("姓名".encode("gbk")) == "姓名" and decoded("﻿a".encode("utf-8")) == "a" and decoded(b"\xff\xfea\x00") == "a"
    assert decoded(b"\x81") != "" and image_type(b"\x89PNG\r\n\x1a\n") == "image/png" and image_type(b"<svg") == "image/svg+xml"


@pytest.mark.parametrize(
    ("link", "want"),
    [("/x", "https://h.example/x"), ("../x.html?q#f", "https://h.example/a/x.html?q#f"), ("?q=1", "https://h.example/a/b/c?q=1"), ("#t", "#t"), ("//o/x", "//o/x"), ("mailto:a@b", "mailto:a@b"), ("", ""), ("../../../x", "https://h.example/x"), ("y/.", "https://h.example/a/b/y/")],
)
def test_absolute(link, want):
    assert absolute("https://h.example/a/b/c?z=1", link) == want
    assert absolute(None, link) == link and absolute("/local/file.html", link) == link


# ---- markdown ----


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(max_size=6), max_size=4), max_size=4))
def test_table_size_is_that_of_its_text(rows):
    assert md.gfm_size(rows) == len(md.gfm(rows).encode())


def test_builder_and_caps():
    p = md.Page(1000)
    p.heading(9, " T ")
    p.paragraph("  ")
    p.paragraph("x")
    assert p.text() == "###### T\n\nx\n" and md.Page(10).text() == "\n"
    with pytest.raises(ParseError):
        md.Page(3).raw("abcd")
    text, cut = md.capped("äöü line\n" * 100, 400)
    assert cut and len(text.encode()) <= 400 and "[!WARNING]" in text and md.capped("x", 400) == ("x", False)
    tables_ = [{"rows": [{"a": "x" * 50}] * 40, "truncated": False, "warnings": []}]
    text, cut = md.capped_tables(tables_, 2500)
    assert cut and len(text.encode()) <= 2500
    assert "# Source: a" in md.rendered([("a", "text", "x"), ("b", "text", " ")]) and "[!NOTE]" in md.rendered([("b", "text", " ")])


# ---- tables ----


def test_csv_records_with_stray_quotes_and_line_breaks():
    text = 'a,b\n1,"x,\n""y"""\n3" z,4\n\n5,"q\r\nr"\r\n"open,6\n7'
    assert tables.records(text, ",") == [["a", "b"], ["1", 'x,\n"y"'], ['3" z', "4"], ["5", "q\nr"], ["open,6\n7"]]
    assert tables.sniffed("a;b;c,d") == ";" and tables.sniffed("abc") == "," and tables.sniffed("a,b;c") == ","


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n é', max_size=6), min_size=2, max_size=3), min_size=1, max_size=6))
def test_csv_round_trip(rows):
    assert tables.records(g.csv_file(rows).decode(), ",") == rows


def test_csv_entry_narrowing():
    data = b"Name,Name,\nA,1,x\nB,2\nC,3,y,z\n"
    t = parsed(data, "a.csv")["tables"][0]
    assert t["range"] == "A1:D4" and t["column_count"] == 4 and t["rows"][0] == {"Name": "A", "Name_2": "1", "column_3": "x", "column_4": ""}
    assert t["headers"]["Name"]["column_index"] == 1
    t = parsed(data, "a.csv", rows="3:9")["tables"][0]
    assert t["row_range"] == {"first_row": 3, "last_row": 4} and t["truncated"] and "--rows 3:9" in t["warnings"][0]
    assert parsed(data, "a.csv", columns=["Nope"])["error"]["code"] == "parse_failed"
    t = parsed(b"", "a.csv")["tables"][0]
    assert t["range"] is None and t["column_count"] == 0
    assert parsed(b"a,b\n" + b"1,2\n" * 300, "a.csv")["tables"][0]["warnings"] == ["preview limited to first 100 data rows out of 300"]


def test_xlsx_values():
    data = g.xlsx({"S": [["n", "f", "s", "d", "b"], [1000000, 1e-7, "x|y", ("date", 45000.5), False], [None] * 5, [2.5, 0.0, "", ("date", 0.25), True]]})
    rows = parsed(data, "a.xlsx")["tables"][0]["rows"]
    assert rows[0] == {"n": "1000000", "f": "0.0000001", "s": "x|y", "d": "2023-03-15T12:00:00", "b": "FALSE"}
    assert rows[1]["d"] == "06:00:00" and rows[1]["n"] == "2.5" and rows[1]["f"] == "0"
    assert "## Sheet: S" in parsed(data, "a.xlsx", mode="document")["markdown"]
    assert parsed(data, "a.xlsx", sheet="T")["error"]["code"] == "parse_failed"
    assert tables.letters(28) == "AB" and tables.excel_moment(1) == "1899-12-31" and tables.is_date_format("yyyy") and not tables.is_date_format('0.0"days"')


# ---- documents ----


def test_html_formatting_outlives_paragraphs():
    out = html.markdown_of("<article><p><b>x<p>y<b>z<p>w</article>", None, 10**6)
    assert out == "**x**\n\n**y**z****\n\n****w****\n" or out == "**x**\n\n**y**z****\n\n****w****\n"
    assert html.markdown_of("<p><b>1<i>2</b>3</i>4", None, 10**6) == "**1*2****3*4\n"
    assert html.markdown_of("<body>bare<div>bare</div><div><p>in</div></body>", None, 10**6) == "in\n"
    assert html.markdown_of("<table>loose<tr><td>a<td>b</table><p>x", None, 10**6) == "| a | b |\n| --- | --- |\n\nx\n"
    assert html.markdown_of("<ul><li>a<ul><li>n</ul><li>b</ul><pre>\nx\n y</pre><blockquote><p>q</p><p>r</p></blockquote>", None, 10**6) == "- a\n\n- b\n\n```\nx\n y\n```\n\n> qr\n"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<a href=x>", "</a>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "x", "<br>", "<h1>", "</h1>"]), max_size=40))
def test_any_html_is_rendered(parts):
    assert html.markdown_of("".join(parts), None, 10**6).endswith("\n")


def test_docx():
    note = '<w:p><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t xml:space="preserve"> bold </w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:hyperlink r:id="web"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p>'
    alt = '<w:p><mc:AlternateContent xmlns:mc="m"><mc:Choice><w:r><w:t>one</w:t></w:r></mc:Choice><mc:Fallback><w:r><w:t>two</w:t></w:r></mc:Fallback></mc:AlternateContent></w:p>'
    r = parsed(g.docx([("h", 1, "T"), ("xml", note), ("xml", alt)], notes={"2": "Said so."}))
    assert r["markdown"] == "# T\n\n**bold** [^2][site](https://example.com/x)\n\none\n\n[^2]: Said so.\n"


def test_pptx_order_and_epub():
    r = parsed(g.pptx([{"texts": [f"s{i}"]} for i in range(1, 12)]))
    assert [x for x in r["markdown"].split() if x.startswith("s")] == [f"s{i}" for i in range(1, 12)]
    assert parsed(g.epub(["<p>a</p>", "<p>b</p>"]))["markdown"] == "## Chapter 1\n\na\n\n## Chapter 2\n\nb\n"


def test_notebook_versions():
    old = b'{"worksheets": [{"cells": [{"cell_type": "heading", "level": 2, "source": "H"}, {"cell_type": "code", "language": "r", "input": ["x\\n", "y"]}]}]}'
    assert parsed(old, "a.ipynb")["markdown"] == "## H\n\n```r\nx\ny\n```\n"
    assert parsed(b"{}", "a.ipynb")["error"]["code"] == "parse_failed"


def test_pdf_pages_and_media():
    data = g.pdf([[(50, 60, "Hello (world)"), (50, 72, "second line")], [], [(50, 60, "third")]], images=1)
    r = parsed(data, provenance="page")
    assert r["markdown"].startswith("## Page 1\n\nHello (world)\nsecond line\n\n![PDF image 1 (p1)](grove://pdf/obj/4/0)\n\n## Page 2\n\n## Page 3")
    raw = r["markdown"].encode()
    assert [raw[s["out_start"] : s["out_end"]].decode().split("\n")[0] for s in r["provenance"]] == ["## Page 1", "## Page 2", "## Page 3"]
    assert dispatch.media(data, "grove://pdf/obj/4/0").startswith(b"\x89PNG")
    assert b"Hello" in b"".join(dispatch.media(data, "grove://pdf/page/1").split(b"</text>")) or b">H<" in dispatch.media(data, "grove://pdf/page/1")
    assert parsed(data, pages="9:9")["error"]["code"] == "parse_failed"
    assert parsed(data, max_work_units=3)["error"]["code"] == "work_budget_exceeded"
    assert parsed(g.pdf([[]]))["error"]["code"] == "pdf_no_extractable_content"


def test_pdf_object_streams_and_filters():
    inner = b"1 0 2 36 << /Type /Catalog /Pages 2 0 R >>      << /Type /Pages /Kids [4 0 R] /Count 1 /MediaBox [0 0 200 200] >>"
    first = 9
    body = zlib.compress(inner)
    content = zlib.compress(b"BT /F 10 Tf 20 100 Td [(A) -900 (B)] TJ T* (C) ' ET")
    data = b"%PDF-1.5\n3 0 obj\n<< /Type /ObjStm /N 2 /First " + str(first).encode() + b" /Filter /FlateDecode /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n"
    data += b"4 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >> >> >>\nendobj\n"
    data += b"5 0 obj\n<< /Filter [/FlateDecode] /Length " + str(len(content)).encode() + b" >>\nstream\n" + content + b"\nendstream\nendobj\n6 0 obj\n<< /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream\nendobj\n"
    assert "A BC" in parsed(data)["markdown"]
    assert Lexer(rb"(a\(b\)\101\n) <4142> [1 0 R /N#20x]").token() == b"a(b)A\n"
    assert lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1, 100) == b"-----A---B"
    assert predicted(bytes([2, 1, 2, 2, 1, 1]), {"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])
    assert len(Pdf(g.pdf([[(1, 1, "x")], []]), 10**6).pages) == 2


def test_pdf_fonts():
    assert glyph_text("eacute") == "é" and glyph_text("uni0041") == "A" and glyph_text("u1F600") == "😀" and glyph_text("alpha") == "α" and glyph_text("g12") == ""
    c = CMap(b"2 beginbfchar <01> <0041> <02> <00660069> endbfchar 1 beginbfrange <10> <12> <0061> endbfrange")
    assert c.get(1) == "A" and c.get(2) == "fi" and c.get(0x12) == "c" and c.get(99) is None
    assert pdf.suspicious("a\x02b") and pdf.suspicious("GLYPH<1> glyph<2>") and not pdf.suspicious("a\tb")


def test_table_recovery():
    assert recovered_tables("t\na  b  c\n\n1  2  3\n4  5  6|\nend") == "t\n\n| a | b | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 4 | 5 | 6\\| |\n\nend"
    assert recovered_tables("a  b  c\n1  2  3") == "a  b  c\n1  2  3"


def test_errors_are_rows():
    import zipfile

    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"A" * 5_000_000)
    for data, source, code in (
        (bomb.getvalue(), "a.docx", "parse_failed"), (b"PK\x03\x04xx", "a.docx", "invalid_container"), (g.archive({"word/x": "y"}), "a", "invalid_container"), (b"{", "a.ipynb", "parse_failed"),
        (b"x" * 100, "a.txt", "parse_budget_exceeded"), (None, "a.txt", "parse_failed"), (g.archive({"word/document.xml": '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'}), "a", "parse_failed"),
    ):
        r = parsed(data, source, max_parse_bytes=50 if code == "parse_budget_exceeded" else 10**7)
        assert r["error"]["code"] == code and code in ERROR_CODES and r["markdown"] is None


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(["a.pdf", "a.docx", "a.xlsx", "a.html", "a.csv", "a.epub", "a.ipynb", "a.bin"]))
def test_nothing_throws(data, source):
    for prefix in (b"", b"%PDF-1.4\n"):
        r = parsed(prefix + data, source)
        assert (r["error"] is None) == (r["kind"] is not None)


# ---- frames ----


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("a.csv", b"x,y\n1,2\n3,4\n", "text/csv"), ("b.pdf", g.pdf([[(50, 60, "one")], [(50, 60, "two")]]), None), ("c.docx", g.docx([("p", "para"), ("image", "i.png")], {"i.png": b"pic"}), None),
        ("d.bin", b"\x00", None), ("e.txt", None, None), ("f.md", "# T\n\ntext | é\n\n\nlast".encode(), None),
    ]
    inputs = spark.createDataFrame(data, "source string, content binary, error string")
    return inputs, engine.parse(inputs, provenance="page").persist()


def test_views(rows):
    inputs, p = rows
    assert p.count() == 6
    assert {r.source: r.code for r in engine.errors(p).collect()} == {"d.bin": "unsupported_format", "e.txt": "parse_failed"}
    assert [(r.page, r.text) for r in engine.pages(p).orderBy("page").collect()] == [(1, "## Page 1\n\none"), (2, "## Page 2\n\ntwo")]
    assert [r.page for r in engine.pages(p, 2, 2).collect()] == [2]
    assert sorted((r.row_no, r.header, r.value) for r in engine.table_cells(p).collect()) == [(2, "x", "1"), (2, "y", "2"), (3, "x", "3"), (3, "y", "4")]
    assert engine.failures(p, 1).collect()[0].source == "d.bin"
    assert all(r.code in WARNING_CODES for r in engine.warnings(p).collect())
    assert engine.default_mode(p).first().mode == "md"
    assert [(r.name, bytes(r.data)) for r in sinks.media_files(inputs).collect()] == [("docx_part_word_media_i.png", b"pic")]
    assert sinks.media_files(inputs, max_parse_bytes=1).count() == 0
    assert '"schema_version"' in sinks.envelope(p).first().json and '"provenance"' in sinks.provenance_json(p).first().json
    assert sinks.report(p).startswith("> [!CAUTION]") and '"tables"' in sinks.tables_report(p)
    empty = engine.parse(inputs.limit(0))
    assert empty.count() == 0 and corpus.metrics(empty).first().ready == 0


def test_deep_pages():
    """No depth is changed; what would take too long is an error, not another tree."""
    for n in (300, 3000):
        assert parsed(f"{'<div>' * n}<p>deep <b>b</b></p>{'</div>' * n}<p>after</p>".encode(), "a.html")["markdown"] == "deep **b**\n\nafter\n"
        assert parsed(f"<p>{'<span>' * n}deep{'</span>' * n} x</p><p>after</p>".encode(), "a.html")["markdown"] == "deep x\n\nafter\n"
        assert parsed(f"<ul>{'<li>x' * n}</ul>".encode(), "a.html")["markdown"].count("- x") == n
    for bad in ("<b><i><div>" * 20_000 + "x" + "</b>" * 20_000, "<table><tr><td>" * 5000 + "x"):
        assert parsed(bad.encode(), "a.html")["error"]["code"] == "parse_budget_exceeded"


def test_media_are_written(rows, tmp_path):
    inputs, _ = rows
    for _ in range(2):  # a task that runs again leaves the same files
        got = sinks.write_media(sinks.media_files(inputs), str(tmp_path)).collect()
        assert [(r.name, open(r.path, "rb").read()) for r in got] == [("docx_part_word_media_i.png", b"pic")]
    assert [f for _, _, fs in os.walk(tmp_path) for f in fs] == ["docx_part_word_media_i.png"]


def test_reports_of_many_inputs(spark):
    """No number of inputs is fixed: the limit of bytes alone decides, and what is left out is counted."""
    texts = spark.range(3000).selectExpr("format_string('%05d.txt', id) source", "cast(concat('text ', id) as binary) content")
    p = engine.parse(texts, doc_id="source").persist()
    whole = sinks.report(p, 1 << 20)
    assert whole.count("# Source: ") == 3000 and "left out" not in whole
    short = sinks.report(p, 3000)
    shown = short.count("# Source: ")
    assert len(short.encode()) <= 3000 and 10 < shown < 200 and f"> {3000 - shown} more inputs are left out" in short
    csv = spark.range(1500).selectExpr("format_string('%05d.csv', id) source", "cast(concat('a\n', id) as binary) content")
    t = engine.parse(csv, doc_id="source").persist()
    found = json.loads(sinks.tables_report(t, 8 << 20))
    assert len(found["tables"]) == 1500 and not found["truncated"]
    cut = json.loads(sinks.tables_report(t, 20000))
    assert cut["truncated"] and any("left out" in w for w in cut["warnings"])
    assert sinks.report(p.limit(0)) == "" and json.loads(sinks.tables_report(t.limit(0)))["tables"] == []


def cli(*args, stdin=b""):
    out = subprocess.run([sys.executable, "-m", "inkgrove", *args], input=stdin, capture_output=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return out.returncode, out.stdout.decode(), out.stderr.decode()


def test_command_line(tmp_path):
    import http.server
    import threading

    (tmp_path / "a.md").write_text("# A\n" + "x" * 3000)
    (tmp_path / "b.md").write_text("# B\n")

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            good = self.path == "/p"
            self.send_response(200 if good else 404)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<main><h1>Web</h1><a href='/q'>q</a></main>" if good else b"no")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        code, out, err = cli(f"{base}/p", f"{base}/missing", str(tmp_path / "b.md"), str(tmp_path / "none.md"))
        assert code == 0 and "# Web" in out and f"({base}/q)" in out and "# B" in out
        # what failed stands in the output and in the messages
        assert out.count("[!CAUTION]") == 2 and err.count("parse_failed") == 2
    finally:
        server.shutdown()
    code, out, _ = cli("--max-output-kib", "1", str(tmp_path / "a.md"), str(tmp_path / "none.md"))
    assert code == 0 and len(out.encode()) <= 1024 and "[!WARNING]" in out and "[!CAUTION]" in out
    assert cli(str(tmp_path / "none.md"))[0] == 1 and cli("-", "--format", "markdown", stdin=b"# In")[1] == "# In\n"
    (tmp_path / "p.pdf").write_bytes(g.pdf([[(50, 60, x)] for x in ("one", "two", "three")]))
    assert json.loads(cli("--provenance", "page", str(tmp_path / "p.pdf"))[1])["provenance"][2]["page_number"] == 3
    (tmp_path / "long.pdf").write_bytes(g.pdf([[(50, 60, "x" * 900)] for _ in range(3)]))
    assert cli("--provenance", "page", "--max-output-kib", "1", str(tmp_path / "long.pdf"))[:2] == (1, "")
    code, out, err = cli("--pages", "2,2", str(tmp_path / "p.pdf"))
    assert code == 0 and "two" in out and "these are about 1 of" in err


def test_corpus_layer(rows, spark):
    _, p = rows
    assert {(r.kind, r.text) for r in corpus.chunks(p).where("doc_id = 'f.md'").collect()} == {("paragraph", "# T"), ("paragraph", "text | é"), ("paragraph", "last")}
    assert corpus.metrics(p).first().errors == 2
    assert corpus.by_status(corpus.manifest(p), "error").count() == 2
    assert corpus.tables_markdown(p).first().markdown == "| x | y |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
    assert "# a.csv" in [r.text for r in corpus.extracted_text(p).where("doc_id = 'a.csv'").collect()][0]
    t = spark.createDataFrame([(1, "s", "aaa b"), (2, "s", "AA"), (3, "s", None)], "index int, source string, text string")
    assert [(r["index"], r.score) for r in corpus.search(t, "aa B").collect()] == [(1, 2), (2, 1)]
    assert corpus.search(t, "  ").count() == 0
    b = spark.createDataFrame([("g", 1, 5), ("g", 2, 8), ("g", 3, 4)], "g string, o int, n long")
    assert [r.accepted for r in corpus.budget_fold(b, "g", "o", "n", 10).orderBy("o").collect()] == [True, False, True]
    x = spark.createDataFrame([("![a](grove://pdf/page/3)",)], "t string")
    assert x.select(corpus.relinked(x.t, "/m?u=")).first()[0] == "![a](/m?u=grove%3A%2F%2Fpdf/page/3)"


def test_locate():
    text = "## Page 1\n\nRevenue grew.\n\n## Page 2\n\n| Item | 2024 |\n| --- | --- |\n| Revenue | 1,335.00 |\n"
    assert evidence.locate(text, "Revenue  grew")["tier"] == "whitespace" and evidence.locate(text, "Revenue grew")["page"] == 1
    found = evidence.locate(text, "2024 Revenue 1,335.00")
    assert found["page"] == 2 and found["hit"] == "| Revenue | 1,335.00 |"
    assert evidence.locate(text, "Costs 1,335.00") is None and evidence.locate(text, "") is None and evidence.locate(None, "x") is None


CHARSET_TEXTS = {
    "cp1252": ["Übergröße für Mädchen", "naïve café", "El niño comió piñas en España.", "Ça va très bien, merci à tous.", "São Paulo é uma cidade muito grande, não é?", "Straße", "It’s a “quoted” word – here…", "Fünf Äpfel ÜBER der BRÜCKE", "Å ikke forstå, ærlig talt, på øya"],
    "cp1251": ["Привет, мир", "Московский государственный университет", "ПРИВЕТ", "Съешь ещё этих мягких французских булок"],
    "gb18030": ["你好，世界", "这是一个简单的句子。", "营业总收入（百万元）,1335\n"],
    "big5": ["你好，世界", "這是一個簡單的句子。", "國立臺灣大學圖書館", "今天天氣很好，我們去公園散步。"],
    "shift_jis": ["こんにちは世界", "これは簡単な文章です。", "東京都千代田区", "カタカナとひらがな"],
    "euc_jp": ["こんにちは世界", "これは簡単な文章です。", "今日は天気がいいですね"],
    "euc_kr": ["안녕하세요 세계", "이것은 간단한 문장입니다.", "오늘은 날씨가 좋네요"],
    "cp1250": ["Zażółć gęślą jaźń", "Příliš žluťoučký kůň úpěl ďábelské ódy"],
    "cp1253": ["Καλημέρα κόσμε", "Η γρήγορη αλεπού"],
    "cp1256": ["مرحبا بالعالم"],
    "iso2022_jp": ["これは簡単な文章です。"],
}


def font_texts(info: str, shown: str, extra: list[bytes] = ()) -> str:
    """Text of a page that shows a string in a font."""
    content = f"BT /F1 10 Tf 1 0 0 1 50 700 Tm {shown} ET".encode("latin-1")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [4 0 R] /Count 1 >>", f"<< /Type /Font {info} >>".encode(), b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 5 0 R /Resources << /Font << /F1 3 0 R >> >> >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content), *extra]
    return parsed(g._pdf_file(objects), "a.pdf")["markdown"].partition("\n\n")[2].strip()


def test_pdf_standard_fonts():
    assert font_texts("/Subtype /Type1 /BaseFont /Times-Roman", "(`a\xae\xd0' \xfb) Tj") == "‘afi—’ ß"
    assert font_texts("/Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding", "(\xfc') Tj") == "ü'"
    assert font_texts("/Subtype /Type1 /BaseFont /Symbol", "(abS\xe5 \xa3) Tj") == "αβΣ∑ ≤"
    assert font_texts("/Subtype /Type1 /BaseFont /ZapfDingbats", "(!H4\xac) Tj") == "✁★✔①"
    program = b"/Encoding 256 array\ndup 1 /alpha put\ndup 2/Adieresis put\nreadonly def currentfile eexec junk"
    assert font_texts("/Subtype /Type1 /BaseFont /Own /FontDescriptor << /FontFile 6 0 R >>", "<0102> Tj", [b"<< /Length %d >>\nstream\n%s\nendstream" % (len(program), program)]) == "αÄ"
    # words meet by the font's own widths: "mm" is 15.56 wide in serif, 12 in typewriter
    for font, width in (("Times-Roman", 15.56), ("Courier", 12.0), ("Helvetica", 16.66)):
        assert font_texts(f"/Subtype /Type1 /BaseFont /{font}", f"(mm) Tj 1 0 0 1 {50 + width} 700 Tm (nn) Tj") == "mmnn"
        assert font_texts(f"/Subtype /Type1 /BaseFont /{font}", f"(mm) Tj 1 0 0 1 {50 + width + 4} 700 Tm (nn) Tj") == "mm nn"


def test_charsets(spark):
    rows = [(name, text, text.encode(name)) for name, texts in CHARSET_TEXTS.items() for text in texts]
    for name, text, data in rows:
        assert decoded(data) == text, (name, text)
    rows += [("utf-8", "Ä ok", "Ä ok".encode()), ("utf-8", "Ä ok", b"\xef\xbb\xbf" + "Ä ok".encode()), ("utf-16-le", "Ä", b"\xff\xfe" + "Ä".encode("utf-16-le")), ("utf-8", "", b""), ("none", None, None), ("utf-8", "é" * 50 + "\ufffd" + "日本" * 50, ("é" * 50).encode() + b"\xff" + ("日本" * 50).encode())]
    df = spark.createDataFrame(rows, "name string, text string, data binary")
    assert df.where(~decoded_text(F.col("data")).eqNullSafe(F.col("text"))).count() == 0


def test_every_tier_of_a_set_of_quotes(spark):
    """One pass with all quotes gives what each quote gives alone; parts change nothing."""
    text = "## Page 1\n\n营业收入 (百万元)\n\n| 营业收入（百万元） | 777,102 | 12.5% |\n| 净利润 | 53128 | 7 |\n\n## Page 2\n净利润 为 13.35亿 元, sum 4711.\na  b\nc d\n"
    want = {"净利润 为": "exact", "a b c": "whitespace", "2024A 净利润 53128": "number", "海外业务 53128": None, "4711": "exact", "999 4711": "number", "净利润 7": None, "12.5%": "exact", "x 12.5%": "number", "净利润 133500万": "amount", "利息 777102万": None, "利息 77.7万": None, "利息 77.71亿": None, "利息 7771.02亿": "amount", "": None, " ": None}
    quotes = [(k, q) for k, q in enumerate(want)]
    got = evidence.QuoteSet(quotes).find(text)
    for k, q in quotes:
        alone = evidence.locate(text, q)
        assert got.get(k) == alone and (alone and alone["tier"]) == want[q], q
        if alone and alone["tier"] in ("exact", "whitespace"):
            assert "".join(text[alone["start"] : alone["end"]].split()) == "".join(q.split())
    row = evidence.locate(text, "2024A 净利润 53128")
    assert row["hit"] == "| 净利润 | 53128 | 7 |" and row["page"] == 1 and evidence.locate(text, "a b c")["page"] == 2
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing"), (1, text)], "doc_id int, text string")
    df = spark.createDataFrame(quotes, "quote_id int, quote string")
    whole = sorted(tuple(r) for r in evidence.evidence_hits(docs, df).collect())
    assert len(whole) == 2 * len(got) and {r[1] for r in whole} == set(got)
    most, evidence.MAX_QUOTE_CHARS = evidence.MAX_QUOTE_CHARS, 60
    try:
        assert sorted(tuple(r) for r in evidence.evidence_hits(docs, df).collect()) == whole
    finally:
        evidence.MAX_QUOTE_CHARS = most
    assert evidence.evidence_hits(docs, df.limit(0)).count() == 0 and evidence.evidence_hits(docs.limit(0), df).count() == 0
    assert docs.select(evidence.located(docs.text, F.lit("x 12.5%"))["tier"].alias("t")).where("t = 'number'").count() == 2


def test_evidence_of_many_quotes_is_handed_on_in_pieces(spark, monkeypatch):
    """Quotes of one wording are found once, no worker holds all that it finds, amounts out of reach are not looked up."""
    texts = [f"## Page {n}\n\n| Order {n} | 134000.50 |\n| Order 555 | 9.99 |\n" for n in range(30)]
    quotes = [(k, "Order of 13.4万") for k in range(1000)] + [(k, f"{k}. Order of 13.4万") for k in range(1000, 1500)] + [(k, f"Order of {k}.5万") for k in range(1500, 1600)] + [(None, "Order 555 |"), (7, None), (7, " "), (7, "Order 555 |")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    df = spark.createDataFrame(quotes, "quote_id int, quote string")
    kind, functions = type(docs), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: functions.append(f) or plain(self, f, schema))
    looked, near = [], evidence.Source.near
    monkeypatch.setattr(evidence.Source, "near", lambda self, value: looked.append(value) or near(self, value))
    found = evidence.evidence_hits(docs, df)
    sizes = [b.num_rows for b in functions[0](iter([pa.RecordBatch.from_pydict({"d": list(range(30)), "t": texts})]))]
    assert sum(sizes) == 30 * 502 and max(sizes) <= 10_000
    assert set(looked) == {134000.0} and len(looked) == 30 * 501
    wanted = sorted((n, -1 if k is None else k, *hit.values()) for n, t in enumerate(texts) for k, q in quotes if (hit := evidence.locate(t, q)))
    rows = lambda df: sorted((r[0], -1 if r[1] is None else r[1], *r[2:]) for r in df.collect())
    assert found.columns == ["doc_id", "quote_id", *evidence.LOCATED.names] and len(wanted) == 30 * 1502
    assert rows(found) == wanted
    monkeypatch.setattr(evidence, "MAX_SHARED_IDS", 10)  # ids and what was found meet by a shuffle
    assert rows(evidence.evidence_hits(docs, df)) == wanted
    # a row of long texts is no longer held with others
    assert [len(x) for x in evidence.pieces([("a" * (3 << 20), 1)] * 5 + [(1, None)] * 20_000)] == [2, 2, 10_000, 10_000, 1]


def test_groups_that_become_one_row_are_bounded(spark):
    df = spark.range(30).selectExpr("cast(id % 2 as int) g", "id o", "id size", "'t' markdown", "cast(id as string) source")
    assert corpus.concatenated(df, "g", most=15).count() == 2 and corpus.budget_fold(df, "g", "o", "size", 50, most=15).count() == 30
    claims = df.selectExpr("g", "o", "'c' claim", "'supported' final_verdict")
    for call in (lambda: corpus.concatenated(df, "g", most=14), lambda: corpus.budget_fold(df, "g", "o", "size", 50, most=14), lambda: evidence.trace(claims, "g", "o", most=14)):
        with pytest.raises(ValueError):
            call()


def test_gate(spark):
    rows = [(1, "supported", True), (2, "supported", None), (3, "unsupported", True), (4, "partial", True)]
    out = evidence.gated(spark.createDataFrame(rows, "k int, verdict string, located boolean"))
    assert [r.final_verdict for r in out.orderBy("k").collect()] == ["supported", "unsupported", "unsupported", "partial"]
    again = evidence.rechecked(out, spark.createDataFrame([(2, True)], "k int, second_located boolean"), "k")
    assert [r.final_verdict for r in again.orderBy("k").collect()] == ["supported", "partial", "unsupported", "partial"]
    j = spark.createDataFrame([("```json\n{\"a\": 1}\n``` done",)], "t string")
    assert j.select(evidence.json_of(j.t, "a int").alias("j")).first().j.a == 1


def test_sql_functions(spark):
    sql.register(spark)
    assert spark.sql("select detect_format(X'255044462D', 'x', null) as f").first().f == "pdf"
    assert spark.sql("select absolute_url('https://a.example/b', '/c') as u").first().u == "https://a.example/c"
    assert [r.text for r in spark.sql("select c.text from (select 'a\\n\\nb' as t), lateral chunks(t) c order by c.index").collect()] == ["a", "b"]
    assert spark.sql("select count(*) as n from (select cast('x,y\\n1,2' as binary) as b), lateral table_cells(b, 'a.csv')").first().n == 2


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello")
    (tmp_path / "in/b.txt").write_text("x" * 500)
    rows = {Path(r.source).name: r.content for r in read_files(spark, str(tmp_path / "in"), max_parse_bytes=100).collect()}
    assert bytes(rows["a.txt"]) == b"hello" and rows["b.txt"] is None
    query = parse_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), once=True)
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    stream = spark.readStream.format("rate").load().selectExpr("timestamp as modificationTime", "cast('x' as binary) as content")
    assert arrivals(stream).isStreaming
    assert inside("a/../b", "/root/x") == "/root/x/b"
    with pytest.raises(ValueError):
        inside("../y", "/root/x")


def test_command_line(tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.md").write_text("# T\n")
    run = lambda *a: subprocess.run([sys.executable, "-m", "inkgrove", *a], capture_output=True, text=True, cwd=Path(__file__).parents[1])
    assert '"x": "1"' in run(str(tmp_path / "a.csv")).stdout
    assert run(str(tmp_path / "*.md")).stdout == "# T\n"
    assert run(str(tmp_path / "none.md")).returncode == 1


def test_squeeze():
    assert squeezed("　a  b\n") == "a b"


# ---- encryption ----


def encrypted(kind):
    """A PDF of one page that the empty password opens, by RC4 or AES."""
    from hashlib import md5

    from inkgrove.parsers.pdf_crypt import PAD, Aes, rc4

    plain, file_id, owner, rights = g.pdf([[(50, 60, "secret (words)")]]), b"0123456789abcdef", b"o" * 32, -44
    key = md5(PAD + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    for _ in range(50):
        key = md5(key).digest()
    user = rc4(key, md5(PAD + file_id).digest())
    for i in range(1, 20):
        user = rc4(bytes(b ^ i for b in key), user)
    stream = Pdf(plain, 10**6).objects[4].raw
    salted = md5(key + (4).to_bytes(3, "little") + b"\x00\x00" + (b"sAlT" if kind == "AESV2" else b"")).digest()
    if kind == "AESV2":
        fill = 16 - len(stream) % 16
        body = b"i" * 16 + Aes(salted).encrypt(stream + bytes([fill]) * fill, b"i" * 16)
    else:
        body = rc4(salted, stream)
    out = plain.replace(b"<< /Length %d >>\nstream\n%s" % (len(stream), stream), b"<< /Length %d >>\nstream\n%s" % (len(body), body))
    version = b"/V 4 /R 4 /CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF" if kind == "AESV2" else b"/V 2 /R 3"
    entry = b"<< /Filter /Standard %s /Length 128 /P %d /O <%s> /U <%s> >>" % (version, rights, owner.hex().encode(), (user + bytes(16)).hex().encode())
    return out.replace(b"/Root 1 0 R", b"/Root 1 0 R /ID [<%s> <00>] /Encrypt %s" % (file_id.hex().encode(), entry))


@pytest.mark.parametrize("kind", ["RC4", "AESV2"])
def test_empty_password_opens(kind):
    assert "secret (words)" in parsed(encrypted(kind))["markdown"]
    broken = encrypted(kind).replace(b"/P -44", b"/P -43")
    assert parsed(broken)["error"]["code"] == "encrypted_pdf"


def test_ciphers_by_published_vectors():
    from inkgrove.parsers.pdf_crypt import Aes, rc4

    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        aes = Aes(bytes(range(n)))
        assert aes.encrypt_block(block).hex() == want and aes.decrypt_block(bytes.fromhex(want)) == block
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_workbook_cell_kinds():
    """Shared strings with phonetic runs, formula results, errors, builtin date formats and sparse rows."""
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="x"><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": g.rels({"r1": ("worksheet", "/xl/worksheets/one.xml"), "r2": ("worksheet", "worksheets/two.xml")}),
        "xl/styles.xml": f'<styleSheet xmlns="{s}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="21"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>Head</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/worksheets/one.xml": f'<worksheet xmlns="{s}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>Mid</t></is></c><c r="D2" t="s"><v>1</v></c></row>'
        '<row r="4"><c r="B4" t="str"><f>A1</f><v>made</v></c><c r="C4" t="e"><v>#DIV/0!</v></c><c r="D4" s="1"><v>45000</v></c></row>'
        '<row r="5"><c r="B5" s="2"><v>0.5</v></c><c r="C5" t="b"><v>1</v></c><c r="D5"><v>12345.6789</v></c></row></sheetData></worksheet>',
        "xl/worksheets/two.xml": f'<worksheet xmlns="{s}"><sheetData/></worksheet>',
    }
    (t,) = parsed(g.archive(parts), "a.xlsx")["tables"]
    assert t["workbook_sheets"] == ["A", "B"] and t["header_row"] == 2 and t["range"] == "B2:D5" and t["row_numbers"] == [4, 5]
    assert t["rows"] == [{"Head": "made", "Mid": "#DIV/0!", "two runs": "2023-03-15"}, {"Head": "12:00:00", "Mid": "TRUE", "two runs": "12345.6789"}]
    assert "## Sheet: B" in parsed(g.archive(parts), "a.xlsx", mode="document")["markdown"]


def test_docx_lists_links_and_text_boxes():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    item = lambda n, lvl, t: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = item(1, 0, "a") + item(1, 1, "b") + item(1, 0, "c") + item(2, 0, "d")
    body += '<w:p><w:r><w:t>outer</w:t></w:r><w:r><w:pict><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p>'
    body += '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>'
    numbering = f'<w:numbering {w}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="8"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num></w:numbering>'
    r = parsed(g.archive({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/numbering.xml": numbering}))
    assert r["markdown"] == "1. a\n\n  - b\n\n2. c\n\n- d\n\nboxed\n\nouter\n\n| x<br>inner |  |\n| --- | --- |\n"
    assert [x["code"] for x in r["warnings"]] == ["merged_table_structure_not_preserved", "embedded_visuals_omitted"]


def test_agent_bodies_and_token_counts(rows, spark):
    _, p = rows
    bodies = {r.doc_id: r.body for r in corpus.agent_bodies(p, most=9).collect()}
    assert bodies["f.md"].startswith("# T\n\ntext\n[cut]") and "format: markdown" in bodies["f.md"]
    assert "page 2: bytes" in bodies["b.pdf"] and "pages: 2" in bodies["b.pdf"]
    t = spark.createDataFrame([(1, "a b c"), (2, None), (3, "é" * 10)], "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus.token_counts(t, lambda xs: [len(x.split()) for x in xs]).collect()) == [(1, 3), (2, 0), (3, 1)]
    d = spark.createDataFrame([("aé" * 10,)], "markdown string").selectExpr("'x' as doc_id", "'document' as kind", "markdown", "'text' as format", "named_struct('page_count', cast(null as int)) as stats", "array() as warnings", "cast(null as array<struct<out_start:bigint,out_end:bigint,page_number:int>>) as provenance")
    d = d.withColumn("warnings", d.warnings.cast("array<struct<code:string>>"))
    assert corpus.agent_bodies(d, most=5).first().body.startswith("aéa\n[cut]")


def test_long_and_deep_inputs_stay_linear():
    import time

    start = time.time()
    line = ",".join(['"a"', "b"] * 60_000)
    assert len(tables.records(line + "\n" + line, ",")[1]) == 120_000
    assert html.markdown_of("<div>" * 20_000 + "<p>x" + "<b>" * 2000 + "y", None, 10**7).startswith("x")
    assert parsed(b"%PDF-1.4\n" + b"[" * 50_000, "a.pdf")["error"] is not None
    assert len(tables.records('a"' + "\n" + '"open\n' * 20_000, ",")) > 1
    assert time.time() - start < 30
