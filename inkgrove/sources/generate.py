"""Small valid containers from texts and rows: for round trips and tests."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from xml.sax.saxutils import escape, quoteattr

from inkgrove.parsers.tables import letters

_XML = '<?xml version="1.0" encoding="UTF-8"?>'
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
W_SPACE = _W
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def archive(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
            body = body.encode() if isinstance(body, str) else body
            info.compress_type = zipfile.ZIP_STORED if len(body) > 100 * len(set(body) or {0}) else zipfile.ZIP_DEFLATED
            z.writestr(info, body)
    return out.getvalue()


def rels(targets: dict[str, tuple[str, str]]) -> str:
    """id -> (kind, target); a web target is external."""
    rows = "".join(f'<Relationship Id="{i}" Type="{_R}/{k}" Target={quoteattr(t)}{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in t else ""}/>' for i, (k, t) in targets.items())
    return f'{_XML}<Relationships xmlns="{_REL}">{rows}</Relationships>'


def csv_file(rows: list[list], delimiter: str = ",") -> bytes:
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\n").writerows(rows)
    return out.getvalue().encode()


def xlsx(sheets: dict[str, list[list]], dates: str = "yyyy\\-mm\\-dd") -> bytes:
    """Workbook of typed cells: text, bool, numbers, ('date', serial), None for no cell."""

    def cell(row: int, column: int, v) -> str:
        ref = f"{letters(column)}{row}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, tuple):
            return f'<c r="{ref}" s="1"><v>{v[1]!r}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    parts = {
        "[Content_Types].xml": f'{_XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>',
        "xl/workbook.xml": f'{_XML}<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels({f"s{i}": ("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)}),
        "xl/styles.xml": f'{_XML}<styleSheet xmlns="{_S}"><numFmts><numFmt numFmtId="170" formatCode={quoteattr(dates)}/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    }
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'{_XML}<worksheet xmlns="{_S}"><sheetData>{body}</sheetData></worksheet>'
    return archive(parts)


def docx(blocks: list[tuple], images: dict[str, bytes] | None = None, notes: dict[str, str] | None = None, parts: dict | None = None) -> bytes:
    """Document of blocks: ('h', level, text), ('p', text), ('list', text), ('table', rows),
    ('image', name), ('xml', raw); parts are added to the container as they are."""
    more, links = parts or {}, {f"i{k}": ("image", f"media/{n}") for k, n in enumerate(images or {}, 1)}
    ids = {n: f"i{k}" for k, n in enumerate(images or {}, 1)}
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    body = []
    for b in blocks:
        if b[0] == "h":
            body.append(f'<w:p><w:pPr><w:pStyle w:val="Heading{b[1]}"/></w:pPr>{run(b[2])}</w:p>')
        elif b[0] == "p":
            body.append(f"<w:p>{run(b[1])}</w:p>")
        elif b[0] == "list":
            body.append(f'<w:p><w:pPr><w:pStyle w:val="ListBullet"/></w:pPr>{run(b[1])}</w:p>')
        elif b[0] == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in r) + "</w:tr>" for r in b[1])
            body.append(f"<w:tbl>{rows}</w:tbl>")
        elif b[0] == "image":
            body.append(f'<w:p><w:r><w:drawing><a:blip xmlns:a="{_A}" r:embed="{ids[b[1]]}"/></w:drawing></w:r></w:p>')
        else:
            body.append(b[1])
    parts: dict = {
        "[Content_Types].xml": f"{_XML}<Types/>",
        "word/document.xml": f'{_XML}<w:document xmlns:w="{_W}" xmlns:r="{_R}"><w:body>{"".join(body)}</w:body></w:document>',
        "word/_rels/document.xml.rels": rels(links | {"web": ("hyperlink", "https://example.com/x")}),
    }
    parts |= {f"word/media/{n}": d for n, d in (images or {}).items()} | more
    if notes:
        parts["word/footnotes.xml"] = f'{_XML}<w:footnotes xmlns:w="{_W}">' + "".join(f'<w:footnote w:id="{k}"><w:p>{run(v)}</w:p></w:footnote>' for k, v in notes.items()) + "</w:footnotes>"
    return archive(parts)


def pptx(slides: list[dict], images: dict[str, bytes] | None = None) -> bytes:
    """Slides of {texts, table, notes, images}."""
    para = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    parts: dict = {"[Content_Types].xml": f"{_XML}<Types/>", "ppt/presentation.xml": f'{_XML}<p:presentation xmlns:p="{_P}"/>'}
    for i, s in enumerate(slides, 1):
        links = {f"i{k}": ("image", f"../media/{n}") for k, n in enumerate(s.get("images", ()), 1)}
        body = "".join(f"<p:sp><p:txBody>{para(t)}</p:txBody></p:sp>" for t in s.get("texts", ()))
        if s.get("table"):
            rows = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{para(c)}</a:txBody></a:tc>" for c in r) + "</a:tr>" for r in s["table"])
            body += f"<p:graphicFrame><a:tbl>{rows}</a:tbl></p:graphicFrame>"
        body += "".join(f'<p:pic><p:blipFill><a:blip r:embed="i{k}"/></p:blipFill></p:pic>' for k in range(1, len(links) + 1))
        if s.get("notes"):
            links["n"] = ("notesSlide", f"../notesSlides/notesSlide{i}.xml")
            parts[f"ppt/notesSlides/notesSlide{i}.xml"] = f'{_XML}<p:notes xmlns:p="{_P}" xmlns:a="{_A}">{"".join(map(para, s["notes"]))}</p:notes>'
        parts[f"ppt/slides/slide{i}.xml"] = f'{_XML}<p:sld xmlns:p="{_P}" xmlns:a="{_A}" xmlns:r="{_R}">{body}</p:sld>'
        parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = rels(links)
    return archive(parts | {f"ppt/media/{n}": d for n, d in (images or {}).items()})


def epub(chapters: list[str]) -> bytes:
    """Book of chapters given as XHTML bodies."""
    items = "".join(f'<item id="c{i}" href="text/c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters)))
    order = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    return archive(
        {
            "mimetype": "application/epub+zip",
            "META-INF/container.xml": f'{_XML}<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
            "OEBPS/book.opf": f'{_XML}<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{order}</spine></package>',
        }
        | {f"OEBPS/text/c{i}.xhtml": f"<html><body>{c}</body></html>" for i, c in enumerate(chapters)}
    )


def notebook(cells: list[tuple[str, str]], language: str = "python") -> bytes:
    rows = [{"cell_type": k, "metadata": {}, "source": t.splitlines(keepends=True)} | ({"outputs": []} if k == "code" else {}) for k, t in cells]
    return json.dumps({"nbformat": 4, "metadata": {"kernelspec": {"language": language}}, "cells": rows}).encode()


def pdf(pages: list[list[tuple[float, float, str]]], extra: dict[int, str] | None = None, images: int = 0, height: int = 792) -> bytes:
    """PDF of pages, each with (x, y from the top, text) in a 10 point sans-serif font.

    extra adds raw content to a page (from 0); images places so many 2 x 2 pictures on the first one.
    """
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    names = ""
    for k in range(images):
        objects.append(b"<< /Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray /Length 4 >>\nstream\n\x00\x40\x80\xff\nendstream")
        names += f"/Im{k} {len(objects)} 0 R "
    kids = []
    for i, lines in enumerate(pages):
        body = "".join(
            "BT /F1 10 Tf 1 0 0 1 {:g} {:g} Tm ({}) Tj ET\n".format(x, height - y, t.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")) for x, y, t in lines
        )
        if i == 0:
            body += "".join(f"q 20 0 0 20 500 {700 - 30 * k} cm /Im{k} Do Q\n" for k in range(images))
        raw = (body + (extra or {}).get(i, "")).encode("cp1252", "replace")
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(raw), raw))
        content = len(objects)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 {height}] /Contents {content} 0 R /Resources << /Font << /F1 3 0 R >> /XObject << {names}>> >> >>".encode())
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    return _pdf_file(objects)


def pdf_objects(content: bytes, cmap: str, height: int = 792) -> bytes:
    """PDF of one page of compressed content, whose font F2 has two-byte codes that cmap gives as characters."""
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [6 0 R] /Count 1 >>",
        b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [7 0 R] /ToUnicode 4 0 R >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap.encode()),
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(content), content),
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 %d] /Contents 5 0 R /Resources << /Font << /F2 3 0 R >> >> >>" % height,
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /X /DW 500 /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>",
    ]
    return _pdf_file(objects)


def _pdf_file(objects: list[bytes]) -> bytes:
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))
