"""One input to one result; every failure ends as an error with a stable code."""

from __future__ import annotations

import re
from collections.abc import Iterator

from inkgrove.functions.charset import decoded
from inkgrove.functions.detect import detect, is_table
from inkgrove.options import ParseOptions
from inkgrove.parsers import docx, html, pdf, slides, tables
from inkgrove.parsers.container import Container
from inkgrove.parsers.pdf_objects import Pdf
from inkgrove.parsers.result import Extracted
from inkgrove.schema import MEDIA_LINK, SCHEME, ParseError

_LINK = re.compile(MEDIA_LINK)


def document(data: bytes, fmt: str, source: str, content_type: str | None, o: ParseOptions) -> Extracted:
    most = o.max_parse_bytes
    if fmt == "pdf":
        return pdf.parse(data, most, o.pages, o.max_work_units, o.provenance == "page")
    if fmt == "docx":
        return docx.parse(data, most)
    if fmt == "pptx":
        return slides.parse_pptx(data, most)
    if fmt == "epub":
        return slides.parse_epub(data, most)
    if fmt == "ipynb":
        return slides.parse_ipynb(data, most)
    if fmt == "csv":
        return Extracted(tables.csv_markdown(data, most))
    if fmt == "xlsx":
        return Extracted(tables.xlsx_markdown(data, most))
    text = decoded(data)
    if fmt == "html" or fmt == "url" and not (content_type or "").startswith("text/markdown"):
        return html.parse(text, source, most)
    return Extracted(text)


def parse(data: bytes | None, source: str | None, content_type: str | None, o: ParseOptions) -> dict:
    """All fields of a parsed row but doc_id; never raises."""
    row = dict.fromkeys(("format", "kind", "markdown", "tables", "serialized_bytes", "error", "provenance"))
    row |= {"source": source, "warnings": [], "media": [], "stats": {"input_bytes": None if data is None else len(data), "output_bytes": None, "page_count": None}}
    try:
        if data is None:
            raise ParseError("parse_failed", "no content", "read")
        name = source or ""
        row["format"] = fmt = detect(data, name, content_type, o.format, o.max_parse_bytes)
        if o.mode == "tables" or o.mode == "auto" and is_table(fmt):
            if not is_table(fmt):
                raise ParseError("parse_failed", f"{fmt} has no tables")
            row["kind"] = "tables"
            row["tables"] = [tables.csv_entry(data, name, o)] if fmt == "csv" else tables.xlsx_entries(data, name, o)
            row["serialized_bytes"] = row["stats"]["output_bytes"] = tables.serialized_size(row["tables"])
            if row["serialized_bytes"] > o.max_parse_bytes:
                raise ParseError("parse_budget_exceeded", f"output over {o.max_parse_bytes} bytes")
        else:
            out = document(data, fmt, name, content_type, o)
            size = len(out.markdown.encode())
            if size > o.max_parse_bytes:
                raise ParseError("parse_budget_exceeded", f"output over {o.max_parse_bytes} bytes")
            row |= {"kind": "document", "markdown": out.markdown, "warnings": out.warnings, "media": out.media, "provenance": out.provenance or None}
            row["stats"] |= {"output_bytes": size, "page_count": out.page_count}
    except ParseError as e:
        row |= {"error": e.row(), "kind": None, "markdown": None, "tables": None, "serialized_bytes": None}
    except MemoryError:
        row |= {"error": ParseError("parse_budget_exceeded", "out of memory").row(), "kind": None, "markdown": None, "tables": None}
    except Exception as e:
        row |= {"error": ParseError("parse_failed", f"{type(e).__name__}: {e}"[:500]).row(), "kind": None, "markdown": None, "tables": None}
    return row


def valid_link(uri: str) -> bool:
    """Whether a text is a link to embedded media: an office part, a PDF object or a PDF page."""
    m = _LINK.fullmatch(uri)
    return m is not None and (m[1] is None or int(m[1]) < 1 << 32 and int(m[2]) < 1 << 16)


def media(data: bytes, uri: str, source: str = "", o: ParseOptions | None = None) -> bytes:
    """Bytes of embedded media by its link; the link must be of the input's own format."""
    o = o or ParseOptions()
    if not valid_link(uri):
        raise ParseError("parse_failed", f"not a media link: {uri}")
    fmt = detect(data, source, None, o.format, o.max_parse_bytes)
    if not uri.startswith(f"{SCHEME}{fmt}/") or fmt == "xlsx":
        raise ParseError("parse_failed", f"the link is not of a {fmt} file")
    return resource(opened(data, fmt, o), uri, o)


def opened(data: bytes, fmt: str, o: ParseOptions) -> Pdf | Container:
    return Pdf(data, o.max_parse_bytes) if fmt == "pdf" else Container(data, o.max_parse_bytes)


def resource(box: Pdf | Container, uri: str, o: ParseOptions) -> bytes:
    """What a valid link means in an opened file."""
    if isinstance(box, Container):
        return box.part(uri.split("/part/", 1)[1])
    m = _LINK.fullmatch(uri)
    if m[3]:
        return pdf.page_svg(box, int(m[3]), o.max_work_units)
    return pdf.image(box, int(m[1]), int(m[2]), o.max_parse_bytes)


def media_of(data: bytes, source: str | None, o: ParseOptions) -> Iterator[tuple[str, bytes]]:
    """Link and bytes of every extractable medium of a file, which is opened once; never raises."""
    row = parse(data, source, None, o)
    links = dict.fromkeys(m["uri"] for m in row["media"] if m["extractable"])
    if not links:
        return
    box = opened(data, row["format"], o)
    for uri in links:
        try:
            yield uri, resource(box, uri, o)
        except (ParseError, KeyError, ValueError):
            continue
