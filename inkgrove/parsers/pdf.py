"""PDF documents: pages, warnings, provenance and embedded pictures."""

from __future__ import annotations

import re
import struct
import zlib
from xml.sax.saxutils import escape

from inkgrove.functions.text import trimmed
from inkgrove.parsers.pdf_objects import Pdf, Stream
from inkgrove.parsers.pdf_text import Interpreter, PageText, Work, columns_text, recovered_tables
from inkgrove.parsers.result import Extracted
from inkgrove.schema import SCHEME, VECTOR_CURVES, ParseError

PICTURE_FILTERS = {"DCTDecode": "image/jpeg", "DCT": "image/jpeg", "JPXDecode": "image/jp2"}


_ODD = re.compile("[\\x00-\\x08\\x0e-\\x1b\\x7f-\\x84\\x86-\\x9f\\ufffd]")


def suspicious(text: str) -> bool:
    """Marks of an unreliable text layer: replacement or control characters, or raw glyph names."""
    if _ODD.search(text):
        return True
    return text.lower().count("glyph<") >= 2


def read_page(pdf: Pdf, page: dict, work: Work) -> PageText:
    """What a page shows; a page that can't be read is empty, a limit of work is not caught."""
    try:
        return Interpreter(pdf, page, work).out
    except ParseError as e:
        if e.code == "work_budget_exceeded":
            raise
    except Exception:
        pass
    return PageText(0.0, 0.0)


def extractable(pdf: Pdf, ref) -> bool:
    stream = pdf.get(ref)
    if not isinstance(stream, Stream):
        return False
    names = [n for n, _ in pdf.filters(stream)]
    if names and names[-1] in PICTURE_FILTERS:
        return True
    known = {"FlateDecode", "Fl", "LZWDecode", "LZW", "ASCIIHexDecode", "AHx", "ASCII85Decode", "A85", "RunLengthDecode", "RL"}
    return set(names) <= known and pdf.get(stream.info.get("BitsPerComponent")) == 8 and channels(pdf, stream) in (1, 3)


def channels(pdf: Pdf, stream: Stream) -> int:
    space = pdf.get(stream.info.get("ColorSpace"))
    if isinstance(space, list) and space:
        kind = str(pdf.get(space[0]))
        if kind == "ICCBased" and isinstance(profile := pdf.get(space[1]), Stream):
            return pdf.get(profile.info.get("N"), 0)
        return {"CalRGB": 3, "CalGray": 1}.get(kind, 0)
    return {"DeviceRGB": 3, "RGB": 3, "DeviceGray": 1, "G": 1}.get(str(space), 0)


def parse(data: bytes, most: int, pages: tuple[int, int] | None = None, max_work: int | None = None, provenance: bool = False) -> Extracted:
    pdf, work, out = Pdf(data, most), Work(max_work), Extracted()
    out.page_count = len(pdf.pages)
    if pages and pages[0] > out.page_count:
        raise ParseError("parse_failed", f"pages start at {pages[0]} but there are {out.page_count}")
    shown = [(n, read_page(pdf, p, work)) for n, p in enumerate(pdf.pages, 1) if not pages or pages[0] <= n <= pages[1]]
    blocks, columns, images, any_text = [], [], 0, False
    for number, page in shown:
        ordered = columns_text(page)
        text = trimmed("".join(page.flat) if ordered is None else ordered)
        if ordered is not None:
            columns.append(number)
        any_text |= bool(text)
        parts = [f"## Page {number}"]
        if text:
            parts.append(trimmed(recovered_tables(text)))
        handles = []
        for ref in page.images:
            images += 1
            ok = extractable(pdf, ref)
            uri = f"{SCHEME}pdf/obj/{ref[0]}/{ref[1]}"
            handles.append(ok)
            parts.append(f"![PDF image {images} (p{number})]({uri})" if ok else f"[PDF image {images} (p{number}): embedded, needs an external renderer]")
            out.media.append({"uri": uri, "ordinal": images, "page": number, "extractable": ok})
        vector = bool(text) and not page.images and page.curves >= VECTOR_CURVES
        if vector:
            uri = f"{SCHEME}pdf/page/{number}"
            parts.append(f"![PDF page {number} figure]({uri})")
            out.media.append({"uri": uri, "ordinal": None, "page": number, "extractable": True})
        blocks.append("\n\n".join(parts))
        if not text:
            out.warn("pdf_page_no_text_layer", f"page {number} has no text layer", "page", number)
        elif suspicious(text):
            out.warn("pdf_page_suspicious_text_layer", f"page {number}: the text layer looks unreliable", "page", number)
        if handles:
            n, k = len(handles), sum(handles)
            how = "all can be extracted by their links" if n == k else "none can be extracted directly" if not k else f"{k} can be extracted by their links"
            out.warn("embedded_visuals_omitted", f"page {number} has {n} pictures that are no text; {how}", "page", number)
        if vector:
            out.warn("vector_graphics_omitted", f"page {number} has vector graphics that are no text; a link to the page as SVG is added", "page", number)
    for number in columns:
        out.warn("pdf_multi_column_reading_order", f"page {number}: reading order was rebuilt from columns", "page", number)
    if not any_text and not images:
        raise ParseError("pdf_no_extractable_content")
    out.markdown = "\n\n".join(blocks) + "\n" if blocks else ""
    if len(out.markdown.encode()) > most:
        raise ParseError("parse_budget_exceeded", f"output over {most} bytes")
    if provenance:
        at = 0
        for (number, _), block in zip(shown, blocks):
            size = len(block.encode())
            out.provenance.append({"out_start": at, "out_end": at + size, "source_kind": "page", "page_number": number})
            at += size + 2
    return out


# ---- media ----


def png(width: int, height: int, colors: int, data: bytes) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    row = width * colors
    raw = b"".join(b"\x00" + data[i * row : (i + 1) * row] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if colors == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def image(pdf: Pdf, number: int, generation: int, most: int) -> bytes:
    """A picture of an opened file: JPEG and JPEG 2000 as they are, 8-bit gray and RGB as PNG."""
    stream = pdf.objects.get(number)
    if not isinstance(stream, Stream) or stream.info.get("Subtype") != "Image":
        raise ParseError("parse_failed", f"object {number} {generation} is no picture")
    if not extractable(pdf, stream):
        raise ParseError("parse_failed", f"the picture {number} {generation} can't be extracted")
    body, rest = pdf.unfiltered(stream)
    if rest:
        return body
    width, height, colors = pdf.get(stream.info.get("Width"), 0), pdf.get(stream.info.get("Height"), 0), channels(pdf, stream)
    need = width * height * colors
    if not need or need > most or len(body) < need:
        raise ParseError("parse_failed", f"the picture {number} {generation} is damaged")
    return png(width, height, colors, body[:need])


def page_svg(pdf: Pdf, number: int, max_work: int | None = None) -> bytes:
    """A page of an opened file as SVG: its paths and its characters."""
    if not 1 <= number <= len(pdf.pages):
        raise ParseError("parse_failed", f"there is no page {number}")
    page = read_page(pdf, pdf.pages[number - 1], Work(max_work))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{page.width:g}" height="{page.height:g}" viewBox="0 0 {page.width:g} {page.height:g}">']
    for how, path in page.paths:
        out.append(f'<path d="{path}" fill="{"#dddddd" if how == "fill" else "none"}" stroke="#333333"/>')
    for texts, advances, x, y, size in page.glyphs:
        for text, advance in zip(texts, advances):
            if text.strip():
                out.append(f'<text x="{x:.2f}" y="{y:.2f}" font-size="{size:.2f}">{escape(text)}</text>')
            x += advance * size
    out.append("</svg>")
    return "\n".join(out).encode()
