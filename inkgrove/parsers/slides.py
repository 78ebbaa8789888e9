"""Presentations, books and notebooks."""

from __future__ import annotations

import json
import posixpath
import re
from urllib.parse import unquote

from inkgrove.functions.markdown import Page
from inkgrove.functions.charset import decoded
from inkgrove.functions.text import trimmed
from inkgrove.parsers import html
from inkgrove.parsers.container import END, START, TEXT, Container, events, relations, safe_path
from inkgrove.parsers.result import Extracted
from inkgrove.schema import SCHEME, ParseError

_SLIDE = re.compile(r"ppt/slides/slide(\d+)\.xml")


class Slide:
    """Text, tables and pictures of one slide."""

    def __init__(self, number: int, box: Container, path: str, page: Page, out: Extracted, images: int):
        self.number, self.page, self.out, self.images = number, page, out, images
        folder, name = path.rsplit("/", 1)
        self.links = relations(box.bytes(f"{folder}/_rels/{name}.rels"))
        self.names = set(box.names)
        self.pictures = self.linked = 0
        self.merged = self.visual = False

    def read(self, xml: bytes) -> None:
        table: list[list[str]] | None = None
        cell: list[str] | None = None
        parts: list[str] = []
        text = False

        def flush():
            nonlocal parts
            if line := trimmed("".join(parts)):
                cell.append(line) if cell is not None else self.page.paragraph(line)
            parts = []

        for kind, name, a in events(xml):
            if kind == TEXT:
                if text:
                    parts.append(name)
                continue
            start = kind == START
            if start:
                self.merged |= any(k in a for k in ("gridSpan", "rowSpan", "hMerge", "vMerge"))
                self.visual |= name in ("pic", "blip", "chart", "oleObj")
            if name == "t":
                text = start
            elif name == "p" and not start:
                flush()
            elif name == "br" and start:
                parts.append("\n")
            elif name == "tbl":
                if start:
                    flush()
                    table = []
                elif table is not None:
                    self.page.table(table)
                    table = None
            elif name == "tr" and start and table is not None:
                table.append([])
            elif name == "tc" and table is not None:
                if start:
                    cell = []
                elif cell is not None and table:
                    table[-1].append(trimmed(" ".join(cell)))
                    cell = None
            elif name == "blip" and start:
                self.pictures += 1
                if link := self.picture(a.get("embed", "")):
                    parts.append(link)
        flush()

    def picture(self, link: str) -> str:
        target = self.links.get(link)
        if target is None or target[2]:
            return ""
        path = posixpath.normpath(posixpath.join("slides", target[1])) if not target[1].startswith("/") else target[1].removeprefix("/ppt/")
        if not safe_path(path) or f"ppt/{path}" not in self.names:
            return ""
        self.images += 1
        self.linked += 1
        uri = f"{SCHEME}pptx/part/ppt/{path}"
        self.out.media.append({"uri": uri, "ordinal": self.images, "page": self.number, "extractable": True})
        return f"![PPTX image {self.images} (slide {self.number})]({uri})"

    def warn(self) -> None:
        if self.merged:
            self.out.warn("merged_table_structure_not_preserved", f"slide {self.number}: a table has merged cells; Markdown doesn't keep their spans", "slide", self.number)
        if self.visual:
            n, k = self.pictures, self.linked
            state = "charts or objects without bitmaps" if not n else f"{n} pictures, all marked by links" if n == k else f"{n} pictures that could not be resolved" if not k else f"{n} pictures, {k} marked by links"
            self.out.warn("embedded_visuals_omitted", f"slide {self.number} has {state}", "slide", self.number)


def note_lines(xml: bytes) -> list[str]:
    out, parts, text = [], [], False
    for kind, name, _ in events(xml):
        if kind == TEXT:
            if text:
                parts.append(name)
        elif name == "t":
            text = kind == START
        elif name == "p" and kind == END:
            if line := trimmed("".join(parts)):
                out.append(line)
            parts = []
    return out


def parse_pptx(data: bytes, most: int) -> Extracted:
    box, out = Container(data, most), Extracted()
    page = Page(most)
    slides = sorted((int(m[1]), n) for n in box.names if (m := _SLIDE.fullmatch(n)))
    images = 0
    for number, path in slides:
        page.heading(2, f"Slide {number}")
        slide = Slide(number, box, path, page, out, images)
        slide.read(box.part(path))
        images = slide.images
        for kind, target, _ in slide.links.values():
            if kind.endswith("/notesSlide"):
                xml = box.bytes(posixpath.normpath(posixpath.join("ppt/slides", target)))
                if xml and (lines := note_lines(xml)):
                    page.paragraph("Notes:")
                    for line in lines:
                        page.paragraph(line)
        slide.warn()
    out.markdown, out.page_count = page.text(), None
    return out


def spine(box: Container) -> list[str]:
    """Chapters of a book in reading order."""
    package = next((a["full-path"] for k, n, a in events(box.part("META-INF/container.xml")) if k == START and n == "rootfile" and "full-path" in a), None)
    if package is None:
        raise ParseError("invalid_container", "no package file is named")
    folder = posixpath.dirname(package)
    items, order = {}, []
    for kind, name, a in events(box.part(package)):
        if kind != START:
            continue
        if name == "item" and "id" in a and "href" in a and ("xhtml" in a.get("media-type", "") or a["href"].endswith((".xhtml", ".html"))):
            items[a["id"]] = posixpath.normpath(posixpath.join(folder, unquote(a["href"])))
        elif name == "itemref" and "idref" in a:
            order.append(a["idref"])
    found = [items[i] for i in order if i in items]
    if not found:
        raise ParseError("invalid_container", "the book has no chapters")
    return found


def parse_epub(data: bytes, most: int) -> Extracted:
    box = Container(data, most)
    page = Page(most)
    for number, path in enumerate(spine(box), 1):
        page.heading(2, f"Chapter {number}")
        page.paragraph(html.markdown_of(decoded(box.part(path)), None, most))
    return Extracted(page.text())


def parse_ipynb(data: bytes, most: int) -> Extracted:
    """Notebooks of version 3 and 4: headings, Markdown and code cells in order, without outputs."""
    try:
        book = json.loads(decoded(data))
    except ValueError as e:
        raise ParseError("parse_failed", f"notebook: {e}") from e
    if not isinstance(book, dict):
        raise ParseError("parse_failed", "notebook: not an object")
    cells = book.get("cells")
    if cells is None and isinstance(sheets := book.get("worksheets"), list):
        cells = [c for s in sheets for c in s.get("cells", [])]
    if not isinstance(cells, list):
        raise ParseError("parse_failed", "notebook: no cells")
    kernel = (book.get("metadata") or {}).get("kernelspec") or {}
    page = Page(most)
    for c in cells:
        kind = c.get("cell_type")
        source = c.get("source", c.get("input", ""))
        source = "".join(source) if isinstance(source, list) else source or ""
        if not trimmed(source):
            continue
        if kind == "heading":
            page.heading(int(c.get("level", 1)), source)
        elif kind == "markdown":
            page.paragraph(source)
        elif kind == "code":
            language = c.get("language") or kernel.get("language") or ""
            page.gap()
            page.raw(f"```{language}\n{source.rstrip(chr(10))}\n```\n")
    return Extracted(page.text())
