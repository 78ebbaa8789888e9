"""Word documents: paragraphs, lists, tables, notes, links and pictures as Markdown."""

from __future__ import annotations

from dataclasses import dataclass, field

from inkgrove.functions.markdown import Page
from inkgrove.functions.text import trimmed
from inkgrove.parsers.container import END, START, TEXT, Container, events, relations, safe_path
from inkgrove.parsers.result import Extracted
from inkgrove.schema import SCHEME

# Numbering formats that count.
COUNTING = frozenset(("decimal", "decimalZero", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman"))


@dataclass
class Style:
    heading: int = 0
    listed: str = ""


def style_of(name: str) -> Style:
    """Heading level or list kind by a style's name."""
    flat = name.strip().lower()
    head, _, level = flat.partition("heading")
    if not head and level.strip().isdigit() and 1 <= int(level) <= 6:
        return Style(heading=int(level))
    return Style(listed="bullet" if "bullet" in flat else "ordered" if "number" in flat else "")


def styles(xml: bytes | None) -> dict[str, Style]:
    out, own = {}, None
    for kind, name, a in events(xml) if xml else ():
        if kind == START and name == "style":
            own = a.get("styleId")
        elif kind == START and name == "name" and own is not None:
            out[own] = style_of(a.get("val", ""))
        elif kind == END and name == "style":
            own = None
    return out


def numbering(xml: bytes | None) -> dict[tuple[str, int], str]:
    """(numId, level) -> ordered or bullet."""
    kinds: dict[tuple[str, int], str] = {}
    chosen: dict[str, str] = {}
    abstract = number = None
    level = 0
    for kind, name, a in events(xml) if xml else ():
        if kind != START:
            continue
        if name == "abstractNum":
            abstract, number = a.get("abstractNumId"), None
        elif name == "num":
            number, abstract = a.get("numId"), None
        elif name == "lvl":
            level = int(a.get("ilvl", 0))
        elif name == "numFmt" and abstract is not None:
            kinds[abstract, level] = "ordered" if a.get("val") in COUNTING else "bullet"
        elif name == "abstractNumId" and number is not None:
            chosen[number] = a.get("val", "")
    return {(n, lvl): k for n, own in chosen.items() for (x, lvl), k in kinds.items() if x == own}


def notes(xml: bytes | None) -> dict[str, str]:
    out, own, parts, text = {}, None, [], False
    for kind, name, a in events(xml) if xml else ():
        if kind == TEXT:
            if text and own is not None:
                parts.append(name)
        elif name == "footnote":
            if kind == START:
                own, parts = a.get("id"), []
            elif own is not None:
                out[own], own = trimmed("".join(parts)), None
        elif name == "t":
            text = kind == START
        elif name == "p" and kind == END and parts:
            parts.append(" ")
    return out


def wrapped(text: str, bold: bool, italic: bool, link: str | None) -> str:
    """A run's text in its marks, white space outside of them."""
    core = text.strip()
    if not core or not (bold or italic or link):
        return text
    mark = "***" if bold and italic else "**" if bold else "*" if italic else ""
    core = f"[{core}]({link})" if link else f"{mark}{core}{mark}"
    at = text.index(text.strip())
    return text[:at] + core + text[at + len(text.strip()) :]


@dataclass
class Paragraph:
    parts: list[str] = field(default_factory=list)
    style: Style | None = None
    style_id: str = ""
    number: str | None = None
    level: int = 0
    listed: str = ""


@dataclass
class TableState:
    rows: list[list[str]] = field(default_factory=list)
    cell: list[str] | None = None


def on(a: dict[str, str]) -> bool:
    return a.get("val", "1").lower() not in ("0", "false", "off", "none")


class Reader:
    """Walks the document's events; paragraphs and tables are stacks, as text boxes and cells nest."""

    def __init__(self, page: Page, box: Container, out: Extracted):
        self.page, self.out = page, out
        self.styles = styles(box.bytes("word/styles.xml"))
        self.numbers = numbering(box.bytes("word/numbering.xml"))
        self.notes = notes(box.bytes("word/footnotes.xml"))
        self.links = relations(box.bytes("word/_rels/document.xml.rels"))
        self.names = set(box.names)
        self.paragraphs: list[Paragraph] = []
        self.tables: list[TableState] = []
        self.counts: dict[tuple, int] = {}
        self.used: list[str] = []
        self.images = 0

    def read(self, xml: bytes) -> None:
        bold = italic = False
        deleted = run = text = 0
        anchors: list[str | None] = []
        skipping = 0  # depth inside an alternative that isn't taken
        alternatives: list[bool] = []
        merged = visual = False
        for kind, name, a in events(xml):
            if kind == TEXT:
                if text and run and not deleted and not skipping and self.paragraphs:
                    self.paragraphs[-1].parts.append(wrapped(name, bold, italic, next((x for x in reversed(anchors) if x), None)))
                continue
            start = kind == START
            if start and name == "gridSpan":
                merged |= not a.get("val", "").isdigit() or int(a["val"]) > 1
            merged |= start and name == "vMerge"
            visual |= start and name in ("drawing", "pict", "object")
            if skipping:
                skipping += 1 if start else -1
                continue
            if name == "AlternateContent":
                alternatives.append(False) if start else alternatives.pop()
            elif name in ("Choice", "Fallback") and alternatives:
                if start and alternatives[-1]:
                    skipping = 1
                elif start:
                    alternatives[-1] = True
            elif name == "p":
                if start:
                    self.paragraphs.append(Paragraph())
                elif self.paragraphs:
                    self.finish(self.paragraphs.pop())
            elif name == "r":
                run += 1 if start else -1
                if start:
                    bold = italic = False
            elif name == "t":
                text += 1 if start else -1
            elif name == "del":
                deleted += 1 if start else -1
            elif name == "hyperlink":
                if start:
                    target = self.links.get(a.get("id", ""))
                    anchors.append(target[1] if target and target[0].endswith("/hyperlink") else None)
                elif anchors:
                    anchors.pop()
            elif name == "tbl":
                if start:
                    self.tables.append(TableState())
                elif self.tables:
                    self.finish_table(self.tables.pop())
            elif name == "tr" and start and self.tables:
                self.tables[-1].rows.append([])
            elif name == "tc" and self.tables:
                own = self.tables[-1]
                if start:
                    own.cell = []
                elif own.rows and own.cell is not None:
                    own.rows[-1].append("<br>".join(own.cell))
                    own.cell = None
            elif start and self.paragraphs:
                p = self.paragraphs[-1]
                if name == "b" and run:
                    bold = on(a)
                elif name == "i" and run:
                    italic = on(a)
                elif name == "tab" and run and not deleted:
                    p.parts.append("\t")
                elif name == "br" and run and not deleted:
                    p.parts.append("\n")
                elif name == "pStyle":
                    p.style_id = a.get("val", "")
                    p.style = self.styles.get(p.style_id) or style_of(p.style_id.replace("Heading", "heading ").replace("List", "list "))
                elif name == "ilvl":
                    p.level = int(a.get("val", 0) or 0)
                elif name == "numId":
                    p.number = a.get("val", "")
                    p.listed = self.numbers.get((p.number, p.level), "")
                elif name == "footnoteReference" and not deleted:
                    note = a.get("id", "")
                    p.parts.append(f"[^{note}]")
                    if note not in self.used:
                        self.used.append(note)
                elif name in ("blip", "imagedata") and not deleted:
                    self.image(p, a.get("embed") or a.get("id") or "")
        for note in self.used:
            if self.notes.get(note):
                self.page.paragraph(f"[^{note}]: {self.notes[note]}")
        if merged:
            self.out.warn("merged_table_structure_not_preserved", "a table has merged cells; Markdown doesn't keep their spans")
        if visual:
            self.out.warn("embedded_visuals_omitted", "pictures, charts or objects may be missing from the text; bitmaps are marked by links")

    def image(self, p: Paragraph, link: str) -> None:
        target = self.links.get(link)
        if target is None or target[2] or not target[0].endswith("/image"):
            return
        path = target[1].removeprefix("/word/")
        if not safe_path(path) or f"word/{path}" not in self.names:
            return
        self.images += 1
        uri = f"{SCHEME}docx/part/word/{path}"
        p.parts.append(f"![DOCX image {self.images}]({uri})")
        self.out.media.append({"uri": uri, "ordinal": self.images, "page": None, "extractable": True})

    def finish(self, p: Paragraph) -> None:
        text = trimmed("".join(p.parts))
        if not text:
            return
        if self.tables and self.tables[-1].cell is not None:
            self.tables[-1].cell.append(text)
            return
        style = p.style or Style()
        listed = p.listed or (style.listed if p.number != "0" else "")
        if style.heading:
            self.page.heading(style.heading, text)
        elif listed:
            mark = "-"
            if listed == "ordered":
                key = (p.number or "style", p.level)
                self.counts[key] = self.counts.get(key, 0) + 1
                mark = f"{self.counts[key]}."
            self.page.gap()
            self.page.raw(f"{'  ' * p.level}{mark} {text}\n")
        else:
            self.page.paragraph(text)

    def finish_table(self, own: TableState) -> None:
        rows = [r for r in own.rows if any(trimmed(c) for c in r)]
        if self.tables and self.tables[-1].cell is not None:
            self.tables[-1].cell.extend(c for r in rows for c in r if trimmed(c))
        else:
            self.page.table(rows)


def parse(data: bytes, most: int) -> Extracted:
    box, out = Container(data, most), Extracted()
    page = Page(most)
    Reader(page, box, out).read(box.part("word/document.xml"))
    out.markdown = page.text()
    return out
