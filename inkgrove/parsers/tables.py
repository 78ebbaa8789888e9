"""CSV files and XLSX workbooks as tables and as Markdown."""

from __future__ import annotations

import json
import math
from datetime import date, timedelta
from decimal import Decimal

import numpy as np

from inkgrove.functions.markdown import Page, gfm_size
from inkgrove.functions.structural import split_fields
from inkgrove.functions.charset import decoded
from inkgrove.functions.text import trimmed
from inkgrove.options import ParseOptions
from inkgrove.parsers.container import END, START, TEXT, Container, events, relations
from inkgrove.schema import HEADER_ROWS, LONG_CELL, MARKDOWN_RECORDS, PREVIEW_ROWS, SNIFF_LINES, ParseError

# ---- records of a CSV text ----


def sniffed(text: str) -> str:
    """Delimiter by raw counts over the first lines; the earlier of equal ones, a comma if there is none."""
    head = "\n".join(text.split("\n", SNIFF_LINES)[:SNIFF_LINES])
    return max(",\t;|", key=lambda c: (head.count(c), -",\t;|".index(c))) if any(c in head for c in ",\t;|") else ","


def records(text: str, delimiter: str) -> list[list[str]]:
    """Records of a whole file: line ends at even quote parity end a record.

    A quote opens only at a field start; where a stray one made the parity wrong, the state machine
    finds a field open at the end of the piece and reads on over the rest of the file.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.flatnonzero((data == 10) & ((np.cumsum(data == 34) & 1) == 0))
    raw = data.tobytes()
    out, at = [], 0
    for end in [*ends.tolist(), len(raw)]:
        line = raw[at:end].decode()
        if '"' in line:
            found, closed = _quoted(line.removesuffix("\r"), delimiter)
            if not closed and end < len(raw):
                out.extend(_quoted(raw[at:].decode().removesuffix("\n").removesuffix("\r"), delimiter)[0])
                break
            out.extend(found)
        elif line := line.removesuffix("\r"):
            out.extend(part.split(delimiter) for part in line.replace("\r\n", "\n").replace("\r", "\n").split("\n") if part)
        at = end + 1
    return [[c.replace("\r\n", "\n").replace("\r", "\n") for c in r] for r in out]


def _quoted(text: str, delimiter: str) -> tuple[list[list[str]], bool]:
    """Records of a text with quotes, and whether its last field was closed: a quote that opens no
    field is plain, an open one runs to the end."""
    out, record, n, at, whole, line_end = [], [], len(text), 0, True, -1
    while at <= n:
        if at < n and text[at] == '"':
            value, at = [], at + 1
            while True:
                close = text.find('"', at)
                if close < 0:
                    value.append(text[at:])
                    at, whole = n, False
                    break
                value.append(text[at:close])
                at = close + 1
                if at < n and text[at] == '"':
                    value.append('"')
                    at += 1
                else:
                    break
            field = "".join(value)
        else:
            field = ""
        if line_end < at:  # looked up once a line, not once a field
            line_end = text.find("\n", at)
            line_end = n if line_end < 0 else line_end
        stop = text.find(delimiter, at, line_end)
        stop = line_end if stop < 0 else stop
        field += text[at:stop].removesuffix("\r") if stop == n or text[stop] == "\n" else text[at:stop]
        record.append(field)
        if stop == n:
            out.append(record)
            break
        if text[stop] == "\n":
            out.append(record)
            record = []
        at = stop + 1
    return [r for r in out if r != [""]], whole


# ---- table entries ----


def letters(column: int) -> str:
    """Name of a column from 1: A, Z, AA."""
    out = ""
    while column:
        column, k = divmod(column - 1, 26)
        out = chr(65 + k) + out
    return out


def row_keys(headers: list[str]) -> list[str]:
    """Keys of a row's cells: trimmed headers, column_n for blank ones, _2 and on for repeated ones."""
    seen: dict[str, int] = {}
    keys = []
    for i, h in enumerate(headers):
        name = trimmed(h) or f"column_{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        keys.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return keys


def entry(source: str, fmt: str, header: list[str], rows: list[tuple[int, list[str]]], width: int, options: ParseOptions, unit: str, **more) -> dict:
    """One table of a header and numbered data rows, narrowed by the options."""
    pad = lambda r: [*r, *[""] * (width - len(r))]
    header = pad(header)
    wanted = options.columns
    missing = [c for c in wanted if c not in header]
    if missing:
        known = ", ".join(h for h in header if trimmed(h))
        raise ParseError("parse_failed", f"no column {', '.join(missing)}; there are: {known}")
    if options.rows:
        chosen = [r for r in rows if options.rows[0] <= r[0] <= options.rows[1]]
    else:
        start = options.offset or 0
        chosen = rows[start : start + (PREVIEW_ROWS if options.limit is None else options.limit)]
    keys = row_keys(header)
    keep = [i for i, k in enumerate(keys) if not wanted or k in wanted]
    cells = [dict(sorted((keys[i], row[i]) for i in keep)) for row in (pad(r) for _, r in chosen)]
    warnings = []
    if len(chosen) < len(rows):
        n, m = len(chosen), len(rows)
        if options.rows:
            warnings.append(f"showing {n} rows from --rows {options.rows[0]}:{options.rows[1]}; {unit} contains {m} data rows in range {rows[0][0]}..{rows[-1][0]}")
        elif options.limit is not None or options.offset is not None:
            warnings.append(f"showing {n} rows (--offset {options.offset or 0} --limit {PREVIEW_ROWS if options.limit is None else options.limit}); {unit} contains {m} data rows")
        else:
            warnings.append(f"preview limited to first {n} data rows out of {m}")
    first, last = (chosen[0][0], chosen[-1][0]) if chosen else options.rows or (0, 0)
    return {
        "source": source, "format": fmt, "sheet": None, "workbook_sheets": None, "delimiter": None, "title": None, "range": None, "column_count": width,
        "header_row": None, "headers": {h: {"column_index": i} for i, h in enumerate(header) if not wanted or h in wanted}, "preamble": None,
        "rows": cells, "row_numbers": [n for n, _ in chosen], "row_range": {"first_row": first, "last_row": last}, "truncated": len(chosen) < len(rows), "warnings": warnings,
    } | more


def csv_entry(data: bytes, source: str, options: ParseOptions) -> dict:
    text = decoded(data)
    mark = sniffed(text)
    found = records(text, mark)
    if not found:
        return entry(source, "csv", [], [], 0, ParseOptions(rows=options.rows), "file", delimiter=mark)
    width = max(map(len, found))
    return entry(source, "csv", found[0], list(enumerate(found[1:], 2)), width, options, "file", delimiter=mark, range=f"A1:{letters(width)}{len(found)}")


def csv_markdown(data: bytes, most: int) -> str:
    text = decoded(data)
    found = records(text, sniffed(text))
    rows = found[:MARKDOWN_RECORDS]
    if gfm_size(rows) > most:
        raise ParseError("parse_budget_exceeded", f"output over {most} bytes")
    page = Page(most)
    page.table(rows)
    if not rows:
        return ""
    out = "".join(page.parts)
    return out + f"\n_(truncated at {MARKDOWN_RECORDS} rows)_\n" if len(found) > MARKDOWN_RECORDS else out


# ---- workbooks ----

#: Number formats of dates and times among the built-in ones. Fixed values.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or time: a date letter outside of quotes and brackets."""
    plain, quoted, depth, skip = [], False, 0, False
    for c in code:
        if skip:
            skip = False
        elif c == "\\" or c == "_" or c == "*":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "[") - (c == "]")
            if not depth and c != "]":
                plain.append(c.lower())
            elif c in "hms" and depth:
                plain.append(c)
    body = "".join(plain)
    return "general" not in body and any(c in body for c in "dymhs")


def plain_number(value: float) -> str:
    """A number without exponent; whole ones without a point."""
    if math.isfinite(value) and value == int(value) and abs(value) < 1e15:
        return str(int(value))
    return format(Decimal(repr(value)), "f") if math.isfinite(value) else str(value)


def excel_moment(serial: float) -> str:
    """Day, moment or time of a serial number, without the fictitious day of 1900."""
    if not math.isfinite(serial) or serial < 0:
        return plain_number(serial)
    total = int(serial) * 86_400 + math.floor((serial - int(serial)) * 86_400 + 0.5)
    days, seconds = divmod(total, 86_400)
    clock = f"{seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"
    if not days:
        return clock
    day = (date(1899, 12, 30) + timedelta(days=days)).isoformat()
    return day if not seconds else f"{day}T{clock}"


class Workbook:
    """Cells of an XLSX workbook as texts, sheet by sheet."""

    def __init__(self, data: bytes, budget: int):
        self.zip = Container(data, budget)
        links = relations(self.zip.part("xl/_rels/workbook.xml.rels"))
        self.sheets: list[tuple[str, str]] = []
        for kind, name, a in events(self.zip.part("xl/workbook.xml")):
            if kind == START and name == "sheet" and a.get("id") in links:
                target = links[a["id"]][1]
                self.sheets.append((a.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        self._shared: list[str] | None = None
        self.dates: list[bool] = []
        if (styles := self.zip.bytes("xl/styles.xml")) is not None:
            self.read_styles(styles)

    def read_styles(self, xml: bytes) -> None:
        custom, inside = {}, False
        for kind, name, a in events(xml):
            if name == "cellXfs":
                inside = kind == START
            elif kind == START and name == "numFmt":
                custom[a.get("numFmtId")] = is_date_format(a.get("formatCode", ""))
            elif kind == START and name == "xf" and inside:
                n = a.get("numFmtId", "0")
                self.dates.append(custom[n] if n in custom else n.isdigit() and int(n) in DATE_FORMATS)

    @property
    def shared(self) -> list[str]:
        if self._shared is None:
            self._shared, item, text, phonetic = [], [], False, 0
            xml = self.zip.bytes("xl/sharedStrings.xml")
            for kind, name, _ in events(xml) if xml else ():
                if kind == TEXT:
                    if text and not phonetic:
                        item.append(name)
                elif name == "rPh":
                    phonetic += 1 if kind == START else -1
                elif name == "t":
                    text = kind == START
                elif name == "si":
                    if kind == START:
                        item = []
                    else:
                        self._shared.append("".join(item))
        return self._shared

    def rows(self, path: str) -> tuple[list[tuple[int, list[str]]], int]:
        """(row number, cells) from the first to the last row that has any, and the first column used."""
        cells: dict[int, dict[int, str]] = {}
        row = column = 0
        a: dict = {}
        value: list[str] = []
        reading = False
        for kind, name, attrs in events(self.zip.part(path)):
            if kind == TEXT:
                if reading:
                    value.append(name)
            elif kind == START:
                if name == "row":
                    row = int(attrs.get("r", row + 1))
                    column = 0
                elif name == "c":
                    a, value = attrs, []
                    column += 1
                    if ref := attrs.get("r"):
                        head = ref.rstrip("0123456789")
                        column = 0
                        for c in head:
                            column = column * 26 + ord(c) - 64
                        row = int(ref[len(head) :] or row)
                reading = name in ("v", "t")
            else:
                reading = False
                if name == "c" and value:
                    if text := self.shown("".join(value), a):
                        cells.setdefault(row, {})[column] = text
        if not cells:
            return [], 1
        low, high = min(min(r) for r in cells.values()), max(max(r) for r in cells.values())
        return [(n, [cells.get(n, {}).get(c, "") for c in range(low, high + 1)]) for n in range(min(cells), max(cells) + 1)], low

    def shown(self, value: str, a: dict) -> str:
        kind = a.get("t", "n")
        if kind == "s":
            k = int(value)
            return self.shared[k] if k < len(self.shared) else ""
        if kind == "b":
            return "TRUE" if value.strip() in ("1", "true") else "FALSE"
        if kind != "n":
            return value
        try:
            number = float(value)
        except ValueError:
            return value
        style = int(a.get("s", 0))
        return excel_moment(number) if style < len(self.dates) and self.dates[style] else plain_number(number)


def filled(cells: list[str]) -> list[str]:
    return [c for c in cells if trimmed(c)]


def header_index(rows: list[tuple[int, list[str]]]) -> int:
    """Row that looks most like a header: full, followed by a full one, short cells, early."""
    best, at = None, 0
    for i, (_, cells) in enumerate(rows[:HEADER_ROWS]):
        own = filled(cells)
        if not own:
            continue
        below = next((len(f) for _, r in rows[i + 1 :] if (f := filled(r))), 0)
        score = 100 * len(own) + 10 * min(below, len(own)) - 80 * sum(len(c) > LONG_CELL for c in cells) - sum(map(len, own)) // 10 - i
        if best is None or score > best:
            best, at = score, i
    return at


def xlsx_entries(data: bytes, source: str, options: ParseOptions) -> list[dict]:
    book = Workbook(data, options.max_parse_bytes)
    names = [n for n, _ in book.sheets]
    if options.sheet is not None and options.sheet not in names:
        raise ParseError("parse_failed", f"no sheet {options.sheet}; there are: {', '.join(names)}")
    out = []
    for name, path in book.sheets:
        if options.sheet is not None and name != options.sheet:
            continue
        rows, low = book.rows(path)
        if not rows:
            continue
        at = header_index(rows)
        width = len(rows[0][1])
        title_at = next((i for i, (_, r) in enumerate(rows[:at]) if len(filled(r)) == 1), None)
        title = trimmed(filled(rows[title_at][1])[0]) if title_at is not None else None
        preamble = None
        if at > 1:
            start = 0 if title_at is None else title_at + 1
            found = next(((n, r) for n, r in rows[start:at] if filled(r)), None)
            if found:
                cells = zip(row_keys(rows[at][1]), found[1])
                preamble = {"row": found[0], "content": {k: c for k, c in sorted(cells) if not options.columns or k in options.columns}}
        body = [(n, r) for n, r in rows[at + 1 :] if filled(r)]
        out.append(
            entry(source, "xlsx", rows[at][1], body, width, options, "sheet", sheet=name, workbook_sheets=names, title=title, preamble=preamble,
                  header_row=rows[at][0], range=f"{letters(low)}{rows[0][0]}:{letters(low + width - 1)}{rows[-1][0]}")
        )
    return out


def xlsx_markdown(data: bytes, most: int) -> str:
    book = Workbook(data, most)
    page = Page(most)
    for name, path in book.sheets:
        page.heading(2, f"Sheet: {name}")
        rows, _ = book.rows(path)
        if rows:
            page.table([rows[0][1], *(r for _, r in rows[1:] if filled(r))])
    return page.text()


def serialized_size(tables: list[dict]) -> int:
    """Bytes of the tables as compact JSON, absent fields left out."""
    lean = [{k: v for k, v in t.items() if v is not None and k != "row_numbers"} for t in tables]
    return len(json.dumps(lean, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode())


__all__ = ["csv_entry", "csv_markdown", "entry", "records", "sniffed", "split_fields", "xlsx_entries", "xlsx_markdown"]
