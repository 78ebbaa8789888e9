"""Markdown output: blocks, tables and caps."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from inkgrove.functions.text import WHITE, trimmed
from inkgrove.schema import MAX_OUTPUT_BYTES, TABLE_SCHEMA_VERSION, TABLE_USAGE, ParseError


class Page:
    """Collects blocks of a document with one blank line between them, under a limit of bytes."""

    def __init__(self, most: int):
        self.parts: list[str] = []
        self.size, self.most = 0, most

    def raw(self, text: str) -> None:
        self.size += len(text.encode())
        if self.size > self.most:
            raise ParseError("parse_budget_exceeded", f"output over {self.most} bytes")
        self.parts.append(text)

    def gap(self) -> None:
        """Ends what stands so far with a blank line."""
        if self.parts:
            end = "".join(self.parts[-2:])[-2:]
            if end != "\n\n":
                self.raw("\n" if end.endswith("\n") else "\n\n")

    def heading(self, level: int, text: str) -> None:
        self.gap()
        self.raw(f"{'#' * min(6, max(1, level))} {trimmed(text)}\n")

    def paragraph(self, text: str) -> None:
        if text := trimmed(text):
            self.gap()
            self.raw(text + "\n")

    def table(self, rows: list[list[str]]) -> None:
        if any(rows):
            self.gap()
            self.raw(gfm(rows))

    def text(self) -> str:
        return "".join(self.parts).rstrip(WHITE) + "\n"


def cell(text: str) -> str:
    """A cell's text on one line, its bars escaped."""
    return text.replace("|", "\\|").replace("\n", " ").replace("\r", " ").replace("\t", " ")


def gfm(rows: list[list[str]]) -> str:
    """Table of rows, the first one its head, short ones padded; no columns give no text."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |\n" for r in rows]
    lines.insert(1, "|" + " --- |" * width + "\n")
    return "".join(lines)


def gfm_size(rows: list[list[str]]) -> int:
    """Bytes of gfm(rows) without making it."""
    width = max(map(len, rows), default=0)
    if not width:
        return 0
    inside = sum(len(c.encode()) + c.count("|") for r in rows for c in r)
    return inside + len(rows) * (3 * width + 2) + 6 * width + 2


def cut_notice(most: int) -> str:
    return f"\n\n> [!WARNING]\n> Output was cut at {most} bytes and is incomplete. Narrow the input or raise the limit.\n"


def capped(text: str, most: int = MAX_OUTPUT_BYTES) -> tuple[str, bool]:
    """Text within a limit of bytes: cut after the last line that leaves room for a notice of the cut."""
    data = text.encode()
    if len(data) <= most:
        return text, False
    notice = cut_notice(most)
    head = data[: max(0, most - len(notice.encode()))].decode("utf-8", "ignore")
    at = head.rfind("\n")
    return (head if at < 0 else head[: at + 1]).rstrip(WHITE) + notice, True


def capped_tables(tables: list[dict], most: int = MAX_OUTPUT_BYTES, left_out: int = 0) -> tuple[str, bool]:
    """JSON envelope of tables within a limit: the last table's rows are halved, then it is dropped.

    left_out inputs aren't among the tables; that is a cut, too.
    """
    tables = [dict(t) for t in tables]
    notice = f"output was cut at {most} bytes; narrow the input or raise the limit"
    envelope = {"schema_version": TABLE_SCHEMA_VERSION, "usage": TABLE_USAGE, "tables": tables, "truncated": False, "warnings": []}
    text = json.dumps(envelope, ensure_ascii=False, indent=2)
    if len(text.encode()) <= most and not left_out:
        return text, False
    envelope |= {"truncated": True, "warnings": [notice, *([f"{left_out} more inputs are left out"] if left_out else [])]}
    while True:
        text = json.dumps(envelope, ensure_ascii=False, indent=2)
        if len(text.encode()) <= most or not tables:
            return text, True
        last = tables[-1]
        if not last["rows"]:
            tables.pop()
            continue
        last["rows"] = last["rows"][: len(last["rows"]) // 2]
        last["truncated"] = True
        note = "some rows were left out by the output limit; page with limit or rows"
        if note not in last["warnings"]:
            last["warnings"] = [*last["warnings"], note]


def rendered(documents: Iterable[tuple[str, str, str]]) -> str:
    """One text of (source, format, markdown): a single document's body, or a section for each."""
    documents = list(documents)
    out = []
    for source, fmt, body in documents:
        name = source.replace("\r", " ").replace("\n", " ")
        if not trimmed(body):
            body = f"> [!NOTE]\n> No text was found in {name} (format {fmt}; the body is empty).\n"
        elif not body.endswith("\n"):
            body += "\n"
        out.append(body if len(documents) == 1 else f"# Source: {name}\n\n{body}")
    return "\n".join(out)


def pages_shown(text: str) -> int:
    """Pages of a paged document that a text shows."""
    return len(re.findall("## Page ", text))
