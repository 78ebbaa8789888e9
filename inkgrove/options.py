"""Options of a parse, validated once on the driver before any task starts."""

from __future__ import annotations

from dataclasses import dataclass, field

from inkgrove.schema import FORMAT_NAMES, MAX_PARSE_BYTES, ParseError


def number_range(text: str) -> tuple[int, int]:
    """first:last, both from 1, both included."""
    first, mark, last = text.partition(":")
    try:
        if not mark:
            raise ValueError
        return checked_range(int(first.strip()), int(last.strip()))
    except ValueError as e:
        raise ValueError(f"expected first:last with 1 <= first <= last, not {text!r}") from e


def checked_range(first: int, last: int) -> tuple[int, int]:
    if first < 1 or last < first:
        raise ValueError("a range needs 1 <= first <= last")
    return first, last


def format_name(text: str) -> str:
    """Format of a name or extension; url can only be detected, never asked for."""
    try:
        return FORMAT_NAMES[text.lower()]
    except KeyError:
        raise ParseError("unsupported_format", text) from None


@dataclass(frozen=True)
class ParseOptions:
    """The narrowing and limits of one parse.

    sheet, rows, columns, limit and offset narrow tables; pages narrows documents. rows counts
    records of the file (the header is 1) and excludes limit and offset.
    """

    format: str | None = None
    max_parse_bytes: int = MAX_PARSE_BYTES
    max_work_units: int | None = None
    sheet: str | None = None
    rows: tuple[int, int] | None = None
    columns: tuple[str, ...] = field(default=())
    limit: int | None = None
    offset: int | None = None
    pages: tuple[int, int] | None = None
    provenance: str = "off"
    mode: str = "auto"

    @classmethod
    def of(cls, **given) -> ParseOptions:
        """Options from keyword arguments; ranges may be texts such as 2:5 or pairs."""
        for k in ("rows", "pages"):
            if isinstance(v := given.get(k), str):
                given[k] = number_range(v)
            elif v is not None:
                given[k] = checked_range(*v)
        if given.get("format") is not None:
            given["format"] = format_name(given["format"])
        if given.get("columns") is not None:
            given["columns"] = tuple(given["columns"])
        else:
            given.pop("columns", None)
        own = cls(**given)
        if own.rows and (own.limit is not None or own.offset is not None):
            raise ValueError("rows can't be combined with limit or offset")
        if own.max_parse_bytes < 1 or (own.max_work_units is not None and own.max_work_units < 1):
            raise ValueError("limits must be at least 1")
        if (own.limit is not None and own.limit < 0) or (own.offset is not None and own.offset < 0):
            raise ValueError("limit and offset can't be negative")
        if own.provenance not in ("off", "page") or own.mode not in ("auto", "document", "tables"):
            raise ValueError("provenance is off or page; mode is auto, document or tables")
        return own
