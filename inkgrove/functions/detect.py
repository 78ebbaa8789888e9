"""Formats by address, magic bytes, extension and content, for one input or for a column."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.functions.text import is_url
from inkgrove.parsers.container import first_kind
from inkgrove.schema import EXTENSIONS, MAX_PARSE_BYTES, SNIFF_BYTES, TABLE_FORMATS, ParseError

# First bytes of formats.
PDF_MAGIC, ZIP_MAGICS, OLD_OFFICE = b"%PDF-", (b"PK\x03\x04", b"PK\x05\x06"), b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
IMAGE_MAGICS = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"))


def extension(source: str) -> str:
    """Extension of a path or address without its query and fragment; empty if it has none."""
    name = source.partition("#")[0].partition("?")[0].rpartition("/")[2]
    return name.rpartition(".")[2] if "." in name else ""


def looks_like_text(data: bytes) -> bool:
    head = data[:SNIFF_BYTES]
    if b"\x00" in head:
        return False
    try:
        head.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def detect(data: bytes, source: str = "", content_type: str | None = None, hint: str | None = None, most: int = MAX_PARSE_BYTES) -> str:
    """Format of an input: size first, then the hint, a web page's type, magic, extension, address, content."""
    if len(data) > most:
        raise ParseError("parse_budget_exceeded", f"input over {most} bytes")
    if hint:
        return hint
    if is_url(source) and content_type:
        if "application/pdf" in content_type:
            return "pdf"
        if "application/json" in content_type:
            return "text"
    if data.startswith(PDF_MAGIC):
        return "pdf"
    if data.startswith(ZIP_MAGICS) and (kind := first_kind(data)):
        return kind
    if data.startswith(OLD_OFFICE):
        raise ParseError("legacy_or_encrypted_office")
    if kind := EXTENSIONS.get(extension(source).lower()):
        return kind
    if is_url(source):
        return "url"
    if looks_like_text(data):
        return "text"
    raise ParseError("unsupported_format")


def is_table(fmt: str) -> bool:
    return fmt in TABLE_FORMATS


def image_type(data: bytes) -> str:
    for magic, mime in IMAGE_MAGICS:
        if data.startswith(magic):
            return mime
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    if data.startswith((b"<?xml", b"<svg")):
        return "image/svg+xml"
    return "application/octet-stream"


def extension_column(source: Column) -> Column:
    return F.regexp_extract(source, r"\A[^#?]*?([^/#?]*?)(?:[?#][\s\S]*)?\z", 1)


def format_column(content: Column, source: Column, content_type: Column | None = None) -> Column:
    """detect() as an expression; an unknown or old format is null. Only archives leave the JVM."""
    content_type = F.lit(None).cast("string") if content_type is None else content_type
    name = F.regexp_extract(F.coalesce(source, F.lit("")), r"\A([^?#]*)", 1)
    ext = F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/]*)\z", 1), r"\.([^.]*)\z", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    starts = lambda magic: F.substring(content, 1, len(magic)) == F.lit(magic)
    web = F.coalesce(source, F.lit("")).rlike(r"\Ahttps?://")
    kind = F.coalesce(content_type, F.lit(""))

    @F.arrow_udf(T.StringType())
    def archive(data: pa.Array) -> pa.Array:
        # also called for rows that need no look
        return pa.array((None if x is None else first_kind(x) for x in data.to_pylist()), pa.string())

    by_name = F.when(F.try_element_at(table, ext).isNotNull(), F.try_element_at(table, ext)).when(web, F.lit("url"))
    head = F.substring(content, 1, SNIFF_BYTES)
    text = F.when(~F.contains(head, F.lit(b"\x00")) & F.is_valid_utf8(head.cast("string")), F.lit("text"))
    zipped = starts(ZIP_MAGICS[0]) | starts(ZIP_MAGICS[1])
    return (
        F.when(web & kind.contains("application/pdf"), "pdf")
        .when(web & kind.contains("application/json"), "text")
        .when(starts(PDF_MAGIC), "pdf")
        .when(zipped, F.coalesce(archive(F.when(zipped, content)), by_name, text))
        .when(starts(OLD_OFFICE), F.lit(None))
        .otherwise(F.coalesce(by_name, text))
    )
