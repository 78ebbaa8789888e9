"""Zip containers under limits, and XML events by local name."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

from inkgrove.schema import MAX_ENTRY_BYTES, MAX_ZIP_ENTRIES, MAX_ZIP_RATIO, ParseError


class Container:
    """An archive whose declared sizes were checked before anything is unpacked."""

    def __init__(self, data: bytes, budget: int):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            infos = self.zip.infolist()
        except Exception as e:
            raise ParseError("invalid_container", str(e)) from e
        if len(infos) > MAX_ZIP_ENTRIES:
            raise ParseError("parse_failed", f"more than {MAX_ZIP_ENTRIES} entries")
        total = 0
        for i in infos:
            if i.file_size > MAX_ENTRY_BYTES:
                raise ParseError("parse_failed", f"entry {i.filename} is over {MAX_ENTRY_BYTES} bytes")
            if i.file_size and (not i.compress_size or i.file_size // i.compress_size > MAX_ZIP_RATIO):
                raise ParseError("parse_failed", f"entry {i.filename} is packed too densely")
            total += i.file_size
        if total > budget:
            raise ParseError("parse_budget_exceeded", f"unpacked size over {budget} bytes")
        self.names = [i.filename for i in infos]

    def bytes(self, name: str) -> bytes | None:
        """Content of an entry, None if there is none; it can't be longer than declared."""
        try:
            info = self.zip.getinfo(name)
        except KeyError:
            return None
        try:
            with self.zip.open(info) as f:
                data = f.read(info.file_size + 1)
        except Exception as e:
            raise ParseError("invalid_container", f"{name}: {e}") from e
        if len(data) > info.file_size:
            raise ParseError("parse_budget_exceeded", f"{name} is longer than declared")
        return data

    def part(self, name: str) -> bytes:
        data = self.bytes(name)
        if data is None:
            raise ParseError("invalid_container", f"{name} is missing")
        return data


def first_kind(data: bytes) -> str | None:
    """Format of a zip archive by the first of its names that tells."""
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except Exception:
        return None
    for n in names:
        for prefix, fmt in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"), ("META-INF/", "epub")):
            if n.startswith(prefix):
                return fmt
        if n == "mimetype":
            return "epub"
    return None


START, END, TEXT = "start", "end", "text"


def events(xml: bytes) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, local name or text, attributes by local name) of an XML part, entities not expanded."""
    found: list = []
    parser = expat.ParserCreate()
    parser.buffer_text = True
    local = lambda x: x.rpartition(":")[2]
    parser.StartElementHandler = lambda n, a: found.append((START, local(n), {local(k): v for k, v in reversed(a.items())}))
    parser.EndElementHandler = lambda n: found.append((END, local(n), {}))
    parser.CharacterDataHandler = lambda t: found.append((TEXT, t, {}))

    def forbidden(*_):
        raise ParseError("parse_failed", "XML entity declarations are not read")

    parser.EntityDeclHandler = forbidden
    for at in range(0, len(xml), 1 << 16):
        try:
            parser.Parse(xml[at : at + (1 << 16)], at + (1 << 16) >= len(xml))
        except expat.ExpatError as e:
            raise ParseError("parse_failed", f"XML: {e}") from e
        yield from found
        found.clear()
    if not xml:
        raise ParseError("parse_failed", "XML: empty part")


def relations(xml: bytes | None) -> dict[str, tuple[str, str, bool]]:
    """Relations of a part: id -> (type, target, whether it is external)."""
    if xml is None:
        return {}
    return {a["Id"]: (a.get("Type", ""), a.get("Target", ""), a.get("TargetMode") == "External") for k, n, a in events(xml) if k == START and n == "Relationship" and "Id" in a}


def safe_path(path: str) -> bool:
    """media/ and then plain components, none of them . or .."""
    head, _, rest = path.partition("/")
    parts = rest.split("/")
    plain = lambda p: p and p not in (".", "..") and all(c.isascii() and (c.isalnum() or c in "-_.") for c in p)
    return head == "media" and all(map(plain, parts))
