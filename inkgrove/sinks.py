"""Results out of the engine: Markdown, JSON envelopes, JSON lines and media files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.markdown import capped, capped_tables, rendered
from inkgrove.operators import corpus, engine
from inkgrove.schema import LISTED_FAILURES, MAX_OUTPUT_BYTES, TABLE_SCHEMA_VERSION, TABLE_USAGE


def write_chunks(parsed: DataFrame, path: str, mode: str = "error") -> None:
    """One chunk a line, as JSON; each task writes its own files."""
    corpus.chunks(parsed).write.mode(mode).json(path)


def write_manifest(parsed: DataFrame, path: str, mode: str = "error") -> None:
    corpus.manifest(parsed).write.mode(mode).json(path)


def write_markdown(parsed: DataFrame, path: str, mode: str = "error") -> None:
    """doc_id, source, format, markdown as parquet, which keeps line breaks and nulls."""
    engine.documents(parsed).write.mode(mode).parquet(path)


def envelope(parsed: DataFrame) -> DataFrame:
    """doc_id, json: the self-describing table envelope of each input with tables."""
    lean = F.transform("tables", lambda t: t.dropFields("row_numbers"))
    body = F.struct(F.lit(TABLE_SCHEMA_VERSION).alias("schema_version"), F.lit(TABLE_USAGE).alias("usage"), lean.alias("tables"), F.exists("tables", lambda t: t["truncated"]).alias("truncated"), F.array().cast("array<string>").alias("warnings"))
    return parsed.where("kind = 'tables'").select("doc_id", F.to_json(body).alias("json"))


def provenance_json(parsed: DataFrame) -> DataFrame:
    """doc_id, json: page spans of each document that has them."""
    return parsed.where("provenance is not null").select("doc_id", F.to_json(F.struct("source", "format", "markdown", "provenance")).alias("json"))


def safe_name(uri: Column) -> Column:
    """A file name for a media link: everything but letters, digits, dot and dash becomes _."""
    return F.regexp_replace(F.regexp_replace(uri, r"^[a-z]+://", ""), r"[^A-Za-z0-9.\-]", "_")


def media_files(inputs: DataFrame, content: str = "content", source: str = "source", doc_id: str | None = None, **options) -> DataFrame:
    """doc_id, name, data of all extractable media, to be written by write_media or any binary sink.

    Each container is opened once, where it is parsed: nothing is joined and no file is shuffled.
    Damaged inputs and those over the limit have no media.
    """
    return engine.parsed_media(inputs, content, source, doc_id, **options).select("doc_id", safe_name(F.col("uri")).alias("name"), "data")


def write_media(media: DataFrame, folder: str) -> DataFrame:
    """Writes each file of media (doc_id, name, data) as folder/doc/name and returns doc_id, name, path.

    Each task writes its own rows, through a name of its own that is then moved, so a task that runs
    again leaves the same files. The folder must be one that all executors share; doc_id becomes
    one path component by a digest where it isn't a plain name.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid
        from hashlib import blake2b

        for b in batches:
            paths = []
            for doc, name, data in zip(b["doc_id"].to_pylist(), b["name"].to_pylist(), b["data"].to_pylist()):
                own = doc if doc and re.fullmatch(r"[A-Za-z0-9_\-]{1,100}", doc) else blake2b((doc or "").encode(), digest_size=16).hexdigest()
                path = os.path.join(folder, own, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["name"], pa.array(paths, pa.string())], ["doc_id", "name", "path"])

    return media.where("data is not null").mapInArrow(write, "doc_id string, name string, path string")


def _first(rows: DataFrame, size: Column, most: int, least: int) -> tuple[DataFrame, int]:
    """The first rows by source that a limit of bytes has room for (one more than fit), and how many rows there are.

    Every row takes at least so many bytes, so the limit itself bounds how many sizes are looked at.
    """
    order = [F.col("source").asc_nulls_first(), F.col("doc_id")]
    sizes = rows.select("source", "doc_id", size.alias("n")).orderBy(*order).limit(most // least + 1).collect()
    used = taken = 0
    for r in sizes:
        taken += 1
        used += r["n"] + least
        if used > most:
            break
    return rows.orderBy(*order).limit(taken), rows.count()


def report(parsed: DataFrame, most: int = MAX_OUTPUT_BYTES) -> str:
    """One text for a reader: failures first, then as many documents by source as the limit has room for.

    What doesn't fit is counted at the end. A corpus is written with write_markdown.
    """
    lines = [f"> [!CAUTION]\n> {r.source}: {r.code}: {r.reason}\n" for r in engine.failures(parsed, LISTED_FAILURES).collect()]
    head = "".join(lines) + ("\n" if lines else "")
    text = parsed.where("kind = 'document'").select("doc_id", "source", "format", "markdown")
    # a section has a heading, a blank line and a line feed at least
    first, number = _first(text, F.octet_length("markdown") + F.coalesce(F.octet_length("source"), F.lit(0)), most, len("# Source: \n\n\n"))
    rows = first.select("source", "format", F.substring("markdown", 1, most).alias("markdown")).collect()
    left_out = lambda n: f"\n> [!NOTE]\n> {n} more inputs are left out by the limit of {most} bytes.\n" if n else ""
    room = max(1, most - len(head.encode()) - len(left_out(number).encode()))
    body, cut = capped(rendered([(r.source or "", r.format, r.markdown) for r in rows]), room)
    shown = min(len(rows), max(1, body.count("\n# Source: ") + body.startswith("# Source: "))) if cut else len(rows)
    return head + body + left_out(number - shown)


def tables_report(parsed: DataFrame, most: int = MAX_OUTPUT_BYTES) -> str:
    """One JSON envelope of the inputs' tables, by source, within a limit; it says so if some are left out."""
    whole = parsed.where("kind = 'tables'").select("doc_id", "source", "tables", "serialized_bytes")
    first, number = _first(whole, F.coalesce("serialized_bytes", F.lit(0)), most, 1)
    rows = first.select("tables").collect()
    found = []
    for r in rows:
        for t in r.tables:
            d = t.asDict(recursive=True)
            d.pop("row_numbers")
            found.append({k: v for k, v in d.items() if v is not None})
    return capped_tables(found, most, number - len(rows))[0]
