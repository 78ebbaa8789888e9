"""Corpus in, relations out: the parse operator and the views over its rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkgrove.options import ParseOptions
from inkgrove.parsers import dispatch
from inkgrove.schema import LISTED_FAILURES, MEDIA, MEDIA_LINK, PARSED, SCHEME, ParseError
from inkgrove.session import ship, spread

#: Bytes of results after which a batch is handed over.
OUT_BYTES = 16 << 20


def parse(inputs: DataFrame, content: str = "content", source: str = "source", doc_id: str | None = None, content_type: str | None = None, **options) -> DataFrame:
    """One parsed row for each input row: doc_id, source, format, kind, markdown, tables,
    serialized_bytes, warnings, stats, provenance, media and error.

    Options are those of ParseOptions. Nothing throws: a null, damaged, oversized or unknown input
    has an error with its code and null results. doc_id is the given column, else the source, as
    text; repeated inputs give repeated rows; other columns are ignored; an empty input gives no
    rows. Inputs over max_parse_bytes never reach Python. Each row stands for itself, so there is
    no shuffle; files differ in cost, which the scan's splits by bytes even out.
    """
    o = ParseOptions.of(**options)
    ship(inputs.sparkSession)
    pick = lambda name: F.lit(None).cast("string") if name is None else inputs[name].cast("string")
    data = inputs[content]
    size = F.octet_length(data).cast("bigint")
    frame = spread(
        inputs.select(
            pick(doc_id if doc_id is not None else source).alias("doc_id"), pick(source).alias("source"), pick(content_type).alias("content_type"),
            F.when(size <= o.max_parse_bytes, data.cast("binary")).alias("content"), size.alias("n"),
        )
    )
    schema = to_arrow_schema(PARSED)
    too_large = ParseError("parse_budget_exceeded", f"input over {o.max_parse_bytes} bytes").row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i, s, kind, c, n in zip(*(b[k] for k in ("doc_id", "source", "content_type", "content", "n"))):
                row = dispatch.parse(c.as_py(), s.as_py(), kind.as_py(), o)
                if not c.is_valid and n.is_valid:
                    row["error"], row["stats"]["input_bytes"] = too_large, n.as_py()
                row["doc_id"] = i.as_py()
                for t in row["tables"] or ():
                    t["headers"] = list(t["headers"].items())
                    t["rows"] = [list(r.items()) for r in t["rows"]]
                    if t["preamble"]:
                        t["preamble"] = t["preamble"] | {"content": list(t["preamble"]["content"].items())}
                rows.append(row)
                size += row["stats"]["output_bytes"] or 0
                if size > OUT_BYTES:  # results may be much larger than their inputs
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return frame.mapInArrow(run, PARSED)


def parsed_media(inputs: DataFrame, content: str = "content", source: str = "source", doc_id: str | None = None, **options) -> DataFrame:
    """doc_id, uri, data: the bytes of all extractable media of the inputs, in one pass over them.

    doc_id is the given column, else the source, as text. Inputs that can't be parsed give no rows.
    """
    o = ParseOptions.of(**options)
    ship(inputs.sparkSession)
    name = inputs[doc_id if doc_id is not None else source].cast("string")
    frame = spread(inputs.select(name.alias("doc_id"), inputs[source].cast("string").alias("source"), inputs[content].cast("binary").alias("content")).where(F.octet_length("content") <= o.max_parse_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["doc_id", "uri", "data"]
        for b in batches:
            rows, size = [], 0
            for i, s, c in zip(b["doc_id"], b["source"], b["content"]):
                for uri, data in dispatch.media_of(c.as_py(), s.as_py(), o):
                    rows.append((i.as_py(), uri, data))
                    size += len(data)
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], keys)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], keys)

    return frame.mapInArrow(run, "doc_id string, uri string, data binary")


# ---- views: plain Catalyst over parsed rows ----


def documents(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'document'").select("doc_id", "source", "format", "markdown", F.col("stats.page_count").alias("page_count"))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("doc_id", "source", "format", "error.*")


def failures(parsed: DataFrame, most: int = LISTED_FAILURES) -> DataFrame:
    """The first failures by source, as a report lists them."""
    return errors(parsed).orderBy("source", "doc_id").limit(most)


def warnings(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", "source", F.posexplode("warnings").alias("warning_no", "w")).select("doc_id", "source", "warning_no", "w.*")


def provenance(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.posexplode("provenance").alias("span_no", "p")).select("doc_id", "span_no", "p.*")


def pages(parsed: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, page, text of documents with page provenance: the bytes of each span."""
    spans = F.col("provenance")
    if first is not None or last is not None:
        spans = F.filter(spans, lambda p: p["page_number"].between(first or 1, last or 2**31 - 1))
    return parsed.where("provenance is not null").select("doc_id", F.explode(span_bytes(F.col("markdown"), spans)).alias("p")).select("doc_id", F.col("p.span.page_number").alias("page"), F.make_valid_utf8(F.col("p.data").cast("string")).alias("text"))


def span_bytes(text: Column, spans: Column) -> Column:
    """Array of (span, data) of a text's byte spans.

    The array of one element gives the bytes a name inside the expression, so that a text is
    encoded once, whatever the number of its spans.
    """

    def parts(data: Column) -> Column:
        part = lambda p: F.substring(data, p["out_start"].cast("int") + 1, (p["out_end"] - p["out_start"]).cast("int"))
        return F.transform(spans, lambda p: F.struct(p.alias("span"), part(p).alias("data")))

    return F.transform(F.array(F.encode(text, "UTF-8")), parts)[0]


def media(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.explode("media").alias("m")).select("doc_id", *[F.col(f"m.{f.name}").alias(f.name) for f in MEDIA])


def tables(parsed: DataFrame) -> DataFrame:
    """One row a table, without its rows."""
    t = parsed.select("doc_id", F.posexplode("tables").alias("table_no", "t"))
    keep = ("source", "format", "sheet", "workbook_sheets", "delimiter", "title", "range", "column_count", "header_row", "headers", "preamble", "row_range", "truncated", "warnings")
    return t.select("doc_id", "table_no", *[F.col(f"t.{k}").alias(k) for k in keep])


def table_rows(parsed: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, values (map by header): the selected data rows of every table."""
    t = parsed.select("doc_id", F.posexplode("tables").alias("table_no", "t"))
    return t.select("doc_id", "table_no", F.explode(F.arrays_zip(F.col("t.row_numbers").alias("row_no"), F.col("t.rows").alias("values"))).alias("r")).select("doc_id", "table_no", "r.row_no", "r.values")


def table_cells(parsed: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, header, value."""
    return table_rows(parsed).select("doc_id", "table_no", "row_no", F.explode("values").alias("header", "value"))


def default_mode(parsed: DataFrame) -> DataFrame:
    """One row: json if there are inputs and all are tables, else md."""
    every = F.coalesce(F.bool_and(F.col("format").isin("csv", "xlsx")), F.lit(False))
    return parsed.agg(F.when(every, "json").otherwise("md").alias("mode"))


def extract_media(content: Column, uri: Column, max_parse_bytes: int = ParseOptions.max_parse_bytes) -> Column:
    """Bytes behind a media link, null if the link or the file doesn't allow it."""

    def one(data: bytes | None, link: str | None) -> bytes | None:
        try:
            return dispatch.media(data, link, "", ParseOptions(max_parse_bytes=max_parse_bytes))
        except Exception:
            return None

    @F.arrow_udf(T.BinaryType())
    def get(data: pa.Array, links: pa.Array) -> pa.Array:
        # a file at a time, as containers may be large
        return pa.array((one(d.as_py(), k.as_py()) for d, k in zip(data, links)), pa.binary())

    return get(content, uri)


def media_links(text: Column) -> Column:
    """Distinct links to embedded media in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SCHEME.replace("/", "/") + r"[A-Za-z0-9/_.\-]+"), F.lit(0)))


def valid_media_link(uri: Column) -> Column:
    """Whether a text is a well-formed link to embedded media."""
    part = lambda k: F.regexp_extract(uri, rf"\A{MEDIA_LINK}\z", k)
    number, generation = part(1), part(2)
    grammar = uri.rlike(rf"\A{MEDIA_LINK}\z")
    small = (number == "") | ((F.lpad(number, 10, "0") <= "4294967295") & (F.lpad(generation, 5, "0") <= "65535"))
    return F.coalesce(grammar & small, F.lit(False))
