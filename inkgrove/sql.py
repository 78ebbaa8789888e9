"""The engine's functions for SQL: scalar functions and table functions for LATERAL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.functions.charset import decoded
from inkgrove.functions.text import absolute
from inkgrove.operators.evidence import finder
from inkgrove.options import ParseOptions
from inkgrove.parsers import dispatch
from inkgrove.schema import ParseError
from inkgrove.session import ship


class PieceRows:
    """Table function: (index, text) of the paragraphs of a text."""

    def eval(self, text: str):
        import re

        parts = [p for p in (x.strip() for x in re.split(r"\n{2,}", text or "")) if p]
        yield from enumerate(parts)


class CellRows:
    """Table function: (table_no, row_no, header, value) of the tables in a file's bytes."""

    def eval(self, content: bytes, source: str):
        row = dispatch.parse(None if content is None else bytes(content), source, None, ParseOptions(mode="tables", limit=1 << 40))
        for k, t in enumerate(row["tables"] or ()):
            for n, values in zip(t["row_numbers"], t["rows"]):
                for header, value in values.items():
                    yield k, n, header, value


def batch(f, *columns: pa.Array) -> pa.Array:
    """f over the rows of Arrow columns, as text."""
    return pa.array([f(*row) for row in zip(*(c.to_pylist() for c in columns))], pa.string())


def register(spark: SparkSession) -> None:
    """detect_format, decode_text, absolute_url, locate_quote, parse_markdown, chunks and table_cells."""
    ship(spark)

    def found(data, source, content_type):
        from inkgrove.functions.detect import detect

        try:
            return None if data is None else detect(data, source or "", content_type)
        except ParseError:
            return None

    def markdown(data, source):
        return dispatch.parse(data, source, None, ParseOptions(mode="document"))["markdown"]

    one = lambda f: F.arrow_udf(lambda a: batch(f, a), T.StringType())
    spark.udf.register("detect_format", F.arrow_udf(lambda a, b, c: batch(found, a, b, c), T.StringType()))
    spark.udf.register("decode_text", one(lambda data: None if data is None else decoded(data)))
    spark.udf.register("absolute_url", F.arrow_udf(lambda a, b: batch(lambda base, link: None if link is None else absolute(base, link), a, b), T.StringType()))
    spark.udf.register("locate_quote", finder("1234"))
    spark.udf.register("parse_markdown", F.arrow_udf(lambda a, b: batch(markdown, a, b), T.StringType()))
    spark.udtf.register("chunks", F.udtf(PieceRows, returnType="index: int, text: string"))
    spark.udtf.register("table_cells", F.udtf(CellRows, returnType="table_no: int, row_no: bigint, header: string, value: string"))
