"""Files as rows: paths and globs, batch or stream, within a size limit that is checked before reading."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.schema import MAX_PARSE_BYTES

FILE_COLUMNS = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def inside(path: str, root: str) -> str:
    """The path below a root folder, or an error if it leaves it."""
    full = posixpath.normpath(posixpath.join(root, path))
    base = posixpath.normpath(root)
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{path} lies outside of {root}")
    return full


def read_files(spark: SparkSession, *paths: str, glob: str | None = None, recursive: bool = False, max_parse_bytes: int = MAX_PARSE_BYTES, root: str | None = None) -> DataFrame:
    """source, content, input_bytes of files; of a file over the limit the content is null and was never read.

    With a root folder, paths are taken below it and one that leaves it is an error.
    """
    if root is not None:
        paths = tuple(inside(p, root) for p in paths)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(list(paths))
    small = files.where(F.col("length") <= max_parse_bytes).select(_source(), F.col("content"), F.col("length").alias("input_bytes"))
    large = files.where(F.col("length") > max_parse_bytes).select(_source(), F.lit(None).cast("binary").alias("content"), F.col("length").alias("input_bytes"))
    return small.unionByName(large)


def _source():
    return F.regexp_replace("path", r"\Afile:/+(?=[^/])", "/").alias("source")


def stream_files(spark: SparkSession, folder: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """source, content of files as they arrive in a folder: parse() works on it as on a batch."""
    reader = spark.readStream.format("binaryFile").schema(FILE_COLUMNS).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select(_source(), "content", "modificationTime")


def fetch_one(url: str | None, timeout: float = 30.0, most: int = MAX_PARSE_BYTES) -> tuple[bytes | None, str | None, str]:
    """Content, content type and status of one web address."""
    import urllib.request

    if not url or not re.match(r"https?://", url):
        return None, None, "not a web address"
    try:
        ask = urllib.request.Request(url, headers={"Accept": "text/markdown, text/html;q=0.9"})
        with urllib.request.urlopen(ask, timeout=timeout) as answer:  # noqa: S310
            if int(answer.headers.get("Content-Length") or 0) > most:
                return None, None, "parse_budget_exceeded"
            data = answer.read(most + 1)
            return (None, None, "parse_budget_exceeded") if len(data) > most else (data, answer.headers.get("Content-Type"), "ok")
    except Exception as e:
        return None, None, str(e)[:200]


def fetch(addresses: DataFrame, column: str = "url", timeout: float = 30.0, most: int = MAX_PARSE_BYTES) -> DataFrame:
    """source, content, content_type, status of web addresses, read on the executors within a limit.

    Only http and https are read; a failure leaves the content null and its reason in status.
    """

    # a row at a time: each waits for its server
    get = F.udf(lambda url: fetch_one(url, timeout, most), "struct<content: binary, content_type: string, status: string>")
    return addresses.select(F.col(column).alias("source"), get(column).alias("r")).select("source", "r.*")
