"""The query layer over parsed text: chunks, search, metrics, budgets and exports. All Catalyst."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkgrove.schema import SEARCH_TOP, SNIPPET
from inkgrove.session import bounded_groups

#: Rows of a group that becomes one row.
MAX_GROUP = 10_000
_EDGE = r"\A(?U)\s+|(?U)\s+\z"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def squeezed(text: Column) -> Column:
    """White space of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def paragraph_chunks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "markdown") -> DataFrame:
    """id, index, text: the trimmed, non-empty parts between blank lines, numbered from 0 after filtering."""
    parts = F.filter(F.transform(F.split(F.col(text_col), r"\n{2,}"), stripped), lambda x: x != "")
    return documents.select(F.col(id_col), F.posexplode(parts).alias("index", "text"))


def table_chunks(parsed: DataFrame) -> DataFrame:
    """doc_id, table_no, kind, index, row, text: a schema chunk and one chunk a row of every table.

    A schema's index is its table's number, a row's its place among the shown rows; row is its
    number in the file.
    """
    t = parsed.select("doc_id", F.posexplode("tables").alias("table_no", "t"))
    about = F.struct(F.col("table_no").alias("table_index"), "t.sheet", "t.range", "t.headers", "t.truncated", "t.warnings")
    head = t.select("doc_id", "table_no", F.lit("table_schema").alias("kind"), F.col("table_no").alias("index"), F.lit(None).cast("bigint").alias("row"), F.to_json(about).alias("text"))
    rows = t.select("doc_id", "table_no", F.posexplode(F.arrays_zip(F.col("t.row_numbers").alias("n"), F.col("t.rows").alias("v"))).alias("index", "r"))
    rows = rows.select("doc_id", "table_no", F.lit("table_row").alias("kind"), "index", F.col("r.n").alias("row"), F.to_json("r.v").alias("text"))
    return head.unionByName(rows)


def chunks(parsed: DataFrame) -> DataFrame:
    """All chunks of a parsed corpus with their kind."""
    paragraphs = paragraph_chunks(parsed.where("kind = 'document'")).select("doc_id", F.lit(None).cast("int").alias("table_no"), F.lit("paragraph").alias("kind"), "index", F.lit(None).cast("bigint").alias("row"), "text")
    return paragraphs.unionByName(table_chunks(parsed))


def occurrences(text: Column, term: str) -> Column:
    """Times a term stands in a text without overlaps, both in lower case."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / F.lit(len(term))).cast("bigint")


def search(texts: DataFrame, query: str, text_col: str = "text", source_col: str = "source", tie_col: str = "index", top: int | None = SEARCH_TOP) -> DataFrame:
    """Texts with any of the query's terms and their score: the sum of the terms' occurrences.

    Ordered by score, then source, then place; the best `top` (all if None). A blank query finds nothing.
    """
    terms = query.lower().split()
    score = sum((F.coalesce(occurrences(F.col(text_col), t), F.lit(0)) for t in terms), F.lit(0).cast("bigint"))
    found = texts.withColumn("score", score).where("score > 0")
    return found if top is None else found.orderBy(F.desc("score"), source_col, tie_col).limit(top)


def search_summary(hits: DataFrame, source_col: str = "source") -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("hits"), F.countDistinct(source_col).alias("sources"))


def snippet(text: Column, size: int = SNIPPET) -> Column:
    return F.substring(text, 1, size)


def metrics(parsed: DataFrame) -> DataFrame:
    """One row: ready and failed inputs, warnings, formats, chunks and output bytes."""
    parts = F.size(F.filter(F.transform(F.split(F.col("markdown"), r"\n{2,}"), stripped), lambda x: x != ""))
    rows = F.aggregate(F.coalesce("tables", F.array()), F.lit(0), lambda n, t: n + F.size(t["rows"]) + 1)
    return parsed.agg(
        F.count_if(F.col("error").isNull()).alias("ready"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"),
        F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"),
        F.coalesce(F.sum(F.when(F.col("kind") == "document", parts).when(F.col("kind") == "tables", rows)), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("stats.output_bytes"), F.lit(0)).alias("output_bytes"),
    )


def manifest(parsed: DataFrame) -> DataFrame:
    """One record an input."""
    return parsed.select(
        "source", F.when(F.col("error").isNull(), "ready").otherwise("error").alias("status"), "format", "stats.input_bytes", "stats.output_bytes",
        F.size("warnings").alias("warnings"), F.col("error.code").alias("error"),
    )


def by_status(rows: DataFrame, status: str) -> DataFrame:
    return rows if status == "all" else rows.where(F.col("status") == status)


def extracted_text(parsed: DataFrame) -> DataFrame:
    """doc_id, text: a document's Markdown, or each table's name and its rows as JSON lines."""
    table = lambda t: F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(t["sheet"], t["source"])), F.array_join(F.transform(t["rows"], lambda r: F.to_json(r)), "\n"))
    return parsed.where("error is null").select("doc_id", F.when(F.col("kind") == "document", F.col("markdown")).otherwise(F.array_join(F.transform("tables", table), "\n\n")).alias("text"))


def tables_markdown(parsed: DataFrame) -> DataFrame:
    """doc_id, table_no, markdown: each table with its head in column order."""
    t = parsed.select("doc_id", F.posexplode("tables").alias("table_no", "t"))
    heads = F.transform(F.array_sort(F.transform(F.map_entries("t.headers"), lambda h: F.struct(h["value"]["column_index"].alias("i"), h["key"].alias("k")))), lambda h: h["k"])
    cell = lambda c: F.translate(F.replace(c, F.lit("|"), F.lit("\\|")), "\n\r\t", "   ")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))
    rows = F.transform("t.rows", lambda r: line(F.transform(F.col("heads"), lambda k: F.coalesce(F.try_element_at(r, k), F.lit("")))))
    return t.withColumn("heads", heads).select(
        "doc_id", "table_no",
        F.array_join(F.concat(F.array(line(F.col("heads")), F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("heads")))), rows), "\n").alias("markdown"),
    )


def gfm_cell(text: Column) -> Column:
    """A cell's text on one line with its bars escaped."""
    return F.translate(F.replace(text, F.lit("|"), F.lit("\\|")), "\n\r\t", "   ")


def concatenated(documents: DataFrame, group_col: str, name_col: str = "source", text_col: str = "markdown", most: int = MAX_GROUP) -> DataFrame:
    """group, corpus: the documents of each group under their names, in order of name.

    For the uploads of one question; a group of more than most rows is an error.
    """
    documents = bounded_groups(documents, group_col, most)
    part = F.struct(F.col(name_col).alias("n"), F.concat(F.lit("# File: "), F.col(name_col), F.lit("\n\n"), F.col(text_col)).alias("t"))
    return documents.groupBy(group_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("corpus"))


def page_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("## Page "))


def byte_size(n: Column) -> Column:
    """A number of bytes as B, KiB or MiB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KiB", n / 1024.0)).otherwise(F.format_string("%.1f MiB", n / 1048576.0))


def suspicious_text(text: Column) -> Column:
    """Replacement or control characters other than white space, or two raw glyph names."""
    return text.rlike("[\\x{FFFD}\\x00-\\x08\\x0E-\\x1B\\x7F-\\x84\\x86-\\x9F]") | (F.regexp_count(F.lower(text), F.lit("glyph<")) >= 2)


def budget_fold(inputs: DataFrame, group_col: str, order_col: str, size_col: str, budget: int, most: int = MAX_GROUP) -> DataFrame:
    """group, order, size, accepted: inputs in order, each taken if it still fits.

    One that doesn't fit is left out and uses nothing, so this is a fold, not a running sum. For
    the inputs of one request; a group of more than most rows is an error.
    """
    inputs = bounded_groups(inputs, group_col, most)
    step = lambda s, x: F.when(
        s["used"] + x["n"] <= budget, F.struct((s["used"] + x["n"]).alias("used"), F.concat(s["taken"], F.array(F.lit(True))).alias("taken"))
    ).otherwise(F.struct(s["used"].alias("used"), F.concat(s["taken"], F.array(F.lit(False))).alias("taken")))
    rows = inputs.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(size_col).cast("bigint").alias("n")))).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("taken"))
    rows = rows.withColumn("taken", F.aggregate("xs", start, step)["taken"])
    return rows.select(group_col, F.explode(F.arrays_zip("xs", "taken")).alias("r")).select(group_col, F.col("r.xs.o").alias(order_col), F.col("r.xs.n").alias(size_col), F.col("r.taken").alias("accepted"))


def page_spans(blocks: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """doc, page, out_start, out_end: byte ranges of page blocks joined by a blank line."""
    size = F.octet_length(F.col(text_col)).cast("bigint")
    before = F.coalesce(F.sum(size + 2).over(W.partitionBy(doc_col).orderBy(page_col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.select(doc_col, page_col, before.cast("bigint").alias("out_start"), (before + size).cast("bigint").alias("out_end"))


def page_at(spans: Column, at: Column) -> Column:
    """Page of the span (array of out_start, out_end, page_number) that holds a byte offset."""
    return F.try_element_at(F.filter(spans, lambda s: (s["out_start"] <= at) & (at < s["out_end"])), F.lit(1))["page_number"]


def relinked(text: Column, prefix: str) -> Column:
    """Media links of images as links of a service: prefix and the encoded link."""
    return F.regexp_replace(text, r"\]\(grove://([A-Za-z0-9/_.\-]+)\)", rf"]({prefix}grove%3A%2F%2F$1)")


def token_counts(texts: DataFrame, counter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tokens: a counter (a function of a list of texts to their numbers of tokens) over batches; null counts 0."""

    @F.pandas_udf("bigint")
    def count(values: pd.Series) -> pd.Series:
        return pd.Series(counter([v or "" for v in values]), dtype="int64")

    return texts.select(id_col, count(text_col).alias("tokens"))


def agent_bodies(parsed: DataFrame, most: int = 96 << 10, spans: int = 12) -> DataFrame:
    """doc_id, body: text cut at a byte limit at a whole character, then a footer of facts: format,
    pages, warnings and the first page spans."""
    data = F.encode("markdown", "UTF-8")
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(data, 1, most).cast("string")), "\\x{FFFD}+\\z", "")
    body = F.when(F.octet_length("markdown") > most, F.concat(cut, F.lit("\n[cut]"))).otherwise(F.col("markdown"))
    notes = F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("\n- "), w["code"])), "")
    places = F.array_join(F.transform(F.slice(F.coalesce("provenance", F.array()), 1, spans), lambda p: F.concat(F.lit("\n- page "), p["page_number"].cast("string"), F.lit(": bytes "), p["out_start"].cast("string"), F.lit(" to "), p["out_end"].cast("string"))), "")
    facts = F.concat(F.lit("\n---\nformat: "), F.col("format"), F.lit("\npages: "), F.coalesce(F.col("stats.page_count").cast("string"), F.lit("-")))
    return parsed.where("kind = 'document'").select("doc_id", F.concat(body, facts, notes, places).alias("body"))
