"""Queries of the corpus layer: chunks, search, metrics, spans, evidence."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from inkgrove.functions import markdown as md
from inkgrove.functions.charset import decoded_text
from inkgrove.operators import corpus, engine, evidence
from inkgrove.session import checked_broadcast, ship, spread
from inkgrove.sources.tables import table

QUESTION = "harbour original report"


def chunk_paragraphs(spark, d):
    rows = table(spark, d, "parse_results").where("markdown is not null")
    return corpus.paragraph_chunks(rows, "parse_id").select("parse_id", "index", F.md5("text").alias("text_md5"))


def keyword_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return corpus.search(docs, QUESTION, tie_col="doc_id").select("doc_id", "source", "score")


def search_snippets(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return corpus.search(docs, "furnace", tie_col="doc_id", top=8).select("doc_id", "score", corpus.snippet(F.col("text")).alias("snippet"))


def search_summary(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return corpus.search_summary(corpus.search(docs, QUESTION, tie_col="doc_id", top=None))


def corpus_metrics(spark, d):
    """Texts of the test items parsed as files: counts, warnings, chunks and bytes."""
    items = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.lit("a.txt").alias("source"), F.encode("text", "UTF-8").alias("content"))
    m = corpus.metrics(engine.parse(items, doc_id="item_id"))
    return m.select(*[F.col(c).cast("bigint").alias(c) if c != "formats" else F.col(c) for c in m.columns])


def corpus_manifest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("repo", F.lit("/"), "file_path", F.lit(".txt")).alias("source"), F.encode("text", "UTF-8").alias("content"))
    return corpus.manifest(engine.parse(docs, doc_id="doc_id")).select("source", "status", "format", "input_bytes", "output_bytes", "error")


def ready_by_format(spark, d):
    """Delivered results by format: rows, results with text, bytes of text."""
    rows = table(spark, d, "parse_results")
    return rows.groupBy("doc_format").agg(F.count(F.lit(1)).alias("n"), F.count_if(corpus.stripped(F.col("markdown")) != "").alias("with_text"), F.sum(F.octet_length("markdown")).alias("bytes"))


def concat_corpus(spark, d):
    items = table(spark, d, "eval_items").select(F.coalesce("suite", F.lit("none")).alias("suite"), F.lpad(F.col("item_id").cast("string"), 6, "0").alias("source"), F.col("text").alias("markdown"))
    return corpus.concatenated(items, "suite").select("suite", F.md5("corpus").alias("corpus_md5"), F.octet_length("corpus").cast("bigint").alias("bytes"))


def gfm_cells(spark, d):
    rows = table(spark, d, "parse_results").where("markdown is not null")
    return rows.select("parse_id", F.md5(corpus.gfm_cell(F.col("markdown"))).alias("cell_md5"))


def squeezed_text(spark, d):
    rows = table(spark, d, "parse_results").where("markdown is not null")
    return rows.select("parse_id", F.md5(corpus.squeezed(F.col("markdown"))).alias("text_md5"))


def suspicious_results(spark, d):
    """Results whose text shows marks of an unreliable layer."""
    rows = table(spark, d, "parse_results").where("markdown is not null")
    return rows.where(corpus.suspicious_text(F.col("markdown"))).select("parse_id")


def result_sizes(spark, d):
    """Sizes and page counts by the text itself beside what was delivered."""
    rows = table(spark, d, "parse_results").where("markdown is not null")
    n = F.octet_length("markdown").cast("bigint")
    return rows.select("parse_id", n.alias("bytes"), corpus.byte_size(n).alias("size"), corpus.page_count(F.col("markdown")).cast("bigint").alias("pages"), F.coalesce(F.col("output_bytes") != n, F.lit(True)).alias("stale"))


def page_texts(spark, d):
    """Pages of results by the byte ranges of their spans, repeated and invalid spans aside."""
    return _page_blocks(spark, d).select("parse_id", "span_no", "page_number", F.md5("data").alias("text_md5"))


def _page_blocks(spark, d):
    """parse_id, span_no, page_number, data: the bytes of every valid span, each result encoded once."""
    span = F.struct("span_no", "out_start", "out_end", "page_number")
    spans = table(spark, d, "provenance_spans").groupBy("parse_id").agg(F.collect_set(span).alias("spans"))
    rows = table(spark, d, "parse_results").where("doc_format = 'pdf' and markdown is not null").select("parse_id", "markdown").join(spans, "parse_id")
    valid = F.filter("spans", lambda s: (0 <= s["out_start"]) & (s["out_start"] < s["out_end"]) & (s["out_end"] <= F.octet_length("markdown")))
    return rows.select("parse_id", F.explode(engine.span_bytes(F.col("markdown"), valid)).alias("p")).select("parse_id", "p.span.span_no", "p.span.page_number", "p.data")


#: Texts whose only characters outside of ASCII are those of one charset's languages.
CHARSETS = {"gb18030": "一-鿿，。：；、（）", "windows-1251": "А-Яа-яЁё", "windows-1252": "éèàüöäßñóíáçêãõúôâîÄÖÜÉ"}


def decode_charsets(spark, d):
    """Texts of documents and results in the charset of their language, decoded without being told which."""
    ship(spark)
    texts = table(spark, d, "documents").select("doc_id", F.lit("documents").alias("origin"), "text").unionByName(table(spark, d, "parse_results").select(F.col("parse_id").alias("doc_id"), F.lit("parse_results").alias("origin"), F.col("markdown").alias("text")))
    charset = F.coalesce(*[F.when(F.regexp_count("text", F.lit(f"[{own}]")) >= 10, F.when(~F.col("text").rlike(rf"[^\x00-\x7f{own}]"), F.lit(name))) for name, own in CHARSETS.items()])

    @F.arrow_udf("binary")
    def encoded(data: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([t.encode(n) for t, n in zip(data.to_pylist(), names.to_pylist())], pa.binary())

    rows = spread(texts.withColumn("charset", charset).where("charset is not null"))
    return rows.select("origin", "doc_id", "charset", F.md5(decoded_text(encoded("text", "charset"))).alias("text_md5"))


def page_spans(spark, d):
    """Byte ranges rebuilt from the texts of the pages (the longest one, where a page has several)."""
    blocks = _page_blocks(spark, d).groupBy("parse_id", "span_no").agg(F.max_by(F.col("data"), F.octet_length("data")).alias("data"))
    return corpus.page_spans(blocks.select("parse_id", "span_no", F.make_valid_utf8(F.col("data").cast("string")).alias("block")), "parse_id", "span_no", "block")


def page_of_offset(spark, d):
    """Page on which the middle byte of each result lies, by its spans."""
    spans = table(spark, d, "provenance_spans").where("out_start is not null and out_end is not null").groupBy("parse_id").agg(F.array_sort(F.collect_set(F.struct("out_start", "out_end", F.col("page_number")))).alias("spans"))
    rows = table(spark, d, "parse_results").where("doc_format = 'pdf' and markdown is not null").select("parse_id", F.floor(F.octet_length("markdown") / 2).alias("at"))
    return rows.join(spans, "parse_id").select("parse_id", corpus.page_at(F.col("spans"), F.col("at")).alias("page"))


def warnings_by_code(spark, d):
    rows = table(spark, d, "parse_warnings").distinct()
    return rows.groupBy("code", F.coalesce("loc_kind", F.lit("")).alias("loc_kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("parse_id").alias("results"))


def entry_heads(spark, d):
    """Heads of delivered tables in column order, and whether their rows were cut."""
    t = table(spark, d, "table_entries")
    heads = F.transform(F.array_sort(F.transform(F.map_entries("headers"), lambda h: F.struct(h["value"]["column_index"].alias("i"), h["key"].alias("k")))), lambda h: h["k"])
    return t.select("entry_id", F.array_join(heads, "|").alias("head"), F.size("headers").alias("n"), "truncated", F.col("row_range.first_row").alias("first_row"), F.col("row_range.last_row").alias("last_row"))


def media_links(spark, d):
    """Links to embedded media in texts made of every result's number, and whether they are well formed."""
    n = F.col("parse_id").cast("string")
    links = [("docx/part/word/media/a", n, ".png"), ("docx/part/word/media/a", n, ".png"), ("docx/part/ppt/media/a", n, ".png"), ("pptx/part/ppt/media/../a", n, ""), ("xlsx/part/xl/media/x/y-", n, ""), ("pdf/page/", n, ""), ("pdf/obj/0", n, "/0"), ("pdf/obj/7/", (F.col("parse_id") * 10).cast("string"), ""), ("pdf/obj/", (F.col("parse_id") * 1_000_000).cast("string"), "/0")]
    text = F.concat_ws(" and ", *[F.concat(F.lit(f"![a](grove://{a}"), x, F.lit(f"{b})")) for a, x, b in links])
    df = table(spark, d, "parse_results").select("parse_id", F.explode(engine.media_links(text)).alias("uri"))
    return df.select("parse_id", "uri", engine.valid_media_link(F.col("uri")).alias("valid"))


CAP = 1500


def markdown_cap(spark, d):
    """Documents cut at a byte limit after a whole line, with a notice: no row is over the limit."""
    ship(spark)

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([md.capped(t, CAP)[0] for t in texts.to_pylist()], pa.string())

    rows = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).withColumn("c", cut("text"))
    return rows.select("doc_id", F.md5("c").alias("text_md5"), (F.octet_length("c") <= CAP).alias("fits"))


def budget_fold(spark, d):
    """Test items of each suite under one budget of bytes, skip and go on."""
    items = table(spark, d, "eval_items").select(F.coalesce("suite", F.lit("none")).alias("suite"), "item_id", F.octet_length("text").alias("size"))
    return corpus.budget_fold(items, "suite", "item_id", "size", 3000).select("suite", "item_id", F.col("size").cast("bigint").alias("size"), "accepted")


def locate_quotes(spark, d):
    """All sentences of the test items, wherever they stand in the documents."""
    quotes = table(spark, d, "eval_items").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.]*\."), F.lit(0))).alias("n", "quote"))
    quotes = quotes.select((F.col("item_id") * 1000 + F.col("n")).alias("quote_id"), "quote")
    return evidence.quote_hits(table(spark, d, "documents"), quotes)


REPORT = "## Page 1\n\nRevenue grew strongly in the last year.\n\n## Page 2\n\n| Item (百万元) | 2023 | 2024 |\n| --- | --- | --- |\n| Revenue | 1,234.50 | 1,335.00 |\n| Margin | 12.5% | 13.1% |\n\n## Page 3\n\n净利润 为 13.35亿 元。\n"
QUOTES = [(1, "Revenue grew strongly"), (2, "Revenue  grew\nstrongly"), (3, "2024 Revenue 1,335.00"), (4, "2024 Expenses 9,999.00"), (5, ""), (6, "Margin 13.1%"), (7, "Cost 13.1%"), (8, "7"), (9, "Revenue 133500万"), (10, None)]


def locate_tiers(spark, d):
    ship(spark)
    df = spark.createDataFrame(QUOTES, "id int, quote string")
    found = df.select("id", evidence.located(F.lit(REPORT), F.col("quote")).alias("l"))
    return found.select("id", F.col("l.tier").alias("tier"), F.col("l.page").alias("page"), F.col("l.hit").alias("hit"))


def _order_reports(spark, d):
    """One report a customer: a table of the customer's orders with their totals."""
    row = F.concat(F.lit("| Order "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" |"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("rows"))
    return rows.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("## Page 1\n\n| Order | Total |\n| --- | --- |\n"), F.array_join(F.col("rows.row"), "\n"), F.lit("\n")).alias("text"))


def _order_quotes(spark, d):
    """Totals of every hundredth order, as written and in units of ten thousand."""
    own = table(spark, d, "orders").where("o_orderkey % 100 = 0")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    number = own.select((2 * F.col("o_orderkey")).alias("quote_id"), F.concat(F.lit("Total of Order: "), price.cast("string")).alias("quote"))
    amount = own.select((2 * F.col("o_orderkey") + 1).alias("quote_id"), F.concat(F.lit("Order of "), F.round(price / 10000, 1).cast("decimal(18,1)").cast("string"), F.lit("万")).alias("quote"))
    return number.unionByName(amount)


def locate_orders(spark, d):
    """Recombined and rounded figures, wherever they stand in the reports over all orders."""
    found = evidence.evidence_hits(_order_reports(spark, d), _order_quotes(spark, d))
    return found.select("doc_id", "quote_id", "tier", "hit", "page")


def _claims(spark, d):
    hits = locate_quotes(spark, d).select(F.floor(F.col("quote_id") / 1000).alias("item_id")).distinct().withColumn("located", F.lit(True))
    verdict = F.element_at(F.array(F.lit("supported"), F.lit("partial"), F.lit("unsupported")), (F.col("item_id") % 3 + 1).cast("int"))
    items = table(spark, d, "eval_items").select("item_id", F.coalesce("suite", F.lit("none")).alias("suite"), F.col("text").alias("claim"), verdict.alias("verdict"))
    return evidence.gated(items.join(checked_broadcast(hits, 1_000_000), "item_id", "left"))


def verdict_gate(spark, d):
    return _claims(spark, d).select("item_id", "verdict", "final_verdict", "evidence_kind", "reason")


def answer_trace(spark, d):
    t = evidence.trace(_claims(spark, d), "suite", "item_id").select("suite", F.explode("parts").alias("p"))
    return t.select("suite", F.col("p.id").alias("id"), F.col("p.claim").alias("claim"), F.col("p.verdict").alias("verdict"))


SEGMENTS = [
    (1, 0, "text", "Intro", None, None, None, None), (1, 1, "claim", "It grew", "supported", "Revenue grew strongly", None, None), (1, 2, "claim", "Costs fell", "supported", "Costs fell by half", None, "they rose"),
    (1, 3, "text", "and", None, None, None, None), (1, 4, "claim", "Margin", "partial", "Margin 13.1%", "rounded", None), (2, 0, "claim", "No quote", "supported", " ", None, None), (2, 1, "claim", "Denied", "unsupported", "Revenue grew strongly", "says nothing", None),
]


def trace_evidence(spark, d):
    """Evidence of complete traces over a fixed report: one row a claim."""
    ship(spark)
    rows = spark.createDataFrame(SEGMENTS, "answer_id int, seq int, kind string, text string, verdict string, quote string, note string, truth string")
    t = evidence.assembled(rows.withColumn("markdown", F.lit(REPORT)).withColumn("source", F.lit("report")))
    e = t.select("answer_id", "audit.supported", F.size("parts").alias("parts"), F.explode("evidence").alias("e"))
    return e.select("answer_id", "supported", "parts", F.col("e.id").alias("id"), F.col("e.kind").alias("kind"), F.col("e.verdict").alias("verdict"), F.col("e.page").alias("page"), F.col("e.hit").alias("hit"), F.col("e.reason").alias("reason"), F.col("e.expected_truth").alias("truth"))


def chunk_tables(spark, d):
    """Chunks of generated tables by kind, with their places and rows."""
    from inkgrove.plans.parsing import CUSTOMER, _csv_files

    parsed = engine.parse(_csv_files(spark, d, "customer", "c_custkey", CUSTOMER), doc_id="file_no", limit=10**9)
    c = corpus.chunks(parsed)
    return c.groupBy(F.col("doc_id").cast("bigint").alias("file_no"), "kind").agg(F.count(F.lit(1)).alias("n"), F.max("index").alias("last_index"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_paragraphs, keyword_search, search_snippets, search_summary, corpus_metrics, corpus_manifest, ready_by_format, concat_corpus, gfm_cells, squeezed_text, suspicious_results, result_sizes,
        page_texts, decode_charsets, page_spans, page_of_offset, warnings_by_code, entry_heads, media_links, markdown_cap, budget_fold, locate_quotes, locate_tiers, locate_orders, verdict_gate, answer_trace, trace_evidence, chunk_tables,
    )
}

_WHITE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_COUNT = lambda text, term: f"((length(lower({text})) - length(replace(lower({text}), '{term}', ''))) // {len(term)})"
_SCORE = " + ".join(_COUNT("text", t) for t in QUESTION.split())
_HITS = r"""
WITH d AS (SELECT doc_id, text, regexp_replace(text, '%s+', '', 'g') AS f FROM documents WHERE text IS NOT NULL
), x AS (SELECT item_id, regexp_extract_all(text, '[^.]*[.]') AS qs FROM eval_items WHERE text IS NOT NULL
), q AS (SELECT item_id * 1000 + unnest(range(len(qs))) AS item_id, regexp_replace(unnest(qs), '^%s+', '') AS q FROM x
), h AS (SELECT doc_id, item_id AS quote_id, CASE WHEN instr(text, q) > 0 THEN 'exact' ELSE 'whitespace' END AS tier, CASE WHEN instr(text, q) > 0 THEN (instr(text, q) - 1)::INTEGER END AS start
  FROM d JOIN q ON contains(f, regexp_replace(q, '%s+', '', 'g')))
""" % (_WHITE, _WHITE, _WHITE)
_GATE = _HITS + """, c AS (
  SELECT item_id, coalesce(suite, 'none') AS suite, text AS claim, ['supported', 'partial', 'unsupported'][item_id % 3 + 1] AS verdict, item_id IN (SELECT quote_id // 1000 FROM h) AS located FROM eval_items
), gate AS (
  SELECT *, CASE WHEN verdict <> 'unsupported' AND located THEN verdict ELSE 'unsupported' END AS final_verdict, CASE WHEN verdict <> 'unsupported' AND located THEN 'quote' ELSE 'none' END AS evidence_kind,
    CASE WHEN verdict <> 'unsupported' AND located THEN NULL WHEN verdict <> 'unsupported' THEN 'the quote is not in the source' ELSE 'the source does not support it' END AS reason FROM c)
"""
SQL = {
    "chunk_paragraphs": rf"""
WITH p AS (SELECT parse_id, list_filter(list_transform(string_split_regex(markdown, '\n{{2,}}'), lambda x: regexp_replace(regexp_replace(x, '^{_WHITE}+', ''), '{_WHITE}+$', '')), lambda x: x <> '') AS parts FROM parse_results WHERE markdown IS NOT NULL)
SELECT parse_id, unnest(range(len(parts)))::INTEGER AS index, md5(unnest(parts)) AS text_md5 FROM p""",
    "keyword_search": f"SELECT doc_id, source, ({_SCORE})::BIGINT AS score FROM documents WHERE {_SCORE} > 0 ORDER BY 3 DESC, source, doc_id LIMIT 24",
    "search_snippets": f"SELECT doc_id, {_COUNT('text', 'furnace')}::BIGINT AS score, substr(text, 1, 700) AS snippet FROM documents WHERE {_COUNT('text', 'furnace')} > 0 ORDER BY 2 DESC, source, doc_id LIMIT 8",
    "search_summary": f"SELECT count(*) AS hits, count(DISTINCT source) AS sources FROM documents WHERE {_SCORE} > 0",
    "corpus_metrics": rf"""
SELECT count(text) AS ready, (count(*) - count(text))::BIGINT AS errors, 0::BIGINT AS warnings, 'text' AS formats, sum(len(list_filter(string_split_regex(text, '\n{{2,}}'), lambda x: regexp_replace(x, '{_WHITE}+', '', 'g') <> '')))::BIGINT AS chunks, sum(strlen(text))::BIGINT AS output_bytes FROM documents""",
    "corpus_manifest": """
SELECT repo || '/' || file_path || '.txt' AS source, CASE WHEN text IS NULL THEN 'error' ELSE 'ready' END AS status, CASE WHEN text IS NOT NULL THEN 'text' END AS format, strlen(text)::BIGINT AS input_bytes, strlen(text)::BIGINT AS output_bytes,
  CASE WHEN text IS NULL THEN 'parse_failed' END AS error FROM documents""",
    "ready_by_format": f"SELECT doc_format, count(*) AS n, count(*) FILTER (regexp_replace(markdown, '{_WHITE}+', '', 'g') <> '') AS with_text, sum(strlen(markdown))::BIGINT AS bytes FROM parse_results GROUP BY 1",
    "concat_corpus": """
WITH c AS (SELECT coalesce(suite, 'none') AS suite, string_agg('# File: ' || lpad(item_id::VARCHAR, 6, '0') || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY lpad(item_id::VARCHAR, 6, '0'), text) AS corpus FROM eval_items GROUP BY 1)
SELECT suite, md5(corpus) AS corpus_md5, strlen(corpus)::BIGINT AS bytes FROM c""",
    "gfm_cells": r"SELECT parse_id, md5(translate(replace(markdown, '|', '\|'), chr(10) || chr(13) || chr(9), '   ')) AS cell_md5 FROM parse_results WHERE markdown IS NOT NULL",
    "squeezed_text": f"SELECT parse_id, md5(trim(regexp_replace(markdown, '{_WHITE}+', ' ', 'g'), ' ')) AS text_md5 FROM parse_results WHERE markdown IS NOT NULL",
    "suspicious_results": r"SELECT parse_id FROM parse_results WHERE regexp_matches(markdown, '[\x{FFFD}\x00-\x08\x0E-\x1B\x7F-\x{84}\x{86}-\x{9F}]') OR len(regexp_extract_all(lower(markdown), 'glyph<')) >= 2",
    "result_sizes": """
SELECT parse_id, strlen(markdown)::BIGINT AS bytes, CASE WHEN strlen(markdown) < 1024 THEN strlen(markdown) || ' B' WHEN strlen(markdown) < 1048576 THEN (strlen(markdown) * 10 + 512) // 1024 // 10 || '.' || (strlen(markdown) * 10 + 512) // 1024 % 10 || ' KiB' ELSE (strlen(markdown) * 10 + 524288) // 1048576 // 10 || '.' || (strlen(markdown) * 10 + 524288) // 1048576 % 10 || ' MiB' END AS size,
  len(regexp_extract_all(markdown, '## Page '))::BIGINT AS pages, coalesce(output_bytes <> strlen(markdown), true) AS stale FROM parse_results WHERE markdown IS NOT NULL""",
    "decode_charsets": "WITH t AS (SELECT doc_id, 'documents' AS origin, text FROM documents UNION ALL SELECT parse_id, 'parse_results', markdown FROM parse_results), c AS (SELECT *, coalesce("
    + ", ".join(rf"CASE WHEN len(regexp_extract_all(text, '[{own}]')) >= 10 AND NOT regexp_matches(text, '[^\x00-\x7f{own}]') THEN '{name}' END" for name, own in CHARSETS.items())
    + ") AS charset FROM t) SELECT origin, doc_id, charset, md5(text) AS text_md5 FROM c WHERE charset IS NOT NULL",
    "page_texts": """
WITH s AS (SELECT DISTINCT parse_id, span_no, out_start, out_end, page_number FROM provenance_spans)
SELECT parse_id, span_no, page_number, md5(decode(unhex(substr(hex(encode(markdown)), CAST(2 * out_start + 1 AS BIGINT), CAST(2 * (out_end - out_start) AS BIGINT))))) AS text_md5
FROM parse_results JOIN s USING (parse_id) WHERE doc_format = 'pdf' AND 0 <= out_start AND out_start < out_end AND out_end <= strlen(markdown)""",
    "page_spans": """
WITH s AS (SELECT parse_id, span_no, max(out_end - out_start) AS size FROM provenance_spans JOIN parse_results USING (parse_id) WHERE doc_format = 'pdf' AND 0 <= out_start AND out_start < out_end AND out_end <= strlen(markdown) GROUP BY 1, 2
), b AS (SELECT *, coalesce(sum(size + 2) OVER (PARTITION BY parse_id ORDER BY span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM s)
SELECT parse_id, span_no, pos AS out_start, (pos + size)::BIGINT AS out_end FROM b""",
    "page_of_offset": """
WITH s AS (SELECT DISTINCT parse_id, out_start, out_end, page_number FROM provenance_spans WHERE out_start IS NOT NULL AND out_end IS NOT NULL
), r AS (SELECT parse_id, strlen(markdown) // 2 AS pos FROM parse_results WHERE doc_format = 'pdf' AND markdown IS NOT NULL)
SELECT r.parse_id, (list({'p': page_number} ORDER BY out_start, out_end, page_number NULLS FIRST) FILTER (out_start <= pos AND pos < out_end))[1].p AS page FROM r JOIN s USING (parse_id) GROUP BY r.parse_id""",
    "warnings_by_code": "WITH w AS (SELECT DISTINCT * FROM parse_warnings) SELECT code, coalesce(loc_kind, '') AS loc_kind, count(*) AS n, count(DISTINCT parse_id) AS results FROM w GROUP BY ALL",
    "entry_heads": """
WITH h AS (SELECT entry_id, unnest(map_entries(headers)) AS h FROM table_entries), g AS (SELECT entry_id, string_agg(h.key, '|' ORDER BY h.value.column_index, h.key) AS head FROM h GROUP BY 1)
SELECT entry_id, coalesce(head, '') AS head, cardinality(headers)::INTEGER AS n, truncated, row_range.first_row AS first_row, row_range.last_row AS last_row FROM table_entries LEFT JOIN g USING (entry_id)""",
    "media_links": """
WITH l AS (SELECT parse_id, unnest(['grove://docx/part/word/media/a' || parse_id || '.png', 'grove://docx/part/ppt/media/a' || parse_id || '.png', 'grove://pptx/part/ppt/media/../a' || parse_id, 'grove://xlsx/part/xl/media/x/y-' || parse_id, 'grove://pdf/page/' || parse_id, 'grove://pdf/obj/0' || parse_id || '/0', 'grove://pdf/obj/7/' || (parse_id * 10), 'grove://pdf/obj/' || (parse_id * 1000000) || '/0']) AS uri,
  unnest([true, false, false, true, parse_id > 0, false, parse_id * 10 < 65536, parse_id * 1000000 < 4294967296]) AS valid FROM parse_results)
SELECT parse_id, uri, valid FROM l""",
    "markdown_cap": f"""
WITH h AS (SELECT doc_id, text, coalesce({", ".join(f"try(decode(unhex(substr(hex(encode(text)), 1, {2 * (CAP - len(md.cut_notice(CAP).encode()) - j)}))))" for j in range(4))}) AS head FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN strlen(text) <= {CAP} THEN text ELSE regexp_replace(CASE WHEN contains(head, chr(10)) THEN regexp_extract(head, '^.*\\n', 0, 's') ELSE head END, '{_WHITE}+$', '') || '{md.cut_notice(CAP)}' END) AS text_md5, true AS fits FROM h""",
    "budget_fold": """
WITH RECURSIVE x AS (SELECT coalesce(suite, 'none') AS suite, item_id, strlen(text)::BIGINT AS size, row_number() OVER (PARTITION BY coalesce(suite, 'none') ORDER BY item_id) AS r FROM eval_items
), f AS (
  SELECT suite, item_id, size, r, size <= 3000 AS accepted, CASE WHEN size <= 3000 THEN size ELSE 0 END AS used FROM x WHERE r = 1
  UNION ALL
  SELECT x.suite, x.item_id, x.size, x.r, f.used + x.size <= 3000, CASE WHEN f.used + x.size <= 3000 THEN f.used + x.size ELSE f.used END FROM f JOIN x ON x.suite = f.suite AND x.r = f.r + 1)
SELECT suite, item_id, size, accepted FROM f""",
    "locate_quotes": _HITS + "SELECT * FROM h",
    "locate_orders": """
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders),
n AS (SELECT 2 * k AS quote_id, p AS quote FROM o WHERE k % 100 = 0),
a AS (SELECT 2 * k + 1 AS quote_id, CAST(CAST(round(CAST(p AS DECIMAL(18,2)) / 10000, 1) AS DECIMAL(18,1)) AS VARCHAR) AS quote FROM o WHERE k % 100 = 0),
both_ AS (SELECT *, NULL AS target FROM n UNION ALL SELECT quote_id, quote, CASE WHEN length(ltrim(replace(quote, '.', ''), '0')) >= 3 AND CAST(quote AS DOUBLE) * 10000 >= 1000 THEN CAST(quote AS DOUBLE) * 10000 END FROM a),
-- third tier: the number as part of a row's text without blanks; fourth: a key or total near the amount
h AS (
  SELECT doc_id, quote_id, 'number' AS tier, min(k) AS k FROM o JOIN both_ ON contains('|Order' || k || '|' || p || '|', quote) GROUP BY ALL
  UNION ALL
  SELECT doc_id, quote_id, 'amount' AS tier, min(k) AS k FROM o JOIN both_ ON (length(CAST(k AS VARCHAR)) >= 3 AND k BETWEEN target - 0.002 * target AND target + 0.002 * target) OR (length(ltrim(replace(p, '.', ''), '0')) >= 3 AND CAST(p AS DOUBLE) BETWEEN target - 0.002 * target AND target + 0.002 * target) GROUP BY ALL
), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, quote_id ORDER BY tier DESC) AS r FROM h)
SELECT b.doc_id, quote_id, tier, '| Order ' || b.k || ' | ' || p || ' |' AS hit, 1 AS page FROM b JOIN o ON o.doc_id = b.doc_id AND o.k = b.k WHERE r = 1""",
    "locate_tiers": """
SELECT * FROM (VALUES (1, 'exact', 1, 'Revenue grew strongly'), (2, 'whitespace', 1, 'Revenue grew strongly'), (3, 'number', 2, '| Revenue | 1,234.50 | 1,335.00 |'), (4, NULL, NULL, NULL), (5, NULL, NULL, NULL), (6, 'number', 2, '| Margin | 12.5% | 13.1% |'),
  (7, NULL, NULL, NULL), (8, NULL, NULL, NULL), (9, 'amount', 3, '13.35'), (10, NULL, NULL, NULL)) AS t(id, tier, page, hit)""",
    "trace_evidence": """
SELECT * FROM (VALUES (1, 1, 5, 'e1', 'quote', 'supported', 1, 'Revenue grew strongly', NULL, NULL), (1, 1, 5, 'e2', 'none', 'unsupported', NULL, NULL, 'the quote given is not in the source; it may be invented', 'they rose'),
  (1, 1, 5, 'e3', 'quote', 'partial', 2, '| Margin | 12.5% | 13.1% |', NULL, NULL), (2, 0, 2, 'e1', 'none', 'unsupported', NULL, NULL, 'nothing in the source supports this', NULL),
  (2, 0, 2, 'e2', 'none', 'unsupported', NULL, NULL, 'says nothing', NULL)) AS t(answer_id, supported, parts, id, kind, verdict, page, hit, reason, truth)""",
    "chunk_tables": """
WITH f AS (SELECT (c_custkey // 500)::BIGINT AS file_no, count(*) AS n FROM customer GROUP BY 1)
SELECT file_no, 'table_schema' AS kind, 1::BIGINT AS n, 0::INTEGER AS last_index, NULL::BIGINT AS first_row, NULL::BIGINT AS last_row FROM f
UNION ALL SELECT file_no, 'table_row', n, (n - 1)::INTEGER, 2, n + 1 FROM f""",
    "verdict_gate": _GATE + "SELECT item_id, verdict, final_verdict, evidence_kind, reason FROM gate",
    "answer_trace": _GATE + "SELECT suite, 'e' || row_number() OVER (PARTITION BY suite ORDER BY item_id) AS id, claim, final_verdict AS verdict FROM gate",
}
