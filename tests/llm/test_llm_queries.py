"""Every query of the subpackage on the smallest data, and every operator on dirty tables."""

import importlib.util
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkgrove.llm import boilerplate, langid, leakage, lookalike, pieces, queries, scanfix, tokenise

ROOT, SF = Path(__file__).parents[2], Path("/root/testdata/sf0.001")
spec = importlib.util.spec_from_file_location("compare", ROOT / "tools/compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)

#: Columns of the queries whose results are fixed.
FIXED = {
    "p2_found": [("parse_id", "bigint"), ("block_no", "int")],
    "p3_found": [("parse_id", "bigint"), ("line_no", "int"), ("kind", "string"), ("fixed", "string")],
    "p4_found": [("parse_id", "bigint"), ("span_no", "int"), ("cut", "string")],
    "p5_found": [("scope", "string"), ("left_id", "bigint"), ("right_id", "bigint")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("seg_no", "int"), ("lang", "string")],
}


@pytest.mark.skipif(not SF.exists(), reason="no data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(SF))
    if name in FIXED:
        assert df.dtypes == FIXED[name]
    cols = sorted(df.columns)
    got = Counter(tuple(compare.plain(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in FIXED:
        assert max(got.values()) == 1  # ids are unique in the tables, so no row comes twice
    if name in queries.SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for p in sorted(SF.iterdir()):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        rows = con.execute(queries.SQL[name])
        names = [x[0] for x in rows.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(compare.plain(r[names.index(c)]) for c in cols) for r in rows.fetchall())


CLASHING = ["host", "keys", "key", "n", "k", "page", "pages", "block", "block_no", "main", "body", "known", "word", "form", "own", "id", "part", "parts", "item", "spans", "span_no", "hard", "cores", "seg_no", "confidence", "no", "first", "last", "nth", "ids", "__join_salt"]


@pytest.fixture(scope="module")
def dirty(spark):
    """Tables with nulls everywhere, blank and very long texts, repeated rows and columns of clashing names."""
    long = "word, " * 20_000 + "x" * 100_000
    texts = [None, "", "  \n\t ", long, "# T\n\nOne text, again. And again.\n\n- a\n- b", "## Page 1\n\nA line that is bro-\nken here.\n12", "\x00�​", "日本語のテキスト。" * 50, "T​ext", "Text"]
    rows = []
    for i, t in enumerate(texts):
        for fmt in ("html", "url", "pdf", "docx", "text", None):
            rows.append((10 * len(rows) if i else None, None if i % 2 else "https://a.example/x", fmt, t))
    rows += rows[-6:]
    results = spark.createDataFrame(rows, "parse_id bigint, source string, doc_format string, markdown string")
    docs = spark.createDataFrame([(None if i == 3 else i, t, k) for i, t in enumerate(texts) for k in (None, "", "en", "python")], "doc_id bigint, text string, lang string")
    spans = spark.createDataFrame([(60, 0, 0, 10), (60, 0, 0, 10), (60, None, 5, 2), (None, 1, 0, 1), (70, 1, None, None), (70, 2, -5, 10**9)], "parse_id bigint, span_no int, out_start bigint, out_end bigint")
    limits = spark.createDataFrame([("html", 100, 10), ("html", 100, 10), ("pdf", 50, None), ("docx", None, 5), (None, 5, 5), ("text", 0, 0)], "doc_format string, max_bytes int, overlap_bytes int")
    entries = spark.createDataFrame([(1, {"Text": (0,), "T​ext": (1,)}), (None, {"x": (None,)}), (2, None), (3, {})], "entry_id bigint, headers map<string,struct<column_index:int>>")
    columns = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, None)], "column_id bigint, entry_id bigint, column_index int")
    labels = spark.createDataFrame([(1, "Text"), (2, None), (None, "Text"), (3, "")], "label_id int, label string")
    items = spark.createDataFrame([(1, long), (1, long), (None, "a b c"), (2, None), (3, "")], "item_id bigint, text string")
    codes = spark.createDataFrame([("en", "prose"), ("python", "code"), ("python", "code"), (None, None)], "lang string, kind string")
    every = {"results": results, "docs": docs, "spans": spans, "limits": limits, "entries": entries, "columns": columns, "labels": labels, "items": items, "codes": codes}
    return {k: v.select("*", *[F.lit("clash").alias(c) for c in CLASHING if c not in v.columns]) for k, v in every.items()}


OPERATORS = {
    "judged_blocks": lambda t: boilerplate.judged_blocks(t["results"]),
    "main_bodies": lambda t: boilerplate.main_bodies(t["results"]),
    "scan_noise": lambda t: scanfix.scan_noise(t["results"]),
    "repaired_texts": lambda t: scanfix.repaired_texts(t["results"]),
    "cut_kinds": lambda t: pieces.cut_kinds(t["results"], t["spans"], t["limits"]),
    "split_oversized": lambda t: pieces.split_oversized(t["results"], t["spans"], t["limits"]),
    "same_looking_pairs": lambda t: lookalike.same_looking_pairs(t["results"], "parse_id", "markdown"),
    "same_looking_headers": lambda t: lookalike.same_looking_headers(t["entries"], t["columns"], t["labels"]),
    "encode_corpus": lambda t: tokenise.encode_corpus(t["docs"], queries.vocabulary_file("byte_bpe_50k.tiktoken"), queries.splitting_pattern()),
    "leaked_items": lambda t: leakage.leaked_items(t["docs"], t["items"]),
    "leaked_passages": lambda t: leakage.leaked_passages(t["docs"], t["items"]),
    "language_segments": lambda t: langid.language_segments(t["docs"], t["codes"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_dirty_tables(dirty, name):
    got = OPERATORS[name](dirty).collect()
    if name == "encode_corpus":
        assert len(got) == dirty["docs"].count() and all(r.ids is not None for r in got)
    if name == "leaked_items":
        assert {(r.doc_id, r.item_id) for r in got} == {(None, 1)}
    if name == "same_looking_headers":
        assert {(r.label_id, r.column_id) for r in got} == {(1, 2), (1, None), (None, 2), (None, None)}
    assert OPERATORS[name]({k: v.limit(0) for k, v in dirty.items()}).count() == 0
