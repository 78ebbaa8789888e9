"""Structural loading against a plain reader, and its rows on a small frame."""

import datetime
import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgrove.functions import structural as s
from inkgrove.operators.joins import salted_left_join
from inkgrove.operators.records import load_cells, load_records, rejected


def plain(raw, d, count, spec):
    """Reason and fields by the rules, one record at a time."""
    if raw is None:
        return "empty", None
    raw = raw.removesuffix("\r")
    if not raw.strip(" "):
        return "empty", None
    fields = s.split_fields(raw, d)
    if fields is None:
        return "quoting", None
    if len(fields) != count:
        return "column_count", None
    for v, k in zip(fields, spec):
        v = v.strip(" ")
        if not v:
            if k.isupper():
                return "invalid_value", None
            continue
        ok = {"i": lambda x: re.fullmatch(r"[+-]?[0-9]+", x), "d": lambda x: re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", x), "b": lambda x: x in ("TRUE", "FALSE"), "x": lambda x: True, "t": day}[k.lower()](v)
        if not ok:
            return "invalid_value", None
    return None, fields


def day(x):
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", x):
        return False
    try:
        datetime.date.fromisoformat(x)
        return True
    except ValueError:
        return False


CELLS = ["1", "-22", "3.5", "1.2.3", "", " ", '""', '"a,b"', '"x""y"', '3" pipe', '"open', 'a"b', '"x" y', "TRUE", "true", "2024-02-29", "2023-02-29", "é数", '"new\nline"', " 7 ", "0001-01-01"]


def check(raws, delimiters, counts, specs):
    reason, fields = s.check_records(pa.array(raws, pa.string()), pa.array(delimiters, pa.string()), pa.array(counts, pa.int32()), pa.array(specs, pa.string()))
    want = [plain(r, d or ",", c, p) for r, d, c, p in zip(raws, delimiters, counts, specs)]
    assert reason.to_pylist() == [w[0] for w in want]
    assert fields.to_pylist() == [w[1] for w in want]


def test_random_records():
    random.seed(1)
    raws, ds, counts, specs = [], [], [], []
    for _ in range(6000):
        d, n = random.choice([",", ";", "\t", "|", None]), random.randint(1, 4)
        raws.append((d or ",").join(random.choice(CELLS) for _ in range(n)) + random.choice(["", "", "\r"]))
        ds.append(d)
        counts.append(random.choice([n, n, n, n + 1]))
        specs.append("".join(random.choice("idtbxX") for _ in range(counts[-1])))
    check(raws + [None, "", "  \r", "\r"], ds + [","] * 4, counts + [1] * 4, specs + ["x"] * 4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='",;a\n\r 1é', max_size=12), min_size=1, max_size=6))
def test_any_records(raws):
    check(raws, [","] * len(raws), [2] * len(raws), ["xi"] * len(raws))


def test_delimiters_of_any_kind():
    check(["a||b", "a；b", "a,b", '"x||y"||b', 'a"b||c'], ["||", "；", "", "||", "||"], [2] * 5, ["xx"] * 5)


def test_empty_batch_and_all_empty():
    check([], [], [], [])
    check([None, ""], [None, ","], [1, 1], ["x", "x"])


def test_frame(spark):
    records = spark.createDataFrame([(1, 7, 2, "a,1", "k"), (2, 7, 3, "a,x", "k"), (3, 7, 4, None, "k"), (4, 8, 2, "b;2", "k"), (5, 9, 2, "lost,1", "k"), (6, 7, 2, "a,1", "k")], "raw_id long, entry_id long, line_no int, raw string, reason string")
    entries = spark.createDataFrame([(7, None, 2, {"N": (1,), "A": (0,)}), (8, ";", 2, {"A": (0,)})], "entry_id long, delimiter string, column_count int, headers map<string,struct<column_index:int>>")
    columns = spark.createDataFrame([(7, 0, "text", True), (7, 1, "integer", False), (8, 0, "text", None), (8, 1, None, True)], "entry_id long, column_index int, kind string, required boolean")
    loaded = load_records(records, entries, columns)
    assert sorted((r.raw_id, r.reason) for r in rejected(loaded).collect()) == [(2, "invalid_value"), (3, "empty")]
    cells = {(r.raw_id, r.header): r.value for r in load_cells(records, entries, columns).collect()}
    assert load_cells(records.limit(0), entries, columns).count() == 0 and len(cells) == 8
    assert cells[1, "A"] == "a" and cells[1, "N"] == "1" and cells[4, "column_2"] == "2" and cells[5, "column_1"] == "lost"
    assert load_records(records.limit(0), entries, columns).count() == 0
    assert load_records(records, entries.limit(0), columns.limit(0)).count() == 6


def test_salted_join_keeps_rows_of_a_hot_key(spark):
    left = spark.range(5000).selectExpr("id", "case when id < 3000 then 1 when id = 4999 then null else id end as k")
    right = spark.createDataFrame([(1, "hot"), (4000, "cold")], "k long, v string")
    got = salted_left_join(left, right, "k", "id", most_share=1 / 16)
    assert got.count() == 5000
    assert {r.v: r["count"] for r in got.groupBy("v").count().collect()} == {"hot": 3000, "cold": 1, None: 1999}


def test_one_table_as_typed_columns(spark):
    from decimal import Decimal

    from inkgrove.operators.records import entry_frame

    records = spark.createDataFrame([(1, 7, 2, "7,x,2024-02-29,TRUE,1.5"), (2, 7, 3, " +8 , ,,FALSE,"), (3, 7, 4, "bad,x,,TRUE,1"), (4, 8, 2, "other")], "raw_id long, entry_id long, line_no int, raw string")
    entries = spark.createDataFrame([(7, None, 5, {"raw_id": (0,), "T": (1,), "Day": (2,), "Ok": (3,)})], "entry_id long, delimiter string, column_count int, headers map<string,struct<column_index:int>>")
    columns = spark.createDataFrame([(7, i, k, False) for i, k in enumerate(("integer", "text", "date", "boolean", "decimal"))], "entry_id long, column_index int, kind string, required boolean")
    rows = entry_frame(load_records(records, entries, columns), entries, columns, 7).orderBy("line_no")
    assert rows.columns == ["raw_id", "line_no", "raw_id_1", "T", "Day", "Ok", "column_5"]
    assert [tuple(r) for r in rows.collect()] == [(1, 2, Decimal(7), "x", datetime.date(2024, 2, 29), True, Decimal("1.5")), (2, 3, Decimal(8), " ", None, False, None)]
