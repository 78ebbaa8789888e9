"""Loading raw delimited records by their tables' declarations, bad ones apart with a reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.structural import KIND_CODES, check_records
from inkgrove.operators.joins import salted_left_join
from inkgrove.session import ship

LOADED = "raw_id bigint, entry_id bigint, line_no int, reason string, fields array<string>"


def record_specs(entries: DataFrame, columns: DataFrame) -> DataFrame:
    """One small row a table: delimiter, wanted count and a code letter for each column."""
    code = F.coalesce(*[F.when(F.col("kind") == k, F.lit(c)) for k, c in KIND_CODES.items()], F.lit("x"))
    code = F.when(F.coalesce(F.col("required"), F.lit(False)), F.upper(code)).otherwise(code)
    spec = (
        columns.where(F.col("column_index") >= 0)
        .groupBy("entry_id")
        .agg(F.array_sort(F.collect_set(F.struct("column_index", code.alias("code")))).alias("codes"))
        .select("entry_id", F.array_join(F.col("codes.code"), "").alias("spec"))
    )
    return entries.select("entry_id", "delimiter", "column_count").dropDuplicates(["entry_id"]).join(spec, "entry_id", "left")


def load_records(records: DataFrame, entries: DataFrame, columns: DataFrame) -> DataFrame:
    """Every record once, either with its fields or with the reason why it doesn't load.

    Result: raw_id, entry_id, line_no, reason, fields. A valid record has a null reason and its
    unquoted fields in order; a rejected one has null fields and the first reason that applies of
    empty, quoting, column_count and invalid_value. Null and blank records are 'empty'; repeated
    records are checked each for itself; a record of an unknown table is read with commas and no
    declared columns; an empty input gives no rows; other columns of the inputs are ignored. Very
    long records only lengthen the byte buffers of their batch.
    """
    ship(records.sparkSession)
    wanted = records.select("raw_id", "entry_id", "line_no", "raw")
    joined = salted_left_join(wanted, record_specs(entries, columns), "entry_id", "raw_id")
    joined = joined.select("raw_id", "entry_id", "line_no", "raw", "delimiter", "column_count", "spec")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                reason, fields = check_records(b["raw"], b["delimiter"], b["column_count"], b["spec"])
                yield pa.RecordBatch.from_arrays([b["raw_id"], b["entry_id"], b["line_no"], reason, fields], ["raw_id", "entry_id", "line_no", "reason", "fields"])

    return joined.mapInArrow(load, LOADED)


def rejected(loaded: DataFrame) -> DataFrame:
    """raw_id and reason of the records that don't load."""
    return loaded.where("reason is not null").select("raw_id", "reason")


def column_names(entries: DataFrame) -> DataFrame:
    """entry_id, names: header by column number, null where none is given, in one small array a table.

    Where several headers claim a column the first in order of text names it.
    """
    names = (
        entries.select("entry_id", "column_count", F.explode(F.map_entries("headers")).alias("h"))
        .where("h.value.column_index >= 0 and h.value.column_index < column_count")
        .groupBy("entry_id", F.col("h.value.column_index").alias("column_index"))
        .agg(F.min("h.key").alias("header"))
        .groupBy("entry_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("column_index", "header"))).alias("names"))
    )
    last = F.array_max(F.map_keys("names"))
    return names.select("entry_id", F.transform(F.sequence(F.lit(0), last), lambda i: F.try_element_at("names", i)).alias("names"))


def load_cells(records: DataFrame, entries: DataFrame, columns: DataFrame) -> DataFrame:
    """The valid records' cells by header: raw_id, entry_id, line_no, column_index, header, value.

    A cell without a header is called column_{i+1}. Names come with the specification in the one
    join that loading needs, so every record is shuffled and parsed once.
    """
    ship(records.sparkSession)
    specs = record_specs(entries, columns).join(column_names(entries), "entry_id", "left")
    joined = salted_left_join(records.select("raw_id", "entry_id", "line_no", "raw"), specs, "entry_id", "raw_id")
    joined = joined.select("raw_id", "entry_id", "line_no", "raw", "delimiter", "column_count", "spec", "names")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fields = check_records(b["raw"], b["delimiter"], b["column_count"], b["spec"])[1]
                row, index, value = cells_of(fields)
                own = [b[k].take(row) for k in ("raw_id", "entry_id", "line_no")]
                yield pa.RecordBatch.from_arrays([*own, index, named(b["names"], row, index), value], ["raw_id", "entry_id", "line_no", "column_index", "header", "value"])

    return joined.mapInArrow(load, "raw_id bigint, entry_id bigint, line_no int, column_index int, header string, value string")


def cells_of(fields: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Row, place in it and value of every field."""
    row = pc.list_parent_indices(fields)
    sizes = pc.fill_null(pc.list_value_length(fields), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    index = np.arange(len(row)) - first[row.to_numpy()]
    return row, pa.array(index.astype(np.int32)), pc.list_flatten(fields)


def named(names: pa.ListArray, row: pa.Array, index: pa.Array) -> pa.Array:
    """The name of each field's column."""
    place = index.to_numpy()
    default = pa.array([f"column_{i + 1}" for i in range(int(place.max(initial=-1)) + 1)], pa.string()).take(index)
    sizes = pc.fill_null(pc.list_value_length(names), 0).to_numpy(zero_copy_only=False)
    flat, first = pc.list_flatten(names), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    at = row.to_numpy()
    known = place < sizes[at]
    own = flat.take(pa.array(np.where(known, first[at] + place, 0), mask=~known)) if len(flat) else pa.nulls(len(place), pa.string())
    return pc.coalesce(own.cast(pa.string()), default)


#: Column types of the declared kinds.
TYPES = {"integer": "decimal(38,0)", "decimal": "decimal(38,10)", "date": "date", "boolean": "boolean"}


def entry_frame(loaded: DataFrame, entries: DataFrame, columns: DataFrame, entry_id: int) -> DataFrame:
    """The valid records of one table as typed columns under its headers, with raw_id and line_no.

    A blank cell is null unless its column is text. Numbers that don't fit their decimal type are
    null. Headers that are missing or repeat get their column's number; the names raw_id and
    line_no belong to the result's first two columns, so such a header gets its number too.
    """
    shape = columns.where(F.col("entry_id") == entry_id).select("column_index", "kind").dropDuplicates(["column_index"]).orderBy("column_index").collect()
    row = entries.where(F.col("entry_id") == entry_id).select("headers").first()
    heads = {v["column_index"]: k for k, v in sorted((row["headers"] or {}).items(), reverse=True)} if row else {}
    taken, out = {"raw_id", "line_no"}, ["raw_id", "line_no"]
    for r in shape:
        i = r["column_index"]
        name = heads.get(i) or f"column_{i + 1}"
        if name.lower() in taken:
            name = f"{name}_{i + 1}"
        taken.add(name.lower())
        cell = F.get("fields", F.lit(i))
        if r["kind"] in TYPES:
            cell = F.expr(f"try_cast(nullif(trim(get(fields, {int(i)})), '') as {TYPES[r['kind']]})")
        out.append(cell.alias(name))
    return loaded.where((F.col("entry_id") == entry_id) & F.col("reason").isNull()).select(*out)
