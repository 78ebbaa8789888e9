"""Structural index of delimited records: quote masks and prefix parity over whole byte buffers.

One pass of numpy over the bytes of a batch finds, for every record at once, which delimiters
separate fields. A quote opens at even and closes at odd parity; where every opening quote
stands at a field start (or directly after a closing one: a doubled quote) and every closing quote
before a delimiter, the end or another quote, parity is exact. The few records where it isn't are
read by a small state machine with the same result type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUOTE, SPACE, CR = 34, 32, 13
EMPTY, QUOTING, COUNT, VALUE = "empty", "quoting", "column_count", "invalid_value"
REASONS = (None, EMPTY, QUOTING, COUNT, VALUE)
#: Codes of the declared kinds in a column specification; a capital letter marks a required column.
KIND_CODES = {"integer": "i", "decimal": "d", "date": "t", "boolean": "b", "text": "x"}

_INTEGER = r"\A[+-]?[0-9]+\z"
_DECIMAL = r"\A[+-]?[0-9]+(\.[0-9]+)?\z"
_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def string_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; a null is an empty string."""
    values = pc.fill_null(values.cast(pa.large_string()), "")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def strings_from(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """String array of consecutive slices of data."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def split_fields(raw: str, delimiter: str) -> list[str] | None:
    """Fields of one record, or None if a quoted field is not closed properly."""
    fields, at, n = [], 0, len(raw)
    while True:
        if at < n and raw[at] == '"':
            value, at = [], at + 1
            while True:
                close = raw.find('"', at)
                if close < 0:
                    return None
                value.append(raw[at:close])
                at = close + 1
                if at < n and raw[at] == '"':
                    value.append('"')
                    at += 1
                elif at == n or raw.startswith(delimiter, at):
                    break
                else:
                    return None
            fields.append("".join(value))
        else:
            end = raw.find(delimiter, at)
            end = n if end < 0 else end
            fields.append(raw[at:end])
            at = end
        if at >= n:
            return fields
        at += len(delimiter)


def real_days(values: pa.Array) -> np.ndarray:
    """True where a text is an existing day as YYYY-MM-DD."""
    good = pc.match_substring_regex(values, _DATE).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(good)
    if not len(at):
        return good
    shaped = values.take(pa.array(at))
    part = lambda a, b: pc.utf8_slice_codeunits(shaped, a, b).cast(pa.int32()).to_numpy()
    year, month, day = part(0, 4), part(5, 7), part(8, 10)
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where(month > 12, 0, month)]
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = np.where((month == 2) & leap, 29, days)
    good = good.copy()
    good[at] = (year > 0) & (month > 0) & (day > 0) & (day <= days)
    return good


def fitting(values: pa.Array, specs: np.ndarray) -> np.ndarray:
    """True where a field fits its column: specs holds one code byte a field."""
    trimmed = pc.utf8_trim(values, " ")
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    kinds = specs | 32
    good = np.ones(len(specs), bool)
    good[blank] = kinds[blank] == specs[blank]
    for code, test in (
        ("i", lambda x: pc.match_substring_regex(x, _INTEGER).to_numpy(zero_copy_only=False)),
        ("d", lambda x: pc.match_substring_regex(x, _DECIMAL).to_numpy(zero_copy_only=False)),
        ("t", real_days),
        ("b", lambda x: pc.is_in(x, pa.array(["TRUE", "FALSE"], x.type)).to_numpy(zero_copy_only=False)),
    ):
        at = np.flatnonzero((kinds == ord(code)) & ~blank)
        if len(at):
            good[at] = test(trimmed.take(pa.array(at)))
    return good


def check_records(raws: pa.Array, delimiters: pa.Array, counts: pa.Array, specs: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Reason (null: valid) and fields (null: rejected) of each record.

    delimiters: null or empty means a comma. counts: wanted number of fields, null means any. specs: one
    KIND_CODES letter a column; columns beyond it are plain optional text.
    """
    n = len(raws)
    null = pc.is_null(raws).to_numpy(zero_copy_only=False)
    data, offsets = string_bytes(raws)
    starts, ends = offsets[:-1], offsets[1:].copy()
    if len(data):
        ends -= (ends > starts) & (data[np.maximum(ends - 1, 0)] == CR)
    marks = [x or "," for x in delimiters.to_pylist()]
    single = np.array([len(x) == 1 and ord(x) < 128 and x != '"' for x in marks], bool)
    byte = np.array([ord(x[0]) if ok else 0 for x, ok in zip(marks, single)], np.uint8)
    wanted = pc.fill_null(counts, -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def running(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    record = np.repeat(np.arange(n), np.diff(offsets))
    inside = np.arange(len(data)) < ends[record]  # without the trailing carriage return
    quote = (data == QUOTE) & inside
    delimiter = (data == byte[record]) & inside & single[record]
    filled = running((data != SPACE) & inside)
    empty = null | (filled[ends] == filled[starts])

    seen = running(quote)
    parity = (seen[1:] - seen[starts][record]) & 1
    opening, closing = quote & (parity == 1), quote & (parity == 0)
    at_start = np.arange(len(data)) == starts[record]
    before = lambda mask: np.concatenate(([False], mask[:-1])) & ~at_start
    at_end = np.arange(len(data)) == ends[record] - 1
    after = lambda mask: np.concatenate((mask[1:], [False])) & ~at_end
    doubled = opening & before(closing)
    odd_open = opening & ~at_start & ~before(delimiter) & ~doubled
    odd_close = closing & ~at_end & ~after(delimiter) & ~after(opening)
    odd = running(odd_open | odd_close)
    irregular = ~empty & ((odd[ends] > odd[starts]) | ~single)
    regular = ~empty & ~irregular
    unclosed = regular & (((seen[ends] - seen[starts]) & 1) == 1)
    separator = delimiter & (parity == 0)
    cuts = running(separator)
    fields = np.where(regular, cuts[ends] - cuts[starts] + 1, 0)

    code = np.zeros(n, np.int8)
    code[empty] = 1
    code[unclosed] = 2
    slow: dict[int, list[str]] = {}
    for i in np.flatnonzero(irregular):
        found = split_fields(bytes(data[starts[i] : ends[i]]).decode("utf-8"), marks[i])
        if found is None:
            code[i] = 2
        else:
            slow[int(i)] = found
            fields[i] = len(found)
    code[(code == 0) & (wanted >= 0) & (fields != wanted)] = 3
    good = code == 0

    # flat fields of the good records: the vector ones as compressed bytes, the odd ones beside them
    fast = good & regular
    kept = fast[record] & inside & ~separator & (~quote | doubled)
    kept_at = running(kept)
    sep_at = np.flatnonzero(separator & fast[record])
    begin = np.sort(np.concatenate((starts[fast], sep_at + 1)))
    end = np.sort(np.concatenate((ends[fast], sep_at)))
    values = strings_from(data[kept], kept_at[end] - kept_at[begin])
    codes = _specs(specs, fields, fast)
    sizes = fields[fast]
    fits = fitting(values, codes)
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    bad = running(~fits)
    code[np.flatnonzero(fast)[bad[firsts[1:]] > bad[firsts[:-1]]]] = 4
    for i, found in list(slow.items()):
        if code[i] == 0 and not fitting(pa.array(found, pa.large_string()), _specs(specs, fields, np.arange(n) == i)).all():
            code[i] = 4

    reason = pa.array(np.array(REASONS, object)[code], pa.string())
    valid = code == 0
    if not slow:
        keep = np.repeat(valid[fast], sizes)
        flat = values.filter(pa.array(keep)).cast(pa.string())
        lengths = np.where(valid, fields, 0)
        return reason, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), flat, mask=pa.array(~valid))
    texts, place = values.to_pylist(), dict(zip(np.flatnonzero(fast).tolist(), firsts[:-1].tolist()))
    rows = [None if not valid[i] else slow[i] if i in slow else texts[place[i] : place[i] + int(fields[i])] for i in range(n)]
    return reason, pa.array(rows, pa.list_(pa.string()))


def _specs(specs: pa.Array, fields: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """One code byte for each field of the chosen records; 'x' where the specification ends early."""
    at = np.flatnonzero(chosen)
    data, offsets = string_bytes(specs.take(pa.array(at)))
    have, need = np.diff(offsets), fields[at]
    if np.array_equal(have, need):
        return data
    out = np.full(int(need.sum()), ord("x"), np.uint8)
    starts = np.concatenate(([0], np.cumsum(need)))[:-1]
    for i in range(len(at)):
        k = min(int(have[i]), int(need[i]))
        out[starts[i] : starts[i] + k] = data[offsets[i] : offsets[i] + k]
    return out
