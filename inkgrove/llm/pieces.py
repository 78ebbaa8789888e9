"""Cutting oversized items into pieces at natural boundaries, all inside the JVM.

The item's UTF-8 bytes are read as Latin-1, so one character is one byte and a bounded quantifier
counts bytes. One pattern a size limit lists the boundaries by strength, each with a quantifier
that consumes as much as the limit allows; the last alternative cuts between characters. The
overlap is a lookback into the item in front of each cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.session import checked_broadcast

#: Limits are one row a format.
MAX_LIMIT_ROWS = 1000
#: Bytes of the longest character; a smaller limit couldn't be kept between characters and counts as none.
LEAST_LIMIT = 4
#: Full stop, exclamation and question mark of CJK text, as the bytes of their UTF-8 form in Latin-1.
CJK_STOPS = ("ã\u0080\u0082", "ï¼\u0081", "ï¼\u009f")
_STOP = "(?:" + "|".join(CJK_STOPS) + ")"
_BLANK = r"[ \t\n\r]"
#: A piece may end here whatever follows, or where a blank or the end follows.
_NATURAL = rf"(?:(?<={_BLANK})|(?<={_STOP})|(?={_BLANK})|\z)"


def as_bytes(text: Column) -> Column:
    """The text's UTF-8 bytes as a string of as many characters."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def as_text(data: Column) -> Column:
    """The text of bytes; a part of a character (a span may cut one) is U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def cut_pattern(most: Column, overlap: Column) -> Column:
    """Pattern whose matches are an item's consecutive cores: what a piece adds to the one before.

    Boundaries by strength: blank line, line break, end of a sentence, any natural boundary; the
    strong ones only if they leave half of a piece. A core is at most the limit less the overlap,
    but a stretch that needs more room takes it from the overlap before it is cut hard.
    """
    core = F.greatest(most - overlap, F.lit(1)).cast("string")
    half = F.greatest(F.floor((most - overlap) / 2), F.lit(1)).cast("string")
    whole = F.greatest(most, F.lit(1)).cast("string")
    piece = lambda low, high, end: F.concat(F.lit(".{"), low, F.lit(","), high, F.lit("}" + end))
    one = F.lit("1")
    return F.concat_ws(
        "|",
        F.concat(F.lit("(?s)"), piece(half, core, r"(?:(?<=\n\n)|\z)")),
        piece(half, core, r"(?<=\n)"),
        piece(half, core, rf"(?:(?<=[.!?] )|(?<={_STOP}))"),
        piece(one, core, _NATURAL),
        piece(one, whole, _NATURAL),
        piece(one, whole, r"(?![\u0080-¿])"),
        piece(one, one, ""),
    )


def items_of(results: DataFrame, spans: DataFrame, limits: DataFrame) -> DataFrame:
    """parse_id, span_no, item, max_bytes, overlap_bytes: the oversized items only.

    An item is the byte range of a distinct, valid span, or the whole text of a result without any
    row in spans (span_no -1). Only results larger than their limit leave the scan, as no part of
    a smaller one can be larger, and only they are shuffled. A result meets its spans as one array
    and is encoded once, whatever their number. An overlap over half of the limit counts as half.
    """
    text = results.select("parse_id", "doc_format", "markdown").where("markdown is not null")
    limits = checked_broadcast(limits.select("doc_format", "max_bytes", "overlap_bytes").where(F.col("max_bytes") >= LEAST_LIMIT).dropDuplicates(["doc_format"]), MAX_LIMIT_ROWS)
    large = text.join(limits, "doc_format").where(F.octet_length("markdown") > F.col("max_bytes"))
    span = F.struct(F.coalesce("span_no", F.lit(-2)).alias("span_no"), "out_start", "out_end")
    both = large.join(spans.groupBy("parse_id").agg(F.collect_set(span).alias("spans")), "parse_id", "left")

    def ranges(data: Column) -> Column:
        """span_no and bytes of the valid spans that are large enough, or of the whole."""
        size = lambda s: s["out_end"] - s["out_start"]
        valid = F.filter("spans", lambda s: (0 <= s["out_start"]) & (s["out_end"] <= F.length(data)) & (size(s) > F.col("max_bytes")))
        part = F.transform(valid, lambda s: F.struct(s["span_no"].alias("span_no"), F.substring(data, s["out_start"].cast("int") + 1, size(s).cast("int")).alias("item")))
        return F.when(F.col("spans").isNull(), F.array(F.struct(F.lit(-1).alias("span_no"), data.alias("item")))).otherwise(part)

    # the array of one element gives the bytes a name inside the expression, so they are made once
    items = F.transform(F.array(as_bytes(F.col("markdown"))), ranges)[0]
    return both.select("parse_id", F.explode(items).alias("i"), "max_bytes", "overlap_bytes").select(
        "parse_id",
        "i.span_no",
        "i.item",
        "max_bytes",
        F.greatest(F.lit(0), F.least(F.coalesce("overlap_bytes", F.lit(0)), F.floor(F.col("max_bytes") / 2).cast("int"))).alias("overlap_bytes"),
    )


def cut_items(items: DataFrame) -> DataFrame:
    """One row an item with its cores (consecutive parts that make it up) and, for each, hard: it
    ends inside a stretch without a natural boundary, by character fallback."""
    sized = items.withColumn("cores", F.regexp_extract_all("item", cut_pattern(F.col("max_bytes"), F.col("overlap_bytes")), F.lit(0)))
    natural = F.lit(rf"(?:{_BLANK}|{_STOP})\z")

    def hard(core: Column, i: Column) -> Column:
        inner = i + 1 < F.size("cores")
        return inner & ~F.regexp(F.substring(core, F.lit(-3), F.lit(3)), natural) & ~F.regexp(F.substring(F.try_element_at("cores", i + 2), 1, 1), F.lit(_BLANK))

    return sized.withColumn("hard", F.transform("cores", hard))


def split_oversized(results: DataFrame, spans: DataFrame, limits: DataFrame) -> DataFrame:
    """parse_id, span_no, piece_no, start, size, shared, hard, piece: the pieces of each oversized item.

    Pieces have at most max_bytes bytes; piece k > 0 begins with `shared` bytes of what stands in
    front of it: about overlap_bytes (at most half of max_bytes), less if its own core leaves no room or the nearest natural
    boundary is nearer. Pieces without their shared bytes make up the item again. No piece ends or
    begins inside a character, unless the span itself does. Null texts, formats without a limit
    and invalid spans have no items; repeated spans count once; an empty table gives no rows.
    """
    starts = F.aggregate("cores", F.array(F.lit(0)), lambda at, core: F.concat(at, F.array(F.element_at(at, -1) + F.length(core))))
    parts = F.arrays_zip(starts.alias("start"), F.transform("cores", F.length).alias("size"), F.col("hard").alias("hard"))
    cut = cut_items(items_of(results, spans, limits)).select("parse_id", "span_no", F.encode("item", "ISO-8859-1").alias("data"), "max_bytes", "overlap_bytes", F.posexplode(parts).alias("piece_no", "cut")).where("cut.size is not null")
    room = F.least("overlap_bytes", F.col("max_bytes") - F.col("cut.size"), F.col("cut.start"))
    # of bytes, a part is found by its place; of a string, by reading all that is in front of it
    cut = cut.withColumn("back", F.decode(F.substring("data", F.col("cut.start") - room + 1, room), "ISO-8859-1"))
    # the first natural boundary in the lookback, else its first whole character
    tail = F.regexp_extract("back", rf"\A[\s\S]*?(?:(?<={_BLANK})(?!{_BLANK})|(?<={_STOP}))([\s\S]+)\z", 1)
    whole = F.regexp_extract("back", r"\A[\u0080-¿]*([\s\S]*)\z", 1)
    cut = cut.withColumn("tail", F.when(F.length(tail) > 0, tail).otherwise(whole))
    size = F.length("tail")
    return cut.select(
        "parse_id",
        "span_no",
        "piece_no",
        (F.col("cut.start") - size).alias("start"),
        (F.col("cut.size") + size).alias("size"),
        size.alias("shared"),
        F.col("cut.hard").alias("hard"),
        as_text(F.substring("data", F.col("cut.start") - size + 1, F.col("cut.size") + size)).alias("piece"),
    )


def cut_kinds(results: DataFrame, spans: DataFrame, limits: DataFrame) -> DataFrame:
    """parse_id, span_no, cut of each oversized item: hard if any of its cores ends inside a stretch."""
    cut = cut_items(items_of(results, spans, limits))
    return cut.select("parse_id", "span_no", F.when(F.exists("hard", lambda h: h), "hard").otherwise("soft").alias("cut"))
