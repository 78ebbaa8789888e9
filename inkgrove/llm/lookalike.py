"""One consistent form for texts that look the same.

A transducer reads the text once from left to right. It stops only at runs that are not plain ASCII
(with the ASCII letter in front, which an accent may join), takes them apart into grapheme clusters
and rewrites each cluster, its accents in canonical order, by the longest keys of one compiled
mapping: compatibility and full-width forms as their plain letters, letters with their accents as
one character, invisible characters gone, every kind of blank as U+0020 and letters of other
scripts as the letter of the same shape. Where a joiner or a tag makes one sign of several
(families, flags) it is not invisible: the cluster keeps it.

The mapping is computed once from Unicode's own data and the tables below over all code points, and
checked for conflicts; forms of runs are remembered.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.session import checked_broadcast, durable, ship, spread

#: Letters whose printed shape is that of another letter, by script: letters, then what they look
#: like. Single letters of the same shape after Unicode's list of confusable characters (UTS 39).
SHAPES = (
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХҮӀԀԌԚԜѴ", "ABESIJKMHOPCTYXYIDGQWV"),
    ("аеѕіјорсухһԁԛԝүӏѵҽк", "aesijopcyxhdqwylveĸ"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("αγικνορσυϲϳ", "ayiĸvopoucj"),
    # Armenian
    ("ՍՏԼՕհոսցօզյ", "USLOhnugoqj"),
    # Coptic
    ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABEHIKMNOPCTYXopc"),
    # Cherokee
    ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiYAJEWMHGZVSLCPKdB"),
    # Lisu
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    # Latin letters of phonetic writing, and marks
    ("ɑɡⱭ⁄∕", "agA//"),
)
#: Blanks and line ends without a decomposition.
BLANKS = {"\u1680": " ", "\u2800": " ", "\x85": "\n", "\u2028": "\n", "\u2029": "\n"}
#: Characters without a visible mark beside those of category Cf.
UNSEEN = {"\u034f", "\u115f", "\u1160", "\u17b4", "\u17b5", "\u3164", "\uffa0", *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0x180B, 0x1810)), *map(chr, range(0xE0100, 0xE01F0))}
#: Signs of category Cf that are printed around the digits behind them.
PRINTED = {*map(chr, range(0x600, 0x606)), "\u06dd", "\u070f", "\u0890", "\u0891", "\u08e2", "\U000110bd", "\U000110cd"}
REMEMBERED_CHARS = 64


def compiled() -> dict[str, str]:
    """Every key that isn't its own form, with its form: single characters, and letters with accents.

    Keys are in canonical order, fully decomposed, as the transducer reads them. Raises if two
    sources give one key different forms, if an ASCII character would be mapped, or if a form
    isn't stable, so that a second pass changes nothing.
    """
    look = {}
    for letters, shapes in SHAPES:
        for x, y in zip(letters, shapes, strict=True):
            if look.setdefault(x, y) != y:
                raise ValueError(f"conflicting shapes of {x!r}")

    def direct(c: str) -> str | None:
        if c in BLANKS:
            return BLANKS[c]
        if c in UNSEEN or (unicodedata.category(c) == "Cf" and c not in PRINTED):
            return ""
        return look.get(c)

    table: dict[str, str] = {}
    composed: dict[str, str] = {}
    for n in range(0x80, 0x110000):
        if 0xAC00 <= n < 0xE000 or 0x323B0 <= n < 0xE0000 or n >= 0xE1000:
            continue  # syllables of Hangul (composed by rule), surrogates, private and unassigned planes
        c = chr(n)
        form = direct(c)
        if form is None:
            parts = unicodedata.normalize("NFKD", c)
            if parts == c:
                continue
            form = "".join(x if (y := direct(x)) is None else y for x in parts)
            if unicodedata.normalize("NFC", (key := unicodedata.normalize("NFD", c))) == c and key != c:
                composed[key] = form = unicodedata.normalize("NFC", form)
                continue
            form = unicodedata.normalize("NFC", form)
        key = unicodedata.normalize("NFD", c)
        if form != c and form != unicodedata.normalize("NFC", key):  # else decomposing is all
            table[key] = form
    # accents on letters of other scripts make the accented letter that they look like
    marks: dict[str, list[str]] = {}
    for key, form in composed.items():
        if len(key) == 2:
            marks.setdefault(key[0], []).append(key[1])
    for x, y in look.items():
        for mark in marks.get(y, ()):
            if composed.setdefault(x + mark, form := unicodedata.normalize("NFC", y + mark)) != form:
                raise ValueError(f"conflicting forms of {x + mark!r}")
    for key, form in composed.items():
        if table.setdefault(key, form) != form:
            raise ValueError(f"conflicting forms of {key!r}")
    trie = _trie(table)
    for key, form in table.items():
        if key.isascii() or _rewritten(trie, form) != form:
            raise ValueError(f"conflicting mapping of {key!r}")
    return table


def _trie(table: dict[str, str]) -> dict:
    """Characters to nodes; a node's own form stands under ''."""
    root: dict = {}
    for key, form in table.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[""] = form
    return root


def _rewritten(trie: dict, cluster: str) -> str:
    """The cluster with the longest keys of the trie rewritten from left to right."""
    text, out, at = unicodedata.normalize("NFD", cluster), [], 0
    n = len(text)
    while at < n:
        node, form, end = trie.get(text[at]), text[at], at + 1
        if node is not None:
            form, k = node.get("", form), at + 1
            while k < n and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    form, end = node[""], k
        out.append(form)
        at = end
    # what is left is composed: marks without a key of their own letter, and Hangul
    return unicodedata.normalize("NFC", "".join(out))


_TRIE: dict = {}
_RUN = regex.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
_CLUSTERS = regex.compile(r"\X")
#: Pictures that joiners or tags make of several characters; they aren't rewritten.
_PICTURE = r"\p{Extended_Pictographic}\p{M}*(?:\u200d\p{Extended_Pictographic}\p{M}*)+|\p{Extended_Pictographic}[\U000e0020-\U000e007f]+"
_PICTURES = regex.compile(_PICTURE)
_HIDDEN: list[regex.Pattern] = []
_KNOWN: dict[str, str] = {}


def _form(match: regex.Match) -> str:
    run = match[0]
    form = _KNOWN.get(run)
    if form is None:
        if not _TRIE:
            table = compiled()
            _TRIE.update(_trie(table))
            _HIDDEN.append(regex.compile(rf"({_PICTURE})|[{''.join(k for k, v in table.items() if not v)}]+"))
        # an accent may stand behind an invisible character, so these go before clusters are found
        seen = _HIDDEN[0].sub(lambda m: m[1] or "", run)
        form = "".join(x if _PICTURES.search(x) else _rewritten(_TRIE, x) for x in _CLUSTERS.findall(seen))
        if len(run) <= REMEMBERED_CHARS:
            if len(_KNOWN) > 300_000:
                _KNOWN.clear()
            _KNOWN[run] = form
    return form


def consistent(text: str) -> str:
    """The consistent form; texts look the same exactly if their forms are equal."""
    return text if text.isascii() else _RUN.sub(_form, text)


def consistent_text(column: Column) -> Column:
    """The consistent form of a string column; null stays null, empty stays empty."""

    @F.arrow_udf(T.StringType())
    def form(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else consistent(v) for v in values.to_pylist()], pa.string())

    return form(column)


def look_keys(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, form, own: 16-byte digests of the consistent form and of the text itself.

    Null texts and texts without anything visible are left out. Only digests leave the worker, so
    what is shuffled later doesn't depend on the length of the texts.
    """
    ship(texts.sparkSession)
    source = spread(texts.select(texts[id_col].alias("id"), texts[text_col].alias("text")).where("text is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, forms, owns = [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                form = consistent(text)
                if form and not form.isspace():
                    raw = text.encode()
                    at.append(i)
                    owns.append(own := blake2b(raw, digest_size=16).digest())
                    forms.append(own if form is text else blake2b(form.encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at, pa.int64())), pa.array(forms, pa.binary()), pa.array(owns, pa.binary())], ["id", "form", "own"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, form binary, own binary")


#: More members of a class, or classes of a form, than this (or than 1 / 4096 of all) are split.
HOT = 4096


def _copied(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Rows once for each part of their key; hot: key, parts (a bounded side)."""
    return df.join(F.broadcast(hot), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def _salted(df: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """Rows with the one part of their key that they belong to."""
    return df.join(F.broadcast(hot), key, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def same_looking_pairs(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """left_id, right_id (the smaller first): texts that look the same and are not the same string.

    Works on classes of equal strings: forms with a single class drop out after a map-side
    combined aggregate, classes of one form are paired, and only then their members joined, so a
    large group of exact copies costs no more than the rows it must give. Forms of many classes and
    classes of many members are split over tasks; as they hold a share of all rows each, there are
    few of them. Null, empty and blank texts are no cases; equal strings are never paired.
    """
    keys = durable(look_keys(texts, id_col, text_col))  # read three times below; the texts only once
    classes = keys.groupBy("form", "own").agg(F.count(F.lit(1)).alias("n"))
    forms = classes.groupBy("form").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows")).where("k > 1")
    classes = durable(classes.join(forms, "form"))
    most = max(HOT, (classes.agg(F.sum("n")).first()[0] or 0) // 4096)
    parts = lambda n: F.ceil(F.col(n) / most).cast("int").alias("parts")
    hot_forms = classes.where(F.col("k") > most).groupBy("form").agg(F.first("k").alias("k")).select("form", parts("k"))
    hot_classes = classes.where(F.col("n") > most).select("own", parts("n"))
    one = _copied(classes.select("form", F.col("own").alias("one")), hot_forms, "form")
    two = _salted(classes.select("form", F.col("own").alias("two")), hot_forms, "form", "two")
    pairs = one.join(two, ["form", "part"]).where("one < two").select("one", "two")
    members = _salted(keys.join(classes.select("own"), "own", "left_semi").select("id", "own"), hot_classes, "own", "id")
    first = members.select(F.col("id").alias("i"), F.col("own").alias("one"), "part")
    second = members.select(F.col("id").alias("j"), F.col("own").alias("two"), "part")
    left = _copied(pairs, hot_classes.withColumnRenamed("own", "one"), "one").join(first, ["one", "part"]).select("i", "two")
    both = _copied(left, hot_classes.withColumnRenamed("own", "two"), "two").join(second, ["two", "part"]).where("i <> j")
    return both.select(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"))


def same_looking_headers(entries: DataFrame, columns: DataFrame, labels: DataFrame, max_labels: int = 100_000) -> DataFrame:
    """label_id, column_id: headers that look the same as a reference label and are not its string."""
    ship(entries.sparkSession)
    heads = entries.select("entry_id", F.explode(F.map_entries("headers")).alias("h"))
    heads = heads.select("entry_id", F.col("h.value.column_index").alias("column_index"), F.col("h.key").alias("header"))
    heads = heads.withColumn("form", consistent_text(F.col("header")))
    known = labels.where("label is not null").select("label_id", "label", consistent_text(F.col("label")).alias("form"))
    found = heads.join(checked_broadcast(known, max_labels), "form").where("header <> label")
    return found.join(columns.select("entry_id", "column_index", "column_id"), ["entry_id", "column_index"]).select("label_id", "column_id").distinct()
