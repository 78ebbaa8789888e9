"""Held-out test passages inside a corpus: one automaton over normalised items, each text scanned once.

Each item is cut into consecutive blocks of half a passage, so that every passage holds a whole
block. The automaton reads words as pairs of symbols out of two small alphabets and finds the
blocks in a text; each hit is compared and followed to both sides as far as text and item agree.
Its size is twice that of the items in words.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkgrove.session import ship, spread

WORD = re.compile(r"[^\W_]+")
WORDS = 13
#: Characters of items that one automaton holds; more are searched in parts, one scan each.
#: README gives the memory at this size.
MAX_ITEM_CHARS = 24 << 20


#: No block. Blocks that come more often than this in an item are followed only outside of the passages
#: that are found: an item of one word again and again would meet itself everywhere. No affected item
#: is lost by it; of such an item a passage may end up to a block early.
NONE, REPEATS = (1 << 32) - 1, 8
#: The two symbols of a word's number; few letters a place keep the automaton's nodes narrow.
CODES = [chr(0x4000 + (n >> 8)) + chr(0x5000 + (n & 255)) for n in range(1 << 16)]
NO_CODE = "\u3000\u3000"


def word_list(text: str) -> list[str]:
    """Words in folded case."""
    return " ".join(WORD.findall(text)).casefold().split()


class LeakFinder:
    """Aho-Corasick automaton over the blocks of all items, with the items to follow its hits."""

    def __init__(self, items: list[tuple], words: int = WORDS):
        import ahocorasick

        self.words, self.block = words, (words + 1) // 2
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.ids: dict[str, int] = {}
        # all items' words one after another, a 0 around each
        self.flat = array("I", [0])
        #: Of each block: its item, its place in flat, and the next block of the same words (or NONE).
        self.item, self.place, self.same = array("I"), array("Q"), array("I")
        #: Of the first block of its words in an item: how many there are, and the first one of the next item.
        self.times, self.jump = array("I"), array("I")
        #: Of each wording: its first block, its last one, and the first one of the last item.
        first, last, own_first = array("I"), array("I"), array("I")
        self.items = []
        for key, text in items:
            own = word_list(text or "")
            if len(own) < words:
                continue
            start = len(self.flat)
            self.flat.extend(self.ids.setdefault(w, len(self.ids) + 1) for w in own)
            self.flat.append(0)
            for at in range(start, start + len(own) - self.block + 1, self.block):
                n, block = len(self.place), "".join([CODES[x & 0xFFFF] for x in self.flat[at : at + self.block]])
                wording = self.automaton.get(block, len(first))
                self.item.append(len(self.items))
                self.place.append(at)
                self.same.append(NONE)
                self.times.append(1)
                self.jump.append(NONE)
                if wording == len(first):
                    self.automaton.add_word(block, wording)
                    first.append(n)
                    last.append(n)
                    own_first.append(n)
                    continue
                self.same[last[wording]] = n
                last[wording] = n
                if self.item[own_first[wording]] == len(self.items):
                    self.times[own_first[wording]] += 1
                else:
                    self.jump[own_first[wording]] = n
                    own_first[wording] = n
            self.items.append(key)
        self.first = first
        self.unknown = len(self.ids) + 1
        self.codes = {w: CODES[k & 0xFFFF] for w, k in self.ids.items()}
        self.empty = not self.items
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item, first and last offset in the original text) of every passage, in order.

        Passages of one item that overlap in the text are one.
        """
        if self.empty or not text:
            return []
        listed, codes = word_list(text), self.codes
        hits = list(self.automaton.iter("".join([codes.get(w, NO_CODE) for w in listed])))
        if not hits:
            return []
        ids, unknown = self.ids, self.unknown
        own = array("I", [ids.get(w, unknown) for w in listed])
        n, flat, ends, runs, covered = len(own), self.flat, {}, [], {}
        for last, wording in hits:
            end = last // 2 + 1
            at = end - self.block
            head = self.first[wording]
            while head != NONE:
                item, k = self.item[head], head
                many = self.times[head] > REPEATS
                while k != NONE and self.item[k] == item and not (many and covered.get(item, 0) >= end):
                    place = self.place[k]
                    # a run of agreeing words is followed once, whatever number of its blocks is hit
                    if ends.get(at - place, 0) <= at and own[at:end] == flat[place : place + self.block]:
                        a, b, i, j = at, end, place - 1, place + self.block
                        while a and own[a - 1] == flat[i]:
                            a, i = a - 1, i - 1
                        while b < n and own[b] == flat[j]:
                            b, j = b + 1, j + 1
                        ends[at - place] = b
                        if b - a >= self.words:
                            runs.append((item, a, b))
                            covered[item] = max(covered.get(item, 0), b)
                    k = self.same[k]
                head = self.jump[head]
        if not runs:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        found: list[list[int]] = []
        for item, a, b in sorted(runs):
            if found and found[-1][0] == item and a < found[-1][2]:
                found[-1][2] = max(found[-1][2], b)
            else:
                found.append([item, a, b])
        return [(self.items[item], spans[a][0], spans[b - 1][1]) for item, a, b in found]


_FINDERS: dict[int, LeakFinder] = {}


def leaked_passages(documents: DataFrame, items: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first, last: every passage of an item in a document, by its offsets in the text.

    A passage is at least `words` consecutive words of an item that stand in the text consecutively
    and in order; case and what stands between words don't count. Shorter items and null or blank
    texts can't leak; equal items are reported each under its own id, an id's texts together, and
    repeated documents each;
    an empty side gives no rows. Items are a stated set: their size is summed first, and what is
    over MAX_ITEM_CHARS is searched in parts of about that size, so what is shared is bounded by it
    and the largest item. The corpus is read in one pass a part, without a shuffle.
    """
    spark = documents.sparkSession
    ship(spark)
    size = items.agg(F.sum(F.length("text") + 16).alias("n")).first()["n"] or 0
    parts = -(-size // MAX_ITEM_CHARS)
    if parts <= 1:
        return _passages(documents, items, words, id_col, text_col)
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))  # all texts of an id together
    found = [_passages(documents, items.where(part == k), words, id_col, text_col) for k in range(parts)]
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionByName(x)
    return whole


def leaked_items(documents: DataFrame, items: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id: one row per document and item with a passage in it; see leaked_passages.

    The passages of a document come from one task in order of items, so the first one of each is
    its row and nothing is shuffled.
    """
    return leaked_passages(documents, items, words, id_col, text_col).where("nth = 0").select("doc_id", "item_id")


def _passages(documents: DataFrame, items: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    spark = documents.sparkSession
    rows = [(r["item_id"], r["text"]) for r in items.select("item_id", "text").where("text is not null").collect()]
    shared = spark.sparkContext.broadcast(pickle.dumps(rows))
    source = spread(documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text")))
    out = T.StructType([source.schema["doc_id"], items.schema["item_id"], *(T.StructField(k, T.LongType()) for k in ("first", "last")), T.StructField("nth", T.IntegerType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((shared.value, words))
        if key not in _FINDERS:
            _FINDERS.clear()
            _FINDERS[key] = LeakFinder(pickle.loads(shared.value), words)
        finder = _FINDERS[key]
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b["text"].to_pylist()):
                seen: dict = {}
                for item, first, end in dict.fromkeys(finder.find(text)):  # an id may have the same text twice
                    at.append(i)
                    found.append((item, first, end, seen.setdefault(item, 0)))
                    seen[item] += 1
            if found:
                cols = [pa.array(c, schema.field(k + 1).type) for k, c in enumerate(zip(*found))]
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at)), *cols], schema=schema)

    return source.mapInArrow(run, out)
