"""Encoding a corpus with a byte-level BPE vocabulary by forced boundaries.

Two bytes that never stand side by side inside any token of the vocabulary are never merged, so
the text can be cut between them for certain. A batch's bytes are looked up in one table of such
pairs, which gives all cuts at once; equal fragments are then encoded once and their ids copied
into place. Cuts the splitting pattern of the vocabulary could notice are not made (after white
space, before an apostrophe, inside a character).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from inkgrove.functions.structural import string_bytes, strings_from
from inkgrove.session import ship, spread

#: Vocabulary files are at most this large; the content is broadcast, so it is checked.
MAX_VOCABULARY_BYTES = 16 << 20
#: Distinct fragments a worker remembers from batch to batch.
REMEMBERED = 200_000
SPACES = (9, 10, 11, 12, 13, 32)
#: Lead or middle bytes in front of the last byte of white space outside of ASCII.
BEFORE_WIDE_SPACE = (0xC2, 0x80, 0x81, 0x9A)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is larger than what may be broadcast")
    return content


class Encoder:
    """Encodes arrays of texts; the ids equal those of encoding each whole text."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encode_one = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.certain = self.certain_cuts(ranks)
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def certain_cuts(ranks: dict[bytes, int]) -> np.ndarray:
        """Table of 65,536 byte pairs: True where a cut between the two is certain and safe."""
        cut = np.ones((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                inside = np.frombuffer(token, np.uint8)
                cut[inside[:-1], inside[1:]] = False
        cut[SPACES, :] = False
        cut[:, ord("'")] = False
        cut[:, 0x80:0xC0] = False
        return cut.ravel()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted starts of all fragments; each text's own start is among them."""
        if len(data) < 2:
            return np.unique(offsets[:-1][np.diff(offsets) > 0])
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        cut = np.zeros(len(data), bool)
        cut[1:] = self.certain[pair]
        wide = np.flatnonzero(cut & (np.concatenate(([0], data[:-1])) >= 0x80))
        cut[wide[np.isin(data[np.maximum(wide - 2, 0)], BEFORE_WIDE_SPACE)]] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        data, offsets = string_bytes(texts)
        starts = self.cuts(data, offsets)
        fragments = strings_from(data, np.diff(np.append(starts, len(data)))).dictionary_encode()
        ids = [self.ids_of(x) for x in fragments.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        begins = np.cumsum(sizes) - sizes
        which = fragments.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = pool[np.repeat(begins[which] - (ends - counts), counts) + np.arange(total)]
        bounds = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, pa.int32()))

    def ids_of(self, fragment: str) -> np.ndarray:
        ids = self.known.get(fragment)
        if ids is None:
            ids = np.array(self.encode_one(fragment), np.int32)
            if len(fragment) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[fragment] = ids
        return ids


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: bytes, pattern: str) -> Encoder:
    key = (hash(vocabulary), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, pattern)
    return _ENCODERS[key]


def encode_corpus(documents: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every row, without special tokens.

    A null or empty text gives an empty list; the text of a special token is ordinary text; equal
    texts give equal ids; a very long text is encoded whole. Other columns, of whatever name, are
    ignored; an empty table gives no rows. One pass without a shuffle: the work per row depends on
    the row alone.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    source = spread(documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["doc_id"], own.encode(b["text"])], ["doc_id", "ids"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")
