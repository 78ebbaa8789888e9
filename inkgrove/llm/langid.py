"""Languages of documents and of the parts of mixed ones, by compression.

Every language has a dictionary of raw text. A text belongs to the language whose dictionary
compresses it to the fewest bytes; the margin to the next one gives the confidence. A narrow margin
decides nothing: a part stays with its surroundings, a document with its own label if that is one
of those in question, and without such a label its language is undetermined. The dictionaries are
filled from a bounded sample of labelled rows, from which wrongly labelled ones are dropped by
cross-validation.

Parts: blocks in fences, script and style tags, here-documents and quotes over several lines are
candidates for another code language; the lines of prose are put in order of languages by
the cheapest path over their compressed sizes, where a change of language costs some bytes.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.session import ship, spread

#: Labelled rows used of each language (about), and characters of each of them.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 2500
DICTIONARY_BYTES = 110 << 10
LEVEL = 2
#: Bytes that a change of language between lines of prose costs.
SWITCH = 14
#: Least margin to the language around it, as a share of its own, for an embedded block to leave it.
EMBEDDED_MARGIN = 0.1
#: Margin under which a code text is judged again without its running words.
NARROW = 0.25
#: Margin under which nothing is decided.
REJECT = 0.02
#: Most languages that there are dictionaries for.
MAX_LANGUAGES = 1000

_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
_TAG = re.compile(r"^\s*<(script|style)\b[^>]*>\s*$", re.I)
_HEREDOC = re.compile(r"<<[-~]?\s*(['\"]?)([A-Za-z_]\w*)\1(?!\S)")
_RUNNING = re.compile(r"[^\W\d_][\w'’-]*(?:[*_]*[,;:.!?]?[*_]* [*_]*[^\W_][\w'’-]*){3,}[.!?,;:]?|[一-鿿，。、；：？！]{4,}")
_OPENS = re.compile(r"(?:#{1,6}|[-*+>|]|[«“¿¡(*_]+) ?\w")
#: A text with at least this share of running words is prose, one with less than the other is code.
PROSE, CODE = 0.75, 0.5
_TRIPLE = re.compile(r'"""|\'\'\'')


class Closers:
    """Where fences, tags, here-documents and quotes may end: each kind's lines are found once."""

    def __init__(self, lines: list[str]):
        self.lines, self.kinds, self.whole = lines, {}, None

    def after(self, i: int, kind: str, test) -> int | None:
        """First line behind i that passes the test of its kind."""
        found = self.kinds.get(kind)
        if found is None:
            found = self.kinds[kind] = [k for k, x in enumerate(self.lines) if test(x)]
        at = bisect_right(found, i)
        return found[at] if at < len(found) else None

    def equal(self, i: int, text: str) -> int | None:
        """First line behind i that is this text alone."""
        if self.whole is None:
            self.whole = {}
            for k, x in enumerate(self.lines):
                self.whole.setdefault(x.strip(), []).append(k)
        found = self.whole.get(text, [])
        at = bisect_right(found, i)
        return found[at] if at < len(found) else None


def embedded(lines: list[str]) -> list[tuple[int, int]]:
    """Ranges of whole lines inside fences, tags, here-documents and quotes of several lines."""
    found, i, n, closers = [], 0, len(lines), Closers(lines)
    while i < n:
        line = lines[i]
        end = None
        if (m := _FENCE.match(line)) is not None:
            mark = m[1]
            end = closers.after(i, mark, lambda x: (y := x.strip()).startswith(mark) and not y.strip(mark[0]))
        elif "<" in line and (m := _TAG.match(line)) is not None:
            close = f"</{m[1].lower()}>"
            end = closers.after(i, close, lambda x: close in x.lower())
        elif "<<" in line and (m := _HEREDOC.search(line)) is not None:
            end = closers.equal(i, m[2])
        elif ('"""' in line or "'''" in line) and len(marks := _TRIPLE.findall(line)) % 2:
            last = marks[-1]
            end = closers.after(i, last, lambda x: last in x)
        elif line.count("`") % 2 and "```" not in line:
            end = closers.after(i, "`", lambda x: x.count("`") % 2 == 1)
        if end is None:
            i += 1
            continue
        if sum(bool(x.strip()) for x in lines[i + 1 : end]) >= 2:
            found.append((i + 1, end))
        i = end + 1
    return found


def prose_share(text: str) -> float:
    """Share of a text that is running words: four or more in a row, in lines that begin like prose."""
    if sum(map(text.count, "{}();=<>_$")) > 0.04 * len(text):
        return 0.0
    words = whole = 0
    for line in text.split("\n"):
        line = line.strip()
        if line:
            whole += len(line)
            if line[0].isalnum() or _OPENS.match(line):
                words += sum(map(len, _RUNNING.findall(line)))
    return words / whole if whole else 0.0


class Languages:
    """Compressors with one dictionary a language."""

    def __init__(self, dictionaries: dict[str, bytes], prose: set[str]):
        import zstandard as z

        self.names = sorted(dictionaries)
        self.prose = [x for x in self.names if x in prose]
        self.code = [x for x in self.names if x not in prose]
        self.compress = {}
        for name, data in dictionaries.items():
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress[name] = z.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, text: str, names: list[str]) -> list[int]:
        data = text.encode()
        return [len(self.compress[k](data)) for k in names]

    def best(self, text: str, names: list[str]) -> tuple[str, float]:
        """Language of the smallest size and its margin to the next, as a share of the smallest."""
        sizes = sorted(zip(self.sizes(text, names), names))
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / max(1, sizes[0][0])

    def among(self, text: str) -> list[str]:
        """Languages that a text's share of running words leaves open."""
        share = prose_share(text)
        return (self.prose if share >= PROSE else self.code if share < CODE else self.names) or self.names

    def segments(self, text: str, label: str | None = None) -> list[tuple[int, int, str | None, float]]:
        """(first line, line after the last, language, confidence) over all lines of a text.

        label is what the document is said to be; it stands where the margin is narrow.
        """
        lines = text.split("\n")
        inner = embedded(lines)
        marked = set()
        for a, b in inner:
            marked.update(range(a, b))
        host = "\n".join(x for i, x in enumerate(lines) if i not in marked) if inner else text
        if not host.strip("`~ \t\n"):
            host, inner = text, []
        among = self.among(host)
        lang, margin = self.best(host, among)
        if margin < NARROW and lang in self.code:
            # comments may outweigh the code they stand in: look at what is no running words
            other, surer = self.best(_RUNNING.sub(" ", host), self.code)
            if surer > margin:
                lang, margin = other, surer
        if margin < REJECT and lang in self.code:
            lang = self.rejected(host, among, label)
        owner: list[tuple[str, float] | None] = [None] * len(lines)
        for a, b in inner:
            inside = "\n".join(lines[a:b])
            if prose_share(inside.replace('"', "")) >= CODE:
                continue  # a quoted text, not another code language
            sizes = dict(zip(self.code, self.sizes(inside, self.code)))
            part = min(sizes, key=lambda k: (sizes[k], k))
            around = sizes[lang] if lang in sizes else self.sizes(inside, [lang])[0] if lang else max(sizes.values())
            gap = (around - sizes[part]) / max(1, sizes[part])
            if part != lang and gap >= EMBEDDED_MARGIN:
                owner[a:b] = [(part, gap)] * (b - a)
        if lang in self.prose:
            self.paragraphs(lines, owner)
        segments: list[list] = []
        for i in range(len(lines)):
            own = owner[i] or (lang, margin)
            if segments and (segments[-1][2] == own[0] or not lines[i].strip()):
                segments[-1][1] = i + 1
                segments[-1][3] = max(segments[-1][3], own[1]) if segments[-1][2] == own[0] else segments[-1][3]
            elif not segments and not lines[i].strip():
                continue
            else:
                segments.append([i, i + 1, *own])
        if segments:
            segments[0][0] = 0
        # of prose, the lines decide: a whole text of two languages has a narrow margin, too
        if len(segments) == 1 and segments[0][2] in self.prose and max(segments[0][3], margin) < REJECT:
            segments[0][2] = self.rejected(host, among, label)
        return [(a, b, k, confidence(m)) for a, b, k, m in segments]

    def rejected(self, text: str, names: list[str], label: str | None) -> str | None:
        """The label if it is about as good as the best language, else None."""
        if label not in self.compress:
            return None
        sizes = dict(zip(self.names, self.sizes(text, self.names)))
        return label if sizes[label] <= min(sizes[k] for k in names) * (1 + REJECT) else None

    def paragraphs(self, lines: list[str], owner: list) -> None:
        """Languages of the lines not yet owned, by the cheapest path over their sizes."""
        n = len(lines)
        blocks = [(i, i + 1) for i in range(n) if owner[i] is None and not _FENCE.match(lines[i]) and any(map(str.isalpha, lines[i]))]
        if not blocks:
            return
        names = self.prose
        costs = [self.sizes("\n".join(lines[a:b]), names) for a, b in blocks]
        total, back = list(costs[0]), []
        for own in costs[1:]:
            low = min(range(len(names)), key=total.__getitem__)
            step, now = [], []
            for k in range(len(names)):
                stay = total[k] <= total[low] + SWITCH
                step.append(k if stay else low)
                now.append((total[k] if stay else total[low] + SWITCH) + own[k])
            back.append(step)
            total = now
        k = min(range(len(names)), key=total.__getitem__)
        path = [k]
        for step in reversed(back):
            k = step[k]
            path.append(k)
        path.reverse()
        for at, (k, own) in enumerate(zip(path, costs)):
            rest = min((x for j, x in enumerate(own) if j != k), default=own[k] * 2)
            a, b = blocks[at]
            until = blocks[at + 1][0] if at + 1 < len(blocks) else n
            mark = (names[k], max(0.0, (rest - own[k]) / max(1, own[k])))
            for i in range(0 if at == 0 else a, until):
                if owner[i] is None:
                    owner[i] = mark


def confidence(margin: float) -> float:
    """A margin as a value between 0 and 1: half at 2 %, nine tenths at 18 %."""
    return round(margin / (margin + 0.02), 4) if margin > 0 else 0.0


# ---- training ----


def sample_rows(documents: DataFrame, codes: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang, text: about so many different labelled texts of each language, chosen by a hash of the text.

    One aggregate over the labels gives each language's number of different texts and with it the
    range of 64-bit hashes that are sampled. Copies meet map-side before the first 4 * rows of each
    language by hash are taken, so neither many rows nor many copies of a text displace others.
    Raises if there are more than MAX_LANGUAGES languages.
    """
    names = [r["lang"] for r in codes.select("lang").where("lang is not null").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    key = F.xxhash64("text")
    labelled = documents.where(F.col("lang").isin(names) & F.col("text").isNotNull()).select("lang", key.alias("key"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    # hashes lie evenly between -2^63 and 2^63; those up to the last one are sampled
    last = F.lit(-(1 << 63))
    for name, n in counts.items():
        last = F.when(F.col("lang") == name, F.lit(last_hash(rows, n))).otherwise(last)
    chosen = labelled.where(F.col("key") <= last).groupBy("lang", "key").agg(F.first("text").alias("text"))
    chosen = chosen.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("no") <= 4 * rows)
    return chosen.select("lang", "text")


def trained(documents: DataFrame, codes: DataFrame) -> DataFrame:
    """lang, dictionary: what language_segments() needs of the labelled documents, as a small table.

    The sample is bounded (README gives its size), so one task learns from it; the table can be
    written once and given to many runs.
    """
    ship(documents.sparkSession)
    prose = {r["lang"] for r in codes.where("kind = 'prose'").select("lang").collect()}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(b["lang"].to_pylist(), b["text"].to_pylist())]
        rows.sort(key=lambda x: (xxhash.xxh3_64_intdigest(x[1]), x[0]))
        if rows:
            names, data = zip(*sorted(train(rows, prose).items()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], ["lang", "dictionary"])

    return sample_rows(documents, codes).coalesce(1).mapInArrow(learn, "lang string, dictionary binary")


def last_hash(rows: int, n: int) -> int:
    """The hash up to which about 1.5 * rows of n different texts lie."""
    if 2 * n <= 3 * rows:
        return (1 << 63) - 1
    return (3 * rows << 64) // (2 * n) - (1 << 63)


def dictionary(texts: list[str]) -> bytes:
    """The texts' bytes, different ones first to last, up to the size of a dictionary."""
    out, size = [], 0
    for t in dict.fromkeys(texts):
        data = t.encode()
        if size + len(data) > DICTIONARY_BYTES:
            data = data[: DICTIONARY_BYTES - size]
        out.append(data)
        size += len(data)
        if size >= DICTIONARY_BYTES:
            break
    return b"".join(out) or b" "


def host_text(text: str) -> str:
    """A text without what other languages may be embedded in it."""
    lines = text.split("\n")
    inner = {i for a, b in embedded(lines) for i in range(a, b)}
    return "\n".join(x for i, x in enumerate(lines) if i not in inner)


def train(rows: list[tuple[str, str]], prose: set[str], rounds: int = 2) -> dict[str, bytes]:
    """Dictionaries by language. In each round either half of the rows judges the other half, and
    only rows whose label agrees go on; so a wrong label can't vouch for itself. Halves are cut by
    the longest line, which copies of a file share, so a copy can't vouch for it either."""
    pool = [(k, h) for k, t in rows if len(h := host_text(t)) >= 40 and (PROSE > prose_share(h) if k not in prose else prose_share(h) >= CODE)]
    for _ in range(rounds):
        halves = [[x for x in pool if xxhash.xxh3_64_intdigest(max(x[1].split("\n"), key=len).strip()) % 2 == s] for s in (0, 1)]
        models = [Languages(_dictionaries(h), prose) for h in halves]
        kept = [x for s in (0, 1) for x in halves[s] if x[0] not in models[1 - s].compress or _agrees(models[1 - s], x[0], x[1])]
        left = {k for k, _ in kept}
        pool = kept + [x for x in pool if x[0] not in left]  # too few rows to judge one another
        pool.sort(key=lambda x: xxhash.xxh3_64_intdigest(x[1]))
    return _dictionaries(pool)


def _agrees(model: Languages, label: str, text: str) -> bool:
    if model.best(text, model.among(text))[0] != label:
        return False
    return label not in model.prose or len({k for _, _, k, _ in model.segments(text)}) == 1


def _dictionaries(rows: list[tuple[str, str]]) -> dict[str, bytes]:
    by: dict[str, list[str]] = {}
    for k, t in rows:
        by.setdefault(k, []).append(t)
    return {k: dictionary(v) for k, v in by.items()}


_MODELS: dict[int, Languages] = {}


def _model(data: bytes) -> Languages:
    key = hash(data)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Languages(*pickle.loads(data))
    return _MODELS[key]


def language_segments(documents: DataFrame, codes: DataFrame, only_doubtful: bool = False, dictionaries: DataFrame | None = None) -> DataFrame:
    """doc_id, seg_no, lang, confidence, first_line, lines: the languages of every document in order.

    A document in one language has one row, seg_no 0; neighbouring segments differ. Null and blank
    texts have no language and give no rows; equal texts with equal labels give equal rows; labels
    other than those of codes count as wrong. Where the margin is narrow the document's own label
    stands if it is about as good; otherwise lang is null (undetermined). only_doubtful leaves out
    documents in one language whose label says so. dictionaries are those of trained(), learnt from
    these documents if none are given; without any labelled row there is nothing to learn from and
    the result is empty. The documents are read in one pass without a shuffle.
    """
    spark = documents.sparkSession
    ship(spark)
    prose = {r["lang"] for r in codes.where("kind = 'prose'").select("lang").collect()}
    learnt = dictionaries if dictionaries is not None else trained(documents, codes)
    shared = spark.sparkContext.broadcast(pickle.dumps(({r["lang"]: bytes(r["dictionary"]) for r in learnt.collect()}, prose)))
    source = spread(documents.select("doc_id", "lang", "text").where("text is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        segments = lru_cache(2000)(model.segments)
        for b in batches:
            at, rows = [], []
            for i, (label, text) in enumerate(zip(b["lang"].to_pylist(), b["text"].to_pylist())):
                if not model.names or not text.strip():
                    continue
                found = segments(text)
                if any(x[2] is None for x in found):
                    found = segments(text, label)
                if only_doubtful and len(found) == 1 and found[0][2] == label:
                    continue
                for no, (first, end, lang, sure) in enumerate(found):
                    at.append(i)
                    rows.append((no, lang, sure, first, end - first))
            if rows:
                no, lang, sure, first, size = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(pa.array(at)), pa.array(no, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(first, pa.int32()), pa.array(size, pa.int32())],
                    ["doc_id", "seg_no", "lang", "confidence", "first_line", "lines"],
                )

    return source.mapInArrow(run, "doc_id bigint, seg_no int, lang string, confidence double, first_line int, lines int")
