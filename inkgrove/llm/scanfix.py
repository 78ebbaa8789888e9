"""Repair of scanned text: page furniture, words broken over lines, wrongly recognised characters.

Two passes. The first counts words and pairs of words over all results; the words of other texts
and those of scans that are no misreadings form the vocabulary. Workers hold its frequent words and
pairs; of the rarer ones a result gets those that it asks for, candidates and pairs alike, by joins
(see _scans). The second reads each paged result by itself: running headers and printed page
numbers are found by their place, their shape and their sequence over the pages, broken words are
joined by the vocabulary, and an unknown word is looked up in the vocabulary's trie by an automaton
that accepts all words within a bounded weighted edit distance; candidates are ranked by distance,
then context, then frequency. What confusions don't explain, or don't fit, may be a free edit (two
in a long word) if the context leaves no doubt.
"""

from __future__ import annotations

import pickle
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.session import durable, ship, spread

#: Fewest uses of a word and of a pair.
FEWEST = 3
#: Words and pairs that workers hold; if there are more, the most frequent ones, and the rest is looked up by joins.
MAX_WORDS, MAX_PAIRS = 500_000, 1_000_000
#: A word seen on scans only is a misreading if a word it may be misread from is this many times as
#: frequent; also if one a free edit away is FREE_DOMINANT times as frequent, unless the word itself
#: is a WORD_SHARE of all words.
DOMINANT, FREE_DOMINANT, WORD_SHARE = 8, 64, 2e-6
#: Characters that scanners confuse, as read and as printed. Fixed values.
CONFUSED = (
    ("c", "e"), ("f", "e"), ("f", "t"), ("o", "a"), ("b", "h"), ("y", "v"), ("l", "i"), ("0", "o"), ("1", "i"), ("1", "l"),
    ("5", "s"), ("6", "b"), ("9", "g"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("h", "li"), ("m", "rn"),
    ("i", "l"), ("q", "g"), ("8", "b"), ("ı", "i"), ("|", "l"), ("|", "i"), ("tt", "ff"), ("nn", "rm"),
)
CONFUSION, EDIT = 0.3, 1.0
#: Weighted distance up to which a candidate is taken whatever stands beside it; three confusions.
MOST = 0.95
#: Distances up to which a candidate is taken that is known beside both neighbours, and the fewest
#: letters of the word as read; one free edit, two in a long word. The candidate's fewest uses, as
#: rare correct words would fall to it otherwise.
FREE, FREE_USES = ((EDIT, 4), (2 * EDIT, 8)), DOMINANT * FEWEST
#: Longer tokens are words only if they are made of letters.
LONG_TOKEN = 40
#: Nodes of the trie that are kept at a time.
MAX_NODES = 100_000
#: Longer words meet at parts of their fold instead of their shortened forms: two for each of two
#: edits, as a letter may stand in two parts, and one more. How much words within any limit differ
#: in length, and their folds where two letters are edited.
LONG_WORD, PARTS, SHIFT = 24, 5, 6
#: What no confusion changes: characters as strokes, so that both sides of every one of them are equal.
_FOLD = str.maketrans({c: to for of, to in (("ceft", "c"), ("ilr1|ı", "i"), ("nuhb68", "ii"), ("m", "iii"), ("d", "ci"), ("oa0", "o"), ("yv", "y"), ("w", "yy"), ("qg9", "g"), ("s5", "s")) for c in of})
HYPHENS = "-­‐‑¬"

_PAGE = re.compile(r"## Page \d+\s*$")
_EDGES = "".join(c for c in map(chr, range(33, 0x3040)) if not c.isalnum() and not 0x300 <= ord(c) < 0x370)
_LIKE_DIGIT = str.maketrans("OoQDlIi|SsBgqZzGbTAt", "0000111155899226" + "6" + "747")
_DIGITS = "0123456789OoQDlIi|SsBgqZzGbTAt"
_NUMERAL = rf"[{_DIGITS}]{{1,4}}"
_NUMBER_LINE = re.compile(rf"^[\W_]*(?:(?:page|seite|página|pág|pag|p|s)\b[\W_]*)?({_NUMERAL})(?:\s*(?:of|von|de|sur|/)\s*({_NUMERAL}))?[\W_]*$", re.I)
_NUMBER_FIRST = re.compile(rf"^({_NUMERAL})(?:\s{{2,}}|\s*[|·–—]\s*)(?=\S)")
_NUMBER_LAST = re.compile(rf"(?:\s*\.{{3,}}\s*|\s{{2,}}|\s*[|·–—]\s*)({_NUMERAL})$")
_ENDS = re.compile(r"[.!?,;:。！？，]$")


def bare(token: str) -> str:
    """The word of a token: lower case, without punctuation around it."""
    return token.strip(_EDGES).lower()


def word_of(token: str) -> str:
    """The word of a token, '' for long ones that are data."""
    word = bare(token)
    return word if len(word) <= LONG_TOKEN or word.replace("-", "").isalpha() else ""


# ---- vocabulary ----


def count_words(results: DataFrame) -> DataFrame:
    """word or pair, with its uses in texts that are no scans (t) and in paged ones (p).

    Each batch sends its own totals, so a frequent word is one row a batch before the shuffle.
    The row without word and pair holds the totals.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, str] = {}
        for b in batches:
            words, pairs, total = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
            for fmt, text in zip(b["doc_format"].to_pylist(), b["markdown"].to_pylist()):
                k = fmt == "pdf"
                tokens = text.split()
                for t in set(tokens):
                    if t not in names:
                        names[t] = word_of(t)
                own = [names[t] for t in tokens]
                if k:  # parts of broken words are no words
                    for i, t in enumerate(tokens):
                        if t[-1] in HYPHENS:
                            own[i : i + 2] = [""] * len(own[i : i + 2])
                words[k].update(own)
                pairs[k].update(f"{a} {b}" for a, b in zip(own, own[1:]) if a and b)
                total[k] += len(own)
            if len(names) > 500_000:
                names.clear()
            rows = [(w, None, words[0][w], words[1][w]) for w in words[0].keys() | words[1].keys() if w]
            rows += [(None, key_of(w), pairs[0][w], pairs[1][w]) for w in pairs[0].keys() | pairs[1].keys()]
            rows.append((None, None, total[0], total[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["word", "pair", "t", "p"])

    source = spread(results.select("doc_format", "markdown").where("markdown is not null"))
    return source.mapInArrow(count, "word string, pair bigint, t bigint, p bigint").groupBy("word", "pair").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))


def key_of(pair: str) -> int:
    return xxhash.xxh3_64_intdigest(pair) - (1 << 63)


def least_uses(counts: DataFrame, most: int) -> int:
    """The uses from which on there are at most so many rows; by powers of two, so a few rows decide."""
    bins = {r["b"]: r["n"] for r in counts.groupBy(F.floor(F.log2("uses")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = 0
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > most:
            return 2 ** (b + 1)
    return FEWEST


def vocabulary(results: DataFrame) -> tuple[bytes, DataFrame | None]:
    """The packed vocabulary, and the known words and pairs that aren't in it (word or pair, uses), if any."""
    counts = durable(count_words(results))  # read several times below; the texts only once
    total = counts.where("word is null and pair is null").first()
    t, p = (total["t"], total["p"]) if total else (0, 0)
    often = counts.withColumn("uses", F.col("t") + F.col("p")).where(F.col("uses") >= FEWEST)
    named = often.where(F.col("word").isNotNull())
    words = durable(named.join(misreadings(named, ceil(WORD_SHARE * (t + p))), "word", "left_anti").select("word", F.lit(None).cast("bigint").alias("pair"), "uses"))
    pairs = often.where(F.col("pair").isNotNull()).select("word", "pair", "uses")
    least, least_pair = least_uses(words, MAX_WORDS), least_uses(pairs, MAX_PAIRS)
    held = words.where(F.col("uses") >= least).toArrow()
    held_pairs = pairs.where(F.col("uses") >= least_pair).select("pair").toArrow()["pair"].to_pylist()
    rest = [x.where(F.col("uses") < n) for x, n in ((words, least), (pairs, least_pair)) if n > FEWEST]
    data = Vocabulary(dict(zip(held["word"].to_pylist(), held["uses"].to_pylist())), held_pairs).packed()
    return data, rest[0].union(rest[-1]) if len(rest) == 2 else rest[0] if rest else None


def misreadings(named: DataFrame, evident: int) -> DataFrame:
    """Words seen on scans only that are taken for misreadings of much more frequent words."""
    scanned = named.where(F.col("t") < FEWEST)
    asked = scanned.select("word", F.lit(MOST).alias("most"), (F.col("uses") * DOMINANT).alias("least"))
    edited = scanned.where((F.col("uses") < evident) & (F.length("word") >= FREE[0][1]))
    asked = asked.union(edited.select("word", F.lit(EDIT), F.col("uses") * FREE_DOMINANT))
    found = near_words(asked, named.select("word", "uses"), {MOST: DOMINANT * FEWEST, EDIT: FREE_DOMINANT * FEWEST})
    # a letter more or less at the end is another form of the word, as in Vocabulary.edited
    ending = F.col("near").startswith(F.col("word")) | F.col("word").startswith(F.col("near"))
    return found.where((F.col("near") != F.col("word")) & ((F.col("most") < EDIT) | ~ending)).select("word").distinct()


def shortened(word: str, by: int) -> set[str]:
    """The word without any letters, up to so many."""
    forms = last = {word}
    for _ in range(by):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        forms = forms | last
    return forms


def keys_of(word: str, most: float, asked: bool) -> set[int]:
    """A word asked for and every known word within the weighted distance have a key in common.

    Letters edited are missing on both sides, whatever is confused has the same fold. In long words
    one part of the known word's fold has no edited letter, so the other's has it near that place.
    """
    edits, forms = int(most // EDIT), set()
    if not edits or len(word) <= LONG_WORD + (SHIFT if asked else 0):
        for n in range(edits + 1):
            if most - n * EDIT >= CONFUSION:
                forms.update(f"f{x.translate(_FOLD)}" for x in shortened(word, n))
            else:
                forms.update(f"w{x}" for x in shortened(word, n))
    if edits and len(word) > LONG_WORD - (SHIFT if asked else 0):
        fold = word.translate(_FOLD)
        for n in range(len(fold) - SHIFT, len(fold) + SHIFT + 1) if asked else (len(fold),):
            for k in range(PARTS):
                at, end = n * k // PARTS, n * (k + 1) // PARTS
                for x in range(-SHIFT, SHIFT + 1) if asked else (0,):
                    if at + x >= 0 and end + x <= len(fold):
                        forms.add(f"{k}{n} {fold[at + x : end + x]}")
    return {key_of(f"{most} {x}") for x in forms}


def near_words(asked: DataFrame, known: DataFrame, limits: dict[float, int]) -> DataFrame:
    """word, most, near, uses, cost: the known words (word, uses) within the distance most of those
    asked for, and their distance.

    asked has word, most and the least uses of a known word; limits has every distance that occurs
    and the fewest uses that are asked for within it. Both sides meet at keys, never as a product.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, len(b), 1000):
                own = b.slice(part, 1000)
                rows = [(i, k) for i, (w, most) in enumerate(zip(own["word"].to_pylist(), own["most"].to_pylist())) for k in keys_of(w, most, True)]
                if rows:
                    at, keys = zip(*rows)
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(own[c].take(at) for c in ("word", "most", "least"))], ["key", "word", "most", "least"])

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, len(b), 1000):
                own = b.slice(part, 1000)
                rows = [(i, k) for i, (w, n) in enumerate(zip(own["word"].to_pylist(), own["uses"].to_pylist())) for most, least in limits.items() if n >= least for k in keys_of(w, most, False)]
                if rows:
                    at, keys = zip(*rows)
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), own["word"].take(at), own["uses"].take(at)], ["key", "near", "uses"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b["word"].to_pylist(), b["near"].to_pylist(), b["most"].to_pylist())
            costs = [0.0 if w == c else next((x for _, x in Vocabulary({c: 1}, ()).candidates(w, most)), None) for w, c, most in rows]
            b = b.append_column("cost", pa.array(costs, pa.float64()))
            yield b.filter(b["cost"].is_valid())

    asks = asked.mapInArrow(ask, "key bigint, word string, most double, least bigint")
    offers = known.where(F.col("uses") >= min(limits.values())).mapInArrow(offer, "key bigint, near string, uses bigint")
    met = asks.join(offers, "key").where(F.col("uses") >= F.col("least")).select("word", "most", "near", "uses").distinct()
    return met.mapInArrow(within, "word string, most double, near string, uses bigint, cost double")


class Vocabulary:
    """Words with their uses, as a trie, and the known pairs of words.

    The trie lies over the sorted words: a node is a range of words with one beginning and finds
    its children by bisection when it is first visited. So the whole is about as large as the words
    themselves (README gives the figures at the bound).
    """

    def __init__(self, words: dict[str, int], pairs):
        self.names = sorted(words)
        self.uses = array("q", [words[w] for w in self.names])
        self.pairs = array("q", sorted(pairs))
        self._prepare()

    def packed(self) -> bytes:
        return pickle.dumps((self.names, self.uses, self.pairs), protocol=5)

    @classmethod
    def unpacked(cls, data: bytes) -> Vocabulary:
        own = cls.__new__(cls)
        own.names, own.uses, own.pairs = pickle.loads(data)
        own._prepare()
        return own

    def _prepare(self) -> None:
        self.root, self.nodes = [0, len(self.names), 0, None], 0
        self.read_as: dict[str, list[tuple[str, str]]] = {}
        for wrong, printed in CONFUSED:
            self.read_as.setdefault(wrong[0], []).append((wrong, printed))
        self.found: dict[tuple[str, float], list[tuple[str, float]]] = {}

    def uses_of(self, word: str) -> int:
        """Uses of a word, 0 if it is unknown."""
        at = bisect_left(self.names, word)
        return self.uses[at] if at < len(self.names) and self.names[at] == word else 0

    def children(self, node: list) -> dict[str, list]:
        """The node's children by their letter. Nodes are [first word, last + 1, depth, children]."""
        at, end, depth, known = node
        if known is None:
            known, names = {}, self.names
            if at < end and len(names[at]) == depth:
                at += 1
            while at < end:
                to = bisect_right(names, names[at][: depth + 1] + "\U0010ffff", at, end)
                known[names[at][depth]] = [at, to, depth + 1, None]
                at = to
            node[3] = known
            self.nodes += 1
        return known

    def candidates(self, token: str, most: float) -> list[tuple[str, float]]:
        """All words within the weighted distance, each with its distance.

        The states of the automaton are places in the token with the distance so far; it runs over
        the trie, so that every prefix shared by words is read once. Confusions cost CONFUSION, any
        other insertion, deletion or replacement EDIT.
        """
        known = self.found.get((token, most))
        if known is not None:
            return known
        if self.nodes > MAX_NODES:
            self.root, self.nodes = [0, len(self.names), 0, None], 0
        best: dict[str, float] = {}
        seen: dict[tuple[int, int], float] = {}
        stack = [(0, self.root, 0.0)]
        n, names = len(token), self.names
        while stack:
            at, node, cost = stack.pop()
            key = (at, id(node))
            if seen.get(key, most + 1) <= cost:
                continue
            seen[key] = cost
            kids = node[3] if node[3] is not None else self.children(node)
            if at == n:
                if node[0] < node[1] and len(word := names[node[0]]) == node[2] and best.get(word, most + 1) > cost:
                    best[word] = cost
            else:
                c = token[at]
                if c in kids:
                    stack.append((at + 1, kids[c], cost))
                if cost + CONFUSION <= most:
                    for wrong, printed in self.read_as.get(c, ()):
                        if token.startswith(wrong, at):
                            to = node
                            for x in printed:
                                to = self.children(to).get(x)
                                if to is None:
                                    break
                            else:
                                stack.append((at + len(wrong), to, cost + CONFUSION))
                if cost + EDIT <= most:
                    stack.append((at + 1, node, cost + EDIT))
            if cost + EDIT <= most:
                for x, to in kids.items():
                    stack.append((at, to, cost + EDIT))
                    if at < n and x != token[at]:
                        stack.append((at + 1, to, cost + EDIT))
        found = sorted(best.items(), key=lambda x: (x[1], x[0]))
        if len(self.found) > 200_000:
            self.found.clear()
        self.found[token, most] = found
        return found

    def holds(self, key: int) -> bool:
        at = bisect_left(self.pairs, key)
        return at < len(self.pairs) and self.pairs[at] == key

    def beside(self, pair: str) -> bool:
        return self.holds(key_of(pair))

    def fit(self, before: str, word: str, after: str) -> int:
        """How many of the two neighbours the word is known to stand beside."""
        return (bool(before) and self.beside(f"{before} {word}")) + (bool(after) and self.beside(f"{word} {after}"))

    def printed(self, word: str, before: str, after: str, strict: bool = False) -> str | None:
        """The word that was printed where this one was read, or None if it is right or unknown.

        strict takes no word that isn't known beside a neighbour.
        """
        if own := self.uses_of(word):
            others = [c for c, _ in self.candidates(word, 2 * CONFUSION) if c != word]
            if not others or self.fit(before, word, after):
                return None
            sure = [c for c in others if self.fit(before, c, after) == 2 and self.uses_of(c) >= own]
            return max(sure, key=self.uses_of) if sure else None
        found = self.candidates(word, MOST)
        best = max(found, key=lambda c: (self.fit(before, c[0], after) - 1.5 * c[1], self.uses_of(c[0])))[0] if found else None
        if best and self.fit(before, best, after):
            return best
        return self.edited(word, before, after) or (None if strict or len(word) <= 3 else best)

    def edited(self, word: str, before: str, after: str) -> str | None:
        """The only frequent word within the free edits that is known beside both neighbours.

        A letter more or less at the end is more often another form of the word than misread.
        """
        if not (before and after):
            return None
        for most, letters in FREE:
            if len(word) < letters:
                return None
            sure = [c for c, _ in self.candidates(word, most) if self.uses_of(c) >= FREE_USES and self.fit(before, c, after) == 2]
            if sure:
                return sure[0] if len(sure) == 1 and word[:-1] != sure[0] and word != sure[0][:-1] else None
        return None


class Widened(Vocabulary):
    """The vocabulary all workers hold with what the others know of one result's words and pairs.

    near has the further candidates for its words, pairs its further pairs. Notes what is asked for
    in vain. Without near there are no candidates at all, to see quickly which words are asked for.
    """

    def __init__(self, shared: Vocabulary, near: list[dict] | None, pairs):
        self.shared, self.blind, self.more_pairs = shared, near is None, frozenset(pairs)
        self.more = {x["near"]: x["uses"] for x in near or ()}
        self.near: dict[str, list[tuple[str, float]]] = {}
        for x in near or ():
            self.near.setdefault(x["word"], []).append((x["near"], x["cost"]))
        self.missed_words: set[str] = set()
        self.missed_pairs: set[int] = set()

    def uses_of(self, word: str) -> int:
        uses = self.shared.uses_of(word) or self.more.get(word, 0)
        if not uses:
            self.missed_words.add(word)
        return uses

    def candidates(self, token: str, most: float) -> list[tuple[str, float]]:
        if self.blind:
            return []
        held, more = self.shared.candidates(token, most), self.near.get(token)
        return sorted(held + [x for x in more if x[1] <= most], key=lambda x: (x[1], x[0])) if more else held

    def holds(self, key: int) -> bool:
        held = key in self.more_pairs or self.shared.holds(key)
        if not held:
            self.missed_pairs.add(key)
        return held


# ---- one result ----


def as_number(text: str) -> int | None:
    digits = text.translate(_LIKE_DIGIT)
    return int(digits) if digits.isdigit() else None


def beside_number(line: str) -> Iterator[re.Match]:
    """Numerals in front of and behind other text of a line."""
    if line and line[0] in _DIGITS and (m := _NUMBER_FIRST.match(line)):
        yield m
    if line and line[-1] in _DIGITS and (m := _NUMBER_LAST.search(line)):
        yield m


def title_key(line: str) -> str:
    """A running title without its number, misread characters folded together."""
    flat = _NUMBER_LAST.sub("", _NUMBER_FIRST.sub("", line.strip())).upper()
    for a, b in (("0", "O"), ("1", "I"), ("L", "I"), ("5", "S"), ("9", "G"), ("6", "B"), ("8", "B"), ("F", "E")):
        flat = flat.replace(a, b)
    return re.sub(r"[\W_]+", " ", flat).strip()


def alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 5:
        return False
    return sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b)) <= max(1, len(a) // 8)


class Furniture:
    """Running titles and page numbers of one result: line number -> kind."""

    DEEP = 3

    def __init__(self, lines: list[str]):
        self.kinds: dict[int, str] = {}
        heads = [i for i, x in enumerate(lines) if _PAGE.match(x)]
        self.pages = []
        for k, (a, b) in enumerate(zip(heads, [*heads[1:], len(lines)])):
            filled = [i for i in range(a + 1, b) if lines[i].strip()]
            if filled:
                self.pages.append((k, filled))
        if not self.pages:
            return
        self.order = {k: at for at, (k, _) in enumerate(self.pages)}
        texts = [lines[i].rstrip() for _, f in self.pages for i in f]
        widths = sorted(map(len, texts))
        self.width = widths[int(len(widths) * 0.9)] if widths else 0
        #: Wide results aren't set in lines, paragraphs stand on one line each: shape alone shows no title.
        self.set_in_lines = self.width <= 110
        self.lines = lines
        self.numbers()
        self.titles()

    def edges(self, filled: list[int]) -> list[tuple[int, int]]:
        """The outer lines of a page: (line number, place); places from the top 0, 1, from the end -1, -2."""
        n = len(filled)
        top = [(filled[k], k) for k in range(min(self.DEEP, n))]
        return top + [(filled[-1 - k], -1 - k) for k in range(min(self.DEEP, n)) if n - 1 - k >= self.DEEP]

    def numbers(self) -> None:
        """Lines with nothing but a number, by the sequence of the pages where there is one."""
        found, votes = [], Counter()
        for k, filled in self.pages:
            for i, place in self.edges(filled):
                line = self.lines[i].strip()
                m = _NUMBER_LINE.match(line)
                if m and (number := as_number(m[1])) is not None:
                    plain = any(c.isdigit() for c in m[1])
                    found.append((k, i, place, number, plain, line))
                    if plain and not re.fullmatch(r"\d+[.,;:]", line):
                        votes[number - k] += 1
                else:
                    for m in beside_number(line):
                        if any(c.isdigit() for c in m[1]) and (number := as_number(m[1])) is not None:
                            votes[number - k] += 1
        self.offset = votes.most_common(1)[0][0] if votes else None
        for k, i, place, number, plain, line in found:
            ended = re.fullmatch(r"\w+[.,;:]", line) is not None
            fits = self.offset is not None and number == self.offset + k
            if place in (0, -1) and (fits or (plain and not ended and votes[self.offset] <= 1)) and not (ended and not fits):
                self.kinds[i] = "page_number"
            elif fits and not ended and place in (1, -2):
                self.kinds[i] = "page_number"
            elif place in (0, -1) and plain and not ended and self.near(number, k):
                self.kinds[i] = "page_number"

    def near(self, number: int, k: int) -> bool:
        """A number of as many digits as the expected one that differs in one of them."""
        if self.offset is None:
            return True
        a, b = str(number), str(self.offset + k)
        return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 1

    def titles(self) -> None:
        """The outermost unfilled line without an end at the edge where the pages have them."""
        found = []
        for k, filled in self.pages:
            body = [i for i in filled if i not in self.kinds]
            for side, order in (("top", body), ("end", body[::-1])):
                for depth, i in enumerate(order[:2]):
                    if shape := self.titled(body, i, side, k):
                        found.append((k, side, depth, i, self.numbered(self.lines[i].strip(), k), title_key(self.lines[i]), shape))
        # titles that recur at their edge, numbers aside, are certain
        groups: list[list] = []
        exact: dict[tuple, list] = {}
        for x in found:
            if x[5]:
                own = exact.get((x[1], x[5])) or next((g for g in groups if g[0][1] == x[1] and alike(g[0][5], x[5])), None)
                if own is None:
                    groups.append(own := [])
                own.append(x)
                exact[x[1], x[5]] = own
        sure = [x for g in groups for x in g if len({y[0] for y in g}) > 1 or x[4]]
        sides = Counter(x[1] for x in sure)
        if not sides and self.set_in_lines:
            sides = Counter(x[1] for x in found if x[6] > 1 and x[2] == 0)
        side = sides.most_common(1)[0][0] if sides else None
        numbered = any(x[4] for x in sure)
        done = set()
        for x in sorted(sure, key=lambda x: x[2]):
            if x[1] == side and x[0] not in done:
                self.kinds[x[3]] = "header"
                done.add(x[0])
        for x in found if self.set_in_lines else ():
            if x[6] >= (1 if sure else 2) and x[1] == side and x[2] == 0 and x[0] not in done and not numbered:
                self.kinds[x[3]] = "header"
                done.add(x[0])

    def numbered(self, line: str, k: int) -> bool:
        """Whether the line holds the page's own printed number beside a title."""
        for m in beside_number(line):
            if len(line) > len(m[0]) and (number := as_number(m[1])) is not None and (self.offset is None or number == self.offset + k or self.near(number, k)):
                return True
        return False

    def titled(self, body: list[int], i: int, side: str, k: int) -> int:
        """Shape of a title: 1 if it begins with a capital or a number, doesn't end and leaves room
        for the next word; 2 if it also is written as a title or holds the page's number."""
        line = self.lines[i].strip()
        if len(line) > 100 or _ENDS.search(re.sub(r"\.{3,}\s*\w+$", "", line)) or line[0] in "#|>*-" or line[-1] in HYPHENS:
            return 0
        if self.numbered(line, k):
            return 2
        first = next((c for c in line if c.isalpha()), "")
        if not first or not (first.isupper() or line[0].isdigit() or (first == "l" and line[1:2].islower())):
            return 0
        if re.search(r"\d{3,}$", line):
            return 0  # ends with a number that isn't the page's
        following = self.lines[body[body.index(i) + 1]].split() if i != body[-1] else self.next_page(k)
        room = bool(following) and len(line) + 1 + len(following[0]) <= self.width
        words = line.split()
        upper = sum(c.isupper() for c in line) > 0.7 * sum(c.isalpha() for c in line)
        capitals = sum(w[:1].isupper() for w in words) * 2 > len(words)
        if len(words) < 2 or not (room or upper):
            return 0
        return 2 if upper or capitals else int(len(line) <= 0.7 * self.width)

    def next_page(self, k: int) -> list[str]:
        at = self.order[k] + 1
        if at == len(self.pages):
            return ["x"]
        inner = [i for i in self.pages[at][1] if i not in self.kinds]
        return self.lines[inner[1]].split() if len(inner) > 1 else []


class Repairer:
    """Finds and repairs the noise of one result after another with a shared vocabulary; or of one
    result with a widened one, for which shared judges all words that workers hold."""

    def __init__(self, vocabulary: Vocabulary, shared: Repairer | None = None):
        self.v, self.shared = vocabulary, shared
        self.status: dict[str, tuple[str, int]] = {}

    def judged(self, token: str) -> tuple[str, int]:
        """Word of a token and 0 (right), 1 (unknown) or 2 (known, but easily confused)."""
        if self.shared:
            word, state = self.shared.judged(token)
            if state == 1 or (len(word) == 1 and word.isalpha() and word < "⺀"):
                state = (2 if len(self.v.candidates(word, 2 * CONFUSION)) > 1 else 0) if self.v.uses_of(word) else int(len(word) > 1)
            return word, state
        got = self.status.get(token)
        if got is None:
            word = word_of(token)
            if not word or not any(c.isalpha() for c in word) or any("⺀" <= c for c in word):
                got = (word, 0)
            elif self.v.uses_of(word):
                got = (word, 2 if len(self.v.candidates(word, 2 * CONFUSION)) > 1 else 0)
            else:
                got = (word, 1 if len(word) > 1 else 0)
            if len(self.status) > 300_000:
                self.status.clear()
            self.status[token] = got
        return got

    def whole(self, first: str, second: str, before: str, after: str) -> str:
        """The word whose parts end one line and begin the next."""
        a, b = bare(first), bare(second)
        joined, compound = a + b, f"{a}-{b}"
        for word in (joined, compound):
            if self.v.uses_of(word):
                return word
        best = None
        for word in (joined, compound):
            for c, cost in self.v.candidates(word, MOST):
                rank = (self.v.fit(before, c, after) - 1.5 * cost, self.v.uses_of(c))
                if best is None or rank > best[0]:
                    best = (rank, c)
        if best:
            return best[1]
        parts = [self.v.uses_of(x) for x in (a, b)]  # both are asked for, whatever one gives
        return compound if all(parts) and len(a) > 2 and len(b) > 2 else joined

    def find(self, text: str) -> list[tuple[int, str, str]]:
        """(line number, kind, fixed) of all noise; distinct, in order."""
        lines = text.split("\n")
        kinds = Furniture(lines).kinds
        rows = [(i, kind, "") for i, kind in kinds.items()]
        body = [i for i, x in enumerate(lines) if i not in kinds and x.strip() and not _PAGE.match(x)]
        split = {i: lines[i].split() for i in body}
        skip_first, before = False, ""
        for at, i in enumerate(body):
            tokens = split[i]
            following = split[body[at + 1]] if at + 1 < len(body) else []
            last, broken = tokens[-1], False
            if last[-1] in HYPHENS and len(last) > 1 and last[-2].isalnum() and following and following[0][:1].isalnum() and not (skip_first and len(tokens) == 1):
                broken = True
                left = bare(tokens[-2]) if len(tokens) > 1 else before
                rows.append((i, "hyphen", self.whole(last[:-1], following[0], left, bare(following[1]) if len(following) > 1 else "")))
            judged = [self.judged(t) for t in tokens]
            first, end = int(skip_first), len(tokens) - broken
            unknown = sum(s == 1 for _, s in judged[first:end])
            # where most words are unknown (another language, a formula) a word must fit beside its neighbours
            strict = 2 * unknown > end - first > 3
            for k in range(first, end):
                word, state = judged[k]
                if state:
                    left = judged[k - 1][0] if k > 0 else before
                    after = judged[k + 1][0] if k + 1 < len(tokens) else (bare(following[0]) if following else "")
                    if k == end - 1 and broken:
                        after = ""
                    fixed = self.v.printed(word, left, after, strict)
                    if fixed:
                        rows.append((i, "misread", fixed))
            skip_first = broken
            before = "" if broken else judged[-1][0]
        return sorted(set(rows))

    def repaired(self, text: str) -> str:
        """Continuous paragraphs: furniture removed, words joined and corrected, lines reflowed.

        Page headings of the engine go with the lines around them; a blank line keeps a paragraph apart, unless
        the page turns in the middle of a sentence.
        """
        lines = text.split("\n")
        noise: dict[int, list[tuple[str, str]]] = {}
        for i, kind, fixed in self.find(text):
            noise.setdefault(i, []).append((kind, fixed))
        paragraphs: list[list[str]] = [[]]
        carry, turned = "", False
        for i, line in enumerate(lines):
            own = noise.get(i, [])
            if any(k in ("header", "page_number") for k, _ in own) or _PAGE.match(line):
                turned = True
                continue
            tokens = line.split()
            if not tokens:
                open_end = paragraphs[-1] and not re.search(r"[.!?:。！？][\"'”’»)]*$", paragraphs[-1][-1])
                if paragraphs[-1] and not carry and not (turned and open_end):
                    paragraphs.append([])
                continue
            turned = False
            fixes = [f for k, f in own if k == "misread"]
            if fixes:
                tokens = [self.replaced(t, fixes) for t in tokens]
            if carry:
                tail = tokens[0][len(tokens[0].rstrip(_EDGES)) :]
                tokens[0], carry = carry + tail, ""
            joined = next((f for k, f in own if k == "hyphen"), None)
            if joined:
                head = tokens.pop()
                lead = head[: len(head) - len(head.lstrip(_EDGES))]
                carry = lead + (joined.capitalize() if head[len(lead) : len(lead) + 1].isupper() else joined)
            paragraphs[-1].extend(tokens)
        if carry:
            paragraphs[-1].append(carry)
        return "\n\n".join(" ".join(p) for p in paragraphs if p)

    def replaced(self, token: str, fixes: list[str]) -> str:
        word, state = self.judged(token)
        if state:
            limits = [MOST, *(most for most, letters in FREE if len(word) >= letters)] if state == 1 else [2 * CONFUSION]
            for most in limits:
                c = next((c for c, _ in self.v.candidates(word, most) if c in fixes and c != word and (state == 1 or self.v.uses_of(c) >= self.v.uses_of(word))), None)
                if c:
                    core = token.strip(_EDGES)
                    new = c.upper() if core.isupper() and len(core) > 1 else c.capitalize() if core[:1].isupper() else c
                    return token.replace(core, new, 1)
        return token


_REPAIRERS: dict[int, Repairer] = {}


def _repairer(data: bytes) -> Repairer:
    key = hash(data)
    if key not in _REPAIRERS:
        _REPAIRERS.clear()
        _REPAIRERS[key] = Repairer(Vocabulary.unpacked(data))
    return _REPAIRERS[key]


def _own(data: bytes, near: list | None, pairs: list | None) -> Repairer:
    """The repairer of a result with candidates and pairs of its own."""
    shared = _repairer(data)
    return Repairer(Widened(shared.v, near or [], pairs or ()), shared) if near or pairs else shared


def _scans(results: DataFrame) -> tuple[DataFrame, Broadcast]:
    """parse_id, markdown, near, pairs of every pdf result, and the vocabulary all workers hold.

    near and pairs are null if that is all. Otherwise they are what the result needs of the rest:
    each is read to see which words it asks for in vain; all further candidates for them, themselves
    too, are found by a join at common keys (near_words). It is read again with these to see which
    pairs it asks for. Words of the rest are less used than held ones, so they never replace one and
    held ones aren't asked for. Texts stand for results: copies need the same.
    """
    data, rest = vocabulary(results)
    shared = results.sparkSession.sparkContext.broadcast(data)
    scans = results.select("parse_id", "doc_format", "markdown").where("doc_format = 'pdf' and markdown is not null").select("parse_id", "markdown")
    near_type, pairs_type = "array<struct<word:string,near:string,uses:bigint,cost:double>>", "array<bigint>"
    if rest is None:
        return spread(scans).withColumns({"near": F.lit(None).cast(near_type), "pairs": F.lit(None).cast(pairs_type)}), shared

    def missing(what: str, kind: pa.DataType):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _repairer(shared.value)
            for b in batches:
                at, asked = [], []
                for i, (text, near) in enumerate(zip(b["markdown"].to_pylist(), b["near"].to_pylist())):
                    own = Widened(held.v, None if what == "word" else near or [], ())
                    Repairer(own, held).find(text)
                    missed = own.missed_words if what == "word" else own.missed_pairs
                    at.extend([i] * len(missed))
                    asked.extend(missed)
                if at:
                    yield pa.RecordBatch.from_arrays([b["text"].take(pa.array(at)), pa.array(asked, kind)], ["text", what])

        return ask

    scans = scans.withColumn("text", F.xxhash64("markdown"))
    words, pairs = rest.where("word is not null").select("word", "uses"), rest.where("pair is not null").select("pair")
    known = spread(scans).withColumn("near", F.lit(None).cast(near_type))
    if not words.isEmpty():
        asked = durable(known.mapInArrow(missing("word", pa.string()), "text bigint, word string").distinct())
        each = asked.select("word").distinct()
        wanted = each.select("word", F.lit(MOST).alias("most"), F.lit(FEWEST).cast("bigint").alias("least"))
        limits = {MOST: FEWEST}
        if not words.where(F.col("uses") >= FREE_USES).isEmpty():
            for most, letters in FREE:
                wanted = wanted.union(each.where(F.length("word") >= letters).select("word", F.lit(most), F.lit(FREE_USES).cast("bigint")))
                limits[most] = FREE_USES
        near = near_words(wanted, words, limits).groupBy("word", "near", "uses").agg(F.min("cost").alias("cost"))
        of_text = asked.join(near, "word").groupBy("text").agg(F.collect_list(F.struct("word", "near", "uses", "cost")).alias("near"))
        known = scans.join(durable(of_text), "text", "left")
    if pairs.isEmpty():
        return known.withColumn("pairs", F.lit(None).cast(pairs_type)), shared
    asked = known.mapInArrow(missing("pair", pa.int64()), "text bigint, pair bigint").distinct()
    return known.join(asked.join(pairs, "pair").groupBy("text").agg(F.collect_list("pair").alias("pairs")), "text", "left"), shared


def scan_noise(results: DataFrame) -> DataFrame:
    """parse_id, line_no, kind, fixed: the noise of every pdf result.

    Kinds are header, page_number, hyphen and misread. Null and blank texts and results set in
    paragraphs without noise give no rows; repeated results give their rows each; a line can have
    several misread words but equal rows are given once; other formats only feed the vocabulary.
    Flags of an unreliable text layer are not used: some are missing and some are wrong.
    """
    ship(results.sparkSession)
    scans, shared = _scans(results)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, (text, near, pairs) in enumerate(zip(*(b[c].to_pylist() for c in ("markdown", "near", "pairs")))):
                found = _own(shared.value, near, pairs).find(text)
                at.extend([i] * len(found))
                rows.extend(found)
            if rows:
                n, k, f = zip(*rows)
                yield pa.RecordBatch.from_arrays([b["parse_id"].take(pa.array(at)), pa.array(n, pa.int32()), pa.array(k, pa.string()), pa.array(f, pa.string())], ["parse_id", "line_no", "kind", "fixed"])

    return scans.mapInArrow(find, "parse_id bigint, line_no int, kind string, fixed string")


def repaired_texts(results: DataFrame) -> DataFrame:
    """parse_id, text: every pdf result as continuous paragraphs with the printed words."""
    ship(results.sparkSession)
    scans, shared = _scans(results)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_own(shared.value, near, pairs).repaired(x) for x, near, pairs in zip(*(b[c].to_pylist() for c in ("markdown", "near", "pairs")))]
            yield pa.RecordBatch.from_arrays([b["parse_id"], pa.array(texts, pa.string())], ["parse_id", "text"])

    return scans.mapInArrow(repair, "parse_id bigint, text string")
