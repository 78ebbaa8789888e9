"""Main bodies of web pages: tree scoring of blocks, with what recurs over pages as evidence.

A page is a tree: the page, its containers (what stands in front of the title, and each heading with
what follows it), their blocks. A block earns points for its length and commas, discounted by its
link density; menus, link lists, controls and furniture earn none. Points go to the container,
where its own link density discounts them again, and, halved, to the page. The best container is
kept with the siblings that reach a share of its score; a sibling under it is kept only if its
blocks earn about as evenly as those of the best one, and it isn't several texts under a heading
that recurs; what stands in front of a title needs the share itself. All other containers go with
their headings; containers of tables alone, empty ones and the title's are never dropped. Between
the first and last block with points, plain lists, code and lines without a full stop are kept too.

A block whose wording (numbers and names aside) recurs beside many different articles is furniture
of the sites; a menu is known by its labels in the same way. It counts by host, beside at least
HOST_SHARE of the host's articles, and over all pages, beside at least RECURRING of them, so there
are fewer than (blocks a page) / share of either, however many pages there are. An article is known
by its title and longest block, so that copies of one under many addresses don't make its own
paragraphs recur. No wording is known beforehand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.operators.joins import salted_left_join
from inkgrove.session import durable, ship, spread

WEB_FORMATS = ("html", "url")
#: Share of all pages on which a wording must stand to count as recurring, and the fewest pages.
RECURRING, FEWEST = 0.001, 3
#: The same share of one host's pages.
HOST_SHARE = 0.05
#: Share of the best container's score that a section needs, and share of its points a block.
SIBLING, EVEN = 0.2, 0.15
#: More wordings than this would not be shared with the workers.
MAX_WORDINGS = 2_000_000
#: More wordings of single hosts than this are joined to their pages instead of shared.
MAX_SHARED = 200_000

_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_BREAK = re.compile(r"\n{2,}")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_HEADING = re.compile(r"#{1,6} ")
_MARKER = re.compile(r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+")
_ENDED = re.compile(r"""[.!?。！？…:;]["'”’»）)\]]*$""")
_SENTENCE = re.compile(r"""[.!?。！？…]["'”’»）)]*(?=\s|$)|[。！？]""")
_DIVIDED = re.compile(r" [|·•>›»/] ")
_NUMBER = re.compile(r"\d+")
_NAME = re.compile(r"(?<=[^.!?\s] )[A-ZÄÖÜÉÀÁÓÍÑ][^\W\d_]+|(?<=[一-鿿])[A-Z][a-z]+")
#: A name at the beginning is known by its coming again.
_FIRST_NAME = re.compile(r"^([A-ZÄÖÜÉÀÁÓÍÑ][^\W\d_]+)\b(?=.*\b\1\b)", re.S)
#: Check boxes, buttons (labels in brackets without a target), links into the page itself, marks of
#: copyright and of the way up: controls of a site in any language.
_CONTROL = re.compile(r"\[[ x]?\](?!\()|\[[^\]\n]{1,24}\]$|\]\(#[^)\n]*\)|^©|[↑⇧▲]$")
_COMMA = re.compile(r"[,，、;；]")
_TABLE = re.compile(r"\|.*\n\|[ :|-]+\|?(?:\n|$)")

def blocks_of(text: str) -> list[str]:
    """Trimmed, non-empty parts between runs of two or more line feeds."""
    return [x for x in (b.strip() for b in _BREAK.split(text)) if x]


def wording(block: str) -> int:
    """64-bit key of a block without its numbers and names (capitals inside, or first and again)."""
    flat = _NAME.sub("N", _FIRST_NAME.sub("N", _NUMBER.sub("0", block)))
    return xxhash.xxh3_64_intdigest(flat) - (1 << 63)


def link_density(block: str) -> tuple[float, str]:
    """Share of the visible characters that are link text; the visible text."""
    if "](" not in block:
        return 0.0, block
    inside = sum(len(m[1].strip()) for m in _LINK.finditer(block))
    visible = _LINK.sub(r"\1", block)
    bare = len(_MARKER.sub("", visible).replace("·", "").strip())
    return (min(1.0, inside / bare) if bare else 1.0), visible


def labels_of(block: str) -> list[str]:
    """The labels of a menu: short, one a line or divided by marks, none of them a sentence."""
    lines = block.split("\n")
    parts = lines if len(lines) > 1 else _DIVIDED.split(block)
    if len(parts) > 1 and all(len(p) <= 40 and not _ENDED.search(p) for p in parts):
        return [_MARKER.sub("", p) for p in parts]
    return []


def link_list(block: str) -> bool:
    """Every line is a list entry."""
    return all(_MARKER.match(x) for x in block.split("\n"))


def labels_only(block: str) -> bool:
    """The links' texts are labels of a word or two, as in a menu, not titles."""
    texts = [m[1].strip() for m in _LINK.finditer(block)]
    wide = sum(len(x.encode()) for x in texts)
    return wide <= 16 * len(texts)


def points(block: str) -> float:
    """What a block of running text earns; 0 for link lists, menus and lines without a sentence."""
    if block[0] == "|" and _TABLE.match(block):
        return 1.0
    density, visible = link_density(block)
    if density >= 0.5:
        return 0.0
    flat = _MARKER.sub("", visible)
    if not _SENTENCE.search(flat):
        return 0.0
    return (1.0 + len(_COMMA.findall(flat)) + min(len(flat) / 100, 3.0)) * (1.0 - density)


def table(block: str) -> bool:
    return block[0] == "|" and bool(_TABLE.match(block))


def furniture(block: str, recurring: frozenset | set | Evidence) -> bool:
    """Whether a block recurs, is a menu of labels that mostly recur, or is a control."""
    if table(block):
        return False
    if wording(block) in recurring or _CONTROL.search(block):
        return True
    labels = labels_of(_LINK.sub(r"\1", block))
    return 2 * sum(wording(x) in recurring for x in labels) > len(labels)


def far_sections(blocks: list[str], sections: list[list[int]], heading: list[bool], prompt: list[bool], earned: list[float], density: list[float], common: list[bool], title: int) -> set[int] | None:
    """Sections with text that are no siblings of the best container; None if nothing earned points.

    A section without any points (a title, a heading before another) is judged by its blocks alone.
    """
    scores, even = [], []
    for own in sections:
        # lists of linked titles are judged by their own rule
        inner = [i for i in own if not heading[i] and not prompt[i] and not (density[i] >= 0.5 and link_list(blocks[i]))]
        size = sum(len(blocks[i]) for i in inner)
        linked = sum(density[i] * len(blocks[i]) for i in inner)
        scores.append(sum(earned[i] for i in inner) * (1.0 - linked / size if size else 1.0))
        # tables earn a fixed point and lines of links none; they say nothing about the blocks around them
        texts = [i for i in inner if blocks[i][0] != "|" and density[i] < 0.5]
        even.append(sum(earned[i] for i in texts) / len(texts) if texts else 0.0)
    best = max(range(len(sections)), key=scores.__getitem__)
    if scores[best] <= 0:
        return None
    # points go up to the page halved; if it is the best container, its sections are measured by their mean
    page = sum(scores) / 2
    least = SIBLING * (page / sum(x > 0 for x in scores) if page > scores[best] else scores[best])
    level = EVEN * even[best]
    far = set()
    for k, own in enumerate(sections):
        if own and own[0] < title and k != best and scores[k] < least:
            far.add(k)  # in front of the title
        elif 0 < scores[k] < least and even[k] and heading[own[0]] and own[0] != title:
            # copies of an article make its own headings recur, so a recurring one counts only over several texts
            several = sum(earned[i] > 0 and blocks[i][0] != "|" for i in own) > 1
            if even[k] < level or (common[own[0]] and several):
                far.add(k)
    return far


def outside(blocks: list[str], recurring: frozenset | set | Evidence) -> list[int]:
    """Numbers of the blocks outside the main body."""
    n = len(blocks)
    if not n:
        return []
    heading = [bool(_HEADING.match(b)) for b in blocks]
    prompt = [not h and furniture(b, recurring) for b, h in zip(blocks, heading)]
    earned = [0.0 if h or p else points(b) for b, h, p in zip(blocks, heading, prompt)]
    density = [0.0 if h else link_density(b)[0] for b, h in zip(blocks, heading)]
    links = [x >= 0.5 for x in density]
    listed = [x and link_list(b) for x, b in zip(links, blocks)]
    common = [h and wording(b) in recurring for b, h in zip(blocks, heading)]
    title = next((i for i in range(n) if blocks[i].startswith("# ")), -1)
    # a heading announces other stories if links follow and its wording recurs; text behind the links goes on
    # above. Where the host has shown nothing yet, also if nothing else in its container has points
    lone = not getattr(recurring, "own", None)
    announces, texts = [False] * n, 0
    for i in range(n - 1, -1, -1):
        texts += earned[i] > 0
        if heading[i]:
            announces[i] = i != title and i + 1 < n and listed[i + 1] and (common[i] or (lone and not texts))
            texts = 0
    sections: list[list[int]] = [[]]
    for i in range(n):
        if heading[i] and not announces[i]:
            sections.append([])
        sections[-1].append(i)
    far = far_sections(blocks, sections, heading, prompt, earned, density, common, title)
    if far is None:
        return list(range(n))
    gone = {i for k in far for i in sections[k]}
    keep = [earned[i] > 0 and i not in gone for i in range(n)]
    texts = [i for i in range(n) if keep[i]]
    first, last = (texts[0], texts[-1]) if texts else (n, -1)
    # a list that the text announces belongs to it
    while last >= 0 and last + 2 < n and not any(prompt[last + 1 : last + 3]) and not heading[last + 1] and blocks[last + 1][-1] in ":：" and link_list(blocks[last + 2]) and not listed[last + 2]:
        last += 2
    for i in range(n):
        if i in gone:
            continue
        if heading[i]:
            keep[i] = not announces[i]
        elif prompt[i]:
            continue
        elif listed[i]:
            # a list of linked titles is a sibling of the text around it, a menu or an announced list is not
            keep[i] = (i == 0 or keep[i - 1] or not heading[i - 1]) and not labels_only(blocks[i])
        elif not links[i] and not keep[i]:
            # no points, but inside the container of the text
            keep[i] = first < i <= last
    # a title without a mark: the last plain line in front of the first kept block
    if title < 0:
        start = next((i for i in range(n) if keep[i]), n)
        for i in range(start - 1, -1, -1):
            if not (prompt[i] or links[i] or heading[i] or "\n" in blocks[i] or labels_of(blocks[i])):
                keep[i] = True
                break
    return [i for i in range(n) if not keep[i]]


def article(blocks: list[str]) -> int:
    """Key of the article on a page: its title, if it has one, and its longest block."""
    title = next((b for b in blocks if b.startswith("# ")), "")
    return xxhash.xxh3_64_intdigest(f"{title}\n{max(blocks, key=len, default='')}") - (1 << 63)


def _pages(results: DataFrame) -> DataFrame:
    web = results.where(F.col("doc_format").isin(*WEB_FORMATS) & F.col("markdown").isNotNull())
    # files and pages without an address have no host
    host = F.nullif(F.regexp_extract(F.lower("source"), _HOST, 1), F.lit(""))
    return spread(web.select("parse_id", host.alias("host"), "markdown"))


def wordings_of_pages(pages: DataFrame) -> DataFrame:
    """host, key, n: beside how many different articles each wording stands; key null: the host's articles.

    Each page sends the keys of its blocks and menu labels once; equal (key, article) pairs meet
    map-side and in the shuffle, so copies count once and a frequent key is spread over all tasks.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, ps, at = [], [], []
            for i, text in enumerate(b["markdown"].to_pylist()):
                blocks = blocks_of(text)
                page = article(blocks)
                found = {k for x in blocks if not table(x) for k in (wording(x), *map(wording, labels_of(_LINK.sub(r"\1", x))))}
                ks.append(None)
                ks.extend(found)
                ps.extend([page] * (len(found) + 1))
                at.extend([i] * (len(found) + 1))
            yield pa.RecordBatch.from_arrays([b["host"].take(pa.array(at, pa.int64())), pa.array(ks, pa.int64()), pa.array(ps, pa.int64())], ["host", "key", "page"])

    seen = pages.select("host", "markdown").mapInArrow(keys, "host string, key bigint, page bigint").distinct()
    return seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))


def recurring_wordings(seen: DataFrame) -> set[int]:
    """Wordings on at least RECURRING of all pages (and FEWEST of them), beside different articles."""
    whole = seen.groupBy("key").agg(F.sum("n").alias("n"))
    total = whole.where("key is null").select("n").first()
    least = max(FEWEST, ceil(RECURRING * (total["n"] if total else 0)))
    often = whole.where(F.col("key").isNotNull() & (F.col("n") >= least)).select("key")
    if often.limit(MAX_WORDINGS + 1).count() > MAX_WORDINGS:
        raise ValueError("more recurring wordings than may be shared")
    return {r["key"] for r in often.toLocalIterator()}


def host_wordings(seen: DataFrame) -> DataFrame:
    """host, keys: the wordings on at least HOST_SHARE of a host's pages (and FEWEST of them)."""
    known = seen.where("host is not null")
    pages = known.where("key is null").select("host", F.col("n").alias("pages"))
    often = known.where(F.col("key").isNotNull() & (F.col("n") >= FEWEST))
    often = salted_left_join(often, pages, "host", "key").where(F.col("n") >= F.ceil(F.col("pages") * HOST_SHARE))
    return often.groupBy("host").agg(F.collect_list("key").alias("keys"))


def _with_evidence(results: DataFrame) -> tuple[DataFrame, Broadcast]:
    """parse_id, markdown and, where they can't be shared, keys: pages with their hosts' wordings;
    the shared wordings of all pages and of each host.

    All hosts' wordings are shared if they are few; otherwise each page gets those of its host by a
    join in which a hot host is salted, so no worker holds more than its pages need.
    """
    pages = _pages(results)
    seen = wordings_of_pages(pages).persist()
    try:
        everywhere = frozenset(recurring_wordings(seen))
        own = host_wordings(seen)
        size = own.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
        if size <= MAX_SHARED:
            hosts = {r["host"]: frozenset(r["keys"]) for r in own.toLocalIterator()}
            return pages.select("parse_id", "host", "markdown").withColumn("keys", F.lit(None).cast("array<bigint>")), results.sparkSession.sparkContext.broadcast((everywhere, hosts))
        own = durable(own)
    finally:
        seen.unpersist()
    joined = salted_left_join(pages.select("parse_id", "host", "markdown"), own, "host", "parse_id")
    return joined.select("parse_id", "host", "markdown", "keys"), results.sparkSession.sparkContext.broadcast((everywhere, {}))


class Evidence:
    """Wordings that recur for the pages of a host: its own and those of all pages."""

    def __init__(self, everywhere: frozenset, hosts: dict[str, frozenset]):
        self.everywhere, self.hosts = everywhere, hosts
        self.own: frozenset = frozenset()

    def of(self, host: str | None, keys: list[int] | None) -> Evidence:
        self.own = frozenset(keys) if keys is not None else self.hosts.get(host, frozenset())
        return self

    def __contains__(self, key: int) -> bool:
        return key in self.everywhere or key in self.own


def judged_blocks(results: DataFrame) -> DataFrame:
    """parse_id, block_no, main, block: every block of every web page and whether it is main body.

    Null and blank texts have no blocks; a page may be all main body or all furniture; repeated
    results are judged each for itself but count once as evidence; pages without an address have
    no host; other formats and columns are ignored.
    """
    ship(results.sparkSession)
    pages, shared = _with_evidence(results)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring = Evidence(*shared.value)
        for b in batches:
            hosts, keys = b["host"].to_pylist(), b["keys"].to_pylist()
            at, no, main, texts = [], [], [], []
            for i, text in enumerate(b["markdown"].to_pylist()):
                blocks = blocks_of(text)
                if blocks:
                    out = set(outside(blocks, recurring.of(hosts[i], keys[i])))
                    at.extend([i] * len(blocks))
                    no.extend(range(len(blocks)))
                    main.extend(k not in out for k in range(len(blocks)))
                    texts.extend(blocks)
            yield pa.RecordBatch.from_arrays([b["parse_id"].take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(np.array(main, bool)), pa.array(texts, pa.string())], ["parse_id", "block_no", "main", "block"])

    return pages.mapInArrow(judge, "parse_id bigint, block_no int, main boolean, block string")


def main_bodies(results: DataFrame) -> DataFrame:
    """parse_id, body: the main body of each web page in its order; pages without one keep out.

    Blocks are joined where they were judged, so nothing is shuffled but the wordings' keys.
    """
    ship(results.sparkSession)
    pages, shared = _with_evidence(results)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring = Evidence(*shared.value)
        for b in batches:
            hosts, keys = b["host"].to_pylist(), b["keys"].to_pylist()
            at, bodies = [], []
            for i, text in enumerate(b["markdown"].to_pylist()):
                blocks = blocks_of(text)
                out = set(outside(blocks, recurring.of(hosts[i], keys[i])))
                if len(out) < len(blocks):
                    at.append(i)
                    bodies.append("\n\n".join(x for k, x in enumerate(blocks) if k not in out))
            yield pa.RecordBatch.from_arrays([b["parse_id"].take(pa.array(at, pa.int64())), pa.array(bodies, pa.string())], ["parse_id", "body"])

    return pages.mapInArrow(join, "parse_id bigint, body string")
