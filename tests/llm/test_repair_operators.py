"""Small cases of main bodies, scan repair and languages."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgrove.llm import boilerplate, langid, scanfix

PAGE = """Skip to content

[Guides](/0) · [Opinion](/1) · [News](/2)

Local > Opinion > Search

{title}

The committee measured the old bridge, the harbour and the canal, and nobody had asked for it. Some years later, it was repaired.

Read also: [The patient bridge and the compass](/other-1)

- [The durable carpenter and the ferry](/harbour)
- [The well-known valley and the storehouse](/visitor)

| a | b |
| --- | --- |
| 1 | 2 |

> In most years, the river was still frozen.

Support Reedmere from only 729 a month.

Privacy, terms of use and imprint are three pages that a club needs before its site goes online.

## Related stories

- [The hand-made barometer and the estuary](/a/85)
- [The central estuary and the turbine](/b/12)

© 2024 Reedmere. All rights reserved."""


@pytest.mark.parametrize("title", ["# The old bridge", "The old bridge and the canal"])
def test_main_body(title):
    blocks = boilerplate.blocks_of(PAGE.format(title=title))
    # nothing marks the request for support on a page alone; it recurs on the site's pages
    assert boilerplate.outside(blocks, set()) == [0, 1, 2, 5, 11, 12, 13] if title[0] == "#" else [1, 2, 5, 11, 12, 13]
    evidence = {boilerplate.wording(x) for x in ("Skip to content", "Support Reedmere from only 12 a month.")}
    assert boilerplate.outside(blocks, evidence) == [0, 1, 2, 5, 9, 11, 12, 13]


def test_page_of_furniture_only_and_page_of_text_only():
    assert boilerplate.outside(["Skip to content", "News | Sport | Shop"], set()) == [0, 1]
    assert boilerplate.outside(["# Title", "A sentence, and another one. It ends here."], set()) == []
    assert boilerplate.outside([], set()) == []


def test_recurring_wording_is_outside(spark):
    text = "# T{0}\n\nThis is the {0} article of many, with its own words about item {0} and nothing else.\n\nOur readers in {0} towns ask for more."
    rows = [(i, f"https://h{i}.example/x", "html", text.format(i).replace("own words", f"own {'abcdefghij'[i]}{'klmnopqrst'[i]} words")) for i in range(10)]
    rows += [(100, None, "url", None), (101, "https://h.example", "html", "  \n "), (102, "https://h.example", "pdf", "x | y")]
    df = spark.createDataFrame(rows, "parse_id long, source string, doc_format string, markdown string")
    got = {(r.parse_id, r.block_no): r.main for r in boilerplate.judged_blocks(df).collect()}
    assert {k[0] for k in got} == set(range(10))
    assert all(not got[i, 2] and got[i, 0] and got[i, 1] for i in range(10))
    assert boilerplate.judged_blocks(df.limit(0)).count() == 0
    bodies = {r.parse_id: r.body for r in boilerplate.main_bodies(df).collect()}
    assert bodies[3].startswith("# T3\n\nThis is the 3 article")


WORDS = ["the", "same", "council", "restored", "library", "in", "a", "report", "that", "few", "people", "read", "another", "low-lying", "harbour", "manuscript", "improved", "and", "original", "agreement", "see", "table", "sheet", "of"]


@pytest.fixture(scope="module")
def repairer():
    return scanfix.Repairer(scanfix.Vocabulary({w: 1000 for w in WORDS}, {}))


SCAN = """## Page 1

THE SAME COUNCIL AND THE LIBRARY
The same counc1l restored another library in a report that few pe-
ople read, and the same low-
lying harbour irnproved another maniiscript. See table 3 and sheet of
1919.
LIBRARY OF 1888
The original agreement and the same council in a report that anot­
— 254 —

## Page 2

Original Librarys
her council read. The harbour and the library improved the original
agreement in a report that few people read and another council.
— 2S5 —
"""


def test_scan_noise(repairer):
    assert repairer.find(SCAN) == [
        (2, "header", ""),
        (3, "hyphen", "people"),
        (3, "misread", "council"),
        (4, "hyphen", "low-lying"),
        (5, "misread", "improved"),
        (5, "misread", "manuscript"),
        (8, "hyphen", "another"),
        (9, "page_number", ""),
        (13, "header", ""),
        (16, "page_number", ""),
    ]


def test_repaired_text(repairer):
    text = repairer.repaired(SCAN)
    assert "council restored another library in a report that few people read, and the same low-lying harbour improved another manuscript." in text
    assert "that another council read." in text and "254" not in text and "Librarys" not in text


def test_candidates_are_complete():
    """The automaton over the trie finds what a plain dynamic program finds."""
    words = ["map", "mop", "nap", "man", "rnap", "lamp", "m", "maps", "tap"]
    v = scanfix.Vocabulary(dict.fromkeys(words, 1), {})

    def distance(a, b):
        big = 9.0
        d = [[big] * (len(b) + 1) for _ in range(len(a) + 1)]
        d[0][0] = 0.0
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if i and j:
                    d[i][j] = min(d[i][j], d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i:
                    d[i][j] = min(d[i][j], d[i - 1][j] + 1)
                if j:
                    d[i][j] = min(d[i][j], d[i][j - 1] + 1)
                for x, y in scanfix.CONFUSED:
                    if a[:i].endswith(x) and b[:j].endswith(y):
                        d[i][j] = min(d[i][j], d[i - len(x)][j - len(y)] + scanfix.CONFUSION)
        return d[-1][-1]

    for token in ("rnap", "mop", "1amp", "tops", "", "xyz", "rn"):
        for most in (scanfix.MOST, *(m for m, _ in scanfix.FREE)):  # the limits of production
            want = {w: round(distance(token, w), 6) for w in words if distance(token, w) <= most + 1e-9}
            assert {w: round(c, 6) for w, c in v.candidates(token, most)} == want


@given(st.lists(st.text("abrmn", max_size=7), max_size=30), st.text("abrmn1", max_size=7))
@settings(max_examples=60, deadline=None)
def test_the_trie_over_sorted_words(words, token):
    """Whatever part of the trie is thrown away between lookups, free edits are complete."""
    v = scanfix.Vocabulary(dict.fromkeys((w for w in words if w), 1), ())
    v = scanfix.Vocabulary.unpacked(v.packed())

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = {w for w, _ in v.candidates(token, 1.0)}
    v.nodes = scanfix.MAX_NODES + 1
    assert {w for w in words if w and edits(token, w) <= 1} <= got and {w for w, _ in v.candidates(token, 2.0)} >= got
    assert all(v.uses_of(w) == 1 for w in words if w) and v.uses_of("zz") == 0


def test_scan_frame(spark):
    rows = [(1, "pdf", SCAN), (2, "text", " ".join(WORDS * 20)), (3, "pdf", None), (4, "pdf", ""), (5, "pdf", "x" * 100_000), (1, "pdf", SCAN)]
    df = spark.createDataFrame(rows, "parse_id long, doc_format string, markdown string")
    got = scanfix.scan_noise(df).collect()
    assert {r.parse_id for r in got} == {1} and len(got) == 20
    assert scanfix.scan_noise(df.limit(0)).count() == 0
    assert scanfix.repaired_texts(df).count() == 4


def code(k, i):
    return {
        "python": f"def load_{i}(path, size={i}):\n    with open(path) as handle:\n        return [x.strip() for x in handle][:{i}]\n\n\nclass Page{i}:\n    def __init__(self, depth):\n        self.depth = depth\n",
        "sql": f"SELECT t.a{i}, COUNT(*) AS n\nFROM page_{i} t\nWHERE t.b > {i}\nGROUP BY t.a{i};\n\nCREATE TABLE node_{i} (\n    id BIGINT PRIMARY KEY,\n    rank INTEGER NOT NULL\n);\n",
        "en": f"The committee repaired the old bridge {i} without much public discussion. Every gardener announced another harbour near the old town hall, and nobody had asked for number {i}.\n\nSome years later, the same library measured the canal.\n",
        "de": f"Der Gemeinderat prüft die neuen Messwerte {i} noch vor dem Sommer. Die Arbeitsgruppe sammelt den jährlichen Bericht {i} trotz der hohen Kosten.\n\nDie Wetterstation ersetzt das gesamte Verzeichnis nach einer langen Prüfung.\n",
    }[k]


@pytest.fixture(scope="module")
def languages():
    rows = [(k, code(k, i)) for k in ("python", "sql", "en", "de") for i in range(40)]
    rows += [("sql", code("python", i)) for i in range(40, 44)]
    return langid.Languages(langid.train(rows, {"en", "de"}), {"en", "de"})


def kinds(model, text):
    return [k for _, _, k, _ in model.segments(text)]


def test_languages_of_segments(languages):
    assert kinds(languages, code("python", 99)) == ["python"]
    assert kinds(languages, code("de", 99)) == ["de"]
    assert kinds(languages, code("en", 98) + code("de", 99)) == ["en", "de"]
    assert kinds(languages, code("en", 98) + "```sql\n" + code("sql", 97) + "```\n" + code("en", 96)) == ["en", "sql", "en"]
    assert kinds(languages, 'query = """\n' + code("sql", 97) + '"""\n' + code("python", 99)) == ["python", "sql", "python"]
    assert kinds(languages, '"""' + code("en", 97) + '"""\n' + code("python", 99) + code("python", 98)) == ["python"]


def test_segments_cover_all_lines(languages):
    text = "\n\n" + code("en", 98) + "```\n" + code("sql", 97) + "```\n" + code("de", 96) + "\n"
    found = languages.segments(text)
    assert found[0][0] == 0 and found[-1][1] == len(text.split("\n"))
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(found, found[1:]))
    assert all(0 <= c <= 1 for *_, c in found)


def test_language_frame(spark):
    rows = [(i, k, code(k, i)) for k in ("python", "sql", "en", "de") for i in range(30)]
    rows += [(1000, None, code("python", 77)), (1001, "sql", code("python", 78)), (1002, "de", ""), (1003, None, None), (1004, "xx", code("en", 79)), (1005, "", " \n\t")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    codes = spark.createDataFrame([("python", "code"), ("sql", "code"), ("en", "prose"), ("de", "prose")], "lang string, kind string")
    got = sorted((r.doc_id, r.seg_no, r.lang) for r in langid.language_segments(df, codes, only_doubtful=True).collect())
    assert got == [(1000, 0, "python"), (1001, 0, "python"), (1004, 0, "en")]
    assert langid.language_segments(df.limit(0), codes).count() == 0
    assert langid.language_segments(df, codes.limit(0)).count() == 0


def test_narrow_margins_decide_nothing(languages, spark, monkeypatch):
    for text in ("ok", "12 34 56 78", "#", "zxqv wklp"):
        (found,) = languages.segments(text)
        assert found[2] is None and found[3] < 0.5
        # a label that fits as well as any stands, one that isn't known doesn't
        (found,) = languages.segments(text, "sql")
        assert found[2] in ("sql", None)
        assert languages.segments(text, "xx")[0][2] is None
    rows = [(i, k, code(k, i)) for k in ("python", "sql", "en") for i in range(30)] + [(99, None, "#"), (98, "python", "7")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    codes = spark.createDataFrame([("python", "code"), ("sql", "code"), ("en", "prose")], "lang string, kind string")
    table = langid.trained(df, codes)
    assert {r["lang"] for r in table.collect()} == {"python", "sql", "en"}
    got = {r.doc_id: r.lang for r in langid.language_segments(df, codes, dictionaries=table).collect()}
    assert got[99] is None and got[98] in ("python", None) and got[3] == "en"
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.trained(df, codes)


def test_sections_of_running_text_beside_the_article_are_outside():
    article = ["# The old bridge"] + ["The committee measured the old bridge, the harbour and the canal, and nobody had asked for it, although some years later, it was repaired."] * 6
    own = ["## The canal", "A short last note on the canal, which was measured, too, in the year after."]
    comments = ["## What others wrote", "Anna, 3 hours ago", "Well done.", "Bert, 2 hours ago", "Reply", "Good to know.", "Cleo, 1 hour ago", "Reply", "Share", "Thanks."]
    teasers = ["## Our letter", "Stay informed.", "One mail a week."]
    blocks = article + own + comments + teasers
    first = len(article) + len(own)
    assert set(boilerplate.outside(blocks, set())) == {*range(first, first + len(comments))}
    # several short texts under a heading that recurs
    assert set(boilerplate.outside(blocks, {boilerplate.wording("## Our letter")})) == {*range(first, len(blocks))}
    # a short own section, a section with a table and one without text stay
    assert boilerplate.outside([*article, *own, "## Figures", "| a | b |\n| --- | --- |\n| 1 | 2 |", "## Next"], set()) == []


LONG = "The committee measured the old bridge, the harbour and the canal, and nobody had asked for it, although some years later, it was repaired."


def test_plain_lists_and_lines_without_an_end_stay():
    body = ["# The old bridge", LONG, "- first item\n- second item", "A line without a full stop", "```\nx = 1\n```", LONG, "It holds three things:", "- one\n- two\n- three"]
    assert boilerplate.outside([*body, "[Mail](#m)", "[Subscribe]", "© 2020 Nobody."], set()) == [8, 9, 10]


def test_what_stands_before_the_title_is_measured_by_its_score():
    notice = "We store small files, as all sites do. You may leave, too."
    assert boilerplate.outside([notice, "# The old bridge", LONG, LONG, LONG, LONG], set()) == [0]
    assert boilerplate.outside([LONG, LONG, "# The old bridge", LONG, LONG], set()) == []


def test_scores_decide(monkeypatch):
    """With a constant for every score the result is another one."""
    blocks = ["We store small files. You may leave.", "# The old bridge", LONG * 3, LONG * 3, "## Voices", "Well done.", "Reply", "Good to know.", "Share", "Why not.", "Report"]
    right = boilerplate.outside(blocks, set())
    assert right == [0, 4, 5, 6, 7, 8, 9, 10]
    real = boilerplate.points
    monkeypatch.setattr(boilerplate, "points", lambda b: float(real(b) > 0))
    assert boilerplate.outside(blocks, set()) != right


def test_furniture_in_wordings_of_any_language(spark):
    """Menus in any order, notices over 250 characters, names that change from site to site; nothing is listed beforehand."""
    name = lambda i: "".join("abcdefghij"[int(x)] for x in str(i))
    labels = ["Notizie", "Meteo", "Cultura", "Lavoro", "Archivio"]
    notice = "Questo sito usa i cookie per ricordare le preferenze. " * 8
    pages = []
    for i in range(12):
        menu = " | ".join(labels[i % 5 :] + labels[: i % 5])
        pages.append(f"{menu}\n\n# Il ponte {name(i)}\n\nIl ponte {name(i)}, il porto e il canale {name(i)} sono vecchi. Nessuno lo sapeva.\n\n- primo {name(i)}\n- secondo\n\n{notice}\n\nDe redactie van Zandgat {i} dankt u.\n\nIl canale {name(i)}, invece, era nuovo. Era {name(i)}.\n\nVerder lezen in Zandgat")
    df = spark.createDataFrame([(i, f"https://a.example/{i}", "html", t) for i, t in enumerate(pages)], "parse_id long, source string, doc_format string, markdown string")
    got = sorted((r.parse_id, r.block_no) for r in boilerplate.judged_blocks(df).where("not main").collect())
    assert got == [(i, k) for i in range(12) for k in (0, 4, 5, 7)]
    # copies of one article under many addresses don't make its paragraphs recur
    copies = spark.createDataFrame([(i, f"https://b.example/{i}", "html", "# T\n\nOne text, again. And again.") for i in range(9)], df.schema)
    assert boilerplate.judged_blocks(copies).where("not main").count() == 0


@pytest.mark.parametrize("shared", [200_000, 0])
def test_wording_that_recurs_on_one_host_only(spark, monkeypatch, shared):
    """On 4 of one host's 40 pages; over all 5,040 pages it would need 6."""
    monkeypatch.setattr(boilerplate, "MAX_SHARED", shared)
    name = lambda i: "".join("abcdefghij"[int(x)] for x in str(i))
    text = "# T\n\nThe {0} article, with {0} words of its own, is about {0} and nothing else at all."
    odd = "\n\nOur patrons in all towns ask for more."
    rows = [(i, f"https://U@Small.example:80/{i}", "html", text.format(name(i)) + odd * (i < 4)) for i in range(40)]
    rows += [(i, f"https://h{i % 400}.example/{i}", "html", text.format(name(i)) + odd * (i == 50)) for i in range(40, 5040)]
    df = spark.createDataFrame(rows, "parse_id long, source string, doc_format string, markdown string").repartition(4)
    got = {(r.parse_id, r.block_no) for r in boilerplate.judged_blocks(df).where("not main").collect()}
    assert got == {(i, 2) for i in range(4)}
    bodies = {r.parse_id: r.body for r in boilerplate.main_bodies(df).collect()}
    assert len(bodies) == 5040 and "patrons" not in bodies[0] and "patrons" in bodies[50]


def test_free_edits_need_both_neighbours():
    words = {"seen": 900, "before": 900, "the": 900, "defore": 1, "meeting": 900, "melting": 900}
    pairs = {scanfix.key_of(p): 5 for p in ("seen before", "before the", "seen defore", "defore the", "the meeting", "meeting seen", "the melting", "melting seen")}
    v = scanfix.Vocabulary(words, pairs)
    for read in ("hefore", "efore", "beforre", "bexore"):
        assert v.printed(read, "seen", "the") == "before"
        assert v.printed(read, "seen", "other") is None and v.printed(read, "", "the") is None
    assert v.printed("meetinx", "the", "seen") == "meeting"
    assert v.printed("meting", "the", "seen") is None  # meeting or melting
    assert v.printed("hexore", "seen", "the") is None
    assert scanfix.Repairer(v).repaired("Seen hefore the meeting") == "Seen before the meeting"


def test_misread_words_of_any_kind():
    """Characters added, dropped and replaced that no table of confusions holds."""
    words = {"harbour": 900, "report": 900, "machine": 900, "the": 900, "old": 900, "was": 900, "irrigation": 900}
    v = scanfix.Vocabulary(words, [scanfix.key_of(p) for w in words for p in (f"old {w}", f"{w} was")])
    for printed, reads in {"harbour": ("harbcur", "harbonr", "hzrbour"), "machine": ("maehine", "machne"), "report": ("repoft", "reporrt", "xeport"), "irrigation": ("irxigatign", "irigtion")}.items():
        for read in reads:
            assert v.printed(read, "old", "was") == printed
            assert v.printed(read, "the", "the") is None or len(v.candidates(read, scanfix.MOST)) > 0
    # another form of a word is not misread, nor is a short one two edits away
    assert v.printed("harbours", "old", "was") is None and v.printed("rexxrt", "old", "was") is None
    # where most words are unknown a confusion must fit as well
    assert v.printed("rnachine", "x", "y") == "machine" and v.printed("rnachine", "x", "y", strict=True) is None


def test_words_beyond_the_trie_are_looked_up(spark, monkeypatch):
    text = " ".join(["the same council restored another library"] * 40 + ["anotherr"] * 3 + ["slatefie1d manuscript-like"] * 4)
    scan = "## Page 1\n\nThe anotherr slatefie1d counc1l and manuscript-\nlike library was here."
    rows = [(1, "text", text), (2, "pdf", scan), (3, "pdf", "")]
    df = spark.createDataFrame(rows, "parse_id long, doc_format string, markdown string")
    whole = {(r.parse_id, r.line_no, r.kind, r.fixed) for r in scanfix.scan_noise(df).collect()}
    assert whole == {(2, 2, "misread", "council"), (2, 2, "hyphen", "manuscript-like")}
    monkeypatch.setattr(scanfix, "MAX_WORDS", 6)
    data, rest = scanfix.vocabulary(df)
    assert {r.word for r in rest.collect()} == {"anotherr", "slatefie1d", "manuscript-like"}
    assert {(r.parse_id, r.line_no, r.kind, r.fixed) for r in scanfix.scan_noise(df).collect()} == whole
    assert {r.parse_id: r.text for r in scanfix.repaired_texts(df).collect()} == {2: "The anotherr slatefie1d council and manuscript-like library was here.", 3: ""}


@pytest.mark.parametrize("most", [6, 0])
def test_words_and_pairs_beyond_the_bounds_are_candidates(spark, monkeypatch, most):
    """what workers don't hold repairs confusions, broken words and free edits, and decides by context."""
    text = ["the same council restored another library"] * 40 + ["the harbormaster restored"] * 30 + ["old slatefield mill"] * 4
    text += ["oak bole", "oak bole", "oak bole", *["iron bolt"] * 30]
    title = "A HISTORY OF THE OLD TOWN AND OF ITS PEOPLE IN THE DAYS OF YORE BY ONE OF US"
    scan = f"## Page 1\n\n{title}\nThe same slatefie1d council restored the library.\nThe harbormxster restored another oak bolf by slate-\n\n## Page 2\n\n{title}\nfie1d mill and the rnill council."
    rows = [(1, "text", "\n".join(text)), (2, "pdf", scan), (3, "pdf", ""), (None, "pdf", scan), (2, "pdf", "## Page 1\n\nThe same counc1l restored iron bolf here.")]
    df = spark.createDataFrame(rows, "parse_id long, doc_format string, markdown string")
    found = lambda: sorted((str(r.parse_id), r.line_no, r.kind, r.fixed) for r in scanfix.scan_noise(df).collect())
    texts = lambda: sorted((str(r.parse_id), r.text) for r in scanfix.repaired_texts(df).collect())
    whole, whole_texts = found(), texts()
    assert {"slatefield", "harbormaster", "bole", "bolt", "mill", "council"} <= {x[3] for x in whole}
    assert {x[1:] for x in whole if x[0] == "2"} >= {x[1:] for x in whole if x[0] == "None"} != set()
    monkeypatch.setattr(scanfix, "MAX_WORDS", most)
    monkeypatch.setattr(scanfix, "MAX_PAIRS", most, raising=False)
    assert len(scanfix.Vocabulary.unpacked(scanfix.vocabulary(df)[0]).names) <= most
    assert found() == whole and texts() == whole_texts


def test_rare_words_of_scans_in_many_words(spark):
    """F1: in 3.4 million words, a word that scans use 4 times and a pair used 3 times are known."""
    rows = [(i, "text", "same council restored " * 27_000) for i in range(42)] + [(50, "text", "iron bolt " * 900 + "oak bole " * 3 + "bole ")]
    rows += [(60 + i, "pdf", "## Page 1\n\nThe council restored tollhouse again.") for i in range(4)]
    rows += [(70, "pdf", "## Page 1\n\nThe council restored tollh0use again, oak bolf council.")]
    # misread too often to be a word: a letter dropped, and a confusion
    rows += [(80 + i, "pdf", "## Page 1\n\nThe same concil restored same counc1l again.") for i in range(5)]
    df = spark.createDataFrame(rows, "parse_id long, doc_format string, markdown string")
    got = {(r.parse_id, r.kind, r.fixed) for r in scanfix.scan_noise(df).collect()}
    assert got == {(70, "misread", "tollhouse"), (70, "misread", "bole")} | {(80 + i, "misread", "council") for i in range(5)}


@given(st.text("abrmnlihcdu1", min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 60)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_words_within_the_distance_have_a_key_in_common(word, changes):
    read = word
    for at, how in changes:  # confusions back to front, or letters added, dropped and replaced
        at %= len(read) + 1
        if how < len(scanfix.CONFUSED) * 2:
            wrong, printed = scanfix.CONFUSED[how % len(scanfix.CONFUSED)]
            read = read[:at] + read[at:].replace(printed, wrong, 1)
        else:
            read = read[:at] + ("x", "", "x")[how % 3] + read[at + how % 2 :]
    own = scanfix.Vocabulary({word: 1}, ())
    for most in (scanfix.MOST, *(m for m, _ in scanfix.FREE)):
        if own.candidates(read, most):
            assert scanfix.keys_of(read, most, True) & scanfix.keys_of(word, most, False)
    assert all(a.translate(scanfix._FOLD) == b.translate(scanfix._FOLD) for a, b in scanfix.CONFUSED)


def test_keys_of_very_long_words():
    long = "harbour" * 10_000
    assert len(scanfix.keys_of(long, 2.0, True)) < 1000 and scanfix.keys_of(long[:300] + long[302:], 2.0, True) & scanfix.keys_of(long, 2.0, False)


def test_page_numbers_of_results_set_in_paragraphs(repairer):
    pages = "\n".join(f"## Page {k}\n\nThe same council {'restored another library in a report that few people read and ' * 4}it.\n\n{40 + k}\n" for k in (1, 2, 3))
    assert [(k, f) for _, k, f in repairer.find(pages)] == [("page_number", "")] * 3


def test_sample_of_very_many_rows_and_of_copies(spark):
    codes = spark.createDataFrame([("python", "code"), ("sql", "code"), ("en", "prose")], "lang string, kind string")
    many = spark.range(10_000_000).selectExpr("'sql' lang", "concat('select ', id) text")
    copies = spark.range(20_000).selectExpr("'python' lang", "'x = 1' text")
    few = spark.createDataFrame([("en", f"Text {i}.") for i in range(5)], "lang string, text string")
    got = [(r["lang"], r["text"]) for r in langid.sample_rows(many.union(copies).union(few), codes, 4).collect()]
    by = {k: [t for x, t in got if x == k] for k in ("python", "sql", "en")}
    assert by["python"] == ["x = 1"] and len(by["en"]) == 5
    assert 1 <= len(by["sql"]) <= 16 and len(set(by["sql"])) == len(by["sql"])
    assert langid.last_hash(400, 10**12) > langid.last_hash(400, 10**13) > -(1 << 63)
