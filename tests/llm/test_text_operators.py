"""Small cases of tokenising, leakage, pieces and look-alikes against plain computations."""

import os
import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgrove.llm import leakage, lookalike, pieces, queries, tokenise

ODD = list(" \n\t' 　 abs tdm'''l're!!??。中文ÄéЖx12_<|endoftext|>́\x85\x1c")


@pytest.fixture(scope="module")
def encoder():
    return tokenise.Encoder(tokenise.read_vocabulary(queries.vocabulary_file("byte_bpe_50k.tiktoken")), queries.splitting_pattern())


def test_encoding_equals_that_of_whole_texts(encoder):
    random.seed(3)
    texts = ["".join(random.choice(ODD) for _ in range(random.randint(0, 80))) for _ in range(3000)] + [None, "", "a" * 50_000, " ", "<|endoftext|>"]
    assert encoder.encode(pa.array(texts)).to_pylist() == [encoder.encode_one(t) if t else [] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoding_any_text(encoder, texts):
    assert encoder.encode(pa.array(texts, pa.string())).to_pylist() == [encoder.encode_one(t) for t in texts]


def test_encode_corpus_frame(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    rows = tokenise.encode_corpus(df, queries.vocabulary_file("byte_bpe_50k.tiktoken"), queries.splitting_pattern()).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in rows) == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert tokenise.encode_corpus(df.limit(0), queries.vocabulary_file("byte_bpe_50k.tiktoken"), queries.splitting_pattern()).count() == 0


def brute_leaks(text, item, n=13):
    """Numbers of the text's words that stand in runs of n or more words of the item."""
    w, v = leakage.word_list(text), leakage.word_list(item)
    return {i + k for i in range(len(w) - n + 1) for j in range(len(v) - n + 1) if w[i : i + n] == v[j : j + n] for k in range(n)}


@pytest.mark.parametrize("n", [1, 2, 4, 5])
def test_leaks_equal_brute_force(n, monkeypatch):
    random.seed(5)
    monkeypatch.setattr(leakage, "REPEATS", 1000)
    word = lambda: random.choice(["a", "B", "c3", "Straße", "é", "数"])
    items = [(k, " ".join(word() for _ in range(random.randint(1, 40)))) for k in range(20)]
    finder = leakage.LeakFinder(items, n)
    for _ in range(200):
        text = random.choice(["_", ", ", "\n// "]).join(word().upper() for _ in range(random.randint(0, 30)))
        spans = [m.span() for m in leakage.WORD.finditer(text)]
        got = {}
        for k, first, last in finder.find(text):
            own = {i for i, (a, z) in enumerate(spans) if first <= a and z <= last}
            assert not own & got.setdefault(k, set())
            got[k] |= own
        assert got == {k: x for k, t in items if (x := brute_leaks(text, t, n))}
        monkeypatch.setattr(leakage, "REPEATS", 0)  # the same items, whatever repeats in them
        assert {k for k, _, _ in finder.find(text)} == set(got)
        monkeypatch.setattr(leakage, "REPEATS", 1000)


def test_leaks_with_more_words_than_codes(monkeypatch):
    """Words whose numbers share a code are told apart by the words themselves."""
    monkeypatch.setattr(leakage, "CODES", ["ab", "ba"] * (1 << 15))
    item = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"w{i + 2}" for i in range(40))
    finder = leakage.LeakFinder([(1, item), (2, " ".join(f"v{i}" for i in range(40)))])
    assert [k for k, _, _ in finder.find(other)] == [1] and finder.find(" ".join(f"w{39 - i}" for i in range(40))) == []


def test_leak_offsets_are_those_of_the_original():
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    leak = "ONE two-three four, five SIX seven\n# eight nine ten eleven twelve thirteen"
    text = f"# Intro\n# {leak} and more {'x ' * 5000} {leak}"
    found = leakage.LeakFinder([(7, item)]).find(text)
    # passages far apart stay apart
    assert [text[a:z] for _, a, z in found] == [leak, leak] and {k for k, _, _ in found} == {7}
    # the same word again and again takes no longer than other words
    item, text = "a b " + "a " * 30_000, "x " + "a " * 100_000
    assert leakage.LeakFinder([(7, item), (8, "a " * 12)]).find(text) == [(7, 2, len(text) - 1)]


def test_leak_frame(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, item[:-3]), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(5, item, "s"), (6, item, None), (7, "short", "s"), (8, None, "s")], "item_id long, text string, suite string")
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(docs, items).collect()) == [(1, 5), (1, 6)]
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0 and leakage.leaked_items(docs.limit(0), items).count() == 0


def test_items_in_parts(spark, monkeypatch):
    """Items over the bound of one automaton are searched in parts, with the same result."""
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(20))) for k in range(12)], "item_id int, text string")
    docs = spark.createDataFrame([(f"d{k}", f"a w{k}x4 " + " ".join(f"w{k}x{i}" for i in range(5, 20)) + f" and {k} " + " ".join(f"w{k}x{i}" for i in range(14))) for k in range(12)], "doc_id string, text string")
    whole = sorted(leakage.leaked_passages(docs, items).drop("nth").collect())
    assert len(whole) == 24 and len(leakage.leaked_items(docs, items).collect()) == 12
    monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", 500)
    assert sorted(leakage.leaked_passages(docs, items).drop("nth").collect()) == whole
    assert sorted(tuple(r) for r in leakage.leaked_items(docs, items).collect()) == sorted((f"d{k}", k) for k in range(12))


@pytest.fixture(scope="module")
def cut(spark):
    limits = spark.createDataFrame([("text", 100, 20), ("zh", 50, 0)], "doc_format string, max_bytes int, overlap_bytes int")
    random.seed(9)
    words = ["alpha", "be", "gamma.", "δέλτα", "中文字。", "x" * 120, "\n\n", "é" * 70, "。" * 60]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(5, 60))) for _ in range(120)]
    texts += ["a" * 101, "a" * 100 + " b", "a" * 100, None, "", "中" * 34]
    rows = [(i, "zh" if i % 3 == 0 else "text", t) for i, t in enumerate(texts)] + [(1000, "other", "x" * 500), (1001, None, "x" * 500)]
    results = spark.createDataFrame(rows, "parse_id long, doc_format string, markdown string")
    spans = spark.createDataFrame([(4, 0, 0, 101), (4, 0, 0, 101), (4, 1, 5, 3), (4, 2, None, 9), (4, 3, 0, 10**6)], "parse_id long, span_no int, out_start long, out_end long")
    out = pieces.split_oversized(results, spans, limits).collect()
    kinds = {(r.parse_id, r.span_no): r.cut for r in pieces.cut_kinds(results, spans, limits).collect()}
    return {r[0]: r for r in rows}, out, kinds


def test_pieces_fit_and_make_up_the_item(cut):
    rows, out, _ = cut
    limit = {"text": (100, 20), "zh": (50, 0)}
    by = {}
    for r in out:
        by.setdefault((r.parse_id, r.span_no), []).append(r)
    assert by
    for (parse, span), found in by.items():
        found.sort(key=lambda r: r.piece_no)
        most, overlap = limit[rows[parse][1]]
        raw = rows[parse][2].encode()
        raw = raw[:101] if span == 0 else raw
        assert b"".join(r.piece.encode()[r.shared :] for r in found) == raw or span == 0
        for r in found:
            assert r.size <= most and r.shared <= overlap
            assert span == 0 or raw[r.start : r.start + r.size].decode() == r.piece


def test_hard_and_soft_cuts(cut):
    import re

    rows, _, kinds = cut
    limit = {"text": 100, "zh": 50}
    want = {}
    for parse, fmt, text in rows.values():
        if fmt not in limit or not text or parse == 4:
            continue
        if len(text.encode()) > limit[fmt]:
            longest = max(len(x.encode()) for x in re.split(r"[ \t\r\n]|(?<=[。！？])", text))
            want[parse, -1] = "hard" if longest > limit[fmt] else "soft"
    assert {k: v for k, v in kinds.items() if k[0] != 4} == want
    assert [k for k in kinds if k[0] == 4] in ([], [(4, 0)])


def test_consistent_form():
    same = [("Position", "Ροsitiοn"), ("日期", "日‍期"), ("Café code", "Cаfé сode"), ("Сумма", "Cyммa"), ("Affix", "Aﬃx"), ("Unit price", "Ｕnit　ｐrice"), ("ё", "ë"), ("a b", "a b")]
    for a, b in same:
        assert lookalike.consistent(a) == lookalike.consistent(b)
    for a, b in [("Größe", "Grosse"), ("Resumé", "Resume"), ("Year", "year"), ("m1", "ml"), ("a b", "a  b"), ("日", "曰")]:
        assert lookalike.consistent(a) != lookalike.consistent(b)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aеéo\u0301\u0323\u0308\u200d\ufeffｅﬁ가가👩🏴\U000e0067", max_size=20)))
def test_consistent_form_is_stable(text):
    once = lookalike.consistent(text)
    assert lookalike.consistent(once) == once


def test_every_code_point_with_another_form_is_mapped():
    """Whatever Unicode calls a compatibility form of other characters looks like them; what has no mark is gone."""
    for n in range(0x80, 0x110000):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or any(c in letters for letters, _ in lookalike.SHAPES):
            continue  # by its shape: a lunate sigma looks like c, not like the sigma it is
        form = lookalike.consistent(f"x{c}y")
        if unicodedata.decomposition(c):
            plain = unicodedata.normalize("NFKD", c)
            assert form == lookalike.consistent(f"x{plain}y"), hex(n)
            assert form == lookalike.consistent(f"x{unicodedata.normalize('NFKC', c)}y"), hex(n)
        elif unicodedata.category(c) == "Cf" and c not in lookalike.PRINTED or c in lookalike.UNSEEN:
            assert form == "xy", hex(n)
        elif unicodedata.category(c) == "Zs":
            assert form == "x y", hex(n)


def test_clusters_and_longest_keys():
    same = [("ệ", "e\u0323\u0302"), ("ệ", "е\u0302\u0323"), ("Ó", "Ο\u2060\u0301"), ("각", "\u1100\u1161\u11a8"), ("🯱23", "123"), ("ρaν", "pav"), ("ᎪᏴ", "AB"), ("ｶﾞ", "ガ"), ("a\u0301\u200bb", "áb")]
    for a, b in same:
        assert lookalike.consistent(a) == lookalike.consistent(b), (a, b)
    family, three = "👨\u200d👩\u200d👧", "👨👩👧"
    assert lookalike.consistent(family) != lookalike.consistent(three) and lookalike.consistent("a\u200db") == "ab"
    assert lookalike.consistent(f"é{family}é") == f"é{family}é"


@pytest.mark.parametrize("keys", ["AA", "ABC"])
def test_conflicting_mappings_are_refused(monkeypatch, keys):
    # one letter with two shapes; a shape that is a letter with another shape
    monkeypatch.setattr(lookalike, "SHAPES", (("аа", "ab"),) if keys == "AA" else (("аѕ", "ѕs"),))
    with pytest.raises(ValueError):
        lookalike.compiled()


def test_hot_forms_and_classes_are_split(spark, monkeypatch):
    """More classes of a form and more members of a class than one part holds."""
    monkeypatch.setattr(lookalike, "HOT", 3)
    variants = ["abcdef", *("abcdef"[:i] + "\u200b" + "abcdef"[i:] for i in range(1, 6)), "аbcdef"]
    texts = [v for k, v in enumerate(variants) for _ in range(10 if k == 1 else k % 3 + 1)] + ["other"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "parse_id long, markdown string")
    got = sorted((r.left_id, r.right_id) for r in lookalike.same_looking_pairs(df, "parse_id", "markdown").collect())
    n = len(texts) - 9
    assert got == [(i, j) for i in range(n) for j in range(i + 1, n) if texts[i] != texts[j]]


def test_same_looking_pairs(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, None), (5, ""), (6, " "), (7, " "), (8, "abd"), (9, "a​bc")]
    df = spark.createDataFrame(rows, "parse_id long, markdown string")
    got = sorted((r.left_id, r.right_id) for r in lookalike.same_looking_pairs(df, "parse_id", "markdown").collect())
    assert got == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9)]
    assert lookalike.same_looking_pairs(df.limit(0), "parse_id", "markdown").count() == 0
