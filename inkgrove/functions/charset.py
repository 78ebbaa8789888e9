"""Which charset bytes are in, by how likely each makes the text.

Every charset has a model: groups of its characters, each with its share of ordinary text, spread
evenly over the group. The groups follow from how the charsets were laid out (rows of frequent
ideographs come before rare ones, kana and Hangul have rows of their own) or are the alphabets
that a single-byte charset was made for. Bytes are decoded in every charset and the text with the
largest likelihood wins; what isn't defined in a charset makes it unlikely, not impossible.
"""

from __future__ import annotations

import codecs
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Log likelihood of an ASCII character, of a broken sequence, and of a character outside of all groups.
ASCII, BROKEN, OTHER = -3.0, -25.0, -16.0
#: Additional cost of a capital at the beginning of a word, behind another capital, behind a small letter.
FIRST_CAPITAL, NEXT_CAPITAL, INNER_CAPITAL = -1.0, -0.7, -4.0
#: Additional cost of a letter of another script beside a Latin one.
MIXED = -6.0
#: Escape into two-byte characters, in a charset whose bytes are all ASCII.
JAPANESE_SHIFT = b"\x1b$"
PUNCTUATION = "、。，．・：；？！「」『』（）《》〈〉“”‘’—…～ー　【】〔〕％＋－＝／０１２３４５６７８９"

#: Two-byte charsets: rows (first byte from, to; second byte from, to) and their share.
ROWS = {
    "gb18030": (((0xB0, 0xD7, 0xA1, 0xFE), 0.82), ((0xD8, 0xF7, 0xA1, 0xFE), 0.03), ((0xA1, 0xA3, 0xA1, 0xFE), 0.01), ((0xA4, 0xA5, 0xA1, 0xF6), 0.002), ((0x81, 0xA0, 0x40, 0xFE), 0.004), ((0xAA, 0xFE, 0x40, 0xA0), 0.004)),
    "big5": (((0xA4, 0xC6, 0x40, 0xFE), 0.82), ((0xC9, 0xF9, 0x40, 0xFE), 0.03), ((0xA1, 0xA3, 0x40, 0xFE), 0.01)),
    "euc_kr": (((0xB0, 0xC8, 0xA1, 0xFE), 0.92), ((0xCA, 0xFD, 0xA1, 0xFE), 0.02), ((0xA1, 0xA9, 0xA1, 0xFE), 0.01)),
    "cp949": (((0xB0, 0xC8, 0xA1, 0xFE), 0.9), ((0xCA, 0xFD, 0xA1, 0xFE), 0.02), ((0xA1, 0xA9, 0xA1, 0xFE), 0.01), ((0x81, 0xC6, 0x41, 0xA0), 0.02)),
    "shift_jis": (((0x82, 0x82, 0x9F, 0xF1), 0.45), ((0x83, 0x83, 0x40, 0x96), 0.14), ((0x88, 0x97, 0x40, 0xFC), 0.27), ((0x98, 0xEA, 0x40, 0xFC), 0.01), ((0x81, 0x82, 0x40, 0x9E), 0.01)),
    "euc_jp": (((0xA4, 0xA4, 0xA1, 0xF3), 0.45), ((0xA5, 0xA5, 0xA1, 0xF6), 0.14), ((0xB0, 0xCF, 0xA1, 0xFE), 0.27), ((0xD0, 0xF4, 0xA1, 0xFE), 0.01), ((0xA1, 0xA3, 0xA1, 0xFE), 0.01)),
}
MARKS = "«»„“”‘’–—…·§°№©®€"
#: Single-byte charsets: small letters of the alphabets that they were made for, by frequency in three parts.
ALPHABETS = {
    "cp1252": ("éèàüöäßñóíáçêãõ", "úôâûîïëìòùåæøœ", "ýÿð¿¡ºªþ"),
    "cp1251": ("оеаинтсрвлкмдпу", "ябыьгзчйхжшюцщэфъ", "ёіїєґўјљњћџђѓќ"),
    "cp1250": ("ąęłóáíéčěšžřńśż", "ćýůőźúťöüäßăâ", "ďňűîşţđ"),
    "cp1253": ("αοιετσνηυρπκμλς", "ίόάέήώωγδθχφβξζψύ", "ϊϋΐΰ"),
    "cp1255": ("יוהלאמתברשנ", "םדכחעפקןגצטסזךףץ", ""),
    "cp1256": ("المينورتبةعدسفه", "كأحقجطصىشخغزضذثظءئإآؤ", "،؛؟پچژگ"),
}
#: How common each charset is, as log likelihood of the whole.
PRIORS = {"cp1252": 0.0, "cp1251": -1.0, "gb18030": -1.0, "shift_jis": -1.0, "euc_kr": -1.5, "big5": -1.5, "cp1250": -2.0, "euc_jp": -2.0, "cp949": -2.0}
RARE_CHARSET = -4.0


@lru_cache(maxsize=None)
def model(name: str) -> np.ndarray:
    """Log likelihood of each character of the basic plane under a charset."""
    table = np.full(1 << 16, OTHER, np.float32)
    table[:128] = ASCII
    table[0xFFFD] = BROKEN
    table[0x80:0xA0] = BROKEN  # control characters

    def spread(chars: str, share: float) -> None:
        at = np.array(sorted({ord(c) for c in chars if 0x80 <= ord(c) < 1 << 16 and c != "�"}), np.int64)
        if len(at):
            table[at] = np.maximum(table[at], np.log(share / len(at)))

    if name in ROWS:
        for (a, b, c, d), share in ROWS[name]:
            pairs = (bytes((x, y)).decode(name, "replace") for x in range(a, b + 1) for y in range(c, d + 1) if y != 0x7F)
            spread("".join(x for x in pairs if len(x) == 1), share)
        spread(PUNCTUATION, 0.12)
    else:
        for letters, share in zip(ALPHABETS[name], (0.72, 0.2, 0.02)):
            spread(letters, share)
        spread(MARKS, 0.06)
    return table


def likelihood(text: str, name: str) -> float:
    """Log likelihood of a decoded text under its charset; of alphabets, small letters count and capitals cost."""
    total = PRIORS.get(name, RARE_CHARSET)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if name in ALPHABETS:
        # a byte is one character, so cases are looked up once for each of the 256
        case = _cases(name)
        kind = case[np.minimum(points, (1 << 16) - 1)]
        behind = np.concatenate(([0], kind[:-1]))
        wide = points >= 0x80
        upper = wide & (kind == 2)
        total += FIRST_CAPITAL * float((upper & (behind == 0)).sum()) + NEXT_CAPITAL * float((upper & (behind == 2)).sum()) + INNER_CAPITAL * float((upper & (behind == 1)).sum())
        if name not in ("cp1252", "cp1250"):
            letter, latin = wide & (kind > 0), ~wide & (kind > 0)
            total += MIXED * float((letter[1:] & latin[:-1]).sum() + (latin[1:] & letter[:-1]).sum())
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    plain = points < 1 << 16
    return total + float(model(name)[points[plain]].sum(dtype=np.float64)) + 2 * OTHER * float((~plain).sum())


@lru_cache(maxsize=None)
def _cases(name: str) -> np.ndarray:
    """0 no letter, 1 small or without case, 2 capital, for the characters of a single-byte charset."""
    table = np.zeros(1 << 16, np.int8)
    for c in bytes(range(256)).decode(name, "replace"):
        table[ord(c)] = 2 if c.isupper() else 1 if c.isalpha() else 0
    return table


def guessed(data: bytes) -> str:
    """Name of the most likely charset of bytes that are not all UTF-8."""
    best, most = "cp1252", -np.inf
    for name in ("cp1252", *(k for k in (*ALPHABETS, *ROWS) if k != "cp1252")):
        value = likelihood(data.decode(name, "replace"), name)
        if value > most:
            best, most = name, value
    # UTF-8 with a few broken sequences: whole sequences hardly come about by chance
    text = data.decode("utf-8", "replace")
    broken = text.count("�")
    whole = sum(c > "\x7f" for c in text) - broken
    return "utf-8" if whole > 4 * broken else best


def decoded(data: bytes) -> str:
    """Text of bytes: by its mark if it has one, as UTF-8 if it is, else in the most likely charset.

    What the charset leaves undefined becomes U+FFFD; the same bytes give the same text everywhere.
    """
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if JAPANESE_SHIFT in data:
        try:
            return data.decode("iso2022_jp")
        except UnicodeDecodeError:
            pass
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode(guessed(data), "replace")


def decoded_text(content: Column) -> Column:
    """decoded() of a binary column; null stays null. What is UTF-8 without a mark stays in the JVM."""
    data = content.cast("binary")
    marked = F.substring(data, 1, 2).isin(codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) | (F.substring(data, 1, 3) == F.lit(codecs.BOM_UTF8))
    plain = F.is_valid_utf8(data.cast("string")) & ~marked & ~F.contains(data, F.lit(JAPANESE_SHIFT))

    @F.arrow_udf(T.StringType())
    def decode(values: pa.Array) -> pa.Array:
        return pa.array((decoded(v) if (v := x.as_py()) is not None else None for x in values), pa.string())

    return F.when(plain, data.cast("string")).otherwise(decode(F.when(~plain, data)))
