"""Text of PDF pages: fonts, the content interpreter, flat text, spans and reading order."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from inkgrove.parsers.pdf_objects import END, Lexer, Name, Pdf, Ref, Stream, Word
from inkgrove.schema import ParseError

# Advance widths of the standard sans-serif font for codes 32 to 126, in thousandths.
SANS_WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
# The same of the standard serif font.
SERIF_WIDTHS = (
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278,
    500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722,
    556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500,
    500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
)
#: Bold letters are wider by about this much.
BOLD = 1.06
# The standard encoding from 161 on, and the symbol font's from 34 and from 161 on; a blank is no character.
STANDARD_UPPER = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ –†‡· ¶•‚„”»…‰ ¿ `´ˆ˜¯˘˙¨ ˚¸ ˝˛ˇ—                Æ ª    ŁØŒº     æ   ı  łøœß"
SYMBOL_LOWER = "∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_ αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼"
SYMBOL_UPPER = "ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…  ↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈   ∑           〉∫"
#: The dingbats font follows Unicode's block from 33 and from 161 on, but for these codes.
DINGBATS = {0x25: "☎", 0x2A: "☛", 0x2B: "☞", 0x48: "★", 0x6C: "●", 0x6E: "■", 0x73: "▲", 0x74: "▼", 0x75: "◆", 0x77: "◗", 0xA8: "♣", 0xA9: "♦", 0xAA: "♥", 0xAB: "♠", 0xD5: "→", 0xD6: "↔", 0xD7: "↕"}
# Glyph names that no rule gives.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’",
    "quoteleft": "‘", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":",
    "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]",
    "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "bullet": "•", "endash": "–",
    "emdash": "—", "ellipsis": "…", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "guillemotleft": "«",
    "guillemotright": "»", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "lslash": "ł", "Lslash": "Ł",
    "dotlessi": "ı", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "Euro": "€", "sterling": "£", "yen": "¥", "cent": "¢", "section": "§",
    "paragraph": "¶", "degree": "°", "copyright": "©", "registered": "®", "trademark": "™", "multiply": "×", "divide": "÷", "plusminus": "±", "mu": "µ",
    "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "dagger": "†", "daggerdbl": "‡", "periodcentered": "·", "nbspace": "\xa0", "exclamdown": "¡", "questiondown": "¿",
}
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "ogonek": "̨", "macron": "̄", "breve": "̆"}


def glyph_text(name: str) -> str:
    """Text of a glyph by its name: known, one letter, a letter with an accent, or a code."""
    name = name.partition(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if name[1:] in ACCENTS and name[0].isalpha():
        return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
    if m := re.fullmatch(r"(?:uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6}))", name):
        if m[1]:
            return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
        return chr(int(m[2], 16)) if int(m[2], 16) < 0x110000 else "�"
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name}")
    except KeyError:
        return ""


def placed(chars: str, first: int) -> dict[int, str]:
    """Codes from the first on with their characters, blanks left out, ligatures as letters."""
    return {first + i: unicodedata.normalize("NFKC", c) if c in "ﬁﬂ" else c for i, c in enumerate(chars) if c != " "}


#: The standard encoding: ASCII with round quotes, and what stands above it.
STANDARD = {c: chr(c) for c in range(32, 127)} | {39: "’", 96: "‘"} | placed(STANDARD_UPPER, 161)


CODES = {codec: {i: bytes([i]).decode(codec, "replace") for i in range(256)} for codec in ("cp1252", "mac_roman")}


@lru_cache(maxsize=10_000)
def base_letter(text: str) -> int:
    """Code of the letter under an accent, 0 if it isn't ASCII."""
    base = unicodedata.normalize("NFD", text)[:1]
    return ord(base) if base and 32 <= ord(base) <= 126 else 0


class CMap:
    """Codes to text, as a font's ToUnicode stream lists them."""

    def __init__(self, data: bytes):
        self.map: dict[int, str] = {}
        self.ranges: list[tuple[int, int, str]] = []
        lexer, held = Lexer(data), []
        while (x := lexer.token()) is not END:
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x == b"endbfchar":
                for code, text in zip(held[::2], held[1::2]):
                    if isinstance(code, bytes) and isinstance(text, bytes):
                        self.map[int.from_bytes(code)] = self.text(text)
            elif x == b"endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3]):
                    if not (isinstance(low, bytes) and isinstance(high, bytes)):
                        continue
                    a, b = int.from_bytes(low), int.from_bytes(high)
                    if isinstance(to, list):
                        self.map.update({a + i: self.text(t) for i, t in enumerate(to[: b - a + 1]) if isinstance(t, bytes)})
                    elif isinstance(to, bytes):
                        self.ranges.append((a, b, self.text(to)))
            held = []

    @staticmethod
    def text(data: bytes) -> str:
        return data.decode("utf-16-be", "replace")

    def get(self, code: int) -> str | None:
        if code in self.map:
            return self.map[code]
        for a, b, text in self.ranges:
            if a <= code <= b and text:
                last = ord(text[-1]) + code - a
                return text[:-1] + (chr(last) if last < 0x110000 else "�")
        return None


class Font:
    """Codes of a string, each with its text, advance (in text units) and whether it is a blank of one byte."""

    def __init__(self, pdf: Pdf, info: dict):
        get = pdf.get
        self.kind = str(info.get("Subtype", ""))
        self.wide = self.kind == "Type0"
        self.cmap = None
        if isinstance(u := get(info.get("ToUnicode")), Stream):
            self.cmap = CMap(pdf.data(u))
        self.widths: dict[int, float] = {}
        self.scale, self.default = 0.001, 0.0
        self.texts: dict[int, str] = {}
        if self.wide:
            inner = get((get(info.get("DescendantFonts"), [{}]) or [{}])[0], {})
            self.default = get(inner.get("DW"), 1000)
            self.read_cid(pdf, get(inner.get("W"), []))
            return
        first = get(info.get("FirstChar"), 0)
        for i, w in enumerate(get(info.get("Widths"), [])):
            w = get(w)
            if isinstance(w, (int, float)):
                self.widths[first + i] = w
        descriptor = get(info.get("FontDescriptor"), {})
        self.default = get(descriptor.get("MissingWidth"), 0) if isinstance(descriptor, dict) else 0
        if self.kind == "Type3":
            matrix = get(info.get("FontMatrix"), [0.001])
            self.scale = abs(get(matrix[0])) or 0.001
        self.read_encoding(pdf, info, descriptor if isinstance(descriptor, dict) else {})
        if self.kind != "Type3" and not self.widths:
            self.standard_widths(str(info.get("BaseFont", "")))
        self.table = [(self.texts.get(c, "") if self.cmap is None or (t := self.cmap.get(c)) is None else t, self.widths.get(c, self.default) * self.scale, c == 32) for c in range(256)]

    def standard_widths(self, name: str) -> None:
        """Widths of the fonts that every reader has, by the letter under an accent."""
        if "Courier" in name:
            self.default = 600
            return
        serif = "Times" in name
        table, self.default = (SERIF_WIDTHS, 500) if serif else (SANS_WIDTHS, 556)
        factor = BOLD if "Bold" in name else 1.0
        for code, text in self.texts.items():
            if base := base_letter(text):
                self.widths[code] = table[base - 32] * factor

    def built_in(self, pdf: Pdf, name: str, descriptor: dict) -> dict[int, str] | None:
        """The encoding of a font that names none: its program's, or that of the standard font it is."""
        if isinstance(program := pdf.get(descriptor.get("FontFile")), Stream):
            found = {int(code): glyph_text(glyph.decode("latin-1")) for code, glyph in re.findall(rb"dup\s+(\d{1,3})\s*/(\S+)\s+put", pdf.data(program).partition(b"eexec")[0]) if int(code) < 256}
            return found or None
        if "Symbol" in name:
            return placed(SYMBOL_LOWER, 34) | placed(SYMBOL_UPPER, 161) | {32: " ", 33: "!"}
        if "Dingbats" in name:
            rule = {c: chr(0x2701 + c - 0x21) for c in range(0x21, 0x7F)} | {c: chr(0x2761 + c - 0xA1) for c in range(0xA1, 0xFF) if c != 0xF0}
            return rule | {c: chr(0x2460 + c - 0xAC) for c in range(0xAC, 0xB6)} | DINGBATS | {32: " "}
        if self.kind in ("Type1", "MMType1") and not any(k in descriptor for k in ("FontFile2", "FontFile3")):
            return STANDARD
        return None

    def read_encoding(self, pdf: Pdf, info: dict, descriptor: dict) -> None:
        encoding = pdf.get(info.get("Encoding"))
        base = encoding if isinstance(encoding, Name) else encoding.get("BaseEncoding") if isinstance(encoding, dict) else None
        self.texts = CODES["mac_roman" if base == "MacRomanEncoding" else "cp1252"]
        if base is None and (own := self.built_in(pdf, str(info.get("BaseFont", "")), descriptor)) is not None:
            self.texts = own
        elif base == "StandardEncoding":
            self.texts = STANDARD
        self.texts = dict(self.texts)
        if isinstance(encoding, dict):
            code = 0
            for x in pdf.get(encoding.get("Differences"), []):
                x = pdf.get(x)
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    text = glyph_text(x)
                    if text or self.kind != "Type3":
                        self.texts[code] = text
                    code += 1

    def read_cid(self, pdf: Pdf, w: list) -> None:
        i = 0
        while i + 1 < len(w):
            first, second = pdf.get(w[i]), pdf.get(w[i + 1])
            if isinstance(second, list):
                self.widths.update({first + k: pdf.get(x) for k, x in enumerate(second)})
                i += 2
            elif i + 2 < len(w):
                value = pdf.get(w[i + 2])
                if second - first < 70_000:
                    self.widths.update(dict.fromkeys(range(first, second + 1), value))
                i += 3
            else:
                break

    def glyphs(self, data: bytes):
        if self.wide:
            for i in range(0, len(data) - 1, 2):
                code = data[i] << 8 | data[i + 1]
                text = self.cmap.get(code) if self.cmap else None
                yield chr(code) if text is None and not 0xD800 <= code < 0xE000 else text or "", self.widths.get(code, self.default) * 0.001, False
            return
        yield from map(self.table.__getitem__, data)


def times(a, b):
    """Product of two transformations (a first)."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


@dataclass
class Span:
    text: str
    x0: float
    x1: float
    y: float
    size: float


@dataclass
class PageText:
    """What one page shows: flat text, spans, glyphs, painted paths and named pictures."""

    width: float
    height: float
    flat: list[str] = field(default_factory=list)
    spans: list[Span] = field(default_factory=list)
    #: Runs of glyphs along a line: texts, advances, place of the first one, size.
    glyphs: list[tuple[list[str], list[float], float, float, float]] = field(default_factory=list)
    paths: list[tuple[str, str]] = field(default_factory=list)
    images: list[Ref] = field(default_factory=list)
    curves: int = 0


@dataclass
class State:
    ctm: tuple = ONE
    font: Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    clip: tuple | None = None


class Work:
    """Counts operations against a limit."""

    def __init__(self, most: int | None):
        self.most, self.done = most, 0

    def charge(self) -> None:
        self.done += 1
        if self.most is not None and self.done > self.most:
            raise ParseError("work_budget_exceeded")


class Interpreter:
    """Runs the content of one page."""

    DEEPEST = 16

    def __init__(self, pdf: Pdf, page: dict, work: Work):
        box = [float(pdf.get(x, 0)) for x in pdf.get(page.get("MediaBox"), [0, 0, 612, 792])]
        self.pdf, self.work = pdf, work
        self.low = (min(box[0], box[2]), min(box[1], box[3]))
        self.out = PageText(abs(box[2] - box[0]), abs(box[3] - box[1]))
        #: Fonts of the whole file by the identity of their dictionaries, which the file keeps.
        self.fonts: dict[int, tuple[dict, Font]] = pdf.fonts
        self.last_x = self.last_y = 0.0
        self.span: Span | None = None
        self.parts: list[str] = []
        self.span_x = self.span_y = 0.0
        self.seen: set = set()
        self.run(pdf.contents(page), pdf.get(page.get("Resources"), {}), State(), 0)
        self.flush()

    def run(self, data: bytes, resources: dict, state: State, depth: int) -> None:
        get = self.pdf.get
        fonts, objects = get(resources.get("Font"), {}), get(resources.get("XObject"), {})
        stack: list[State] = []
        matrix = line = ONE
        path: list[tuple] = []
        clipping = False
        lexer, args = Lexer(data), []
        while (x := lexer.token()) is not END:
            if not isinstance(x, Word):
                args.append(x)
                continue
            self.work.charge()
            op, a = bytes(x), args
            args = []
            num = [v for v in a if isinstance(v, (int, float)) and not isinstance(v, bool)]
            try:
                if op == b"q":
                    stack.append(State(**vars(state)))
                elif op == b"Q":
                    state = stack.pop() if stack else state
                elif op == b"cm":
                    state.ctm = times(tuple(num[:6]), state.ctm)
                elif op == b"BT":
                    matrix = line = ONE
                elif op == b"Tf":
                    state.font, state.size = self.font(fonts.get(str(a[0]))), float(num[-1])
                elif op == b"Tc":
                    state.char = float(num[0])
                elif op == b"Tw":
                    state.word = float(num[0])
                elif op == b"Tz":
                    state.scale = num[0] / 100
                elif op == b"TL":
                    state.leading = float(num[0])
                elif op == b"Ts":
                    state.rise = float(num[0])
                elif op == b"Tm":
                    matrix = line = tuple(map(float, num[:6]))
                elif op in (b"Td", b"TD"):
                    if op == b"TD":
                        state.leading = -num[1]
                    matrix = line = times((1, 0, 0, 1, num[0], num[1]), line)
                elif op in (b"T*", b"'", b'"'):
                    if op == b'"':
                        state.word, state.char = float(num[0]), float(num[1])
                    matrix = line = times((1, 0, 0, 1, 0, -state.leading), line)
                    if op != b"T*":
                        matrix = self.show(a[-1], state, matrix)
                elif op == b"Tj":
                    matrix = self.show(a[0], state, matrix)
                elif op == b"TJ":
                    for part in a[0]:
                        if isinstance(part, bytes):
                            matrix = self.show(part, state, matrix)
                        elif isinstance(part, (int, float)):
                            matrix = times((1, 0, 0, 1, -part / 1000 * state.size * state.scale, 0), matrix)
                elif op in (b"m", b"l", b"c", b"v", b"y", b"re", b"h"):
                    self.extend(path, op, num, state.ctm)
                elif op in (b"W", b"W*"):
                    clipping = True
                elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
                    if clipping:
                        state.clip = self.clipped(state.clip, path)
                    if op != b"n" and path:
                        self.paint(path, op)
                    path, clipping = [], False
                elif op == b"Do":
                    self.draw(objects.get(str(a[0])), resources, state, depth)
                elif op == b"BI":
                    lexer.at = self.after_inline(data, lexer.at)
            except ParseError:
                raise
            except (IndexError, TypeError, ValueError, AttributeError, KeyError, ZeroDivisionError):
                continue  # an operator without its operands is left out

    @staticmethod
    def after_inline(data: bytes, at: int) -> int:
        m = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)").search(data, at)
        return m.end() if m else len(data)

    def font(self, ref) -> Font | None:
        info = self.pdf.get(ref)
        if not isinstance(info, dict):
            return None
        if id(info) not in self.fonts:  # with the dictionary, whose identity then stays its own
            self.fonts[id(info)] = (info, Font(self.pdf, info))
        return self.fonts[id(info)][1]

    def extend(self, path: list, op: bytes, num: list, ctm: tuple) -> None:
        at = lambda x, y: (x * ctm[0] + y * ctm[2] + ctm[4], x * ctm[1] + y * ctm[3] + ctm[5])
        if op == b"re":
            x, y, w, h = num[:4]
            path += [("M", [at(x, y)]), ("L", [at(x + w, y)]), ("L", [at(x + w, y + h)]), ("L", [at(x, y + h)]), ("Z", [])]
        elif op == b"h":
            path.append(("Z", []))
        else:
            points = [at(*p) for p in zip(num[::2], num[1::2])]
            if op == b"v":
                points.insert(0, next((p[1][-1] for p in reversed(path) if p[1]), points[0]))
            elif op == b"y":
                points.append(points[-1])
            path.append(("M" if op == b"m" else "L" if op == b"l" else "C", points))

    @staticmethod
    def clipped(old, path):
        points = [p for _, ps in path for p in ps]
        if not points:
            return old
        box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))
        return box if old is None else (max(old[0], box[0]), max(old[1], box[1]), min(old[2], box[2]), min(old[3], box[3]))

    def paint(self, path: list, op: bytes) -> None:
        self.out.curves += sum(k == "C" for k, _ in path)
        flip = lambda p: f"{p[0] - self.low[0]:.2f} {self.out.height - (p[1] - self.low[1]):.2f}"
        text = " ".join(f"{k}{' '.join(map(flip, ps))}" for k, ps in path)
        self.out.paths.append(("fill" if op[:1] in b"fFbB" else "stroke", text))

    def draw(self, ref, resources: dict, state: State, depth: int) -> None:
        target = self.pdf.get(ref)
        if not isinstance(target, Stream) or depth >= self.DEEPEST:
            return
        if target.info.get("Subtype") == "Image":
            if isinstance(ref, Ref) and ref not in self.out.images:
                self.out.images.append(ref)
            return
        if target.info.get("Subtype") != "Form" or id(target) in self.seen:
            return
        self.seen.add(id(target))
        inner = State(**vars(state))
        matrix = [float(self.pdf.get(v, 0)) for v in self.pdf.get(target.info.get("Matrix"), ONE)]
        inner.ctm = times(tuple(matrix), state.ctm)
        self.run(self.pdf.data(target), self.pdf.get(target.info.get("Resources"), resources), inner, depth + 1)
        self.seen.discard(id(target))

    def show(self, data: bytes, state: State, matrix: tuple) -> tuple:
        """Shows a string; returns the text matrix behind it.

        Only the place moves from glyph to glyph, along the baseline, so everything else of the
        transformation is computed once a string.
        """
        font = state.font
        if font is None:
            return matrix
        place = times((state.size * state.scale, 0, 0, state.size, 0, state.rise), base := times(matrix, state.ctm))
        size = abs((place[0] + place[2]) * (place[1] + place[3])) ** 0.5 or (abs(place[0]) + abs(place[3])) / 2
        step_x, step_y = base[0], base[1]
        at_x, at_y = place[4] - self.low[0], self.out.height - (place[5] - self.low[1])
        clip = state.clip
        if clip is not None:
            clip = (clip[0] - size - self.low[0], self.out.height - (clip[3] + size - self.low[1]), clip[2] + size - self.low[0], self.out.height - (clip[1] - size - self.low[1]))
        moved, first = 0.0, True
        flat, glyphs = self.out.flat, self.out.glyphs
        if clip is None and not font.wide and len(data) > 1 and not (state.char or state.word or step_y) and abs(state.size * state.scale * step_x - size) < 1e-9 * size:
            shown = [font.table[c] for c in data]
            texts = [t for t, _, _ in shown]
            if all(texts):
                # every glyph begins where the one before ends, so only the first can begin a line or a word
                advances = [a for _, a, _ in shown]
                self.begin(at_x, at_y, size)
                flat.extend(texts)
                glyphs.append((texts, advances, at_x, at_y, size))
                moved = sum(advances)
                end = at_x + moved * size
                self.extend_span(texts[0], at_x, at_y, at_x + advances[0] * size, size)
                self.parts.extend(texts[1:])
                self.span.x1 = max(self.span.x1, end)
                self.last_x, self.last_y, self.span_x = end, at_y, end
                moved *= state.size * state.scale
                return (*matrix[:4], matrix[4] + moved * matrix[0], matrix[5] + moved * matrix[1])
        for text, advance, blank in font.glyphs(data):
            if text:
                x, y = at_x + moved * step_x, at_y - moved * step_y
                if clip is None or (clip[0] <= x <= clip[2] and clip[1] <= y <= clip[3]):
                    end = x + advance * size
                    if first:
                        self.begin(x, y, size)
                        first = False
                    flat.append(text)
                    glyphs.append(([text], [advance], x, y, size))
                    self.last_x, self.last_y = end, y
                    self.extend_span(text, x, y, end, size)
            moved += (advance * state.size + state.char + (state.word if blank else 0)) * state.scale
        return (*matrix[:4], matrix[4] + moved * matrix[0], matrix[5] + moved * matrix[1])

    def begin(self, x: float, y: float, size: float) -> None:
        """Line breaks and a blank in front of a string, by its place behind the one before."""
        down = abs(y - self.last_y)
        if down > 1.5 * size:
            self.out.flat.append("\n")
        if x < self.last_x and down > 0.5 * size:
            self.out.flat.append("\n")
        if x > self.last_x + 0.1 * size:
            self.out.flat.append(" ")

    def extend_span(self, text: str, x: float, y: float, end: float, size: float) -> None:
        """Adds a glyph to the open span, or begins another after a jump."""
        s = self.span
        if s is not None and (abs(y - self.span_y) > max(size, s.size) * 0.5 or x < self.span_x - 0.1 * size or x > self.span_x + 0.5 * size):
            self.flush()
            s = None
        if s is None:
            self.span, self.parts = Span("", x, end, y, size), [text]
        else:
            if x > self.span_x + 0.1 * size:
                self.parts.append(" ")
            self.parts.append(text)
            if end > s.x1:
                s.x1 = end
        self.span_x, self.span_y = end, y

    def flush(self) -> None:
        if self.span is not None:
            self.span.text = "".join(self.parts)
            if self.span.text.strip():
                self.out.spans.append(self.span)
        self.span = None


# ---- reading order ----


def gutter(spans: list[Span], width: float) -> float | None:
    """Middle of the gap between two columns, if a page surely has two."""
    if width <= 0 or len(spans) < 6:
        return None
    best, reach = None, None
    for a, b in sorted((s.x0, s.x1) for s in spans if s.x1 > s.x0):
        if reach is not None and a > reach and 0.2 * width <= (a + reach) / 2 <= 0.8 * width and (best is None or a - reach > best[1] - best[0]):
            best = (reach, a)
        reach = b if reach is None else max(reach, b)
    if best is None:
        return None
    sizes = sorted(s.size for s in spans if s.size > 0)
    if best[1] - best[0] < max(sizes[len(sizes) // 2] if sizes else 0, 0.03 * width):
        return None
    if sum(s.x1 <= best[0] for s in spans) < 3 or sum(s.x0 >= best[1] for s in spans) < 3:
        return None
    return sum(best) / 2


def lines_of(spans: list[Span]) -> list[str]:
    """Spans as lines from the top, each from the left."""
    lines: list[list[Span]] = []
    base = 0.0
    for s in sorted(spans, key=lambda s: (s.y, s.x0)):
        if lines and abs(s.y - base) <= 0.6 * max(1.0, s.size):
            lines[-1].append(s)
        else:
            lines.append([s])
            base = s.y
    return [" ".join(s.text for s in sorted(line, key=lambda s: s.x0)) for line in lines]


def columns_text(page: PageText) -> str | None:
    """Text column by column where a page has two, else None."""
    middle = gutter(page.spans, page.width)
    if middle is None:
        return None
    left = [s for s in page.spans if (s.x0 + s.x1) / 2 < middle]
    right = [s for s in page.spans if not (s.x0 + s.x1) / 2 < middle]
    return "\n".join(lines_of(left) + lines_of(right))


def recovered_tables(text: str) -> str:
    """Runs of three or more lines with three or more cells (two blanks apart) as Markdown tables.

    One blank line between two rows belongs to the run.
    """

    def cells(line: str) -> list[str]:
        parts = (c.strip() for c in line.split("  "))
        return [c for c in parts if c and not (c.startswith("[Table") and c.endswith("]"))]

    lines = text.split("\n")
    rows = [c if len(c := cells(x)) >= 3 else None for x in lines]
    out, i = [], 0
    while i < len(lines):
        run, last, j = [], i, i
        while j < len(lines) and (rows[j] or (run and not lines[j].strip() and j + 1 < len(lines) and rows[j + 1])):
            if rows[j]:
                run.append(rows[j])
                last = j
            j += 1
        if len(run) < 3:
            out.append(lines[i])
            i += 1
            continue
        width = max(map(len, run))
        table = ["| " + " | ".join([*(c.replace("|", "\\|") for c in r), *[""] * (width - len(r))]) + " |" for r in run]
        table.insert(1, "|" + " --- |" * width)
        out += [*([""] if out else []), *table, *([""] if last + 1 < len(lines) else [])]
        i = last + 1
    return "\n".join(out)
