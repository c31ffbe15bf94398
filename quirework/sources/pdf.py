"""The text layer of PDF files: objects, streams, pages, and the operators that show text.

Objects are found where they stand in the file, the last of a number counting, so that damaged or missing cross-reference tables do no harm; objects packed in
streams are added. Codes of a font become characters by its ToUnicode map, else by its encoding and the names of its differences. A new line begins where the
baseline moves, a word where a shift within a line is wide. What can't be read raises ValueError."""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from functools import lru_cache
from typing import Any, NamedTuple

#: Pages within pages, forms within forms, arrays within arrays.
DEPTH = 24
#: A shift within a line, in thousandths of the font's size, that parts words.
WORD = 200
#: Bytes that one stream may unpack to.
MOST = 1 << 28
DELIMITERS = b"()<>[]{}/%"
SPACES = b"\0\t\n\f\r "
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_WORD = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_BLANK = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REFERENCE = re.compile(rb"[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_INTEGER, _REAL, _ESCAPED = re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?(\d+\.\d*|\.\d+)"), re.compile(rb"#([0-9A-Fa-f]{2})")
_HEX, _NO_HEX, _OCTAL, _PLAIN = re.compile(rb"<((?:[0-9A-Fa-f]{2})*)>"), re.compile(rb"[^0-9A-Fa-f]"), re.compile(rb"[0-7]{1,3}"), re.compile(rb"[^\\()]+")
#: Bytes up to which the map of a font is kept for documents that have the same one.
KEPT = 1 << 16
#: Names of accents and marks within the names of characters, and of characters that a single letter doesn't name.
ACCENTS = {
    "acute": "́", "caron": "̌", "ring": "̊", "dieresis": "̈", "circumflex": "̂", "grave": "̀", "tilde": "̃",
    "cedilla": "̧", "ogonek": "̨", "hungarumlaut": "̋", "breve": "̆", "dotaccent": "̇", "macron": "̄",
}
MARKS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oslash": "ø", "Oslash": "Ø", "lslash": "ł", "Lslash": "Ł",
    "dcroat": "đ", "Dcroat": "Đ", "degree": "°", "section": "§", "copyright": "©",
}


class Name(str):
    """A /Name."""


class Ref(NamedTuple):
    number: int


class Operator(NamedTuple):
    name: bytes


class Stream(NamedTuple):
    info: dict
    raw: bytes


_CONSTANTS = {b"true": True, b"false": False, b"null": None}


class Reader:
    """Values from bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _BLANK.match(self.data, self.at).end()

    def value(self, refs: bool = True, depth: int = 0) -> Any:
        """The next value; EOFError at the end."""
        if depth > DEPTH:
            raise ValueError("values too deep")
        self.skip()
        d, at = self.data, self.at
        if at >= len(d):
            raise EOFError
        c = d[at : at + 1]
        if c == b"/":
            m = _WORD.match(d, at + 1)
            self.at = m.end() if m else at + 1
            return Name(_ESCAPED.sub(lambda x: bytes([int(x[1], 16)]), m[0]).decode("latin-1") if m else "")
        if c == b"(":
            return self._string()
        if d[at : at + 2] == b"<<":
            self.at += 2
            return self._dict(refs, depth)
        if c == b"<":
            if m := _HEX.match(d, at):
                self.at = m.end()
                return bytes.fromhex(m[1].decode())
            end = d.find(b">", at)
            digits = _NO_HEX.sub(b"", d[at + 1 : end if end >= 0 else len(d)])
            self.at = end + 1 if end >= 0 else len(d)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.at >= len(d) or d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value(refs, depth + 1))
        if c in b")>]{}":
            self.at += 2 if d[at : at + 2] == b">>" else 1
            return Operator(c)
        word = _WORD.match(d, at)
        self.at = word.end()
        return self._word(word[0], refs)

    def _word(self, word: bytes, refs: bool) -> Any:
        if _INTEGER.fullmatch(word):
            if refs and (m := _REFERENCE.match(self.data, self.at)):
                self.at = m.end()
                return Ref(int(word))
            return int(word)
        if _REAL.fullmatch(word):
            return float(word)
        return _CONSTANTS[word] if word in _CONSTANTS else Operator(word)

    def _dict(self, refs: bool, depth: int) -> dict:
        out = {}
        while True:
            self.skip()
            if self.at >= len(self.data) or self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            k = self.value(refs, depth + 1)
            self.skip()
            if self.data[self.at : self.at + 2] != b">>" and isinstance(k, Name):
                out[k] = self.value(refs, depth + 1)

    def _string(self) -> bytes:
        d, i, open_, out = self.data, self.at + 1, 1, bytearray()
        while i < len(d):
            if m := _PLAIN.match(d, i):
                out += m[0]
                i = m.end()
                continue
            c = d[i]
            if c == 0x5C:
                i += 1
                nxt = d[i : i + 1]
                if nxt in (b"n", b"r", b"t", b"b", b"f") and nxt:
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}[nxt]
                elif m := _OCTAL.match(d, i):
                    out.append(int(m[0], 8) & 255)
                    i = m.end() - 1
                elif nxt in (b"\r", b"\n"):
                    i += d[i : i + 2] == b"\r\n"
                else:
                    out += nxt
            elif c == 0x29 and open_ == 1:
                i += 1
                break
            else:
                open_ += (c == 0x28) - (c == 0x29)
                out.append(c)
            i += 1
        self.at = i
        return bytes(out)


def _inflated(raw: bytes) -> bytes:
    engine = zlib.decompressobj()
    try:
        out = engine.decompress(raw, MOST)
    except zlib.error:
        engine, out = zlib.decompressobj(), b""
        for i in range(0, len(raw), 512):  # what can be read of a damaged stream
            try:
                out += engine.decompress(raw[i : i + 512], MOST)
            except zlib.error:
                break
    return out


def _unpredicted(data: bytes, parms: dict) -> bytes:
    """Rows that a predictor has changed, as they were."""
    if parms.get("Predictor", 1) < 10:
        return data
    pixel = max(1, parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)
    size = -(-parms.get("Columns", 1) * parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)
    above, out = bytearray(size), bytearray()
    for at in range(0, len(data), size + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + size])
        for i in range(len(row)):
            a, b, c = row[i - pixel] if i >= pixel else 0, above[i], above[i - pixel] if i >= pixel else 0
            if kind == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                near = (0, a, b, (a + b) // 2)[kind] if kind < 4 else 0
            row[i] = row[i] + near & 255
        out += row
        above = row + bytes(size - len(row))
    return bytes(out)


def _ascii85(raw: bytes) -> bytes:
    out, held = bytearray(), []
    for c in raw.partition(b"~")[0]:
        if c == 0x7A and not held:
            out += bytes(4)
        elif 33 <= c <= 117:
            held.append(c - 33)
            if len(held) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(held)) & 0xFFFFFFFF).to_bytes(4, "big")
                held = []
    if len(held) > 1:
        n = len(held) - 1
        held += [84] * (5 - len(held))
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(held)) & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    return bytes(out)


class Document:
    def __init__(self, raw: bytes):
        if b"%PDF" not in raw[:1024]:
            raise ValueError("no PDF")
        self.raw, self.cached, self.trailer = raw, {}, {}
        self.where = {int(m[1]): m.end() for m in _OBJECT.finditer(raw)}
        self.packed: dict[int, Any] = {}
        self.fonts: dict[int, Font] = {}
        for m in re.finditer(rb"\btrailer\b", raw):
            t = self._try(lambda m=m: Reader(raw, m.end()).value())
            self.trailer |= t if isinstance(t, dict) else {}
        for n in sorted(self.where, key=self.where.get):
            head = raw[self.where[n] : self.where[n] + 2000]
            if b"/ObjStm" in head or b"/XRef" in head:
                s = self.get(Ref(n))
                if isinstance(s, Stream) and s.info.get("Type") == "XRef":
                    self.trailer |= s.info
                elif isinstance(s, Stream) and s.info.get("Type") == "ObjStm":
                    self._unpack(s)
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")

    @staticmethod
    def _try(f) -> Any:
        try:
            return f()
        except (EOFError, ValueError, IndexError, TypeError):
            return None

    def _unpack(self, s: Stream) -> None:
        data, first = self.bytes_of(s), self.get(s.info.get("First"), 0)
        reader = Reader(data)
        pairs = [(reader.value(False), reader.value(False)) for _ in range(self.get(s.info.get("N"), 0)) if reader.at < first]
        for number, at in pairs:
            if isinstance(number, int) and isinstance(at, int) and number not in self.where:
                self.packed[number] = self._try(lambda at=at: Reader(data, first + at).value())

    def get(self, v: Any, default: Any = None) -> Any:
        """What a value stands for; references are followed."""
        for _ in range(DEPTH):
            if not isinstance(v, Ref):
                break
            if v.number not in self.cached:
                self.cached[v.number] = None  # a reference to itself is null
                self.cached[v.number] = self._try(lambda v=v: self._object(v.number))
            v = self.cached[v.number]
        return default if v is None or isinstance(v, Ref) else v

    def _object(self, number: int) -> Any:
        if number not in self.where:
            return self.packed.get(number)
        r = Reader(self.raw, self.where[number])
        v = r.value()
        r.skip()
        if isinstance(v, dict) and self.raw.startswith(b"stream", r.at):
            at = r.at + 6
            at += 2 if self.raw[at : at + 2] == b"\r\n" else 1 if self.raw[at : at + 1] in (b"\n", b"\r") else 0
            size = self.get(v.get("Length"))
            if not isinstance(size, int) or not re.match(rb"\s*endstream", self.raw[at + size : at + size + 20]):
                end = self.raw.find(b"endstream", at)
                size = (end if end >= 0 else len(self.raw)) - at
            return Stream(v, self.raw[at : at + size])
        return v

    def bytes_of(self, s: Stream) -> bytes:
        names, parms = self.get(s.info.get("Filter"), []), self.get(s.info.get("DecodeParms"), {})
        names = names if isinstance(names, list) else [names]
        parms = parms if isinstance(parms, list) else [parms]
        data = s.raw
        for i, name in enumerate(self.get(n) for n in names):
            if name in ("FlateDecode", "Fl"):
                p = self.get(parms[i], {}) if i < len(parms) else {}
                data = _unpredicted(_inflated(data), {k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {})
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif name in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            else:
                raise ValueError(f"filter {name}")
        return data

    def info(self) -> dict[str, str]:
        d = self.get(self.trailer.get("Info"), {})
        return {k.lower(): told(v) for k, x in d.items() if isinstance(v := self.get(x), bytes)} if isinstance(d, dict) else {}

    def pages(self) -> list[dict]:
        """Pages in order, each with the resources that it inherits."""
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict) or "Pages" not in root:
            found = (self.get(Ref(n)) for n in [*self.where, *self.packed])
            root = next((v for v in found if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        out: list[dict] = []
        seen: set[int] = set()

        def walk(v: Any, resources: Any, depth: int) -> None:
            if isinstance(v, Ref):
                if v.number in seen:
                    return
                seen.add(v.number)
            node = self.get(v)
            if not isinstance(node, dict) or depth > DEPTH:
                return
            resources = node.get("Resources", resources)
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for k in kids:
                    walk(k, resources, depth + 1)
            else:
                out.append(node | {"Resources": resources})

        walk(root.get("Pages"), None, 0)
        return out

    def text(self, page: dict) -> str:
        contents = self.get(page.get("Contents"), [])
        parts = [self.get(c) for c in (contents if isinstance(contents, list) else [contents])]
        data = b"\n".join(self.bytes_of(p) for p in parts if isinstance(p, Stream))
        shown = Shown()
        self._show(data, self.get(page.get("Resources"), {}), shown, 0)
        return "".join(shown.out)

    def font(self, v: Any) -> Font:
        made = self.fonts.get(v.number) if isinstance(v, Ref) else None
        if made is None:
            d = self.get(v)
            made = Font(self, d if isinstance(d, dict) else {})
            if isinstance(v, Ref):
                self.fonts[v.number] = made
        return made

    def _show(self, data: bytes, resources: dict, shown: Shown, depth: int) -> None:
        reader, held = Reader(data), []
        named = lambda kind, n: found.get(n) if isinstance(found := self.get(resources.get(kind)), dict) else None
        while True:
            try:
                v = reader.value(False)
            except EOFError:
                return
            if not isinstance(v, Operator):
                held.append(v)
                continue
            op, args, held = v.name, held, []
            if op == b"Tf" and len(args) > 1 and isinstance(args[-2], Name):
                shown.font = self.font(named("Font", args[-2]))
            elif op == b"Do" and args and depth < DEPTH:
                form = self.get(named("XObject", args[-1]))
                if isinstance(form, Stream) and form.info.get("Subtype") == "Form":
                    self._show(self.bytes_of(form), self.get(form.info.get("Resources"), resources), shown, depth + 1)
            elif op == b"BI":  # an image within the content
                end = re.compile(rb"\sEI(?=[\0\t\n\f\r ]|$)").search(data, reader.at)
                reader.at = end.end() if end else len(data)
            else:
                shown.step(op, args)


class Shown:
    """Text in the order it is shown, with the line that it stands on."""

    def __init__(self):
        self.out: list[str] = []
        self.font: Font | None = None
        self.x = self.y = self.leading = 0.0
        self.last: float | None = None
        self.moved = False

    def step(self, op: bytes, args: list) -> None:
        number = lambda i: args[i] if len(args) >= -i and isinstance(args[i], int | float) else 0
        if op == b"BT":
            self.x = self.y = 0.0
        elif op in (b"Td", b"TD"):
            self._move(number(-2), number(-1))
            if op == b"TD":
                self.leading = -number(-1)
        elif op == b"Tm":
            self.moved |= number(-1) == self.y and number(-2) != self.x
            self.x, self.y = number(-2), number(-1)
        elif op == b"TL":
            self.leading = number(-1)
        elif op == b"T*":
            self._move(0, -self.leading)
        elif op in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
            if op != b"Tj":
                self._move(0, -self.leading)
            self.show(args[-1])
        elif op == b"TJ" and args and isinstance(args[-1], list):
            for v in args[-1]:
                if isinstance(v, bytes):
                    self.show(v)
                elif isinstance(v, int | float) and v < -WORD and self.out and not self.out[-1].endswith((" ", "\n")):
                    self.out.append(" ")

    def _move(self, x: float, y: float) -> None:
        self.moved |= not y and x > 0
        self.x += x
        self.y += y

    def show(self, code: bytes) -> None:
        text = self.font.told(code) if self.font else code.decode("latin-1")
        if not text:
            return
        if self.last is not None and self.last != self.y:
            self.out.append("\n")
        elif self.moved and self.out and not self.out[-1].endswith((" ", "\n")) and not text.startswith(" "):
            self.out.append(" ")
        self.out.append(text)
        self.last, self.moved = self.y, False


class Font:
    """How the codes of a font read."""

    def __init__(self, doc: Document, d: dict):
        self.map: dict[bytes, str] = {}
        #: (bytes of a code, first, last, characters of the first), in order
        self.ranges: list[tuple[int, int, int, bytes]] = []
        self.sizes = [1]
        to = doc.get(d.get("ToUnicode"))
        encoding = doc.get(d.get("Encoding"))
        if isinstance(to, Stream):
            data = doc.bytes_of(to)
            found, self.ranges, self.sizes = (_kept_unicode if len(data) <= KEPT else _unicode)(data)
            self.map = dict(found)  # known() adds to it
        elif d.get("Subtype") == "Type0":
            self.sizes = [2]  # codes of glyphs, without a way to characters
        else:
            base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
            codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
            self.map = {bytes([c]): bytes([c]).decode(codec, "ignore") for c in range(256)}
            at = 0
            for v in doc.get(encoding.get("Differences"), []) if isinstance(encoding, dict) else []:
                v = doc.get(v)
                if isinstance(v, int):
                    at = v
                elif isinstance(v, Name):
                    if at < 256:
                        self.map[bytes([at])] = named(v)
                    at += 1

    def known(self, code: bytes) -> str | None:
        if code in self.map:
            return self.map[code]
        n = int.from_bytes(code, "big")
        at = bisect_right(self.ranges, (len(code), n, 1 << 62)) - 1
        if at < 0 or self.ranges[at][0] != len(code) or n > self.ranges[at][2]:
            return None
        _, first, _, to = self.ranges[at]
        last = (int.from_bytes(to[-2:], "big") + n - first) & 0xFFFF
        self.map[code] = found = (to[:-2] + last.to_bytes(2, "big")).decode("utf-16-be", "surrogatepass")
        return found

    def told(self, code: bytes) -> str:
        out, at = [], 0
        if len(self.sizes) == 1:
            size, get = self.sizes[0], self.map.get
            parts = (code[i : i + size] for i in range(0, len(code), size))
            out, at = [get(c) or self.known(c) or "" for c in parts], len(code)
        while at < len(code):
            size = next((s for s in self.sizes if self.known(code[at : at + s]) is not None), self.sizes[-1])
            out.append(self.known(code[at : at + size]) or "")
            at += size
        # halves of a pair may come as two codes
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _unicode(data: bytes) -> tuple[dict[bytes, str], list[tuple[int, int, int, bytes]], list[int]]:
    """Characters of single codes, ranges of codes and the sizes of codes that a ToUnicode map has."""
    known: dict[bytes, str] = {}
    ranges: list[tuple[int, int, int, bytes]] = []
    reader, held, sizes = Reader(data), [], set()
    chars = lambda v: v.decode("utf-16-be", "replace") if isinstance(v, bytes) else named(v) if isinstance(v, Name) else ""
    while True:
        try:
            v = reader.value(False)
        except EOFError:
            break
        if not isinstance(v, Operator):
            held.append(v)
            continue
        if v.name == b"endcodespacerange":
            sizes |= {len(c) for c in held if isinstance(c, bytes)}
        elif v.name == b"endbfchar":
            known |= {c: chars(t) for c, t in zip(held[::2], held[1::2], strict=False) if isinstance(c, bytes)}
        elif v.name == b"endbfrange":
            for lo, hi, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
                    continue
                first, last = int.from_bytes(lo, "big"), int.from_bytes(hi, "big")
                if isinstance(to, list):
                    known |= {(first + i).to_bytes(len(lo), "big"): chars(t) for i, t in enumerate(to[: last - first + 1])}
                elif isinstance(to, bytes) and len(to) >= 2:
                    ranges.append((len(lo), first, last, to))
        held = []
    ranges.sort()
    return known, ranges, sorted(sizes - {0}) or [max([*map(len, known), *(r[0] for r in ranges)], default=1)]


_kept_unicode = lru_cache(maxsize=32)(_unicode)


def named(name: str) -> str:
    """The character of a glyph's name."""
    name = name.partition(".")[0]
    if name in MARKS or len(name) == 1:
        return MARKS.get(name, name)
    if m := re.fullmatch(r"(?:uni|u)([0-9A-Fa-f]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else ""
    if name[1:] in ACCENTS:
        return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
    return ""


def told(raw: bytes) -> str:
    """A text string of a document's information."""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace").strip("\0 ")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace").strip()
    return raw.decode("cp1252", "replace").strip("\0 ")
