"""Mobipocket and Palm books: the records of a Palm database, their compressions, the extended header's metadata and the text.

Text records are packed by PalmDOC's byte pairs or by Huffman codes of phrases (which may be packed themselves); bytes behind a record's text, told by the
header's flags, are cut off first. Of a book in the newer layout the first section, its markup, is the text. What is damaged or protected raises ValueError."""

from __future__ import annotations

import re
import struct

#: Fields of the extended header.
AUTHOR, PUBLISHER, ISBN, TITLE, LANGUAGE = 100, 101, 104, 503, 524
PLAIN, PALMDOC, HUFF = 1, 2, 17480
ENCODINGS = {1252: "cp1252", 65001: "utf-8"}
#: Phrases within phrases; a damaged table could refer to itself.
DEPTH = 32


def records(raw: bytes) -> list[bytes]:
    """The records of a Palm database."""
    if len(raw) < 78:
        raise ValueError("shorter than a database header")
    n = struct.unpack_from(">H", raw, 76)[0]
    if len(raw) < 78 + 8 * n or not n:
        raise ValueError("the list of records is cut off")
    at = [struct.unpack_from(">I", raw, 78 + 8 * i)[0] for i in range(n)] + [len(raw)]
    if any(a > b for a, b in zip(at, at[1:], strict=False)):
        raise ValueError("records out of order")
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


#: Bytes that stand for themselves.
_LITERAL = re.compile(rb"[\x00\x09-\x7f]+")


def _palmdoc(data: bytes) -> bytes:
    out = bytearray()
    i, n = 0, len(data)
    while i < n:
        c = data[i]
        if c == 0 or 9 <= c < 0x80:
            run = _LITERAL.match(data, i)
            out += run[0]
            i = run.end()
            continue
        i += 1
        if c < 9:
            out += data[i : i + c]
            i += c
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        else:
            if i >= n:
                raise ValueError("a reference is cut off")
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            back, size = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise ValueError("a reference points before the text")
            at = len(out) - back
            out += out[at : at + size] if size <= back else (out[at:] * size)[:size]  # it may overlap what it writes
    return bytes(out)


class Huffman:
    """Codes of phrases: a HUFF record says how codes are told apart, CDIC records hold the phrases."""

    def __init__(self, huff: bytes, dictionaries: list[bytes]):
        if huff[:4] != b"HUFF" or any(d[:4] != b"CDIC" for d in dictionaries):
            raise ValueError("no table of codes")
        near, far = struct.unpack_from(">II", huff, 8)
        # by the first byte of a code: its length, whether that is final, the greatest code of this length
        self.first = [(v & 31, v & 128, v >> 8) for v in struct.unpack_from(">256I", huff, near)]
        ends = struct.unpack_from(">64I", huff, far)
        self.least, self.most = (0, *ends[0::2]), (0, *ends[1::2])
        self.phrases: list[tuple[bytes, bool]] = []
        for d in dictionaries:
            total, bits = struct.unpack_from(">II", d, 8)
            for offset in struct.unpack_from(f">{min(1 << bits, total - len(self.phrases))}H", d, 16):
                size = struct.unpack_from(">H", d, 16 + offset)[0]
                self.phrases.append((d[18 + offset : 18 + offset + (size & 0x7FFF)], bool(size & 0x8000)))

    def unpacked(self, data: bytes, depth: int = 0) -> bytes:
        if depth > DEPTH:
            raise ValueError("phrases refer to themselves")
        out, bits, total = [], int.from_bytes(data + bytes(8), "big"), 8 * len(data)
        at, end = 0, total + 64
        while at < total:
            code = bits >> (end - at - 32) & 0xFFFFFFFF
            size, final, most = self.first[code >> 24]
            if not final:
                while size <= 32 and (not size or code >> (32 - size) < self.least[size]):
                    size += 1
                if size > 32:
                    raise ValueError("no such code")
                most = self.most[size]
            at += size
            if not size or at > total:
                break
            number = most - (code >> (32 - size))
            if not 0 <= number < len(self.phrases):
                raise ValueError("no such phrase")
            phrase, plain = self.phrases[number]
            if not plain:
                phrase = self.unpacked(phrase, depth + 1)
                self.phrases[number] = (phrase, True)
            out.append(phrase)
        return b"".join(out)


def _behind(record: bytes, flags: int) -> int:
    """Bytes behind a record's text: an entry for each flag, its size written backwards at its end; last, rests of a split character."""
    cut = 0
    for _ in range((flags >> 1).bit_count()):
        size = shift = 0
        for i in range(1, 5):
            if cut + i > len(record):
                break
            c = record[-cut - i]
            size |= (c & 127) << shift
            shift += 7
            if c & 128:
                break
        cut += size
    if flags & 1 and cut < len(record):
        cut += (record[-cut - 1] & 3) + 1
    return min(cut, len(record))


def _extended(head: bytes, at: int) -> dict[int, list[bytes]]:
    found: dict[int, list[bytes]] = {}
    if head[at : at + 4] != b"EXTH":
        return found
    n, at = struct.unpack_from(">I", head, at + 8)[0], at + 12
    for _ in range(n):
        if at + 8 > len(head):
            break
        kind, size = struct.unpack_from(">II", head, at)
        if size < 8:
            break
        found.setdefault(kind, []).append(head[at + 8 : at + size])
        at += size
    return found


def read(raw: bytes) -> tuple[dict[str, list[str]], str]:
    """(metadata by name: title, author, publisher, isbn, language; markup)."""
    parts = records(raw)
    head = parts[0]
    if raw[60:68] not in (b"BOOKMOBI", b"TEXtREAd") or len(head) < 16:
        raise ValueError("no book")
    packing, _, length, n, _, lock = struct.unpack_from(">HHIHHH", head)
    if lock:
        raise ValueError("protected")
    mobi = head[16:20] == b"MOBI"
    size, encoding, version, flags = 0, "cp1252", 0, 0
    if mobi:
        size, _, code, _, version = struct.unpack_from(">IIIII", head, 20)
        encoding = ENCODINGS.get(code, "utf-8")
        if size >= 228 and len(head) >= 244:
            flags = struct.unpack_from(">H", head, 242)[0]
    if packing == HUFF:
        first, count = struct.unpack_from(">II", head, 112)
        unpack = Huffman(parts[first], parts[first + 1 : first + count]).unpacked
    elif packing in (PLAIN, PALMDOC):
        unpack = _palmdoc if packing == PALMDOC else bytes
    else:
        raise ValueError(f"compression {packing}")
    if n >= len(parts):
        raise ValueError("text records are missing")
    text = b"".join(unpack(r[: len(r) - _behind(r, flags)]) for r in parts[1 : n + 1])[:length]
    if version == 8 and len(head) >= 196:
        section = struct.unpack_from(">I", head, 192)[0]
        if section < len(parts) and parts[section][:4] == b"FDST":
            text = text[slice(*struct.unpack_from(">II", parts[section], 12))]
    told = lambda b: b.decode(encoding, "replace").strip("\0 ")
    meta: dict[str, list[str]] = {"title": [told(raw[:32].partition(b"\0")[0]).replace("_", " ")]}
    if mobi:
        at, many = struct.unpack_from(">II", head, 84)
        if 0 < many and at + many <= len(head):
            meta["title"] = [told(head[at : at + many])]
        if struct.unpack_from(">I", head, 128)[0] & 0x40:
            more = _extended(head, 16 + size)
            for name, kind in (("title", TITLE), ("author", AUTHOR), ("publisher", PUBLISHER), ("isbn", ISBN), ("language", LANGUAGE)):
                if more.get(kind):
                    meta[name] = [told(v) for v in more[kind]]
    return meta, text.decode(encoding, "replace")
