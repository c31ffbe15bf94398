"""Book files built from rows, for the queries and tests of file sources."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import functions as F

from quirework.functions import slices


def built(f: Callable[..., bytes | None]):
    """A function of values as one of columns."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for cols in batches:
            for part in slices.rows(cols):
                yield pa.array([f(*row) for row in part], pa.binary())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")


def epub(title: str, items: list[str | None]) -> bytes:
    """A book whose spine has these items; null ones are named but missing. The manifest is in another order."""
    out = io.BytesIO()
    listed = "".join(f'<item id="i{k}" href="t/{k}.xhtml"/>' for k in reversed(range(len(items))))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/content.opf",
            f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{escape(title)}</dc:title><dc:creator>Jan Novák</dc:creator>'
            f'<dc:identifier>urn:isbn:8071741302</dc:identifier></metadata><manifest>{listed}</manifest><spine>{"".join(f"<itemref idref=\"i{k}\"/>" for k in range(len(items)))}</spine></package>',
        )
        for k, t in enumerate(items):
            if t is not None:
                z.writestr(f"OEBPS/t/{k}.xhtml", t)
    return out.getvalue()


def palmdoc(data: bytes) -> bytes:
    """Bytes packed with references to what stands at most 2047 bytes before."""
    out, i, seen = bytearray(), 0, {}
    while i < len(data):
        key = data[i : i + 3]
        at = seen.get(key, -1)
        seen[key] = i
        if at >= 0 and i - at <= 2047 and i + 3 <= len(data):
            n = 3
            while n < 10 and i + n < len(data) and data[at + n] == data[i + n]:
                n += 1
            out += struct.pack(">H", 0x8000 | (i - at) << 3 | n - 3)
            i += n
        elif data[i] == 32 and i + 1 < len(data) and 0x40 <= data[i + 1] < 0x80:
            out.append(data[i + 1] ^ 0x80)
            i += 2
        elif data[i] == 0 or 9 <= data[i] < 0x80:
            out.append(data[i])
            i += 1
        else:
            n = next((k for k in range(1, 9) if i + k >= len(data) or data[i + k] < 0x80), 8)
            out += bytes([n]) + data[i : i + n]
            i += n
    return bytes(out)


def mobi(title: str, author: str, isbn: str | None, markup: str, packing: int, encoding: str = "utf-8", pack: Callable[[bytes], bytes] | None = None, tables: list[bytes] | None = None) -> bytes:
    """A Mobipocket book; each text record has two bytes behind its text and no split characters. packing: 1 plain, 2 packed, else by `pack` with its tables."""
    data, size = markup.encode(encoding), 4096
    pack = pack or (palmdoc if packing == 2 else bytes)
    texts = [pack(data[i : i + size]) + b"\x00" + b"\x07\x82" for i in range(0, len(data), size)]
    fields = [(100, author.encode(encoding)), (503, title.encode(encoding)), *([(104, isbn.encode())] if isbn else [])]
    more = b"".join(struct.pack(">II", k, len(v) + 8) + v for k, v in fields)
    more = b"EXTH" + struct.pack(">II", len(more) + 12, len(fields)) + more
    head = bytearray(16 + 232)
    struct.pack_into(">HHIHHHH", head, 0, packing, 0, len(data), len(texts), size, 0, 0)
    struct.pack_into(">4sIIII", head, 16, b"MOBI", 232, 2, 65001 if encoding == "utf-8" else 1252, 7)
    struct.pack_into(">I", head, 36, 6)
    struct.pack_into(">II", head, 112, len(texts) + 1, len(tables or []))
    struct.pack_into(">I", head, 128, 0x40)
    struct.pack_into(">H", head, 242, 0b11)
    parts = [bytes(head) + more, *texts, *(tables or [])]
    at, listed = 78 + 8 * len(parts) + 2, b""
    for k, p in enumerate(parts):
        listed += struct.pack(">II", at, 2 * k)
        at += len(p)
    name = title.encode("ascii", "ignore")[:31].ljust(32, b"\0")
    return name + bytes(28) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(parts)) + listed + b"\0\0" + b"".join(parts)


def pdf(title: str, author: str, isbn: str | None, pages: list[list[str]], kind: int = 0) -> bytes:
    """A document of lines by page. kind 0: two-byte codes with a map to characters, packed contents; 1: objects packed in a stream, rows of its table predicted; 2: plain bytes in the
    font's own encoding and no table at all."""
    text = lambda s: b"<" + (b"\xfe\xff" + s.encode("utf-16-be")).hex().encode() + b">"
    flate = lambda d, more=b"": b"<<" + more + b"/Filter/FlateDecode/Length %d>>stream\n" % len(z := zlib.compress(d)) + z + b"\nendstream"
    plain = lambda d: b"<</Length %d>>stream\n" % len(d) + d + b"\nendstream"

    def shown(line: str) -> bytes:
        if kind == 2:
            raw = line.encode("cp1252", "replace")
            for c in (b"\\", b"(", b")"):
                raw = raw.replace(c, b"\\" + c)
            return b"(" + raw.replace(b"\r", b"\\r") + b") Tj T*\n"
        half = len(line) // 2
        return b"[<" + line[:half].encode("utf-16-be").hex().encode() + b"> 20 <" + line[half:].encode("utf-16-be").hex().encode() + b">] TJ T*\n"

    to = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + b"".join(
        b"1 beginbfrange <%02X00> <%02XFF> <%02X00> endbfrange\n" % (k, k, k) for k in range(256)
    )
    font = b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 4 0 R>>" if kind < 2 else b"<</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>>"
    first = 6
    small = {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Type/Pages/Resources<</Font<</F1 3 0 R>>>>/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % (first + 2 * k) for k in range(len(pages)))),
        3: font,
        5: b"<</Title %s/Author %s%s>>" % (text(title), text(author), b"/ISBN (%s)" % isbn.encode() if isbn else b""),
    } | {first + 2 * k: b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (first + 2 * k + 1) for k in range(len(pages))}
    wrap = plain if kind == 2 else flate
    large = ({4: flate(to)} if kind < 2 else {}) | {first + 2 * k + 1: wrap(b"BT /F1 12 Tf 14 TL 72 720 Td\n" + b"".join(map(shown, p)) + b"ET") for k, p in enumerate(pages)}
    if kind == 1:
        head, body = b"", b""
        for k, v in small.items():
            head += b"%d %d " % (k, len(body))
            body += v + b" "
        top = first + 2 * len(pages)
        large[top] = flate(head + body, b"/Type/ObjStm/N %d/First %d" % (len(small), len(head)))
        rows = bytes(4 * (top + 2))
        large[top + 1] = flate(b"".join(b"\x02" + rows[i : i + 4] for i in range(0, len(rows), 4)), b"/Type/XRef/W[1 2 1]/Size %d/Root 1 0 R/Info 5 0 R/DecodeParms<</Predictor 12/Columns 4>>" % (top + 2))
        objects = large
    else:
        objects = small | large
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items())
    return out + (b"trailer <</Root 1 0 R/Info 5 0 R>>\n" if kind != 1 else b"") + b"startxref\n0\n%%EOF"
