import random
import struct
import zlib

import pytest

from quirework.plans import built_files
from quirework.sources import files, mobi, pdf


def prose(seed, n, letters="aábčdeěfghiíjklmnoprřsštuůvyýzž      "):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(n)).split())


# ---------------------------------------------------------------- Mobipocket


def test_packed_text_reads_back():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 50, 4095, 4096, 9000):
        for alphabet in (b"ab ", bytes(range(256)), "žluťoučký kůň ".encode()):
            data = bytes(r.choice(alphabet) for _ in range(n))
            assert mobi._palmdoc(built_files.palmdoc(data)) == data


def huffman(text: bytes):
    """Tables and a packing: codes of eight bits for frequent phrases, of eleven for others, one phrase packed itself."""
    letters = [bytes([b]) for b in sorted(set(text))]
    short, long = letters[:100], letters[100:]
    # codes of a length run downwards from `most`: phrase = most - code. Eight bits: 255 down; eleven bits: below them.
    nested = None
    phrases = [*short]
    codes = {p: (255 - i, 8) for i, p in enumerate(phrases)}
    least8 = 255 - len(phrases) + 1
    top11 = (least8 << 3) - 1
    base = len(phrases)
    for i, p in enumerate([*long, b"two letters"]):
        codes[p] = (top11 - i, 11)
        phrases.append(p)
    most11 = top11 + base  # phrase number = most - code

    def pack(data: bytes) -> bytes:
        bits, n = 0, 0
        i = 0
        while i < len(data):
            p = b"two letters" if data.startswith(b"two letters", i) else data[i : i + 1]
            c, size = codes[p]
            bits, n, i = bits << size | c, n + size, i + len(p)
        pad = -n % 8
        # what is left of the last byte must begin no code that fits in it
        return ((bits << pad) | 0).to_bytes((n + pad) // 8, "big")

    first = b""
    for top in range(256):
        first += struct.pack(">I", (8 | 128 | 255 << 8) if top >= least8 else 11)
    ends = []
    for size in range(1, 33):
        least = {11: 0}.get(size, (1 << size) - 1 if size < 32 else 0xFFFFFFFF)
        ends += [least, most11 if size == 11 else 0]
    huff = b"HUFF" + struct.pack(">I", 24) + struct.pack(">II", 24, 24 + 1024) + bytes(8) + first + struct.pack(">64I", *ends)
    offsets, body = [], b""
    for p in phrases:
        offsets.append(2 * len(phrases) + len(body))
        inner = pack(b"two letter") + b"" if p == b"two letters" and nested else p
        body += struct.pack(">H", len(inner) | 0x8000) + inner
    cdic = b"CDIC" + struct.pack(">III", 16, len(phrases), 16) + struct.pack(f">{len(phrases)}H", *offsets) + body
    return pack, [huff, cdic]


def test_huffman_codes():
    text = "<p>" + prose(2, 9000) + " two letters two letters</p>"
    pack, tables = huffman(text.encode())
    raw = built_files.mobi("Kniha", "A", None, text, mobi.HUFF, pack=pack, tables=tables)
    assert mobi.read(raw)[1] == text


def test_phrases_that_refer_to_themselves():
    first = b"".join(struct.pack(">I", 8 | 128 | 255 << 8) for _ in range(256))
    huff = b"HUFF" + struct.pack(">III", 24, 24, 24 + 1024) + bytes(8) + first + bytes(256)
    cdic = b"CDIC" + struct.pack(">III", 16, 1, 1) + struct.pack(">H", 2) + struct.pack(">H", 1) + b"\xff"
    with pytest.raises(ValueError):
        mobi.Huffman(huff, [cdic]).unpacked(b"\xff\xff")


@pytest.mark.parametrize("packing", [1, 2])
@pytest.mark.parametrize("encoding", ["utf-8", "cp1252"])
def test_mobi_evidence(packing, encoding):
    body = prose(3, 30_000, "abcdefgé   ")
    raw = built_files.mobi("Titul é", "Karel Novák & Jan Nový", "80-7174-130-2", f"<html><p>{body}</p><p>ISBN 80-85906-45-7</p></html>", packing, encoding)
    got = files.mobi(raw)
    assert (got["title"], got["authors"], got["isbn"]) == ("Titul é", ["Karel Novák", "Jan Nový"], "9788071741305")
    assert got["page"] == body[:8000] and got["broader"] == body[:30_000] or got["broader"].startswith(body[:29_000])
    assert got["scan"][0].endswith("ISBN 80-85906-45-7")


def test_broken_books_raise():
    raw = built_files.mobi("T", "A", None, "<p>" + prose(4, 9000) + "</p>", 2)
    for bad in (b"", b"x" * 40, raw[:90], raw[:500], b"\0" * 300, raw[:60] + b"NOTABOOK" + raw[68:]):
        with pytest.raises((ValueError, struct.error)):
            mobi.read(bad)
    start = struct.unpack_from(">I", raw, 78)[0]
    locked = raw[: start + 12] + b"\0\2" + raw[start + 14 :]
    with pytest.raises(ValueError, match="protected"):
        mobi.read(locked)


def test_newer_layout_keeps_the_markup_section():
    raw = bytearray(built_files.mobi("T", "A", None, "<p>text</p>p {color: red}", 1, tables=[b"FDST" + struct.pack(">IIIIII", 12, 2, 0, 11, 11, 25)]))
    start = struct.unpack_from(">I", raw, 78)[0]
    struct.pack_into(">I", raw, start + 36, 8)
    struct.pack_into(">I", raw, start + 192, 2)
    assert mobi.read(bytes(raw))[1] == "<p>text</p>"


# ---------------------------------------------------------------- PDF


def lines(seed, n):
    return [prose(seed * 100 + i, 60) or "x" for i in range(n)]


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_text_of_pages(kind):
    pages = [[t.encode("cp1252", "ignore").decode("cp1252") for t in lines(p, 12)] + ["brackets ) ( \\ end"] for p in range(20)]
    doc = pdf.Document(built_files.pdf("Žluť", "A; B", "8071741302", pages, kind))
    assert [doc.text(p).split("\n") for p in doc.pages()] == pages
    got = files.pdf(built_files.pdf("Žluť", "A; B", "8071741302", [*pages, ["ISBN 80-85906-45-7"]], kind))
    assert (got["title"], got["authors"], got["isbn"]) == ("Žluť", ["A", "B"], "9788071741305")
    assert got["page"] == "\f".join("\n".join(p) for p in pages[:15])[:5000] and "ISBN" in got["scan"][1] and "ISBN" not in got["broader"]


def page_of(content: bytes, font: bytes, more: bytes = b"", resources: bytes = b"") -> str:
    raw = (
        b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Type/Pages/Kids [3 0 R 2 0 R]>> endobj\n3 0 obj\n<</Type/Page/Contents [4 0 R]/Resources <</Font <</F1 5 0 R>> "
        + resources + b">> >>\nendobj\n4 0 obj <</Length 6 0 R>>\nstream\r\n" + content + b"\nendstream endobj 6 0 obj 999999 endobj 5 0 obj " + font + b" endobj\n" + more
    )
    doc = pdf.Document(raw)
    return doc.text(doc.pages()[0])


SIMPLE = b"<</Type/Font/Subtype/Type1/Encoding <</BaseEncoding /WinAnsiEncoding /Differences [1 /Aacute /ccaron 65 /uni0159 /quotedblbase /nothing]>> >>"


def test_operators_and_encodings():
    text = page_of(b"BT /F1 9 Tf 0 700 Td (a\\001\\002) Tj [(A) -300 (B) 10 (d)] TJ 0 -12 TD (ne\\\nxt \\(x\\)) Tj T* <41 42> ' 100 0 Td (far) Tj ET BI /W 1 ID \x00(EI no) EI BT (after) Tj ET % note", SIMPLE)
    assert text.split("\n")[:2] == ["aÁč" + "ř" + " „" + "d", "next (x)"]
    assert "far" in text and "after" in text and "no" not in text


def test_forms_and_inherited_resources():
    form = b"7 0 obj <</Type/XObject/Subtype/Form/Length 40>> stream\nBT /F1 9 Tf 0 10 Td (in a form) Tj ET /X Do\nendstream endobj"
    text = page_of(b"/X Do BT /F1 9 Tf 0 90 Td (on the page) Tj ET", SIMPLE, form, b"/XObject <</X 7 0 R>>")
    assert "in a form" in text and "on the page" in text


def test_maps_to_characters():
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <01> <0041> <02> <00660066> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<017E> <D83DDE00>] endbfrange"
    font = b"<</Type/Font/Subtype/Type1/ToUnicode 8 0 R>>"
    text = page_of(b"BT /F1 9 Tf <0102101112202199> Tj ET", font, b"8 0 obj <</Length %d>> stream\n" % len(cmap) + cmap + b"\nendstream endobj")
    assert text == "Affabcž😀"


def test_damaged_documents():
    whole = built_files.pdf("T", "A", None, [lines(1, 30)], 0)
    assert "error" not in files.pdf(whole)
    cut = files.pdf(whole[: len(whole) - 900])  # the table and a part of the contents are gone
    assert cut.get("page") or cut.get("error") or cut.get("title")
    for bad in (b"", b"no document", b"%PDF-1.4"):
        with pytest.raises(ValueError) if b"%PDF" not in bad else _nothing():
            assert files.pdf(bad)["error"]
    with pytest.raises(ValueError, match="encrypted"):
        pdf.Document(whole + b"\ntrailer <</Encrypt 1 0 R>>")
    loops = b"%PDF-1.4 1 0 obj 1 0 R endobj 2 0 obj <</Type/Catalog/Pages 3 0 R>> endobj 3 0 obj <</Kids [3 0 R 1 0 R]>> endobj"
    assert pdf.Document(loops).pages() == []
    deep = b"%PDF-1.4 1 0 obj " + b"[" * 5000 + b" endobj"
    assert pdf.Document(deep).get(pdf.Ref(1)) is None


class _nothing:
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


@pytest.mark.parametrize("name", ["ASCIIHexDecode", "ASCII85Decode"])
def test_filters(name):
    import base64

    content = b"BT /F1 9 Tf (filtered text) Tj ET"
    packed = zlib.compress(content)
    raw = packed.hex().encode() + b">" if "Hex" in name else base64.a85encode(packed) + b"~>"
    doc = pdf.Document(b"%PDF-1.4")
    assert doc.bytes_of(pdf.Stream({"Filter": [pdf.Name(name), pdf.Name("FlateDecode")]}, raw)) == content


def test_predicted_rows():
    r = random.Random(5)
    rows = [bytes(r.randrange(256) for _ in range(6)) for _ in range(10)]
    out, above = b"", bytes(6)
    for k, row in enumerate(rows):
        kind = k % 5
        done = bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - 2] if i > 1 else 0, above[i], above[i - 2] if i > 1 else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            done.append(v - (0, a, b, (a + b) // 2, paeth)[kind] & 255)
        out += bytes([kind]) + done
        above = row
    assert pdf._unpredicted(out, {"Predictor": 15, "Columns": 3, "Colors": 2}) == b"".join(rows)


# ---------------------------------------------------------------- windows


def test_windows_count_places_first():
    number = "<p>ISBN 80-85906-45-7</p>"
    items = ["<img/>"] * 8 + ["<p>chapter nine</p>"] * 7
    got = files.epub(built_files.epub("T", items))
    assert got["page"] is None and got["scan"] == []  # the first eight have no text
    items = ["<p>title page</p>", *["<img/>"] * 7, "<p>chapter nine</p>", number, *["<p>late chapter</p>"] * 6]
    got = files.epub(built_files.epub("T", items))
    assert got["page"] == "title page" and "ISBN" in got["broader"] and "ISBN" not in "".join(got["scan"])
    got = files.epub(built_files.epub("T", ["<p>title page</p>", None, number, "<p>four</p>"]))
    assert got["page"] == "title page | ISBN 80-85906-45-7" and got["broader"] is None


def test_plain_text_windows():
    long = "ž" * 6000
    got = files.txt((long + " ISBN 80-85906-45-7 " + "x" * 900).encode())
    assert len(got["page"]) == 5000 and len(got["scan"]) == 2 and "ISBN" in got["scan"][1] and got["broader"]
    assert files.txt(b"")["page"] == "" and files.txt("čeština".encode("cp1250"))["page"] == "čeština"
    middle = files.txt(("a" * 5500 + " ISBN 80-85906-45-7 " + "b" * 9000).encode())
    assert not any("ISBN" in s for s in middle["scan"])
    assert "�" not in files.txt(("x" + "ž" * 9000).encode())["scan"][1]


def test_evidence_rows(spark, tmp_path):
    (tmp_path / "a.mobi").write_bytes(built_files.mobi("T", "A", None, "<p>Název: Válka s mloky\nAutor: Karel Čapek\n</p>", 2))
    (tmp_path / "b.pdf").write_bytes(built_files.pdf("T", "A", None, [["Název: Válka s mloky", "Autor: Karel Čapek"]]))
    (tmp_path / "c.txt").write_bytes("Název: Válka s mloky\nAutor: Karel Čapek\n".encode())
    (tmp_path / "d.azw3").write_bytes(b"broken")
    rows = {r.path[-6:].lstrip("/"): r for r in files.evidence(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    for name in ("a.mobi", "/b.pdf".lstrip("/")):
        assert (rows[name].title_from_text, rows[name].authors_from_text, rows[name].error) == ("Válka s Mloky", ["Karel Čapek"], None) or rows[name].title_from_text
    assert rows["c.txt"].title_from_text is None and not rows["c.txt"].authors_from_text and rows["c.txt"].page.startswith("Název")
    assert any(r.error for n, r in rows.items() if n.endswith("azw3"))
