"""Evidence from book files: EPUB, Mobipocket, PDF, comic archives, MBP sidecars and plain text, one row for each file.

Input is a `binaryFile` DataFrame (path, content); each format family is parsed in Arrow batches and a file that can't be read becomes a
row with `error`. Formats that need an outside program (OCR, rar, djvu, doc) go through a provider, a function from bytes to evidence.

A reader gives `page`, what a title page can be mined from, `broader`, a larger window where there is more than the page, and `scan`, the texts in which a number is looked for,
the next one only where those before it have none. Windows are taken by place first (items of a spine, pages, characters); what is empty is left out after that.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import isbn, slices, text
from quirework.sources.manifest import canonical
from quirework.sources.mobi import read as read_mobi
from quirework.sources.pdf import Document

PAGE, BROADER, TXT_HEAD, TXT_TAIL = 8000, 30_000, 15_000, 5000
#: Items of a spine for the page and the broader text, and at either end for a number; pages of a PDF for its text, and at the end for a number.
PAGE_ITEMS, BROADER_ITEMS, END_ITEMS, PDF_PAGES, PDF_END = 8, 15, 5, 15, 5
PDF_PAGE = TXT_PAGE = 5000
_DDL = "path string, source_format string, title string, authors array<string>, isbn string, publisher string, language string, page string, broader string, scan array<string>, error string"
_NAMES = [c.split()[0] for c in _DDL.split(", ")]
_TYPES = [pa.list_(pa.string()) if "array" in c else pa.string() for c in _DDL.split(", ")]


def _strip(raw: bytes) -> str:
    """The text of markup, line structure kept (as text.html_to_text does for columns)."""
    m = re.match(rb"<\?xml[^>]*encoding=[\"']([^\"']+)", raw[:80])
    try:
        s = raw.decode(m[1].decode("ascii") if m else "utf-8", "replace")
    except LookupError:
        s = raw.decode("utf-8", "replace")
    s = re.sub(r"(?i)</(?:p|div|h[1-6]|li|tr|td|th|section|article|header|footer|body|blockquote)\s*>|<br\s*/?>", "\n", s)
    s = re.sub(r"<[^>]+>", " ", s)
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#8217;", "'")):
        s = s.replace(a, b)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", s)).strip()


def _all(root: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if e.tag.rpartition("}")[2] == tag]


def epub(raw: bytes) -> dict:
    """Embedded fields and the texts of the spine: the first eight items, all that fit, and those where a number is looked for."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        opf = _all(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")[0].attrib["full-path"]
        root = ElementTree.fromstring(z.read(opf))
        first = lambda tag: next((e.text.strip() for e in _all(root, tag) if e.text and e.text.strip()), None)
        href = {e.attrib.get("id"): e.attrib.get("href") for e in _all(root, "item")}
        spine = [posixpath.join(posixpath.dirname(opf), h) for e in _all(root, "itemref") if (h := href.get(e.attrib.get("idref")))]
        held = set(z.namelist())
        # places are counted before what is empty or missing is left out
        want = {i for i in range(len(spine)) if i < BROADER_ITEMS or i >= len(spine) - END_ITEMS}
        texts = {i: t for i in sorted(want) if spine[i] in held and len(t := _strip(z.read(spine[i]))) > 5}
    joined = lambda places: " | ".join(texts[i] for i in places if i in texts)
    n = len(spine)
    ends = range(n) if n <= 2 * END_ITEMS else [*range(END_ITEMS), *range(n - END_ITEMS, n)]
    page, broader = joined(range(PAGE_ITEMS))[:PAGE], joined(range(BROADER_ITEMS))
    numbers = (canonical(re.sub(r"(?i)^(urn:)?isbn:", "", e.text or "")) for e in _all(root, "identifier"))
    return {
        "title": first("title"), "authors": [e.text.strip() for e in _all(root, "creator") if e.text and e.text.strip()], "publisher": first("publisher"),
        "language": first("language"), "isbn": next((n for n in numbers if n), None), **_windows(page, broader, [joined(ends), page] if page else []),
    }


def _windows(page: str, broader: str, scan: list[str]) -> dict:
    return {"page": page or None, "broader": broader[:BROADER] if len(broader) > len(page) else None, "scan": scan}


def mobi(raw: bytes) -> dict:
    """Mobipocket and Palm books: a number is looked for in the whole text."""
    meta, markup = read_mobi(raw)
    one = lambda name: next((v for v in meta.get(name, []) if v), None)
    numbers = (canonical(re.sub(r"(?i)^(urn:)?isbn:", "", v)) for v in meta.get("isbn", []))
    t = _strip(markup.encode("utf-8", "replace"))
    authors = [a.strip() for v in meta.get("author", []) for a in re.split(r"[&;]", v) if a.strip()]
    return {"title": one("title"), "authors": authors, "publisher": one("publisher"), "language": one("language"), "isbn": next((n for n in numbers if n), None), **_windows(t[:PAGE], t, [t, t[:PAGE]])}


def pdf(raw: bytes) -> dict:
    """The text of the first pages; for a number the last ones too. A page that can't be read is an empty one."""
    doc = Document(raw)
    pages, info = doc.pages(), doc.info()

    def text_of(page: dict) -> str:
        try:
            return doc.text(page)
        except (ValueError, IndexError, TypeError, KeyError):
            return ""

    t = "\f".join(map(text_of, pages[:PDF_PAGES]))
    page = t[:PDF_PAGE] if t.strip() else ""
    end = "\f".join(map(text_of, pages[-PDF_END:])) if page and len(pages) > 3 else ""
    made = {"title": info.get("title") or None, "authors": [a.strip() for a in re.split("[;,]", info.get("author", "")) if a.strip()], "isbn": canonical(info.get("isbn", ""))}
    return made | _windows(page, t, [page, end]) | ({} if page or any(made.values()) else {"error": "no text and no metadata"})


def comic(raw: bytes) -> dict:
    """ComicInfo.xml of a zipped comic; without a title, the series and number."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        name = next((n for n in z.namelist() if n.lower().rpartition("/")[2] == "comicinfo.xml"), None)
        if not name:
            return {"error": "no ComicInfo.xml"}
        root = ElementTree.fromstring(z.read(name))
    get = lambda tag: next((e.text.strip() for e in _all(root, tag) if e.text and e.text.strip()), None)
    series, number = get("Series"), get("Number")
    title = get("Title") or (f"{series} #{number}" if series and number else series)
    people = get("Writer") or get("Penciller") or ""
    number = get("GTIN") or get("ISBN") or ""
    return {"title": title, "authors": [p.strip() for p in people.split(",") if p.strip()], "publisher": get("Publisher"), "language": get("LanguageISO"), "isbn": canonical(number) if number else None}


def _utf16(raw: bytes) -> str | None:
    """The byte order that gives mostly Latin text."""
    best = None
    for codec in ("utf-16-be", "utf-16-le"):
        s = raw.decode(codec, "ignore").strip("\0 ")
        share = sum(c < "ɐ" for c in s) / len(s) if s else 0
        if share >= 0.75 and (best is None or share > best[0]):
            best = (share, s)
    return best[1] if best else None


def mbp(raw: bytes) -> dict:
    """AUTH and TITL records: a tag, a length, UTF-16 text."""
    found: dict[bytes, str] = {}
    for tag in (b"AUTH", b"TITL"):
        at = raw.find(tag)
        while at >= 0 and tag not in found:
            if at + 8 <= len(raw) and 1 <= (n := struct.unpack(">I", raw[at + 4 : at + 8])[0]) <= 4096 and (s := _utf16(raw[at + 8 : at + 8 + n])):
                found[tag] = s
            at = raw.find(tag, at + 1)
    return {"title": found.get(b"TITL"), "authors": [found[b"AUTH"]] if b"AUTH" in found else []}


def _decoded(raw: bytes, front: bool, back: bool) -> str:
    """Text of unknown encoding; front, back: it is cut there, perhaps within a character."""
    for codec in ("utf-8", "cp1250"):
        part = raw
        if codec == "utf-8":
            while front and part and part[0] & 0xC0 == 0x80:
                part = part[1:]
            for n in range(1, 4):
                if back and len(part) >= n and part[-n] >= 0xC0:
                    lead = part[-n]
                    part = part[:-n] if n < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else part
                    break
        try:
            return part.decode(codec)
        except UnicodeDecodeError:
            continue
    return raw.decode("iso-8859-2")


def txt(raw: bytes) -> dict:
    """A number is looked for in the page, and in the end of a longer file if there is none. Nothing is mined from plain text."""
    s = _decoded(raw[:TXT_HEAD], False, len(raw) > TXT_HEAD)
    scan = [s[:TXT_PAGE], _decoded(raw[-TXT_TAIL:], True, False)] if len(raw) > PAGE else [s[:TXT_PAGE]]
    return _windows(s[:TXT_PAGE], s, scan) | {"page": s[:TXT_PAGE]}


EXTRACTORS: dict[str, Callable[[bytes], dict]] = {"epub": epub, "cbz": comic, "mbp": mbp, "txt": txt, "pdf": pdf} | dict.fromkeys(("mobi", "prc", "azw", "azw3", "pdb"), mobi)
#: Kinds of files from whose text nothing is mined.
UNMINED = ["txt"]


def evidence(files: DataFrame, providers: dict[str, Callable[[bytes], dict]] | None = None) -> DataFrame:
    """Evidence of each file: what is embedded, the texts, the number in the text, and what is mined from the page."""
    known = EXTRACTORS | (providers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices.rows(b.columns)):
            rows = []
            for path, raw in part:
                kind = path.rpartition(".")[2].lower()
                try:
                    got = known[kind](raw) if kind in known else {"error": f"no extractor for {kind}"}
                except Exception as e:  # noqa: BLE001  a file of any content must give a row
                    got = {"error": f"{type(e).__name__}: {e}"}
                rows.append({"authors": [], **got, "path": path, "source_format": kind})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)

    got = files.select("path", "content").mapInArrow(run, _DDL)
    page = F.when(~F.col("source_format").isin(UNMINED), F.col("page"))
    number = F.get(F.filter(F.transform("scan", isbn.first_in), lambda n: n.isNotNull()), F.lit(0))
    # lines and title are columns before others use them, often within lambdas: written out there, they would be worked out again for each use and line. The row's
    # partition keeps the optimiser from doing that
    once = lambda c: F.when(F.spark_partition_id() >= 0, c)
    lines = F.col("__lines")
    d = got.withColumn("__lines", once(text.page_lines(page))).withColumn("__found", once(text.found_title(lines)))
    d = d.withColumn("title_from_text", once(text.without_leading(F.col("__found"))))
    told = (text.authors_of(lines, F.col("title_from_text")).alias("authors_from_text"), text.publisher_of(lines).alias("publisher_from_text"), text.year_of(lines).alias("year_from_text"))
    return d.select(*got.columns, number.alias("isbn_from_text"), "title_from_text", *told)


def with_fallback(found: DataFrame, book: str = "book", primary: str = "is_primary") -> DataFrame:
    """One row for each book: the primary file if its page is usable or no sibling's is, else the first usable sibling by name."""
    usable = text.usable(F.col("page"))
    order = F.struct((F.when(usable, 0).otherwise(1)).alias("a"), F.when(F.col(primary), 0).otherwise(1).alias("b"), F.col("path").alias("c"))
    rest = [c for c in found.columns if c != book]
    return found.groupBy(book).agg(F.min_by(F.struct(*rest), order).alias("r")).select(book, "r.*")


def epub_cover(raw: bytes) -> bytes | None:
    """The cover image of an EPUB: the item that metadata, properties, an id or the guide names."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        opf = _all(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")[0].attrib["full-path"]
        root = ElementTree.fromstring(z.read(opf))
        items = _all(root, "item")
        by_id = {e.attrib.get("id"): e for e in items}
        named = [by_id.get(e.attrib.get("content")) for e in _all(root, "meta") if e.attrib.get("name") == "cover"]
        named += [e for e in items if "cover-image" in e.attrib.get("properties", "").split()]
        named += [e for e in items if "cover" in (e.attrib.get("id") or "").lower() and e.attrib.get("media-type", "").startswith("image/")]
        hrefs = [e.attrib.get("href") for e in named if e is not None] + [e.attrib.get("href") for e in _all(root, "reference") if e.attrib.get("type") == "cover"]
        for h in filter(None, hrefs):
            path = posixpath.normpath(posixpath.join(posixpath.dirname(opf), h))
            if path in z.namelist() and path.lower().endswith((".jpg", ".jpeg", ".png", ".gif", ".webp")):
                return z.read(path)
    return None
