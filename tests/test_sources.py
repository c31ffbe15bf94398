import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quirework.sources import files, library, manifest, render, review_file, web


def book(tmp, author, title, number, **extra):
    d = tmp / author / f"{title} ({number})"
    d.mkdir(parents=True)
    (d / "metadata.json").write_text(json.dumps({"title": title, "authors": [author], "publishedYear": "1999", **extra}))
    (d / "book.epub").write_bytes(b"x")
    return d


def test_library_source(spark, tmp_path):
    book(tmp_path, "Jan Novak", "Kniha", 1, series=[{"name": "Nadace", "sequence": "3"}], isbn="8071741302")
    book(tmp_path, "needfix", "Jina", 2)
    book(tmp_path, ".hidden", "Ne", 3)
    (tmp_path / "~$lock").mkdir()
    library.register(spark)
    df = spark.read.format("library").load(str(tmp_path))
    rows = {r.title_folder: r for r in df.withColumn("m", manifest.scanned(F.col("manifest"))).collect()}
    assert set(rows) == {"Kniha (1)", "Jina (2)"}
    r = rows["Kniha (1)"]
    assert r.author_folder == "Jan Novak" and [f.name for f in r.files] == ["book.epub", "metadata.json"]
    assert (r.m.title, r.m.authors, r.m.year, r.m.isbn, r.m.series[0]["name"], r.m.series[0]["index"]) == ("Kniha", ["Jan Novak"], 1999, "9788071741305", "Nadace", "3")
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("library").load(str(tmp_path / "nowhere")).count()


OPF = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata><dc:title>Placeholder</dc:title><dc:creator opf:role="aut">A B</dc:creator><dc:creator opf:role="trl">C</dc:creator><dc:identifier>isbn:8071741302</dc:identifier><dc:date>0101-01-01</dc:date></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>'


def test_opf():
    got = manifest.read_opf(OPF.format(items="", refs=""))
    assert (got["title"], got["authors"], got["year"], got["isbn"]) == ("Placeholder", ["A B"], None, "9788071741305")
    assert manifest.read_opf("<broken")["error"] and manifest.read_opf("")["error"]


def epub(pages):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", OPF.format(items="".join(f'<item id="c{i}" href="c{i}.xhtml"/>' for i in range(len(pages))), refs="".join(f'<itemref idref="c{i}"/>' for i in range(len(pages)))))
        for i, p in enumerate(pages):
            z.writestr(f"OEBPS/c{i}.xhtml", f"<html><head><title>t</title></head><body><p>{p}</p></body></html>")
    return out.getvalue()


def test_file_evidence(spark, tmp_path):
    pages = [f"chapter number {i}" for i in range(11)] + ["ISBN 978-80-903850-5-4 at the end"]
    (tmp_path / "a.epub").write_bytes(epub(pages))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ComicInfo.xml", "<ComicInfo><Series>S</Series><Number>2</Number><Writer>W, V</Writer><LanguageISO>cs</LanguageISO></ComicInfo>")
    (tmp_path / "b.cbz").write_bytes(out.getvalue())
    name = "Karel Čapek".encode("utf-16-be")
    (tmp_path / "c.mbp").write_bytes(b"HEAD" * 5 + b"AUTH" + struct.pack(">I", len(name)) + name)
    (tmp_path / "d.txt").write_bytes(("žluťoučký kůň " * 900 + " ISBN 8071741302").encode("cp1250"))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.epub").write_bytes(b"not a zip")
    df = files.evidence(spark.read.format("binaryFile").load(str(tmp_path)), {"pdf": lambda raw: {"page": "from a provider"}})
    by = {r.path.rpartition("/")[2]: r for r in df.collect()}
    a = by["a.epub"]
    assert a.title == "Placeholder" and a.isbn_from_text == "9788090385054" and "chapter number 8" not in a.page and "chapter number 8" in a.broader
    assert by["b.cbz"].title == "S #2" and by["b.cbz"].authors == ["W", "V"] and by["c.mbp"].authors == ["Karel Čapek"]
    assert by["d.txt"].page.startswith("žluťoučký") and by["d.txt"].isbn_from_text == "9788071741305"
    assert by["e.pdf"].page == "from a provider" and "BadZipFile" in by["f.epub"].error


def test_sibling_fallback(spark):
    prose = "slovo kniha text dalsi veta " * 5
    rows = [(1, "a.epub", True, "x"), (1, "b.txt", False, prose), (1, "c.txt", False, prose), (2, "a.epub", True, ""), (2, "b.txt", False, "")]
    got = {r.book: r.path for r in files.with_fallback(spark.createDataFrame(rows, "book int, path string, is_primary boolean, page string")).collect()}
    assert got == {1: "b.txt", 2: "a.epub"}


def test_web_pages(spark):
    ld = {"@type": "Book", "name": " 1984 ", "isbn": "80-85906-45-7", "author": [{"name": "George Orwell"}], "publisher": {"name": "Argo"}, "inLanguage": "cs", "genre": "sci-fi"}
    html = f"<script type='application/ld+json'>{json.dumps(ld)}</script><a class='tag' title='antiutopie' href='x'>a</a><a class='tag' title='sci-fi'>b</a>"
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, "<script type='application/ld+json'>{bad</script>")], "page_id int, html string")
    got = {r.page_id: r.detail for r in web.detail(df).collect()}
    assert got[2] is None and got[3] is None
    assert (got[1].title, got[1].isbn, got[1].authors, got[1].publisher, got[1].genres) == ("1984", "9788085906455", ["George Orwell"], "Argo", ["sci-fi", "antiutopie"])
    search = "".join(f"<p class='new'><a class='new' type='book' href='knihy/{i % 12}' title='T{i}'>x</a><span class='pozn'>20{i:02d}, A</span></p>" for i in range(15))
    rows = web.results(spark.createDataFrame([(1, search)], "page_id int, html string")).orderBy("pos").collect()
    assert len(rows) == 10 and (rows[0].path, rows[0].title, rows[0].year) == ("knihy/0", "T0", 2000)


def test_render_and_overlay(spark):
    df = spark.createDataFrame([("T & <x>\x01😀", ["Jan Novák"], 1999)], "title string, authors array<string>, year int")
    empty = F.lit(None).cast("string")
    b = {"title": F.col("title"), "authors": F.col("authors"), "year": F.col("year"), "id": F.lit(5), "subjects": F.array(F.lit("a"), F.lit("a"), F.lit("b")), "cover": F.lit(True), **{k: empty for k in ("isbn", "uuid", "publisher", "language", "description", "series", "series_index")}}
    xml = df.select(render.opf(b).alias("x")).first().x
    got = manifest.read_opf(xml)
    assert (got["title"], got["authors"], got["year"], got["tags"], got["error"]) == ("T & <x>", ["Jan Novák"], 1999, ["a", "b"], None)
    assert 'opf:file-as="Novák, Jan"' in xml
    over = spark.createDataFrame([('{"keep": "1", "title": "old"}', '{"title": "new"}')], "a string, b string").select(manifest.overlaid(F.col("a"), F.col("b")).alias("x")).first().x
    assert json.loads(over) == {"keep": "1", "title": "new"}


def test_review_file_round_trip(spark, tmp_path):
    (tmp_path / "review.yaml").write_text("# header\n---\nuuid: u1\nid: 1\npath: /a\naction: pending\nproposed: {title: null, year: 2000}\n---\n- {uuid: u2, action: edit, edited: {title: B}}\n- {uuid: u3, action: swap, current: {author: A, title: T}}\n")
    rows = {r.uuid: r for r in review_file.read_reviews(spark, str(tmp_path)).collect()}
    assert rows["u1"].action is None and rows["u1"].proposed == {"title": None, "year": "2000"} and sorted(rows["u1"].proposed_keys) == ["title", "year"]
    assert rows["u2"].action == "accept" and rows["u2"].proposed == {"title": "B"} and rows["u3"].proposed == {"title": "A", "author": "T"}
    docs = [r.doc for r in review_file.rendered(review_file.read_reviews(spark, str(tmp_path))).collect()]
    back = [e for d in docs for e in review_file.entries(d)]
    assert {e["uuid"] for e in back} == {"u1", "u2", "u3"}
    with pytest.raises(ValueError):
        list(review_file.entries("just text"))
