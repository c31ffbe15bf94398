"""Queries of file sources, package documents, review files and catalogue pages, over contents built from the tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from quirework.functions import fuzzy, slices, text
from quirework.plans import built_files
from quirework.plans.adapter import books, cte
from quirework.plans.book_flow_queries import D_FLOW, flow_records
from quirework.plans.built_files import built
from quirework.plans.record_queries import D_ISBN, records
from quirework.plans.registry import query
from quirework.plans.text_queries import PAGES
from quirework.sources import files, manifest, render, review_file, web


def _zipped(*names: str):
    """A zip archive of texts under these names, in the order of the columns."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for part in (p for cols in batches for p in slices.rows(cols)):
            out = []
            for texts in part:
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    for n, t in zip(names, texts, strict=True):
                        z.writestr(n, t)
                out.append(raw.getvalue())
            yield pa.array(out, pa.binary())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")


def _file(kind: str):
    return F.concat(F.lit("/b/"), F.col("id").cast("string"), F.lit(f".{kind}")).alias("path")


_N = lambda: F.col("id").cast("string")
_ID = "CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT)"


#: What a book's file says: a labelled title page for one in three, then the document's text without digits and markup, and a number at its head or its end, or none.
_NUMBER = "ISBN 80-85906-45-7"
_LABELLED = f"CASE WHEN id % 3 = 0 THEN {PAGES[0][0]} END"
_BODY_IN = r"trim(regexp_replace(regexp_replace(text, '[0-9<>&\f]', '', 'g'), '[ \t\n\r\x0B]+', ' ', 'g'))"
_BODY_SPARK = r"trim(regexp_replace(regexp_replace(text, '[0-9<>&\\f]+', ''), '[\\t\\n\\r\\x0B][ \\t\\n\\r\\x0B]*| [ \\t\\n\\r\\x0B]+', ' '))"
_MINED = "CASE WHEN id % 3 = 0 THEN {} END"
D_FILE = cte() + f", bk AS (SELECT id, {_LABELLED} AS label, {_BODY_IN} AS body FROM books), "


def _file_books(spark, sf_dir):
    return books(spark, sf_dir).selectExpr("id", f"{_LABELLED} AS label", f"{_BODY_SPARK} AS body")


def _told(found, *more: str):
    """Columns of evidence; what is mined counts where the page is labelled."""
    d = found.selectExpr("*", f"{_ID} AS id")
    return d.selectExpr("id", *more, _MINED.format("title_from_text") + " AS mined_title", _MINED.format("array_join(authors_from_text, '|')") + " AS mined_authors", _MINED.format("publisher_from_text") + " AS mined_publisher", _MINED.format("year_from_text") + " AS mined_year")


_D_MINED = f"{_MINED.format(PAGES[0][1])} AS mined_title, {_MINED.format(PAGES[0][4])} AS mined_authors, {_MINED.format(PAGES[0][2])} AS mined_publisher, CAST({_MINED.format(PAGES[0][3])} AS INT) AS mined_year"
_D_MINED_GOOD = _D_MINED.replace("CASE WHEN id % 3 = 0", "CASE WHEN id % 3 = 0 AND NOT bad").replace("END AS mined_authors", "WHEN id % 3 = 0 THEN '' END AS mined_authors")
_TXT = f"CASE id % 4 WHEN 0 THEN concat_ws('', '{_NUMBER} ', label, body) WHEN 1 THEN concat_ws('', label, body, ' {_NUMBER}') ELSE concat_ws('', label, body) END"


@query(D_FILE + f"""tx AS (SELECT id, {_TXT} AS t FROM bk) SELECT id, md5(left(t, 5000)) AS page_md5, length(t) > 5000 AS has_broader,
CASE WHEN id % 4 = 0 OR (id % 4 = 1 AND (length(t) <= 5000 OR strlen(t) > 8000)) THEN '9788085906455' END AS isbn_from_text, CAST(NULL AS VARCHAR) AS mined_title, CASE WHEN id % 3 = 0 THEN '' END AS mined_authors, CAST(NULL AS VARCHAR) AS mined_publisher, CAST(NULL AS INT) AS mined_year FROM tx""")
def txt_source(spark, sf_dir):
    """Plain text: a number in the first 5000 characters, else in the last 5000 bytes of a longer file; nothing is mined."""
    b = _file_books(spark, sf_dir).select("id", _file("txt"), F.encode(F.expr(_TXT), "UTF-8").alias("content"))
    return _told(files.evidence(b), "md5(page) AS page_md5", "broader IS NOT NULL AS has_broader", "isbn_from_text")


@query(cte() + "SELECT id, concat('Titul ', id) AS title, CASE WHEN id % 3 > 0 THEN 'Karel Novák' ELSE '' END AS authors FROM books")
def mbp_source(spark, sf_dir):
    """Tagged records with a length and UTF-16 text, written with either byte order."""
    tagged = lambda tag, s: F.concat(F.lit(tag).cast("binary"), F.unhex(F.lpad(F.hex(F.octet_length(s).cast("long")), 8, "0")), s)
    title = tagged("TITL", F.encode(F.concat(F.lit("Titul "), _N()), "UTF-16BE"))
    author = F.when(F.col("id") % 3 > 0, tagged("AUTH", F.encode(F.lit("Karel Novák"), "UTF-16LE"))).otherwise(F.lit("").cast("binary"))
    b = books(spark, sf_dir).select("id", _file("mbp"), F.concat(F.lit("BPARMOBI").cast("binary"), title, author).alias("content"))
    return files.evidence(b).selectExpr(f"{_ID} AS id", "title", "array_join(authors, '|') AS authors")


@query(cte() + "SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 2 = 0 THEN concat('Strip ', id) ELSE concat('Series #', id) END AS title, CASE WHEN id % 4 = 0 THEN '' ELSE 'A Writer|B Writer' END AS authors, id % 4 = 0 AS failed FROM books")
def comic_source(spark, sf_dir):
    named = F.when(F.col("id") % 2 == 0, F.concat(F.lit("<Title>Strip "), _N(), F.lit("</Title>"))).otherwise(F.concat(F.lit("<Series>Series</Series><Number>"), _N(), F.lit("</Number>")))
    xml = F.when(F.col("id") % 4 == 0, "<broken").otherwise(F.concat(F.lit("<ComicInfo>"), named, F.lit("<Writer>A Writer, B Writer</Writer></ComicInfo>")))
    b = books(spark, sf_dir).select("id", _file("cbz"), _zipped("ComicInfo.xml", "1.txt")(xml, F.lit("")).alias("content"))
    return files.evidence(b).selectExpr(f"{_ID} AS id", "title", "array_join(authors, '|') AS authors", "error is not null AS failed")


#: Item k of the spine of a book: its labelled page, the number, nothing but a picture, missing, or a chapter.
_ITEM = f"""CASE WHEN k = 0 AND label IS NOT NULL THEN label WHEN k = id % 17 THEN concat('Tiráž {_NUMBER} knihy ', chr(CAST(65 + k AS INT))) WHEN (k + id) % 3 = 0 THEN '' WHEN (k + id) % 7 = 2 THEN NULL
ELSE trim(concat('Kapitola ', chr(CAST(65 + k AS INT)), ' ', left(body, 700))) END"""
_SPINE_LENGTH = "CAST(1 + id % 19 AS INT)"
D_EPUB = D_FILE + f"sp AS (SELECT id, label, list_transform(range(0, {_SPINE_LENGTH}), lambda k: {_ITEM}) AS items FROM bk), "
_D_JOIN = lambda items: f"array_to_string(list_filter({items}, lambda x: length(x) > 5), ' | ')"


@query(D_EPUB + f"""wn AS (SELECT id, {_D_JOIN('items[1:8]')} AS p, {_D_JOIN('items[1:15]')} AS br, {_D_JOIN('CASE WHEN len(items) <= 10 THEN items ELSE list_concat(items[1:5], items[-5:]) END')} AS sc FROM sp)
SELECT id, concat('T', id) AS title, 'Jan Novák' AS authors, '9788071741305' AS isbn, md5(nullif(left(p, 8000), '')) AS page_md5, CASE WHEN length(br) > length(left(p, 8000)) THEN length(left(br, 30000)) END AS broader_chars,
CASE WHEN p <> '' AND (contains(sc, 'ISBN') OR contains(left(p, 8000), 'ISBN')) THEN '9788085906455' END AS isbn_from_text, {_D_MINED} FROM wn""")
def epub_source(spark, sf_dir):
    """Embedded fields; windows of the spine by its order (not the manifest's), items without text counted; the number in the text; mined fields."""
    spark_item = _ITEM.replace("chr(", "char(")
    items = F.expr(f"transform(sequence(0, {_SPINE_LENGTH} - 1), k -> {spark_item})")
    pages = F.transform(items, lambda t: F.when(t == "", "<p><img src='x.png'/></p>").otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>"))))
    b = _file_books(spark, sf_dir).select("id", _file("epub"), built(built_files.epub)(F.concat(F.lit("T"), _N()), pages).alias("content"))
    return _told(files.evidence(b), "title", "array_join(authors, '|') AS authors", "isbn", "md5(page) AS page_md5", "CAST(char_length(broader) AS BIGINT) AS broader_chars", "isbn_from_text")


_MARKUP_TEXT = f"concat_ws(concat(chr(10), ' '), label, nullif(body, ''), CASE WHEN id % 2 = 0 THEN '{_NUMBER}' END)"


@query(D_FILE + f"""tx AS (SELECT id, {_MARKUP_TEXT} AS t FROM bk), fl AS (SELECT *, id % 7 = 5 AS bad FROM tx) SELECT id, bad AS failed, CASE WHEN NOT bad THEN concat('Titul ', id) END AS title, CASE WHEN bad THEN '' ELSE 'Karel Čapek|Jan Novák' END AS authors,
CASE WHEN NOT bad AND id % 4 = 0 THEN '9788071741305' END AS isbn, CASE WHEN NOT bad THEN md5(nullif(left(t, 8000), '')) END AS page_md5, CASE WHEN NOT bad AND length(t) > 8000 THEN length(left(t, 30000)) END AS broader_chars,
CASE WHEN NOT bad AND id % 2 = 0 THEN '9788085906455' END AS isbn_from_text, {_D_MINED_GOOD} FROM fl""")
def mobi_source(spark, sf_dir):
    """Mobipocket books, packed or not: embedded fields, the whole text and the number in it; cut files give an error."""
    parts = [F.concat(F.lit("<p>"), F.col(c), F.lit("</p>")) for c in ("label", "body")]
    markup = F.concat(F.lit("<html><body>"), *[F.coalesce(p, F.lit("")) for p in parts], F.when(F.col("id") % 2 == 0, F.lit(f"<p>{_NUMBER}</p>")).otherwise(""), F.lit("</body></html>"))
    number = F.when(F.col("id") % 4 == 0, "8071741302")
    raw = built(built_files.mobi)(F.concat(F.lit("Titul "), _N()), F.lit("Karel Čapek & Jan Novák"), number, markup, (1 + F.col("id") % 3 % 2).cast("int"))
    b = _file_books(spark, sf_dir).select("id", _file("mobi"), F.when(F.col("id") % 7 == 5, F.substring(raw, 1, 300)).otherwise(raw).alias("content"))
    return _told(files.evidence(b), "error IS NOT NULL AS failed", "title", "array_join(authors, '|') AS authors", "isbn", "md5(page) AS page_md5", "CAST(char_length(broader) AS BIGINT) AS broader_chars", "isbn_from_text")


#: Lines of a printed document: pieces of 90 characters, 30 on a page; a page more for the number.
D_PDF = D_FILE + f"""ln AS (SELECT id, list_concat(CASE WHEN label IS NULL THEN [] ELSE [label] END, [substr(body, CAST(90 * i + 1 AS INT), 90) FOR i IN range(0, (length(body) + 89) // 90)]) AS lines FROM bk),
pg AS (SELECT id, list_concat([array_to_string(list_filter(lines[30 * i + 1 : 30 * i + 30], lambda x: x <> ''), chr(10)) FOR i IN range(0, greatest((len(lines) + 29) // 30, 1))], CASE WHEN id % 2 = 0 THEN ['{_NUMBER}'] ELSE [] END) AS pages FROM ln)"""


@query(D_PDF + f""", tx AS (SELECT id, pages, array_to_string(pages[1:15], chr(12)) AS t, id % 7 = 5 AS bad FROM pg), wn AS (SELECT *, CASE WHEN trim(t, concat(' ', chr(12), chr(10))) = '' THEN NULL ELSE left(t, 5000) END AS p FROM tx)
SELECT id, bad AS failed, CASE WHEN NOT bad THEN concat('Titul ', id) END AS title, CASE WHEN bad THEN '' ELSE 'Karel Čapek|Jan Novák' END AS authors, CASE WHEN NOT bad THEN md5(p) END AS page_md5,
CASE WHEN NOT bad AND p IS NOT NULL AND length(t) > 5000 THEN length(left(t, 30000)) END AS broader_chars, CASE WHEN NOT bad AND (contains(p, '{_NUMBER}') OR (p IS NOT NULL AND len(pages) > 3 AND id % 2 = 0)) THEN '9788085906455' END AS isbn_from_text, {_D_MINED_GOOD} FROM wn""")
def pdf_source(spark, sf_dir):
    """The text layer of documents of three makes: the first 15 pages, the last five for a number; encrypted ones give an error."""
    lines = F.concat(F.array_compact(F.array("label")), F.expr("transform(filter(sequence(0, (char_length(body) + 89) div 90), i -> i * 90 < char_length(body)), i -> substr(body, CAST(90 * i + 1 AS INT), 90))"))
    pages = F.expr("transform(sequence(0, greatest((size(lines) + 29) div 30, 1) - 1), i -> slice(lines, CAST(30 * i + 1 AS INT), 30))")
    last = F.when(F.col("id") % 2 == 0, F.array(F.array(F.lit(_NUMBER)))).otherwise(F.array().cast("array<array<string>>"))
    narrow = ~F.array_join("lines", "").rlike(r"[^\x20-\x7E]")
    kind = F.when((F.col("id") % 3 == 1) & narrow, 2).otherwise(F.col("id") % 2).cast("int")
    b = _file_books(spark, sf_dir).select("id", lines.alias("lines")).select("id", "lines", pages.alias("pages"))
    raw = built(built_files.pdf)(F.concat(F.lit("Titul "), _N()), F.lit("Karel Čapek; Jan Novák"), F.lit(None).cast("string"), F.concat("pages", last), kind)
    locked = F.concat(raw, F.encode(F.lit("\ntrailer <</Encrypt 9 0 R>>"), "UTF-8"))
    b = b.select("id", _file("pdf"), F.when(F.col("id") % 7 == 5, locked).otherwise(raw).alias("content"))
    return _told(files.evidence(b), "error IS NOT NULL AS failed", "title", "array_join(authors, '|') AS authors", "md5(page) AS page_md5", "CAST(char_length(broader) AS BIGINT) AS broader_chars", "isbn_from_text")


@query(cte() + ", f AS (SELECT id, unnest(['epub', 'xyz']) AS k FROM books) SELECT id, k AS source_format, k = 'xyz' OR id % 2 = 0 AS failed FROM f")
def extractor_dispatch(spark, sf_dir):
    """Files of an unknown kind and broken ones give a row with an error."""
    b = books(spark, sf_dir).select("id", F.explode(F.array(F.lit("epub"), F.lit("xyz"))).alias("k"))
    good = _zipped("META-INF/container.xml", "c.opf")(F.lit('<c><rootfile full-path="c.opf"/></c>'), F.lit("<package/>"))
    b = b.select(F.concat(F.lit("/b/"), _N(), F.lit("."), F.col("k")).alias("path"), F.when(F.col("id") % 2 == 0, F.lit("no zip").cast("binary")).otherwise(good).alias("content"))
    return files.evidence(b).selectExpr(f"{_ID} AS id", "source_format", "error is not null AS failed")


@query(cte() + "SELECT id AS book, CASE WHEN length(text) >= 80 AND len(regexp_extract_all(regexp_replace(regexp_replace(text, '@page\\s*\\{[^}]*\\}', ' ', 'g'), '[{};]', ' ', 'g'), '[A-Za-zÁ-ž]{3,}')) >= 8 AND id % 2 = 0 THEN concat('/b/', id, '/b.txt') ELSE concat('/b/', id, '/a.txt') END AS path FROM books")
def sibling_fallback(spark, sf_dir):
    """The primary file unless its page is unusable and another's is not."""
    b = books(spark, sf_dir).select("id", "text", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k"))
    page = F.when(F.col("k") == "b", F.when(F.col("id") % 2 == 0, F.col("text")).otherwise("short")).otherwise("css only")
    f = b.select(F.col("id").alias("book"), F.concat(F.lit("/b/"), _N(), F.lit("/"), "k", F.lit(".txt")).alias("path"), page.alias("page"), (F.col("k") == "a").alias("is_primary"))
    return files.with_fallback(f).select("book", "path")


_MARKED = "CASE id % 5 WHEN 0 THEN concat('<b>', title, '</b> & \"', chr(1), '\" ', chr(128512)) ELSE title END"
_XML = "nullif(trim(regexp_replace(t, '[^\\x{9}\\x{A}\\x{D}\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}]', '', 'g')), '')"


@query(D_ISBN + f", tm AS (SELECT *, {_MARKED} AS t FROM rec) SELECT id, {_XML} AS title, array_to_string(list_filter(authors, lambda x, i: list_position(authors, x) = i), '|') AS authors, isbn, year FROM tm")
def opf_round_trip(spark, sf_dir):
    """A rendered package document says, when read, what the record said (a repeated author once); markup in fields does no harm, and what XML can't hold goes."""
    r = records(spark, sf_dir).withColumn("title", F.expr(_MARKED.replace("chr(1)", "char(1)").replace("chr(128512)", "'😀'")))
    none = F.lit(None).cast("string")
    fields = {"title": F.col("title"), "authors": F.col("authors"), "isbn": F.col("isbn"), "uuid": F.col("uuid"), "id": F.col("id"), "year": F.col("year"), "publisher": F.col("publisher"), "language": F.col("language"), "description": F.lit('a < b & "c"'), "series": none, "series_index": none, "subjects": F.array(F.lit("x")), "cover": F.lit(True)}
    o = r.select("id", manifest.parsed_opf(render.opf(fields)).alias("o"))
    return o.select("id", "o.title", F.array_join("o.authors", "|").alias("authors"), "o.isbn", "o.year")


@query(cte() + "SELECT id, CASE id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'keep' END AS action, CASE WHEN id % 3 = 0 THEN concat('New ', id) END AS title, id % 2 = 0 AS verified FROM books")
def review_source(spark, sf_dir):
    """Review documents, older forms among them, as rows."""
    spark.udtf.register("review_entries", review_file.ReviewEntries)
    i = F.col("id")
    act = F.when(i % 3 == 0, F.concat(F.lit("action: edit\nedited: {title: New "), _N(), F.lit("}\n"))).when(i % 3 == 1, "action: reject\n").otherwise("action: null\n")
    doc = F.concat(F.lit("---\nid: "), _N(), F.lit("\nuuid: u\n"), act, F.when(i % 2 == 0, "verified: true\n").otherwise(""))
    books(spark, sf_dir).select(doc.alias("raw")).createOrReplaceTempView("__review_docs")
    e = spark.sql("SELECT e.* FROM __review_docs d, LATERAL review_entries(d.raw) e")
    return e.select("id", "action", F.col("proposed")["title"].alias("title"), "verified")


@query(cte() + "SELECT id, concat('Kniha ', id) AS title, CASE WHEN id % 2 = 0 THEN 'Jan A|Eva B' ELSE 'Jan A' END AS authors, '9788071741305' AS isbn, 'Argo' AS publisher, 'sci-fi|povídky' AS genres FROM books WHERE id % 4 > 0")
def detail_page(spark, sf_dir):
    who = F.when(F.col("id") % 2 == 0, '[{"@type": "Person", "name": "Jan A"}, {"name": "Eva B"}]').otherwise('{"name": "Jan A"}')
    ld = F.when(F.col("id") % 4 > 0, F.concat(F.lit('<script type="application/ld+json">{"@type": "Book", "name": "Kniha '), _N(), F.lit('", "isbn": "80-7174-130-2", "publisher": [{"name": "Argo"}], "genre": ["sci-fi"], "author": '), who, F.lit("}</script>"))).otherwise("")
    d = web.detail(books(spark, sf_dir).select("id", F.concat(ld, F.lit("<a class='tag' title='povídky'>x</a>")).alias("html"))).where("detail is not null")
    return d.select("id", "detail.title", F.array_join("detail.authors", "|").alias("authors"), "detail.isbn", "detail.publisher", F.array_join("detail.genres", "|").alias("genres"))


@query(cte() + "SELECT id AS page_id, concat('knihy/', id) AS path, concat('Kniha ', id) AS title, CAST(1990 + id % 30 AS INT) AS year FROM books UNION ALL SELECT id, 'knihy/x', 'Jiná', CAST(2001 AS INT) FROM books WHERE id % 2 = 0")
def search_page(spark, sf_dir):
    """Hits of a search page, a repeated one once."""
    hit = lambda path, title, year: F.concat(F.lit("<p class='new'><a class='new' type='book' href='"), path, F.lit("' title='"), title, F.lit("'>x</a><span class='pozn'>"), year, F.lit(", Jan A</span></p>"))
    own = hit(F.concat(F.lit("knihy/"), _N()), F.concat(F.lit("Kniha "), _N()), (1990 + F.col("id") % 30).cast("string"))
    page = F.concat(own, own, F.when(F.col("id") % 2 == 0, hit(F.lit("knihy/x"), F.lit("Jiná"), F.lit("2001"))).otherwise(""))
    return web.results(books(spark, sf_dir).select(F.col("id").alias("page_id"), page.alias("html"))).select("page_id", "path", "title", "year")


@query(D_FLOW + "SELECT id, contains(first_page, authors[1]) AS found FROM flow")
def author_in_text(spark, sf_dir):
    f = flow_records(spark, sf_dir).select("id", text.normalise(F.col("f_author")).alias("a"), text.normalise(F.substring("first_page", 1, 4000)).alias("p"))
    return f.select("id", (fuzzy.in_text(F.col("a"), F.col("p"), author=True) >= 0.8).alias("found"))


@query("SELECT doc_id AS id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS collapsed FROM documents")
def whitespace_collapse(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), text.collapse(F.coalesce("text", F.lit(""))).alias("collapsed"))


@query(cte() + ", p AS (SELECT id, CASE WHEN list_contains(formats, 'epub') THEN 'skipped' WHEN len(list_filter(['azw3', 'mobi', 'prc', 'pdf', 'rtf', 'txt', 'docx'], lambda f: list_contains(formats, f))) = 0 THEN 'no source' ELSE list_filter(['azw3', 'mobi', 'prc', 'pdf', 'rtf', 'txt', 'docx'], lambda f: list_contains(formats, f))[1] END AS plan FROM books) SELECT plan, count(*) AS n FROM p GROUP BY plan")
def epub_summary(spark, sf_dir):
    has, order = F.array_contains("formats", "epub"), ["azw3", "mobi", "prc", "pdf", "rtf", "txt", "docx"]
    src = F.get(F.filter(F.array(*map(F.lit, order)), lambda f: F.array_contains(F.col("formats"), f)), F.lit(0))
    plan = F.when(has, "skipped").otherwise(F.coalesce(src, F.lit("no source")))
    return books(spark, sf_dir).groupBy(plan.alias("plan")).agg(F.count("*").alias("n"))


#: What a folder holds, by id: a manifest, one that can't be read beside a package document, a package document, both unreadable, nothing; some titles are damaged.
_FOLDER_TITLE = "CASE WHEN id % 7 = 0 THEN 'Jiшн Kosek' ELSE concat('Kniha ', id) END"


@query(cte() + """SELECT id, CASE id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'opf(fallback)' WHEN 2 THEN 'opf' WHEN 3 THEN 'opf(fallback)' ELSE 'path' END AS source, CASE WHEN id % 5 > 2 THEN '' WHEN id % 7 = 0 THEN 'Jiří Kosek' ELSE concat('Kniha ', id) END AS title,
CASE WHEN id % 5 > 2 THEN '' ELSE 'Jan Novák' END AS authors, CASE WHEN id % 5 < 3 THEN '9788071741305' END AS isbn, CASE WHEN id % 5 < 3 THEN 'Argo' END AS publisher, id % 5 < 3 AND id % 7 = 0 AS repaired, id % 5 = 0 AND id % 2 = 0 AS verified FROM books""")
def record_reader(spark, sf_dir):
    """Records of folders: the manifest, else the package document, else the path alone; damaged text repaired."""
    from quirework.sources import scan

    t = F.expr(_FOLDER_TITLE)
    good = F.to_json(F.struct(t.alias("title"), F.array(F.lit("Jan Novák")).alias("authors"), F.lit("80-7174-130-2").alias("isbn"), F.lit("Argo").alias("publisher"), (F.col("id") % 2 == 0).alias("verified")))
    package = F.concat(F.lit('<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>'), t, F.lit("</dc:title><dc:creator>Jan Novák</dc:creator><dc:identifier scheme='ISBN'>8071741302</dc:identifier><dc:publisher>Argo</dc:publisher></metadata></package>"))
    k = F.col("id") % 5
    d = books(spark, sf_dir).select("id", F.when(k == 0, good).when(k.isin(1, 3), "{broken").alias("manifest"), F.when(k.isin(0, 1, 2), package).when(k == 3, "<broken").alias("opf"))
    return scan.read(d).select("id", "source", "title", F.array_join("authors", "|").alias("authors"), "isbn", "publisher", F.col("encoding_repaired").alias("repaired"), "verified")
