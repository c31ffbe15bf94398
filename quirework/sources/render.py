"""Package documents and manifests as text columns; writing them is a separate step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.names import author_sort


def xml_safe(s: Column) -> Column:
    """Without what XML 1.0 forbids (and without characters beyond the basic plane), specials escaped."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def opf(b: dict[str, Column]) -> Column:
    """A package document from title, authors, isbn, uuid, id, year, publisher, language, description, series, series_index, subjects, cover."""
    tag = lambda name, value, attrs="": F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"    <dc:{name}{attrs}>"), xml_safe(value), F.lit(f"</dc:{name}>\n"))).otherwise("")
    meta = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f'    <meta name="{name}" content="'), xml_safe(value), F.lit('"/>\n'))).otherwise("")
    creator = lambda a: F.concat(F.lit('    <dc:creator opf:file-as="'), xml_safe(author_sort(a)), F.lit('" opf:role="aut">'), xml_safe(a), F.lit("</dc:creator>\n"))
    seen = F.array_distinct(F.filter(b["subjects"], lambda s: s != ""))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="uuid_id" version="2.0">\n  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">\n'),
        tag("identifier", b["id"].cast("string"), ' opf:scheme="calibre" id="calibre_id"'), tag("identifier", b["uuid"], ' opf:scheme="uuid" id="uuid_id"'), tag("identifier", b["isbn"], ' opf:scheme="ISBN"'),
        tag("title", b["title"]), F.array_join(F.transform(b["authors"], creator), ""), tag("publisher", b["publisher"]),
        tag("date", F.when(b["year"].isNotNull(), F.concat(F.lpad(b["year"].cast("string"), 4, "0"), F.lit("-01-01")))), tag("language", b["language"]), tag("description", b["description"]),
        meta("calibre:series", b["series"]), meta("calibre:series_index", b["series_index"]),
        F.array_join(F.transform(seen, lambda s: F.concat(F.lit("    <dc:subject>"), xml_safe(s), F.lit("</dc:subject>\n"))), ""),
        F.lit("  </metadata>\n"), F.when(b["cover"], '  <guide>\n    <reference type="cover" title="Cover" href="cover.jpg"/>\n  </guide>\n').otherwise(""), F.lit("</package>\n"),
    )
