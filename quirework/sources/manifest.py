"""Manifests (JSON) and package documents (OPF)."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions import isbn

MARK = "0101-01-01"


def scanned(raw: Column) -> Column:
    """struct of title, authors, series (name, index), year, isbn, verified of a manifest; null if it isn't JSON. Native: VARIANT access."""
    v = F.try_parse_json(raw)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    year = F.substring(get("$.publishedYear"), 1, 4).try_cast("int")
    items = F.try_variant_get(v, "$.series", "array<variant>")
    one = lambda x: F.struct(
        F.coalesce(F.try_variant_get(x, "$.name", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.lit("")).alias("name"),
        F.coalesce(F.try_variant_get(x, "$.index", "string"), F.try_variant_get(x, "$.sequence", "string"), F.lit("")).alias("index"),
    )
    return F.when(
        v.isNotNull(),
        F.struct(
            F.coalesce(get("$.title"), F.lit("")).alias("title"), F.filter(F.coalesce(F.try_variant_get(v, "$.authors", "array<string>"), F.array().cast("array<string>")), lambda a: a != "").alias("authors"),
            F.transform(items, one).alias("series"), F.when(year >= 1000, year).alias("year"), isbn.canonical(get("$.isbn")).alias("isbn"), F.coalesce(get("$.verified", "boolean"), F.lit(False)).alias("verified"),
        ),
    )


def opf_year(date: Column) -> Column:
    year = F.regexp_extract(date, r"^(\d{4})", 1).try_cast("int")
    return F.when(~date.startswith(MARK) & year.between(1400, 2100), year)


def overlaid(raw: Column, managed: Column) -> Column:
    """A manifest with the managed keys (a JSON object) laid over it; all other keys survive, numbers, lists and objects as such."""
    old, new = F.from_json(raw, "map<string,variant>"), F.from_json(managed, "map<string,variant>")
    keep = F.map_filter(F.coalesce(old, F.from_json(F.lit("{}"), "map<string,variant>")), lambda k, v: ~F.map_contains_key(new, k))
    return F.to_json(F.map_concat(keep, new))


_DDL = "struct<title: string, authors: array<string>, isbn: string, year: int, language: string, publisher: string, tags: array<string>, series: string, error: string>"
_FIELDS = ("title", "authors", "isbn", "year", "language", "publisher", "tags", "series", "error")


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def read_opf(xml: str | None) -> dict:
    """The fields of one package document, namespaces aside."""
    out: dict = dict.fromkeys(_FIELDS)
    out["authors"], out["tags"] = [], []
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError as e:
        return out | {"error": str(e)}
    for e in root.iter():
        tag, value = _local(e.tag), (e.text or "").strip()
        attrs = {_local(k): v for k, v in e.attrib.items()}
        if tag == "creator" and value and attrs.get("role", "aut") == "aut" and value not in out["authors"]:
            out["authors"].append(value)
        elif tag == "subject" and value:
            out["tags"].append(value)
        elif tag == "identifier" and out["isbn"] is None and "isbn" in (attrs.get("scheme", "") + value).lower():
            out["isbn"] = canonical(value)
        elif tag == "date" and out["year"] is None and not value.startswith(MARK) and value[:4].isdigit() and 1400 <= int(value[:4]) <= 2100:
            out["year"] = int(value[:4])
        elif tag == "meta" and attrs.get("name") == "calibre:series":
            out["series"] = attrs.get("content")
        elif tag in ("title", "language", "publisher") and value and out[tag] is None:
            out[tag] = value
    return out


def canonical(raw: str) -> str | None:
    """The ISBN of a string as 13 digits, as isbn.canonical() does for columns."""
    s = raw.lstrip("".join(c for c in set(raw) if c not in "0123456789Xx")).replace("-", "").replace(" ", "").upper()
    total13 = lambda d: sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(d))
    if len(s) == 10 and s[:9].isdigit() and (s[9].isdigit() or s[9] == "X"):
        if sum((10 if c == "X" else int(c)) * (10 - i) for i, c in enumerate(s)) % 11:
            return None
        return "978" + s[:9] + str(-total13("978" + s[:9]) % 10)
    return s if len(s) == 13 and s.isdigit() and total13(s) % 10 == 0 else None


def parsed_opf(xml: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("title", pa.string()), ("authors", pa.list_(pa.string())), ("isbn", pa.string()), ("year", pa.int32()), ("language", pa.string()), ("publisher", pa.string()), ("tags", pa.list_(pa.string())), ("series", pa.string()), ("error", pa.string())])
        for a in batches:
            yield pa.array([read_opf(x) for x in a.to_pylist()], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _DDL)(xml)
