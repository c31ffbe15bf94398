"""ISBN canonicalisation as column expressions: no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.constants import ISBN_IN_TEXT


def _digits(s: Column) -> Column:
    """The digits of s as an array of ints; X counts ten."""
    return F.transform(F.split(s, ""), lambda c: F.when(c == "X", 10).otherwise(c.try_cast("int")))


def _weighted(s: Column, weight) -> Column:
    parts = F.transform(_digits(s), lambda d, i: d * weight(i))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def valid10(s: Column) -> Column:
    return _weighted(s, lambda i: 10 - i) % 11 == 0


def valid13(s: Column) -> Column:
    return _weighted(s, lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0


def to13(s10: Column) -> Column:
    """A checked ISBN-10 under the 978 prefix."""
    body = F.concat(F.lit("978"), F.substring(s10, 1, 9))
    check = (10 - _weighted(body, lambda i: F.when(i % 2 == 0, 1).otherwise(3)) % 10) % 10
    return F.concat(body, check.cast("string"))


def canonical(raw: Column) -> Column:
    """The 13 digits of a valid ISBN, else null. Separators and what stands before the first digit or X go."""
    s = F.upper(F.regexp_replace(F.regexp_replace(raw, "^[^0-9Xx]+", ""), "[- ]", ""))
    ten, thirteen = s.rlike("^[0-9]{9}[0-9X]$"), s.rlike("^[0-9]{13}$")
    return F.when(ten, F.when(valid10(s), to13(s))).when(thirteen, F.when(valid13(s), s))


def all_in(text: Column) -> Column:
    """The valid ISBNs of a text, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?=[Ii0-9])" + ISBN_IN_TEXT), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(found, canonical)))


def first_in(text: Column) -> Column:
    return F.get(all_in(text), F.lit(0))


def looks_like(s: Column) -> Column:
    """Ten or thirteen digits (the last may be X) once all else is taken out."""
    clean = F.regexp_replace(F.coalesce(s, F.lit("")), "[^0-9Xx]", "")
    return clean.rlike("^([0-9]{9}|[0-9]{12})[0-9Xx]$")
