"""Structured answers in free text: fences, foreign literals, trailing commas and truncation are repaired before parsing."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = re.compile(r'("(?:[^"\\]|\\.)*(?:"|\Z))', re.S)
_LITERALS = {"None": "null", "True": "true", "False": "false"}


def sanitised(text: str) -> str:
    """Literals of another language and trailing commas, outside strings."""
    parts = _STRING.split(text)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\b(None|True|False)\b", lambda m: _LITERALS[m[0]], parts[i])
    joined = "".join(parts)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], joined)


def completed(text: str) -> str:
    """A cut-off document with its string, arrays and objects closed."""
    open_, inside, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
    text = text + '"' if inside else text.rstrip().rstrip(",:")
    return text + "".join(reversed(open_))


def read(text: str | None) -> dict | None:
    """The object of an answer, or null."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text or "")
    start = body.find("{")
    if start < 0:
        return None
    end = body.rfind("}")
    tries = [body[start : end + 1]] if end > start else []
    for t in [*tries, body[start:]]:
        for fixed in (t, sanitised(t), completed(sanitised(t)), sanitised(completed(t))):
            try:
                if isinstance(got := json.loads(fixed), dict):
                    return got
            except ValueError:
                continue
    return None


def coerced(got: dict | None) -> dict:
    got = got or {}
    text = lambda k: v.strip() if isinstance(v := got.get(k), str) and v.strip() else None
    year = re.match(r"\d{4}", str(got.get("year") or ""))
    authors = got.get("authors")
    authors = [authors] if isinstance(authors, str) else authors if isinstance(authors, list) else []
    return {"title": text("title"), "authors": [a for a in authors if isinstance(a, str) and a], "isbn": text("isbn"), "year": int(year[0]) if year and int(year[0]) >= 1000 else None}


def parsed(c: Column) -> Column:
    kind = pa.struct([("title", pa.string()), ("authors", pa.list_(pa.string())), ("isbn", pa.string()), ("year", pa.int32())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([coerced(read(x)) for x in a.to_pylist()], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<title: string, authors: array<string>, isbn: string, year: int>")(c)
