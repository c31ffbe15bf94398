"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, digits, schemes (://) and identifier cues. From each
anchor a deterministic local parser expands to the boundaries and validates: e-mail (around @), address (four parts of at most 255),
card (14 to 19 digits, Luhn), phone (+, 10 to 15 digits). These four kinds are the base: leftmost, non-overlapping per
kind, a match that fails its validation is dropped and not tried again from within. Beyond them the anchors give
`login` (user:password@ after a scheme), `iban` (a cue or its country code is not enough: modulo 97 must hold) and `account` (a cue,
then at most eight separators, then an identifier of at least six digits).

Every text is scanned whole, once, in the task that reads it; nothing is shuffled. Offsets are code points, ends exclusive.
Odd input: a null or empty text has no spans; spans of different kinds may overlap; repeated rows give equal results; a text of any length takes time in
proportion to it; extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "account")
BASE = KINDS[:4]
CUES = ("account", "acct", "iban", "passport", "ssn", "tax id", "konto", "compte", "cuenta")
SPANS_DDL = "array<struct<kind: string, start: long, end: long>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOUR = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/:@?#]+:[^\s/@?#]+@")
_IBAN = re.compile(r"[:# ]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_IDENTIFIER = re.compile(r"(?: ?(?:no|nr|number|num|id)\b)?[.:#= ]{0,8}([0-9](?:[ -]?[0-9]){5,33})(?![A-Za-z0-9])")
_ASCII_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_MADE: list[ahocorasick.Automaton] = []


def _anchors() -> ahocorasick.Automaton:
    if not _MADE:
        a = ahocorasick.Automaton()
        for word in ("@", "+", "://", *"0123456789", *CUES):
            a.add_word(word, word)
        a.make_automaton()
        _MADE.append(a)
    return _MADE[0]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _iban(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """The (kind, start, end) of a text by start, then kind as listed."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_ASCII_LOWER)
    found: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = login_end = account_end = 0
    run_end = 0
    for at, what in _anchors().iter(low):
        if what in _DIGITS:
            if at < run_end:
                continue
            # the start of a run of digits: all parsers look from here, unless their last match covers it
            if at >= ip_end and (m := _FOUR.match(text, at)):
                ip_end = m.end()
                if all(map(_small, m.groups())):
                    found.append(("ip", at, ip_end))
            if at >= card_end and (m := _GROUPED.match(text, at)):
                card_end = m.end()
                if m.end() - at >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    found.append(("card", at, card_end))
            run_end = at + 1
            n = len(text)
            while run_end < n and text[run_end] in _DIGITS:
                run_end += 1
        elif what == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append(("email", start, email_end))
        elif what == "+":
            if (m := _DIAL.match(text, at)) and 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                found.append(("phone", at, m.end()))
        elif what == "://":
            if at >= login_end and (m := _LOGIN.match(text, at + 1)):
                login_end = m.end()
                found.append(("login", at + 1, login_end - 1))
        else:
            first, after = at - len(what) + 1, at + 1
            if first < account_end or first and text[first - 1].isalnum():
                continue
            if m := _IBAN.match(text, after):
                if _iban(m[1]):
                    account_end = m.end(1)
                    found.append(("iban", m.start(1), account_end))
            elif (m := _IDENTIFIER.match(low, after)) and m.start(1) > after:
                account_end = m.end(1)
                found.append(("account", m.start(1), account_end))
    found.sort(key=lambda f: (f[1], KINDS.index(f[0])))
    return found


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with an array column of the spans (kind, start, end) of their texts."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out}; name another")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            got = (find(t.as_py()) for t in a)
            yield pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in got], pa.list_(SPAN))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(run, SPANS_DDL)(F.col(text_col)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; of overlapping spans the first stands."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            out = []
            for t in a.to_pylist():
                parts, last = [], 0
                for kind, s, e in find(t):
                    if s >= last:
                        parts += [t[last:s], f"[{kind}]"]
                        last = e
                out.append(None if t is None else "".join(parts) + t[last:])
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(text_col, F.arrow_udf(run, "string")(F.col(text_col)))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    got = with_spans(docs.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
