import hashlib
import random
import re

from pyspark.sql import functions as F

from quirework.llm import pii_anchor
from quirework.llm.pii_anchor import BASE, find, luhn

from .helpers import ODD, docs, empty

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


SAMPLES = ["a@b.co", "x a.b+c@d-e.f.g, 1.2.3.4.5.6.7.8 and 999.1.1.1", "4539 1488 0343 6467 4539-1488-0343-6467", "+1 (555) 123-4567 ++49 30 123456 78", "a@b@c.de @x.y", "0001.02.3.255"]


def test_base_spans_against_regular_expressions():
    r = random.Random(1)
    texts = SAMPLES + ["".join(r.choice("0123456789.@+-  ab()9İ_%:/") for _ in range(r.randint(0, 80))) for _ in range(5000)]
    for t in texts:
        assert [x for x in find(t) if x[0] in BASE] == brute(t), t


def test_added_kinds():
    t = "IBAN: DE89 3704 0044 0532 0130 00. Account no: 12345678, http://bob:pw@h.com/ the ssn 123-45-6789; accounting 12345678"
    assert [(k, t[a:b]) for k, a, b in find(t) if k not in BASE] == [("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("login", "bob:pw"), ("account", "123-45-6789")]


def test_query(spark):
    texts = SAMPLES + ODD
    got = {r.doc_id: r for r in pii_anchor.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in want) for k in BASE]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
    assert pii_anchor.digest(empty(spark)).count() == 0


def test_masking_and_clashing_names(spark):
    d = docs(spark, ["mail a@b.co now", None]).withColumn("kind", F.lit(1)).withColumn("start", F.lit(2))
    assert [r.text for r in pii_anchor.masked(d).orderBy("doc_id").collect()] == ["mail [email] now", None]
    assert pii_anchor.with_spans(d).columns == [*d.columns, "spans"]


def test_long_runs_take_linear_time():
    assert find("1" * 200_000) == [] and find("+1" + "(" * 100_000) == []
    assert len(find("a" * 100_000 + "@b.c")) == 1
