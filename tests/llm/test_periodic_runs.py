import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from quirework.llm import periodic_runs

from .helpers import ODD, docs, empty, prose


def brute_runs(words, shortest=24, times=3):
    """Every maximal stretch by every lag, kept if no smaller period holds in it."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(shortest, times * q) and not any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q)):
                out.append((start, end - start, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(left),
    )


def repetitive(r):
    """Words with periods inside periods, broken and joined."""
    words = [r.choice("abcdefgh") for _ in range(r.randrange(20))]
    for _ in range(r.randrange(1, 5)):
        unit = [r.choice("ab" if r.random() < 0.3 else "abcdefgh") for _ in range(r.randrange(1, 14))]
        if r.random() < 0.4:
            unit = unit * r.randrange(1, 6) + [r.choice("ab")]
        words += unit * r.randrange(1, 9)
        words += unit[: r.randrange(len(unit) + 1)]
        if r.random() < 0.3:
            words[r.randrange(len(words))] = "x"
    return words


def test_runs_against_brute_force():
    r = random.Random(3)
    seen = 0
    for _ in range(1500):
        words = repetitive(r)
        got = periodic_runs.runs([w.encode() for w in words])
        assert got == brute_runs(words), words
        seen += len(got)
    assert seen > 1500


def test_other_least_lengths():
    r = random.Random(4)
    for _ in range(300):
        words = repetitive(r)
        for shortest, times in ((4, 2), (10, 5)):
            got = periodic_runs.runs([w.encode() for w in words], shortest, times)
            wide = brute_runs(words, shortest, times)
            assert [x for x in got if x[1] >= 3 * x[2]] == [x for x in wide if x[1] >= 3 * x[2]]


def test_query_against_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(repetitive(r)) for _ in range(150)] + [prose(i, 200, 50) for i in range(40)] + [x for x in ODD if len(x or "") < 1000]
    texts += ["a  b\tc\n" * 40, "a b " * 30 + "c d\x0b" * 50, "1 " * 24, "1 " * 23]
    got = sorted(tuple(x) for x in periodic_runs.digest(docs(spark, texts)).collect())
    assert got == sorted(brute_row(i, t) for i, t in enumerate(texts))
    assert sum(x[1] > 0 for x in got) > 100 and sum(x[1] > 1 for x in got) > 10


def test_long_texts_are_dealt_out_by_lags(spark):
    r = random.Random(6)
    texts = [" ".join(repetitive(r) * 3 + prose(i, 60, 30).split()) for i in range(30)] + [None, "", "a " * 500, prose(1, 400)]
    d = docs(spark, texts + texts, list(range(len(texts))) * 2)
    rows = lambda long: sorted(map(repr, periodic_runs.find(d, long=long).collect()))
    pieces = rows(16)
    assert pieces == rows(1 << 16) and len(pieces) == 2 * len(texts)


def test_very_long_text(spark):
    words = [f"w{i % 5003}" for i in range(40_000)] + prose(1, 5000).split() + ["z"] * 100_000
    got = periodic_runs.find(docs(spark, [" ".join(words)]), shortest=24, times=3, long=20_000).collect()[0]
    assert [tuple(x) for x in got.runs] == [(0, 40_000, 5003), (45_000, 100_000, 1)]
    assert got.collapsed.split() == words[:5003] + words[40_000:45_001]


def test_odd_input(spark):
    assert periodic_runs.digest(empty(spark)).collect() == []
    d = docs(spark, ODD).withColumn("runs", F.lit(1)).withColumn("ID", F.lit("x")).withColumn("collapsed", F.lit(2))
    assert periodic_runs.digest(d).count() == len(ODD)
    twice = docs(spark, ["a b c " * 20] * 3, [5, 5, 5])
    assert periodic_runs.digest(twice).distinct().count() == 1 and periodic_runs.digest(twice).count() == 3
    null_id = spark.createDataFrame([(None, "a b " * 30), (None, None)], "doc_id long, text string")
    got = {x.n_runs: x for x in periodic_runs.digest(null_id).collect()}
    assert got[1].doc_id is None and (got[1].start, got[1].length, got[1].period) == (0, 60, 2)
    none = got[0]
    assert (none.start, none.length, none.period, none.exponent_milli) == (None,) * 4 and none.runs_sha256 == none.collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_collapse_keeps_the_table(spark):
    d = docs(spark, ["a b c " * 20, "few words  here", None]).withColumn("__text", F.lit("own"))
    got = {x.doc_id: x for x in periodic_runs.collapse(d).collect()}
    assert got[0].text == "a b c" and got[1].text == "few words  here" and got[2].text is None and got[0]["__text"] == "own"
    assert periodic_runs.collapse(d).columns == d.columns


def test_planes_hold_the_ids():
    ids = np.array([0, 5, 2, 7, 1])
    assert [sum((p >> i & 1) << b for b, p in enumerate(periodic_runs.planes(ids))) for i in range(5)] == ids.tolist()
