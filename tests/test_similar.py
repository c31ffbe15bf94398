import random

import numpy as np
from pyspark.sql import functions as F

from quirework.functions import fuzzy
from quirework.operators import similar


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_partial(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m = len(short)
    return max((200 * brute_lcs(short, long[max(0, i) : i + m]) / (m + len(long[max(0, i) : i + m])) for i in range(1 - m, len(long))), default=0.0)


def text(r, n, letters="abcdefgh "):
    return "".join(r.choice(letters) for _ in range(n))


def test_subsequences_of_any_length():
    r = random.Random(1)
    for n in (0, 1, 5, 63, 64, 65, 127, 128, 129, 200):
        a = text(r, n)
        many = [text(r, r.randrange(160)) for _ in range(20)] + [a, a[: n // 2], ""]
        got = fuzzy.Many(many).lcs(a, np.arange(len(many)))
        assert got.tolist() == [brute_lcs(a, b) for b in many]
        assert [fuzzy.lcs(a, b) for b in many] == got.tolist()


def test_partial_ratio_has_no_longest_needle():
    r = random.Random(2)
    for n in (3, 60, 63, 64, 65, 90, 130):
        for m in (n, n + 7, 150):
            a, b = text(r, n), text(r, max(m, n))
            b = b[: len(b) // 3] + a[: n // 2] + b[len(b) // 3 :]
            assert abs(fuzzy.partial_ratio(a, b) - brute_partial(a, b)) < 1e-9


WORDS = ["válka", "mír", "the", "robot", "nadace", "duna", "series", "volume", "of", "king", "zkáza", "dům", "u", "lásky", "x1", "stopař", "průvodce", "galaxií"]


def title(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 6)))


def edited(r, t, most=5):
    for _ in range(r.randrange(0, most)):
        i = r.randrange(len(t) + 1)
        t = t[:i] + r.choice(["", "x", "é", " "]) + t[i + r.randrange(2) :]
    return t.upper() if r.random() < 0.3 else t


def key(t):
    return " ".join(sorted((t or "").lower().split()))


def ratio(a, b):
    return 200 * brute_lcs(a, b) / (len(a) + len(b))


def test_index_finds_every_pair(spark):
    r = random.Random(3)
    base = [title(r) for _ in range(120)]
    keys = sorted(set(map(key, base)) | {key(edited(r, t, 4)) for t in base for _ in range(4)} | {text(r, n, "ab") for n in range(1, 9) for _ in range(12)} - {""})
    keys = sorted({k for k in (key(k) for k in keys) if k})
    known = spark.createDataFrame([(k,) for k in keys], "key string")
    asked = known.where(F.pmod(F.crc32("key"), F.lit(3)) == 0)
    own = [x.key for x in asked.collect()]
    for threshold in (85.0, 90.0, 95.0):
        want = {(a, b) for a in own for b in keys if a != b and ratio(a, b) >= threshold}
        got = [(x.asked, x.known) for x in similar.pairs(asked, known, threshold).collect()]
        assert set(got) == want and len(want) > 20


def test_hot_grams_are_dealt_out(spark, monkeypatch):
    r = random.Random(4)
    keys = sorted({f"series volume {i}" for i in range(300)})
    known = spark.createDataFrame([(k,) for k in keys], "key string")
    want = {(a, b) for a in keys for b in keys if a != b and ratio(a, b) >= 95}
    monkeypatch.setattr(similar, "HOT", 20)
    assert {(x.asked, x.known) for x in similar.pairs(known, known, 95.0).collect()} == want and r


def brute_answer(t, want, rows, floor=70):
    best = None
    for place, other, year in rows:
        if not key(t) or not key(other):
            continue
        s = ratio(key(t), key(other))
        if s >= floor:
            close = want is not None and year is not None and abs(year - want) <= 1
            best = max(best, (close, s, -place)) if best else (close, s, -place)
    return best and (round(best[1], 6), -best[2])


def asked_and_known(r, n=150, m=400):
    rows = [(i, title(r) if i % 9 else r.choice(["", None, " "]), r.choice([None, *range(1990, 1996)])) for i in range(m)]
    rows += [(m + i, "Duna", 1990 + i % 4) for i in range(60)]
    asks = [(i, edited(r, r.choice(rows)[1] or "nic"), r.choice([None, *range(1988, 1998)])) for i in range(n)] + [(n, None, 1990), (n + 1, "  ", None), (n + 2, "naprosto jiné", 1991), (n + 3, "duna", 1992), (n + 4, "duna", None)]
    return asks, rows


def test_lookup_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    asks, rows = asked_and_known(r)
    a = spark.createDataFrame(asks, "id long, title string, want_year int")
    c = spark.createDataFrame(rows, "place long, title string, year int").withColumn("hit", F.struct("title"))
    run = lambda: {x.id: x.found and (round(x.found.score, 6), x.found.place) for x in similar.looked_up(a, c).collect()}
    want = {i: brute_answer(t, y, rows) for i, t, y in asks}
    assert run() == want
    assert sum(v is not None and v[0] < 90 for v in want.values()) > 10
    monkeypatch.setattr(similar, "BLOCK", 16)
    assert run() == want


def test_lookup_without_rows(spark):
    a = spark.createDataFrame([(1, "x", 1990)], "id long, title string, want_year int")
    c = spark.createDataFrame([], "place long, title string, year int").withColumn("hit", F.struct("title"))
    assert [x.found for x in similar.looked_up(a, c).collect()] == [None]
    assert similar.looked_up(a.where("id = 0"), c).collect() == []


def test_common_classes_bound_the_score():
    r = random.Random(6)
    texts = [text(r, r.randrange(1, 60), "aaabcdefghijklmnop ěšč") for _ in range(80)]
    levels, more = similar.classes(texts)
    common = levels @ levels.T + np.minimum(more[:, None], more)
    assert all(common[i, j] >= brute_lcs(texts[i], texts[j]) for i in range(80) for j in range(80))


def test_high_bounds_first_spare_the_others(monkeypatch):
    r = random.Random(7)
    keys = sorted({f"{r.randrange(10**5)} lambda omega" for _ in range(1500)})
    asked = [f"{r.randrange(10**5)} lambda omega" for _ in range(60)]
    years = [r.choice([None, 1990, 1995]) for _ in keys]
    wants = [r.choice([None, 1990, 2000]) for _ in asked]
    scored = []
    lcs = similar.Masks.lcs
    monkeypatch.setattr(similar.Masks, "lcs", lambda self, q, *more: scored.append(len(q)) or lcs(self, q, *more))
    found = similar.Asked(asked, wants, 70.0)
    for lo in range(0, len(keys), 500):
        found.meet(keys[lo : lo + 500], years[lo : lo + 500], list(range(lo, min(lo + 500, len(keys)))))
    rows = list(zip(range(len(keys)), keys, years, strict=True))
    assert [(round(s, 6), int(p)) for s, p in zip(found.score, found.place, strict=True)] == [brute_answer(a, w, rows) for a, w in zip(asked, wants, strict=True)]
    assert sum(scored) < len(asked) * len(keys) / 4


def test_capitals_of_a_sharp_s_are_the_same_title(spark, tmp_path):
    from quirework.plans import queries

    spark.createDataFrame([(20, "Große Straße am Fluß\nund so", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in queries()["title_lookup"](spark, str(tmp_path)).collect()] == [(20, 20, 100.0)]
