import random

from pyspark.sql import functions as F

from quirework.operators import clusters
from quirework.operators.neighbours import neighbours


def test_neighbours_against_a_list(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["cs", "cs", "cs", "en", None, "x"]), r.random() < 0.4) for i in r.sample(range(5000), 700)]
    rows += [(9000 + i, "none kept", False) for i in range(3)] + [(9100, "one", True)]
    d = spark.createDataFrame(rows, "id long, language string, kept boolean").repartition(6)
    got = {x.id: (x.next, x.prev) for x in neighbours(d, "language", "id", F.col("kept")).collect()}
    want = {}
    for i, lang, _ in rows:
        own = sorted(k for k, x, kept in rows if x == lang and kept)
        behind, before = [k for k in own if k > i], [k for k in own if k < i]
        want[i] = ((behind or own or [None])[0], (before or own or [None])[-1])
    assert got == want


def test_candidates_by_grams_miss_no_cluster():
    r = random.Random(2)
    words = ["valka", "s", "mloky", "robot", "nadace", "a", "rise", "duna", "zkaza", "mesto"]
    for _ in range(60):
        rows = []
        for i in range(80):
            t = " ".join(r.choice(words) for _ in range(r.randrange(0, 5)))
            for _ in range(r.randrange(3)):
                at = r.randrange(len(t) + 1)
                t = t[:at] + r.choice(["", "x"]) + t[at + r.randrange(2) :]
            rows.append({"dest": "d", "id": i, "title": t, "authors": [r.choice(["jan novak", "petr novak", "j novak"])], "isbn": r.choice([None, None, f"n{r.randrange(12)}"]), "year": r.choice([None, 1990, 1991])})
        fast, slow = clusters._Place("d"), clusters._Place("d")
        slow._candidates = lambda _, own=slow: list(range(len(own.base)))
        for x in rows:
            fast.take(dict(x))
            slow.take(dict(x))
        assert fast.rows() == slow.rows()
