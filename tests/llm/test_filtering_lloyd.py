import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import filtering_lloyd as fl

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Lloyd's algorithm by plain Python integers; every vector has one length."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda c, p: min((dist(c, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], p)[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = [[near(c[p], p) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in g) for g in got]
    by = {}
    for (_, _, lab), e in zip(kept, error, strict=True):
        by[lab] = by.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in g), e, by[lab], sha) for (i, _, lab), g, e in zip(kept, got, error, strict=True)], books


def found(spark, rows):
    return sorted(map(tuple, fl.digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr)


def vectors(r, n, width, spread=1.0, centres=7):
    mid = [[r.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [[x + r.gauss(0, 0.2) * spread for x in r.choice(mid)] for _ in range(n)]


def test_query_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, v, r.choice([None, 1, 2, 3])) for i, v in enumerate(vectors(r, 300, 32))]
    rows += [(1000 + i, rows[i % 7][1], 1) for i in range(120)]  # copies: ties, equal entries
    rows += [(2000 + i, [float(r.randrange(2)) for _ in range(32)], 5) for i in range(100)]
    assert found(spark, rows) == sorted(brute(rows)[0], key=repr)


def test_equal_first_entries_and_few_rows(spark):
    r = random.Random(2)
    same = [(i, [0.5] * 16, 1) for i in range(40)] + [(100 + i, v, 2) for i, v in enumerate(vectors(r, 30, 16))]
    assert found(spark, same) == sorted(brute(same)[0], key=repr)
    few = [(i, v, None) for i, v in enumerate(vectors(r, 5, 8))]
    assert found(spark, few) == sorted(brute(few)[0], key=repr)


def test_odd_rows(spark):
    r = random.Random(3)
    good = [(i, v, i % 3) for i, v in enumerate(vectors(r, 60, 16))]
    odd = [(-1, None, 1), (-2, [], 1), (-3, [None] * 16, 1), (-4, [math.nan] * 16, 1), (-5, [math.inf] + [0.0] * 15, 2), (-6, [1.0] * 15 + [None], 2)]
    odd += [(-7, [3e38] * 16, 1), (-8, [1.0] * 8, 1)]  # too large for a long; another length
    repeated = [good[3], good[3], (None, good[5][1], None), (None, good[6][1], None)]
    rows = good + repeated
    assert found(spark, rows + odd) == sorted(brute(rows)[0], key=repr)
    assert found(spark, odd[:7]) == [] and found(spark, []) == []
    extra = spark.createDataFrame(good, SCHEMA).withColumn("code", F.lit(1)).withColumn("row", F.lit("x")).withColumn("of", F.lit(2))
    assert fl.digest(extra).count() == len(good)


def test_length_that_parts_do_not_divide(spark):
    r = random.Random(4)
    rows = [(i, v, 0) for i, v in enumerate(vectors(r, 80, 10))]
    padded = [(i, v + [0.0] * 6, lab) for i, v, lab in rows]
    got = found(spark, rows)
    assert [x[:4] for x in got] == [x[:4] for x in sorted(brute(padded)[0], key=repr)]


def test_trees_keep_their_points_and_eliminate():
    r = np.random.default_rng(5)
    x = (r.normal(size=(5000, 4)) * 40).astype(np.int32) + r.choice(np.arange(16) * 3000, (5000, 1)).astype(np.int32)
    tree = fl.unpack(fl.pack(fl.build(x)), len(x), 4)
    assert (tree.points == x[tree.order]).all() and sorted(tree.order) == list(range(5000))
    for level, (lo, hi, s) in enumerate(zip(tree.low, tree.high, tree.sums, strict=True)):
        for i, (a, b) in enumerate(zip(fl._bounds(5000, level), fl._bounds(5000, level)[1:], strict=False)):
            held = tree.points[a:b]
            assert (held.min(0) == lo[i]).all() and (held.max(0) == hi[i]).all() and (held.sum(0) == s[i]).all()
    book = np.repeat(np.arange(16)[:, None] * 3000 + 20, 4, axis=1)
    whole, single = [], []
    fl.settle(tree, book, lambda level, nodes, _: whole.extend(5000 >> level for _ in nodes), lambda places, *_: single.extend(places))
    assert sum(whole) > 4000 and len(whole) < 1000 and len(single) < 1000  # whole subtrees are assigned at once
    entry, distance = fl.assign(tree, book)
    every = ((x[:, None].astype(np.int64) - book) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_large_components_stay_exact():
    top = fl.limit(64)
    r = np.random.default_rng(6)
    x = r.choice([-top, top, top - 1], (200, 8)).astype(np.int32)
    entry, distance = fl.assign(fl.build(x), x[:16].astype(np.int64))
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in x[:16]] for p in x]
    assert distance.tolist() == [min(d) for d in every] and entry.tolist() == [d.index(min(d)) for d in every]


def test_chunks_and_batches_change_nothing(spark, monkeypatch):
    r = random.Random(7)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(r, 400, 16))]
    want = sorted(brute(rows)[0], key=repr)
    monkeypatch.setattr(fl, "CHUNK", 400)
    assert found(spark, rows) == want


def test_decode(spark):
    r = random.Random(8)
    rows = [(i, v, 0) for i, v in enumerate(vectors(r, 200, 16, 0.1))]
    d = spark.createDataFrame(rows, SCHEMA)
    done, books = fl.compress(d)
    got = {x.id: x for x in fl.decode(done.select("row.id", "code", "error"), books).collect()}
    for i, v, _ in rows:
        ints = np.array([math.floor(4096 * float(np.float32(x))) for x in v])
        assert ((ints - np.array(got[i].decoded) * 4096) ** 2).sum() == pytest.approx(got[i].error)
