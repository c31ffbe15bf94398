import itertools
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quirework.llm import simhash

from .helpers import ODD, docs, empty, prose


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits=3):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits and root(a) != root(b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in fps}


def test_cover_meets_every_pair_of_at_most_three_bytes():
    assert len(simhash.COVER) == 20
    for five in itertools.combinations(range(8), 5):
        assert any(set(s) <= set(five) for s in simhash.COVER)


def test_query_against_brute_force(spark):
    base = [prose(i) for i in range(25)]
    r = random.Random(2)
    texts = list(base) + base[:6] * 3
    for b in base[:10] * 4:
        w = b.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ODD
    got = {x.doc_id: x for x in simhash.digest(docs(spark, texts)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(x.fingerprint, 16) for i, x in got.items()} == fps
    assert {i: x.component_id for i, x in got.items()} == brute_components(fps)


def test_links_of_planted_fingerprints(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        fps.add(f)
        for _ in range(6):
            g = f
            for b in r.sample(range(64), r.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = Counter((x.a, x.b) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect())
    want = {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count() <= 3}
    assert set(got) == want and set(got.values()) <= {1}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_keep_first_and_odd_input(spark):
    t = prose(1)
    d = docs(spark, [t, t, prose(2), None, "", t], [5, 3, 9, 8, 2, None])
    kept = simhash.keep_first(d).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept) == [-1, 2, 3, 9]
    twice = d.union(d).where("doc_id is not null")
    assert sorted(r.doc_id for r in simhash.keep_first(twice).collect()) == [2, 3, 9]
    assert simhash.digest(empty(spark)).count() == 0
    assert simhash.keep_first(empty(spark)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    d = docs(spark, [prose(1)] * 2).withColumn("id", F.lit("x")).withColumn("fp", F.lit("y")).withColumn("component_id", F.lit(1))
    assert simhash.digest(d).count() == 2
    assert [c for c, _ in simhash.near_duplicates(d).dtypes] == ["id", "fp", "component_id"]
    e = d.withColumn("__rank", F.lit(1)).withColumn("__stays", F.lit(1))
    assert simhash.keep_first(e).columns == e.columns and simhash.keep_first(e).count() == 1
