import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import near_copies

from .helpers import ODD, docs, empty, prose


def brute_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for w in words]


def brute_kept(texts):
    sets, parent = brute_sets(texts), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i for i in range(len(texts)) if root(i) == i}


def edited(text, n, r):
    w = text.split()
    for p in r.sample(range(len(w)), n):
        w[p] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_stage_against_brute_force(spark):
    r = random.Random(3)
    base = [prose(i, 150) for i in range(40)]
    texts = base + [edited(b, n, r) for b in base for n in (1, 2, 3, 4, 6)] + ODD + [ODD[3], "a  B", *base[:3]]
    got = {x.doc_id for x in corpus_pipeline.simhash_near_dedup(spark, docs(spark, texts), "").collect()}
    assert got == brute_kept(texts)


def test_large_group_gives_few_candidates(spark):
    r = random.Random(4)
    group = [edited(prose(1, 200), 2, r) for _ in range(300)]
    d = docs(spark, group)
    assert {x.doc_id for x in near_copies.keep_first(d).collect()} == {0}
    rows = d.select(F.col("doc_id").alias("id"), "text").mapInArrow(near_copies._entries(5), "id long, name long, n long, keys array<long>")
    assert near_copies.candidates(rows).count() < 300 * 299 // 4


def test_ids_and_empty_table(spark):
    t = prose(1)
    d = docs(spark, [t, t, prose(2), None, "", t], [5, 3, 9, 8, 2, None])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in near_copies.keep_first(d).collect()) == [-1, 2, 3, 9]
    twice = d.union(d).where("doc_id is not null")
    assert sorted(r.doc_id for r in near_copies.keep_first(twice).collect()) == [2, 3, 9]
    assert near_copies.keep_first(empty(spark)).count() == 0
    odd = d.withColumn("__rank", F.lit(1)).withColumn("name", F.lit(1)).withColumn("id", F.lit("x"))
    assert near_copies.keep_first(odd).columns == odd.columns


def test_large_postings_lose_no_link(spark, monkeypatch):
    """Three hundred texts share half of their words, so postings are large; in each, a few near copies are found among the unlike ones."""
    monkeypatch.setattr(near_copies, "BEFORE", 1)
    r = random.Random(9)
    shared = prose(1, 150)
    texts = [shared + " " + prose(100 + i, 60) for i in range(120)]
    texts += [edited(texts[i], 1, r) for i in range(0, 120, 3)]
    d = docs(spark, texts)
    assert {x.doc_id for x in near_copies.keep_first(d).collect()} == brute_kept(texts)


def entries_of(d):
    return d.select(F.col("doc_id").alias("id"), "text").mapInArrow(near_copies._entries(5), "id long, name long, n long, keys array<long>")


def brute_print(shingles):
    """Bits by majority over the shingles; each hash is drawn out by SplitMix64, in plain whole numbers."""
    ones, low = [0] * (64 * near_copies.WORDS), (1 << 64) - 1
    for s in shingles:
        h = xxhash.xxh64_intdigest(b" ".join(s), 42)
        for k, add in enumerate(near_copies._ADD.tolist()):
            z = (h + add) & low
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & low
            z = (z ^ z >> 27) * 0x94D049BB133111EB & low
            z ^= z >> 31
            for b in range(64):
                ones[64 * k + b] += z >> b & 1
    bits = [2 * n > len(shingles) for n in ones]
    return [sum(1 << b for b in range(64) if bits[64 * k + b]) for k in range(near_copies.WORDS)]


def test_stage_finds_its_pairs_by_simhash_tokens(spark):
    """Fingerprints by brute force; a pair is a candidate only if it shares two (position, byte) tokens of a group, and pairs of near copies are."""
    r = random.Random(6)
    base = [prose(i, 120) for i in range(25)]
    texts = base + [edited(b, 2, r) for b in base] + [prose(90, 700), "one two", None]
    rows = entries_of(docs(spark, texts)).cache()
    sets, got = brute_sets(texts), {x.id: x for x in rows.collect()}
    prints = {i: [w & (1 << 64) - 1 for w in x.keys] for i, x in got.items()}
    assert prints == {i: brute_print(s) for i, s in enumerate(sets)}
    tokens = {got[i].name: b"".join(w.to_bytes(8, "little") for w in p[1:-1]) for i, p in prints.items()}
    pairs = {(x.a, x.b) for x in near_copies.candidates(rows).collect()}
    for a, b in pairs:
        same = [x == y for x, y in zip(tokens[a], tokens[b], strict=True)]
        groups = [sum(same[i :: near_copies.GROUPS]) for i in range(near_copies.GROUPS)]
        assert sum(same) >= near_copies.LEAST_EQUAL and max(groups) >= 2
    assert {tuple(sorted((got[i].name, got[25 + i].name))) for i in range(25)} <= pairs


def test_groups_guarantee_a_posting():
    """More than GROUPS equal positions have two in one group, hence a posting; no two groupings have a posting in common."""
    first = {frozenset(p) for p in near_copies.TABLES[0].T.tolist()}
    for i in range(near_copies.GROUPS):
        group = [i, i + near_copies.GROUPS, i + 2 * near_copies.GROUPS]
        assert all(frozenset(p) in first for p in itertools.combinations(group, 2))
    every = [frozenset(p) for t in near_copies.TABLES for p in t.T.tolist()]
    assert len(set(every)) == len(every) == 3 * 3 * near_copies.GROUPS


def test_recall_at_the_least_similarity():
    """Random sets of Jaccard 0.8, or just above for the smallest: of two thousand pairs each, at most two are missed; unrelated ones don't pass."""
    r, trials = np.random.default_rng(8), 2000
    low = near_copies._SIZE_BITS + near_copies._CHECK_BITS

    def found(a, b, common):
        prints, sizes, shared = [], [], [set() for _ in range(trials)]
        h = r.integers(0, 1 << 63, (trials, a + b + common), dtype=np.uint64) * np.uint64(2)
        for lo, hi in ((0, a + common), (a, a + b + common)):
            prints.append(np.array([near_copies.fingerprint(x[lo:hi]) for x in h]))
            sizes.append(np.full(trials, hi - lo))
        posted = [{(i, k) for at, keys in near_copies.postings(p, n) for i, k in zip(at.tolist(), (keys >> low).tolist(), strict=True)} for p, n in zip(prints, sizes, strict=True)]
        for i, _ in posted[0] & posted[1]:
            shared[i].add(1)
        x = prints[0] ^ prints[1]
        differ = np.bitwise_count(x[:, 0]).astype(int) + np.bitwise_count(x[:, -1] & np.uint64((1 << near_copies._CHECK_BITS) - 1))
        most = near_copies.RADIUS_SHORT if max(a, b) + common <= near_copies.SHORT else near_copies.RADIUS
        equal = (x[:, 1:-1].copy().view(np.uint8) == 0).sum(axis=1)
        return sum(bool(s) and d <= most and e >= near_copies.LEAST_EQUAL for s, d, e in zip(shared, differ, equal, strict=True))

    for a, b, common in ((0, 1, 4), (1, 2, 12), (2, 3, 20), (5, 6, 44), (0, 20, 80), (20, 20, 160)):
        assert found(a, b, common) >= trials - 2, (a, b, common)
    assert found(100, 100, 0) == 0


def test_candidates_grow_with_a_group_and_not_with_its_square(spark):
    r = random.Random(4)
    group = [edited(prose(1, 200), 2, r) for _ in range(1600)]
    few, many = (near_copies.candidates(entries_of(docs(spark, group[:n]))).count() for n in (400, 1600))
    assert many < 6 * few


def test_postings_beyond_the_limit_lose_no_link(spark, monkeypatch):
    """Long postings end batches and comparisons; what is left over is found by the exact search."""
    monkeypatch.setattr(near_copies, "LIMIT", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        r = random.Random(11)
        shared = prose(1, 150)
        texts = [shared + " " + prose(100 + i, 40) for i in range(90)]
        texts += [edited(texts[i], 1, r) for i in range(0, 90, 3)]
        assert {x.doc_id for x in near_copies.keep_first(docs(spark, texts)).collect()} == brute_kept(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
