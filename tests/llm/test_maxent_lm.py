import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import maxent_lm as lm

from .helpers import ODD, docs, empty


def tokens(t):
    return [*(t or "").encode("utf-8", "surrogatepass").lower().split(), b"\n"]


def corpus(n=80):
    r = random.Random(3)
    out = []
    for i in range(n):
        words = ["alpha", "beta", "gamma", "delta"] if i % 2 else ["uno", "dos", "tres", "quatro"]
        out.append(" ".join(r.choice(words) if r.random() < 0.9 else f"rare{r.randrange(500)}" for _ in range(60)))
    return out


def test_base_counts_against_brute_force(spark):
    texts = [*corpus(), *ODD, "Mixed CASE É é"]
    got = {r.doc_id: r for r in lm.digest(docs(spark, texts)).collect()}
    c = Counter()
    for i, t in enumerate(texts):
        if crc32(str(i).encode()) % 5 != 1:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = tokens(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[i].held_out == (crc32(str(i).encode()) % 5 == 1)
        want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert got[i].base_score == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("heavy", [4, 64])
def test_rare_tokens_by_join_equal_those_looked_up(spark, monkeypatch, heavy):
    d = docs(spark, corpus(40))
    want = {r.doc_id: r for r in lm.digest(d).collect()}
    monkeypatch.setattr(lm, "HEAVY", heavy)
    for r in lm.digest(d).collect():
        assert r.base_score == pytest.approx(want[r.doc_id].base_score) and (r.n_tokens, r.n_known) == (want[r.doc_id].n_tokens, want[r.doc_id].n_known)


def test_probabilities_sum_to_one(spark):
    model, counts = lm.fit(docs(spark, corpus()))
    p = model._softmax(model.wc, np.array([[1, 2, 3], [7, 8, 9]]), model.wc[lm.DIM])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    q = model._softmax(model.ww, np.array([[1, 2, 3]]), model.ww[lm.DIM : lm.DIM + 1])
    assert np.allclose(q.sum(), 1, atol=1e-5)
    by = {}
    for r in counts.collect():
        w = r.token.encode()
        if model.index.get(w, lm.HEAD) >= lm.HEAD:
            k = lm._tail_class_of(w)
            by[k] = by.get(k, 0) + (r.c + 0.5) / model.mass[k]
    assert all(x <= 1 + 1e-9 for x in by.values())


def test_training_helps_on_held_out(spark):
    got = lm.digest(docs(spark, corpus(200))).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_native_and_python_tail_classes_agree(spark):
    words = ["a", "ab", "é", "日本語", "z\x00", "word,", "ÿ"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", lm._tail_class(F.col("w")).alias("k")).collect()
    assert all(r.k == lm._tail_class_of(r.w.encode()) for r in got)


def test_odd_tables(spark):
    assert lm.digest(empty(spark)).count() == 0
    only = [i for i in range(50) if crc32(str(i).encode()) % 5 == 1][:2]
    got = lm.digest(docs(spark, ["a b", None], only)).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    d = docs(spark, ["a b c"] * 3, [None, 4, 4]).withColumn("uid", F.lit(1)).withColumn("rare", F.lit("x"))
    assert lm.digest(d).count() == 3


def test_words_up_to_rank_1024_are_predicted_from_history():
    model = lm.Model([(f"w{i}", 5000 - i) for i in range(1500)], 10**7, 1500, [10] * lm.TAIL_CLASSES, [1] * lm.TAIL_CLASSES)
    at = np.array([700, 700])
    feats = np.array([[1, 2, 3], [4, 5, 6]])
    model.ww[model.within(feats, model.cls[at])[0], 700 % lm._SIZE] += 1
    p = model.predict(at, model.cls[at], feats)
    assert (model.cls[:1024] < lm.HEAD_CLASSES).all() and p[0] > p[1]


def brute_score(model, counts, text):
    """Token by token, feature by feature, with whole numbers for the hashes."""
    mask, out, own = (1 << 64) - 1, 0.0, [0, 0]
    shift = 64 - (model.dim.bit_length() - 1)
    mix = lambda x: (((x * 0xD6E8FEB86659FD93 & mask) ^ (x >> 7)) * 0x9E3779B97F4A7C15 & mask) >> shift
    soft = lambda z, k: z[k] - max(z) - math.log(sum(math.exp(v - max(z)) for v in z))
    for w in tokens(text):
        at = model.index.get(w, -1)
        cls = int(model.cls[at]) if at >= 0 else lm.HEAD_CLASSES + lm._tail_class_of(w)
        w2, w1 = own[-2:]
        rows = [mix(w1), mix(w2 + (1 << 20)), mix((w1 * 0x9E3779B97F4A7C15 + w2 * 0xC2B2AE3D27D4EB4F) & mask)]
        z = [float(model.wc[model.dim][k] + sum(model.wc[r][k] for r in rows)) for k in range(len(model.wc[0]))]
        out += soft(z, cls) / math.log(10)
        if 0 <= at < lm.HEAD:
            inner = [(r * 31 + cls * 1009 + 7) % model.dim for r in rows]
            z = [float(model.ww[model.dim + cls][k] + sum(model.ww[r][k] for r in inner)) for k in range(len(model.ww[0]))]
            out += soft(z, at % lm._SIZE) / math.log(10)
        else:
            out += math.log10((counts.get(w, 0) + 0.5) / model.mass[cls - lm.HEAD_CLASSES])
        own.append(at + len(model.wc[0]) + 1 if at >= 0 else cls + 1)
    return out


def test_score_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 64)
    texts = [*corpus(60), None, "", "one", "alpha beta alpha unknownword beta"]
    d = docs(spark, texts)
    model, counts = lm.fit(d)
    c = {r.token.encode(): r.c for r in counts.collect()}
    got = {r.id: r.score for r in lm.score(d, model, counts).collect()}
    assert np.abs(model.wc[: model.dim]).sum() > 0 and np.abs(model.ww[: model.dim]).sum() > 0
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_score(model, c, t), rel=1e-4, abs=1e-3)


def test_hashed_rows_grow_with_the_training_tokens():
    assert [lm.rows_for(n) for n in (0, 10**6, 1 << 24, (1 << 24) + 1, 4 * 10**9)] == [4096, 4096, 4096, 8192, 65536]
    many = [(f"w{i}", 5000 - i) for i in range(1500)]
    for dim in (1 << 12, 1 << 16):
        model = lm.Model(many, 10**6, 1500, [10] * lm.TAIL_CLASSES, [1] * lm.TAIL_CLASSES, dim)
        r = np.random.RandomState(1)
        at = r.randint(0, 1500, 20_000)
        feats = model.features(at, model.cls[at], np.array([0]))
        assert feats.min() >= 0 and dim > feats.max() > 0.9 * dim
        learner = lm.Learner(model)
        learner.learn(at[:4096], model.cls[at[:4096]], feats[:4096])
        assert np.isfinite(learner.now[1]).all() and (learner.used[1] > 0).sum() > 2000
