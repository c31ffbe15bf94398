import re
from collections import Counter

from pyspark.sql import functions as F

from quirework.llm import quality

from .helpers import ODD, docs, empty, prose

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    covered = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_against_brute_force(spark):
    a = prose(1, 40)
    texts = ODD + [a, a + " " + prose(2, 100) + " " + a, "a b c d e " * 7, "l1\nl1\n l1\n\n\nl2", "# $ %% a|b <c>", prose(3, 9), prose(3, 10)]
    labels = spark.createDataFrame([(9, 1, 0)], LABELS)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.digest(docs(spark, texts), labels).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_ratio_rejects_what_is_unlike_the_target(spark):
    good = [prose(i, 120, 300) for i in range(60)]
    junk = [" ".join(f"{x}###" for x in prose(1000 + i, 120, 300).split()) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(60, 0, 0), (None, 1, 0), (999, 1, 0)], LABELS)
    got = {r.doc_id: r for r in quality.digest(docs(spark, good + junk), labels).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 80))
    kept = quality.keep_good(docs(spark, good + junk), labels)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def test_ratio_against_brute_force(spark):
    texts = [prose(i, 30, 50) for i in range(12)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], LABELS)
    d, buckets = docs(spark, texts), 64
    counts = quality.gram_counts(d, labels, buckets)
    weight = quality.weights(counts, buckets)
    h = {r.w: r.h for r in d.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {(x, y) for t in texts for x, y in zip(t.split(), t.split()[1:], strict=False)}
    rows = spark.createDataFrame([(h[x], h[y]) for x, y in pairs], "x long, y long").select("x", "y", F.xxhash64("x", "y").alias("h")).collect()
    two = {(r.x, r.y): r.h for r in rows}

    def grams(t):
        w = [h[x] for x in t.split()]
        return [x % buckets for x in w] + [two[p] % buckets for p in zip(w, w[1:], strict=False)]

    raw, target = Counter(g for t in texts for g in grams(t)), Counter(g for t in texts[:5] for g in grams(t))
    assert {r.b: (r.raw, r.target) for r in counts.collect()} == {b: (raw[b], target[b]) for b in raw}
    got = {r.doc_id: r.quality.llr for r in quality.judge(d, weight).collect()}
    for i, t in enumerate(texts):
        g = grams(t)
        assert abs(got[i] - sum(weight[x] for x in g) / len(g)) < 1e-5


def test_odd_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert quality.digest(empty(spark), labels).count() == 0
    got = quality.digest(docs(spark, [prose(1), None]), labels).collect()
    assert {r.doc_id: r.kept for r in got} == {0: True, 1: False}
    d = docs(spark, [prose(1)] * 2, [7, 7]).withColumn("b", F.lit(1)).withColumn("t", F.lit(2))
    assert quality.rules(d, spark.createDataFrame([(7, 1, 0), (7, 1, 0)], LABELS)).count() == 2
    clash = d.withColumn("quality", F.lit(1)).withColumn("kept", F.lit(False)).withColumn("doc", F.lit(2))
    kept = quality.keep_good(clash, spark.createDataFrame([(7, 1, 0)], LABELS))
    assert kept.columns == clash.columns and kept.count() == 2


def test_windows_of_long_texts_by_all_bits(spark):
    a = prose(5, 3000, 30)
    texts = [a, a + " " + prose(6, 60_000, 10**6) + " " + prose(7, 40), prose(8, 50_000, 20)]
    labels = spark.createDataFrame([], LABELS)
    got = {r.doc_id: r.n_repeat_words for r in quality.digest(docs(spark, texts), labels).collect()}
    assert [got[i] for i in range(3)] == [brute(t)[4] for t in texts]


def test_own_columns_do_not_clash(spark):
    d = docs(spark, [prose(1)])
    for name in ("__q_h", "__q_words", "__Q_hash", "__q_llr", "__q_pin", "__q_found"):
        d = d.withColumn(name, F.lit(name))
    labels = spark.createDataFrame([(0, 1, 0)], LABELS)
    assert quality.rules(d, labels).first()["__q_h"] == "__q_h"
    assert quality.keep_good(d, labels).collect() == d.collect()
