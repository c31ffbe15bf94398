import random

import numpy as np

from quirework.llm import toxicity

from .helpers import ODD, docs, empty, prose

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grubwort", "spitelda", "vilenor"]


def corpus():
    r = random.Random(4)
    texts, labels = [], []
    for i in range(300):
        words = prose(i, 60, 800).split()
        toxic = i % 5 == 0
        for _ in range(r.randint(1, 8) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "en", "ier"]) + r.choice(["", ",", "!"]))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return texts, labels


def test_held_out_accuracy_and_order(spark):
    texts, labels = corpus()
    d, half = docs(spark, texts), spark.createDataFrame(labels[:200], LABELS)
    got = {r.doc_id: r for r in toxicity.digest(d, half).collect()}
    held = range(200, 300)
    assert all(got[i].toxic == (i % 5 == 0) for i in held)
    many = docs(spark, [prose(9, 60, 800) + " grubwort" * n for n in (0, 1, 12)])
    s = [r["toxicity"].severity for r in toxicity.score(many, toxicity.fit(d, half)).orderBy("doc_id").collect()]
    assert s[0] < s[1] < s[2] <= toxicity.GRADES


def test_thresholds_are_ordered_and_severity_is_their_sum(spark):
    texts, labels = corpus()
    m = toxicity.fit(docs(spark, texts), spark.createDataFrame(labels, LABELS))
    assert (np.diff(m.theta) > 0).all() and (m.weight >= 0).all()
    for r in toxicity.score(docs(spark, texts[:20]), m).collect():
        above = r["toxicity"].above
        assert above == sorted(above, reverse=True) and abs(sum(above) - r["toxicity"].severity) < 1e-9
        p = [1 - above[0], *(a - b for a, b in zip(above, [*above[1:], 0.0], strict=True))]
        assert int(np.argmax(p)) == r["toxicity"].grade


def test_sample_bound_does_not_break(spark):
    texts, labels = corpus()
    m = toxicity.fit(docs(spark, texts), spark.createDataFrame(labels, LABELS), rows=40)
    assert len(m.at)


def test_odd_input(spark):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.digest(docs(spark, ODD), none).collect()
    assert len(got) == len(ODD) and all(r.severity == 0 and r.grade == 0 and not r.toxic for r in got)
    assert toxicity.digest(empty(spark), none).count() == 0
    texts, labels = corpus()
    odd = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None), (9999, 0, 1), (5, 1, 1)], LABELS)
    m = toxicity.fit(docs(spark, texts), odd)
    rows = toxicity.score(docs(spark, [None, "", " ", *ODD[5:]]), m).orderBy("doc_id").collect()
    assert [r["toxicity"].severity for r in rows[:3]] == [0, 0, 0]


def test_severity_against_brute_force_and_planted_amounts(spark):
    """Scores word by word from the model's weights; the mean severity rises with the number of planted words, and so does the grade."""
    import math
    from collections import Counter

    texts, labels = corpus()
    m = toxicity.fit(docs(spark, texts), spark.createDataFrame(labels, LABELS))
    weight = dict(zip(m.at.tolist(), m.weight.tolist(), strict=True))
    amounts = [0, 1, 3, 8, 16]
    planted = [" ".join([prose(5000 + i, 60, 800), *[BAD[(i + k) % 3] for k in range(n)]]) for i in range(20) for n in amounts]
    got = {r.doc_id: r["toxicity"] for r in toxicity.score(docs(spark, planted), m).collect()}
    for i, t in enumerate(planted):
        words = t.lower().split()
        c = Counter(f for w in words for f in toxicity._positions(w) if f in weight)
        z = sum(weight[f] * math.log1p(n) for f, n in c.items()) + m.length * (math.log1p(len(words)) - 6)
        want = sum(1 / (1 + math.exp(-max(-40, min(40, z - x)))) for x in m.theta)
        assert abs(got[i].severity - want) < 1e-9
    mean = [sum(got[i].severity for i in range(k, len(planted), 5)) / 20 for k in range(5)]
    grade = [sum(got[i].grade for i in range(k, len(planted), 5)) / 20 for k in range(5)]
    assert mean == sorted(mean) and mean[-1] - mean[0] > 1 and grade == sorted(grade)
