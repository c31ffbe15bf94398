import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.llm import line_runs

from .helpers import ODD, docs, empty, prose


def brute(texts, min_docs=10):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    keys = [[low(x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n")] for t in texts]
    n = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for t, ks in zip(texts, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if not (k and n[k] >= min_docs)]
        out.append((len(ks), len(ks) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def sample():
    r = random.Random(1)
    common = ["Shared Line", "  shared LINE \t", "É keeps its case", "é keeps its case", "all rights reserved", ""]
    texts = ["\n".join(r.choice(common) if r.random() < 0.5 else prose(r.random(), 6) for _ in range(r.randint(0, 8))) for _ in range(60)]
    return texts + ODD


def test_query_against_brute_force(spark):
    texts = sample()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_runs.digest(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_broadcast_and_merge_join_agree(spark, monkeypatch, bound):
    monkeypatch.setattr(line_runs, "BROADCAST_ROWS", bound)
    texts = sample()
    got = {r.doc_id: r.n_dropped for r in line_runs.digest(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [b[1] for b in brute(texts)]


def test_levels_compact_and_counts_hold(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    for i in range(5):
        runs.add(docs(spark, [f"a\nb{i}", "a"]))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    one = line_runs.LineRuns(spark, fanout=3)
    one.load(docs(spark, [t for i in range(5) for t in (f"a\nb{i}", "a")]), batches=4)
    assert sorted(map(tuple, runs.counts().collect())) == sorted(map(tuple, one.counts().collect()))
    assert sorted(r.n for r in runs.counts().collect()) == [1] * 5 + [10]


def test_new_batch_is_merge_anti_joined(spark):
    runs = line_runs.LineRuns(spark)
    runs.add(docs(spark, ["old line\nboth"]))
    got = runs.fresh(docs(spark, ["BOTH \nnew\n", None]))
    assert sorted((r.id, r.pos, r.line) for r in got.collect()) == [(0, 1, "new"), (0, 2, ""), (1, 0, "")]


def test_odd_tables(spark):
    assert line_runs.digest(empty(spark)).count() == 0
    d = docs(spark, ["x\ny"] * 12, [None] * 12)
    assert {(r.n_lines, r.n_dropped) for r in line_runs.digest(d).collect()} == {(2, 2)} and line_runs.digest(d).count() == 12
    clash = d.withColumn("h1", F.lit(1)).withColumn("n", F.lit(2)).withColumn("h", F.lit(3)).withColumn("batch", F.lit(4))
    got = line_runs.dedup(clash)
    assert got.columns[: len(clash.columns)] == clash.columns and got.count() == 12
    with pytest.raises(ValueError):
        line_runs.dedup(d.withColumn("kept", F.lit(1))).count()


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 2), (6, 3)])
def test_settled_hashes_leave_the_batches(spark, batches, fanout):
    texts = sample()
    d = docs(spark, texts)
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_runs.dedup(d, batches=batches, fanout=fanout).collect()}
    assert [got[i] for i in range(len(texts))] == [b[:2] for b in brute(texts)]


def test_batches_are_merge_anti_joined_bucket_by_bucket(spark):
    runs = line_runs.LineRuns(spark, fanout=2, min_docs=3)
    for i in range(2):
        runs.add(docs(spark, ["often\nsometimes", "often", f"b{i}"]))
    assert [len(x) for x in runs.settled] == [1]
    runs.add(docs(spark, ["often\nnew", "sometimes"]))
    last = runs._runs([[runs.levels[0][-1]]])
    assert last.count() == 2  # 'often' is settled and not counted again
    plan = runs._unsettled(last)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    plan = runs._sums(runs._runs(runs.levels))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert runs.common(3).distinct().count() == 2
    with pytest.raises(ValueError):
        runs.common(4)


def test_linear_in_the_lines_of_a_text(spark):
    texts = ["\n".join(f"line {i} {'a' if i % 2 else t}" for i in range(60_000)) for t in range(10)]
    got = line_runs.digest(docs(spark, texts)).collect()
    assert [(r.n_lines, r.n_dropped) for r in got] == [(60_000, 30_000)] * 10


def test_own_columns_do_not_clash(spark):
    d = docs(spark, ["x\ny", "x", "z"] * 10)
    for name in ("__line_id", "__LINE_text", "__line_hits", "__line_all", "__line_kept", "pos", "h", "run", "a.b"):
        d = d.withColumn(name, F.lit(name))
    got = line_runs.dedup(d)
    assert got.columns[: len(d.columns)] == d.columns
    assert {(r.kept, r["__line_id"], r["a.b"]) for r in got.collect()} == {("", "__line_id", "a.b")}
