import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import moves


def simulated(plan, existing):
    """Carry the plan out step by step; within a step in any order."""
    there = {p: p for p in existing}
    for step in sorted({r.step for r in plan if r.step is not None}):
        now = [r for r in plan if r.step == step]
        assert len({r.dest for r in now}) == len(now)
        for r in now:
            assert r.source in there, (step, r)
            assert r.dest not in there, (step, r)
        for r in now:
            there[r.dest] = there.pop(r.source)
    return there


def check(spark, wanted, existing):
    w = spark.createDataFrame(wanted, "pos long, source string, dest string").repartition(3)
    e = spark.createDataFrame([(p,) for p in existing], "path string")
    plan = moves.plan(w, e).collect()
    there = simulated(plan, existing)
    assert sorted(there.values()) == sorted(existing) and not any(p.endswith(".moving") for p in there)
    return {v: k for k, v in there.items()}, plan


def test_chains_and_rings(spark):
    places = [f"p{i}" for i in range(40)]
    wanted = [(i, f"p{i}", f"p{i + 1}") for i in range(20)]  # a chain of twenty, its end free
    wanted += [(100 + i, f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(200, "s0", "s1"), (201, "s1", "s0"), (300, "same", "same"), (301, "gone", "x")]
    existing = places[:20] + [f"r{i}" for i in range(7)] + ["s0", "s1", "same", "stays"]
    where, plan = check(spark, wanted, existing)
    assert all(where[f"p{i}"] == f"p{i + 1}" for i in range(20)) and all(where[f"r{i}"] == f"r{(i + 1) % 7}" for i in range(7)) and where["s0"] == "s1"
    actions = {r.pos: r.action for r in plan if r.action != "set_aside"}
    assert actions[300] == "already_correct" and actions[301] == "error" and sum(r.action == "set_aside" for r in plan) == 2


def test_smallest_free_numbers(spark):
    existing = ["a", "a (dup 1)", "a (dup 3)", "a (dup 4)", "a (dup 07)", "a (dup 9)", *[f"n{i}" for i in range(6)], "b", "m0", "m1", "a (dup 6)"]
    wanted = [(i, f"n{i}", "a") for i in range(6)] + [(10, "m0", "b"), (11, "m1", "b"), (12, "b", "c"), (13, "a (dup 9)", "d"), (14, "a (dup 6)", "a (dup 8)")]
    where, _ = check(spark, wanted, existing)
    # 6 and 9 are left, 8 is wanted by name: all count as taken
    assert [where[f"n{i}"] for i in range(6)] == [f"a (dup {n})" for n in (2, 5, 7, 10, 11, 12)]
    assert (where["m0"], where["m1"], where["b"], where["a (dup 9)"], where["a (dup 6)"]) == ("b", "b (dup 1)", "c", "d", "a (dup 8)")


def test_random_libraries(spark):
    r = random.Random(4)
    for _ in range(4):
        names = [f"x{i}" for i in range(60)] + [f"x{i} (dup {n})" for i in range(5) for n in range(1, 4)]
        existing = r.sample(names, 45)
        sources = r.sample(existing, 35) + ["missing"]
        wanted = [(k, s, r.choice(names[:12] if r.random() < 0.4 else names)) for k, s in enumerate(sources)]
        where, plan = check(spark, wanted, existing)
        free = set(names) - (set(existing) - {s for _, s, d in wanted if s != d})
        for d in {d for _, _, d in wanted}:
            claims = sorted(k for k, s, x in wanted if x == d and s != d and s in existing)
            if claims and d in free:
                assert where[dict((k, s) for k, s, _ in wanted)[claims[0]]] == d


def test_numbering_within_a_hot_key(spark):
    rows = [(k % 3 if k % 10 else None, k) for k in range(2000)] + [(7, 5000 + k) for k in range(3000)]
    d = spark.createDataFrame(rows, "key long, o long").repartition(5)
    got = moves.numbered(d, "key", "o").collect()
    want = {}
    for k in {k for k, _ in rows}:
        for n, o in enumerate(sorted(o for x, o in rows if x == k), 1):
            want[k, o] = n
    assert {(x.key, x.o): x.n for x in got} == want


def test_folder_named_twice_and_no_moves(spark):
    where, plan = check(spark, [(1, "a", "b"), (2, "a", "c")], ["a"])
    assert where == {"a": "b"} and len(plan) == 1
    assert check(spark, [], ["a"])[0] == {"a": "a"}


@pytest.mark.parametrize("stop", [None, 0, 1, 2])
def test_execution_that_is_killed_and_repeated(spark, tmp_path, monkeypatch, stop):
    from quirework.sources import moving
    from quirework.tables import written

    lib, journal = tmp_path / "lib", str(tmp_path / "journal")
    names = ["A/one", "A/two", "B/three", "B/four", "C/five", "D/lock", "E/kept"]
    for n in names:
        (lib / n).mkdir(parents=True)
        (lib / n / "name.txt").write_text(n)
    path = lambda n: str(lib / n)
    wanted = [(1, "A/one", "A/two"), (2, "A/two", "B/three"), (3, "B/three", "A/one"), (4, "B/four", "C/five"), (5, "C/five", "X/new/deep")]
    w = spark.createDataFrame([(k, path(s), path(d)) for k, s, d in wanted], "pos long, source string, dest string")
    e = spark.createDataFrame([(path(n),) for n in names], "path string")
    steps = moves.plan(w, e).unionByName(spark.createDataFrame([(None, 9, path("D/lock"), None, "delete")], "step long, pos long, source string, dest string, action string"))
    steps = written(steps, "plan")
    if stop is not None:
        real, calls = moving._step, []

        def dies(*a):
            if len(calls) == stop:
                raise RuntimeError("killed")
            calls.append(a)
            return real(*a)

        monkeypatch.setattr(moving, "_step", dies)
        with pytest.raises(RuntimeError, match="killed"):
            moving.carried_out(steps, str(lib), journal, str(tmp_path / "trash"))
        monkeypatch.setattr(moving, "_step", real)
        if stop == 1:  # as if the step had been cut off half-way: one of its folders has moved already
            one = steps.where("step = 0").orderBy("pos").first()
            import os

            os.makedirs(os.path.dirname(one.dest), exist_ok=True)
            os.rename(one.source, one.dest)
    out = {(r.pos, r.action): r for r in moving.carried_out(steps, str(lib), journal, str(tmp_path / "trash")).collect()}
    text = lambda n: (lib / n / "name.txt").read_text()
    assert {d: text(d) for _, _, d in wanted} == {d: s for _, s, d in wanted}
    assert not (lib / "D").exists() and text("E/kept") == "E/kept" and not any(p.name.endswith(".moving") for p in lib.rglob("*"))
    assert all(r.outcome in ("done", "deleted") for r in out.values()), out
    assert out[9, "delete"].snapshot.endswith(".tar.gz")
    import tarfile

    with tarfile.open(out[9, "delete"].snapshot) as t:
        assert "lock/name.txt" in t.getnames()
    # once more: nothing happens
    again = moving.carried_out(steps, str(lib), journal, str(tmp_path / "trash"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.values()))
    assert F is not None
