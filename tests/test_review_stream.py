import random

import pytest
from pyspark.sql import functions as F

from quirework.streaming import review

RESULT = "uuid string, pos long, wanted boolean, action string, proposed string, path string, verified boolean"
PRIOR = "uuid string, pos long, action string, proposed string, notes string, path string, verified boolean"


def rows(r, lo, n):
    return [(f"u{r.randrange(40)}" if r.random() < 0.95 else None, lo + i, r.random() < 0.8, r.choice([None, "accept", "delete"]), f"p{lo + i}", f"/n/{lo + i}", r.random() < 0.3) for i in range(n)]


def expected(batches, prior):
    """Batch by batch, with a dict for the state."""
    known = {}
    for p in sorted((p for p in prior if p[0] is not None), key=lambda p: p[1]):
        known[p[0]] = p
    out, done = [], set()
    for b in batches:
        for u, _, wanted, action, proposed, path, verified in sorted(b, key=lambda x: x[1]):
            if not wanted or (u is not None and u in done):
                continue
            p = known.get(u) if u is not None else None
            out.append((u, p[2], p[3], p[4], path, p[6], "kept") if p and p[2] is not None else (u, action, proposed, p and p[4], path, verified, "built"))
            done.add(u)
    return out + [(u, p[2], p[3], p[4], p[5], p[6], "carried") for u, p in known.items() if u not in done]


@pytest.mark.parametrize("stops", [False, True])
def test_a_stream_that_stops_goes_on(spark, tmp_path, stops):
    r = random.Random(1)
    batches = [rows(r, 100 * k, 25) for k in range(4)]
    prior = [(f"u{i % 45}", i, r.choice([None, "keep"]), f"old{i}", f"note{i}", f"/o/{i}", False) for i in range(60)] + [(None, 99, "keep", "x", "y", "z", True)]
    p = spark.createDataFrame(prior, PRIOR)
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = lambda: spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).parquet(folder)
    for k, b in enumerate(batches):
        spark.createDataFrame(b, RESULT).coalesce(1).write.mode("append").parquet(folder)
        if stops or k == len(batches) - 1:
            if not stops:
                # all files are there at once; they are read in the order of their times
                pass
            entries = review.reviewed(stream(), p, out, state)
    got = sorted(map(tuple, review.closed(entries, p).collect()), key=repr)
    assert got == sorted(expected(batches, prior), key=repr)
    s = review.summary(review.closed(entries, p)).first()
    assert (s.written, s.kept, s.carried) == (len(got), sum(x[-1] == "kept" for x in got), sum(x[-1] == "carried" for x in got))
    # nothing new: nothing changes
    again = review.reviewed(stream(), p, out, state)
    assert again.count() == sum(x[-1] != "carried" for x in got)


def test_a_batch_that_fails_is_repeated_once(spark, tmp_path):
    r = random.Random(2)
    b = rows(r, 0, 30)
    p = spark.createDataFrame([("u1", 1, "keep", "old", "n", "/o", False)], PRIOR)
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(b, RESULT).coalesce(1).write.parquet(folder)
    broken = spark.readStream.schema(RESULT).parquet(folder).withColumn("proposed", F.when(F.col("pos") == 17, F.raise_error(F.lit("stopped"))).otherwise(F.col("proposed")))
    with pytest.raises(Exception, match="stopped|STREAM_FAILED"):
        review.reviewed(broken, p, out, state)
    entries = review.reviewed(spark.readStream.schema(RESULT).parquet(folder), p, out, state)
    assert sorted(map(tuple, review.closed(entries, p).collect()), key=repr) == sorted(expected([b], [("u1", 1, "keep", "old", "n", "/o", False)]), key=repr)


def test_first_decisions_over_batches(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    for k in range(3):
        spark.createDataFrame([(10 * k + i, i % 4 + k, "view" if i % 3 == 0 else f"t{k}{i}", None) for i in range(8)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    got = {x.user_id: x.decision for x in review.first_decisions(spark, str(tmp_path / "events")).collect()}
    rows = sorted((r.event_id, r.user_id, r.event_type) for r in spark.read.parquet(str(tmp_path / "events")).collect())
    want = {}
    for _, u, t in rows:
        if t != "view":
            want.setdefault(u, t)
    assert got == want


def entries(spark, lo, n):
    kind = "id long, uuid string, path string, action string, proposed map<string,string>, notes string, verified boolean"
    return spark.createDataFrame([(i, f"u{i}", f"/b/{i}", [None, "accept"][i % 2], {"title": f"T: {i} # ž", "year": None, "authors": '["A", "B"]'}, "two\nlines" if i % 3 else None, True) for i in range(lo, lo + n)], kind)


def test_sink_writes_what_is_read_back(spark, tmp_path):
    import os

    from quirework.sources import review_file, review_sink

    review_sink.register(spark)
    path = str(tmp_path / "review")
    entries(spark, 0, 50).repartition(4).write.format("review").mode("append").save(path)
    with open(f"{path}/header.yaml") as f:
        assert "# 50 books need review." in f.read()
    got = {r.uuid: r for r in review_file.read_reviews(spark, path).collect()}
    assert len(got) == 50 and got["u1"].action == "accept" and got["u0"].action is None and got["u4"].notes == "two\nlines"
    assert got["u7"].proposed == {"title": "T: 7 # ž", "year": None, "authors": '["A", "B"]'} and "year" in got["u7"].proposed_keys
    # a task that fails leaves the old review and nothing else
    bad = entries(spark, 100, 40).repartition(4).withColumn("path", F.when(F.col("id") == 117, F.raise_error(F.lit("disk full"))).otherwise(F.col("path")))
    with pytest.raises(Exception, match="disk full"):
        bad.write.format("review").mode("append").save(path)
    assert {r.uuid for r in review_file.read_reviews(spark, path).collect()} == set(got) and os.listdir(tmp_path) == ["review"]
    # the next one replaces it, and the old one stays behind until the run is finished
    entries(spark, 200, 3).coalesce(1).write.format("review").mode("append").save(path)
    assert {r.uuid for r in review_file.read_reviews(spark, path).collect()} == {"u200", "u201", "u202"}
    assert {r.uuid for r in review_file.read_reviews(spark, f"{path}.bak").collect()} == set(got)
    review_sink.finished(path)
    assert os.listdir(tmp_path) == ["review"]
    entries(spark, 0, 0).write.format("review").mode("append").save(path)
    assert review_file.read_reviews(spark, path).count() == 0


def test_files_that_nobody_counted_go(tmp_path):
    from quirework.sources.review_sink import ReviewWriter, Written

    w = ReviewWriter(str(tmp_path / "r"))
    from pyspark.sql import Row

    first, again = w.write(iter([Row(uuid="a", action=None)])), w.write(iter([Row(uuid="a", action=None)]))
    w.commit([again, None, Written("gone.yaml", 0)])
    import os

    assert sorted(os.listdir(tmp_path / "r")) == ["header.yaml", again.file] and first.file != again.file
