from pyspark.sql import functions as F

from quirework.operators import clusters, content, covers, lookup, placement, provider, review, rules

BOOK = "id long, path string, author_folder string, title_folder string, authors array<string>, title string, isbn string, year int, language string, series_name string, series_index string, formats array<string>, files array<string>, bad_fields array<string>, primary_file string, verified boolean, publisher string"
BASE = {"id": 1, "path": "/lib/Some Author/Some Book (1)", "author_folder": "Some Author", "title_folder": "Some Book (1)", "authors": ["Some Author"], "title": "Some Book", "isbn": "9788071741305", "year": 2000, "language": None, "series_name": None, "series_index": None, "formats": ["epub"], "files": ["book.epub", "cover.jpg"], "bad_fields": [], "primary_file": "x.epub", "verified": False, "publisher": None}


def books(spark, *changes):
    rows = [{**BASE, "id": i + 1, **c} for i, c in enumerate(changes)]
    names = [c.split()[0] for c in BOOK.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], BOOK)


def test_rules_one_by_one(spark):
    cases = [
        ({}, "OK"), ({"files": ["metadata.json", "cover.jpg", "x.bak"]}, "EMPTY_BOOK"), ({"author_folder": "~$ob"}, "C6"), ({"authors": ["anthony burgess"]}, "C12"), ({"authors": ["* antologie"]}, "C12"),
        ({"title": "Title"}, "C5"), ({"bad_fields": ["title"]}, "C4"), ({"title": "Kniha.doc"}, "C2"), ({"title": "a_b_c_d"}, "C2"), ({"primary_file": "a/Some Book - Me.epub"}, "C2"), ({"authors": ["byKarelandJan"]}, "C7"),
        ({"authors": ["Isaac Asimov"], "title": "Asimov stories"}, "C1"), ({"authors": ["Kniha 12"]}, "C3"), ({"authors": ["Isaac Asimov", "Jan Novák"]}, "C8"), ({"authors": ["A B", "C D", "E F", "G H"]}, "C10"),
        ({"authors": ["Neznámý"], "author_folder": "Neznámý"}, "C9"), ({"authors": [], "author_folder": "Neznamy", "title": "Bible"}, "C9"), ({"isbn": None}, "MISSING_ISBN"), ({"year": None}, "MISSING_YEAR"), ({"files": ["book.epub"]}, "MISSING_COVER"),
    ]
    got = rules.detect(books(spark, *[c for c, _ in cases])).orderBy("id").collect()
    assert [r.primary.category for r in got] == [want for _, want in cases]
    assert got[16].primary.verdict == "OK"


def test_location_is_promoted_and_missing_accepted(spark):
    d = rules.detect(books(spark, {"path": "/lib/Elsewhere/X"}, {"isbn": None, "path": "/lib/Elsewhere/X"}), with_location=True).orderBy("id").collect()
    assert [r.primary.category for r in d] == ["C13", "C13"]
    b = rules.detect(books(spark, {"isbn": None}, {"isbn": None, "title": "x.doc"}))
    got = b.orderBy("id").select(rules.acceptable_missing(F.col("primary"), F.col("diagnoses")).alias("a")).collect()
    assert [r.a for r in got] == [True, False]


def test_placement(spark):
    got = placement.placed(books(spark, {}, {"formats": [], "path": "/lib/needfix/empty/A/B (2)"}, {"title": "x.doc"}, {"title": "x.doc", "verified": True})).orderBy("id").collect()
    assert [(r.area, r.dest) for r in got] == [("ok", "/lib/Some Author/Some Book (1)"), ("needfix", "/lib/needfix/empty/A/B (2)"), ("needfix", "/lib/needfix/Some Author/Some Book (1)"), ("ok", "/lib/Some Author/x.doc (4)")]


def test_merge_and_clusters(spark):
    b = books(spark, {"isbn": None, "authors": ["jan novák"], "publisher": "Argo", "year": None}, {"authors": ["Jan Novák", "Eva"], "publisher": None}, {"title": "Quite Different Thing"}).withColumn("dest", F.lit("d"))
    m = placement.merged(b, "dest").first()
    assert (m.base_id, m.publisher, m.year, m.members, m.authors) == (2, "Argo", 2000, 3, ["Jan Novák", "Eva", "Some Author"])
    c = clusters.greedy(books(spark, {"isbn": None}, {"isbn": None, "year": None}, {"isbn": None, "title": "Quite Different"}, {"isbn": None, "year": 1990}).withColumn("dest", F.lit("d"))).orderBy("cluster").collect()
    assert [(r.base_id, r.members) for r in c] == [(1, 2), (3, 1), (4, 1)]


def test_crosscheck_decisions(spark):
    rows = [(1, "AGREES"), (1, "DISAGREES"), (1, "DISAGREES"), (2, "DISAGREES"), (2, "DISAGREES"), (3, "AGREES"), (3, "UNCERTAIN"), (4, "DISAGREES")]
    got = {r.id: r.decision for r in content.crosscheck(spark.createDataFrame(rows, "id int, verdict string")).collect()}
    assert got == {1: "quarantine", 2: "ambiguous", 3: "clean", 4: "skipped"}


def test_verify_ladder(spark):
    rows = [
        (1, None, None, "T", None, "text", "T", []), (2, "f", "978", "T", "978", "x", "T", []), (3, "f", None, "T", "978", "x", "T", []), (4, "f", "1", "T", "2", "x", "T", []),
        (5, "f", None, "Čas přílivu", None, "je to CAS PRILIVU tady", "T", []), (6, "f", None, "abcdefgh", None, "zzzz", "T", []), (7, "f", None, "", None, "", "E", []), (8, "f", None, "", None, "", None, []),
    ]
    df = spark.createDataFrame(rows, "id int, primary_file string, isbn string, title string, isbn_from_text string, first_page string, embedded_title string, authors array<string>")
    got = [r.result for r in content.verify(df).orderBy("id").collect()]
    assert got == ["NO_CONTENT", "VERIFIED", "VERIFIED", "MISMATCH", "VERIFIED", "MISMATCH", "UNCERTAIN", "NO_CONTENT"]


def test_lookup_and_review(spark):
    q = spark.range(3).select("id")
    s = lambda rows: spark.createDataFrame(rows, "id long, title string")
    got = {r.id: r.best for r in lookup.first_hit(q, [("a", s([(0, "x")])), ("b", s([(0, "y"), (1, "z")]))]).collect()}
    assert (got[0].source, got[0].hit.title, got[1].source, got[2]) == ("a", "x", "b", None)
    entries = spark.createDataFrame([("u1", "a"), (None, "b"), ("u3", "c")], "uuid string, path string")
    assert sorted(r.path for r in review.pruned(entries, spark.createDataFrame([("u1",)], "uuid string")).collect()) == ["b", "c"]


def test_covers(spark):
    df = spark.createDataFrame([(3, 1200, 1600, 0.7), (3, 10, 10, 0.1), (9, 1200, 1600, 0.7)], "b int, w int, h int, d double")
    assert [round(r.s, 1) for r in df.select(covers.score(F.col("b"), F.col("w"), F.col("h"), F.col("d")).alias("s")).collect()] == [1.2, 0.5, 0.2]


def test_provider_loop_and_limits(spark):
    good, bad = '{"title": "Right"}', '{"title": "Wrong"}'
    check = lambda a: None if a["title"] == "Right" else "wrong title"
    run = lambda *answers: provider.loop({"text": "t"}, provider.Mock(list(answers)), check)[1]
    assert [run(good), run(bad, good), run(bad, bad, good), run(bad), run("nothing"), run(RuntimeError("429"), good)] == ["llm:flash", "llm:loop", "llm:high", "llm:low", None, "llm:loop"]
    m = provider.Mock([bad, good])
    provider.loop({"text": "t"}, m, check)
    assert "wrong title" in m.asked[1][1]
    assert provider.limited("Error 429, Retry-After: 7") == (True, 7.0) and provider.limited("retry-after-ms: 1500 rate limit") == (True, 1.5) and provider.limited("boom") == (False, None)
    clock = [0.0]
    b = provider.Bucket(2.0, now=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
    assert [b.take() for _ in range(3)] == [0.0, 2.0, 2.0]
    c = provider.Cooldown()
    assert [c.refused(0) for _ in range(5)] == [5, 10, 20, 40, 60] and c.refused(0, 90) == 60
    c.succeeded()
    assert c.failures == 0
    rows = spark.createDataFrame([(1, "t"), (2, "t")], "id long, text string")
    out = provider.answered(rows, lambda: provider.Mock([good]), lambda r, a: None).collect()
    assert sorted((r.id, r.title, r.label) for r in out) == [(1, "Right", "llm:flash"), (2, "Right", "llm:flash")]


def test_clusters_follow_the_order_of_ids(spark):
    """A later record with a number becomes the base, and what comes after is held against it; equal records before and after may part."""
    from quirework.operators.clusters import greedy

    ddl = "dest string, id long, title string, authors array<string>, isbn string, year int"
    rows = [("d", 1, "T", ["A"], None, None), ("d", 2, "T", ["A"], None, 1999), ("d", 3, "T", ["A"], "9788071741305", 2005), ("d", 4, "T", ["A"], None, 1999), ("e", 9, "", [], None, None), ("e", 8, "", [], None, None)]
    got = sorted((r.dest, r.base_id, r.members) for r in greedy(spark.createDataFrame(rows, ddl)).collect())
    assert got == [("d", 3, 3), ("d", 4, 1), ("e", 8, 1), ("e", 9, 1)]


def test_clusters_against_brute_force(spark):
    import random

    from quirework.functions.fuzzy import token_sort_ratio
    from quirework.operators.clusters import greedy

    r = random.Random(5)
    ddl = "dest string, id long, title string, authors array<string>, isbn string, year int"
    rows = [(f"d{r.randrange(4)}", i, r.choice(["war and peace", "peace and war", "war and piece", "other", ""]), r.sample(["ann lee", "lee ann", "bo"], r.randint(0, 2)), r.choice([None, None, "1", "2"]), r.choice([None, 1999, 2005])) for i in range(160)]

    def same(a, b):
        if a[4] and a[4] == b[4]:
            return True
        near = lambda x, y: token_sort_ratio(x, y) >= 85
        return bool(a[2] and b[2] and near(a[2], b[2]) and any(near(x, y) for x in a[3] for y in b[3]) and not (a[5] and b[5] and a[5] != b[5]))

    want = []
    for dest in sorted({x[0] for x in rows}):
        found = []
        for x in [y for y in rows if y[0] == dest]:
            base = lambda c: min([y for y in c if y[4]] or c, key=lambda y: y[1])
            home = next((c for c in found if same(base(c), x)), None)
            home.append(x) if home else found.append([x])
        want += [(dest, i, min([y for y in c if y[4]] or c, key=lambda y: y[1])[1], len(c)) for i, c in enumerate(found)]
    assert sorted(tuple(x) for x in greedy(spark.createDataFrame(rows, ddl)).collect()) == sorted(want)


def test_proposals_are_sought_in_every_window_and_for_every_author(spark):
    from quirework.operators import content, proposals

    ddl = "title string, authors array<string>, isbn string, isbn_from_text string, first_page string, broader string"
    rows = [("Nothing alike here", ["Nobody", "Karel Čapek"], None, None, "plain prose of page one", "then nothing alike here by karel capek"), ("Nothing alike here", ["Nobody"], None, None, "prose", "xyz"), ("Zz", ["Nobody"], None, None, "", None)]
    d = spark.createDataFrame(rows, ddl)
    assert [r.passed for r in proposals.verified(d).collect()] == [True, False, True]
    assert [r.confirmed for r in content.confirm_identity(d).collect()] == [True, False, False]


def test_snapshot_of_the_scan(spark, tmp_path):
    from quirework.sources import snapshot

    rows = spark.createDataFrame([("/a", 1, 2, "u1", '{"title":"A"}'), ("/b", 1, 2, None, "x"), ("/a", 2, 2, "u1", '{"title":"A2"}')], "path string, mtime long, size long, uuid string, payload string")
    s = snapshot.saved(snapshot.put(snapshot.empty(spark), rows), f"{tmp_path}/v1")
    assert [(r.path, r.mtime) for r in s.collect()] == [("/a", 2)]
    listing = spark.createDataFrame([("/a", 2, 2), ("/c", 1, 1)], "path string, mtime long, size long")
    assert sorted((r.path, r.state) for r in snapshot.looked_up(listing, s).collect()) == [("/a", "hit"), ("/c", "new")]
    moved = snapshot.repointed(s, spark.createDataFrame([("/a", "/n")], "path string, new_path string"))
    assert [r.path for r in moved.collect()] == ["/n"]
    s.withColumn("version", s.version + 1).write.parquet(f"{tmp_path}/v2")
    assert snapshot.loaded(spark, f"{tmp_path}/v2").count() == 0
