import random

from pyspark.sql import functions as F

from quirework.llm import decontam
from quirework.llm.decontam import Items, find_spans, fold

from .helpers import ODD, docs, empty, prose

ITEM = "item_id long, text string"


def edits_within(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def sentence(seed, n=25):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(n))


def changed(text, n, seed):
    r, s = random.Random(seed), list(text)
    for _ in range(n):
        p, kind = r.randrange(len(s)), r.random()
        if kind < 0.4:
            s[p] = r.choice("uvwxyz")
        elif kind < 0.7:
            del s[p]
        else:
            s.insert(p, r.choice("uvwxyz"))
    return "".join(s)


def test_against_edit_distance():
    rows = [(i, sentence(i, 10 + i)) for i in range(20)]
    items = Items(rows)
    for n in range(150):
        r = random.Random(n)
        i = r.randrange(20)
        x = items.ids.index(i)
        text = sentence(900 + n, r.randint(0, 40)) + " " + changed(rows[i][1], r.randint(0, items.k[x] + 6), n) + " " + sentence(700 + n, r.randint(0, 20))
        best = edits_within(items.codes[x].tolist(), fold(text)[0].tolist())
        hit = [s for s in find_spans([text], items)[0] if s[0] == i]
        assert bool(hit) == (best <= items.k[x])
        if hit:
            assert min(h[3] for h in hit) == best


def test_blocks_cut_long_texts_without_loss():
    items = Items([(1, sentence(1)), (2, sentence(2))])
    text = sentence(5, 300) + " " + sentence(1).upper() + "\n" + sentence(6, 500) + " " + sentence(2) + " " + sentence(7, 100)
    whole = find_spans([text, None, text], items)
    assert find_spans([text, None, text], items, block=1900) == whole
    assert [s[0] for s in whole[0]] == [1, 2] and whole[1] == []
    for _, a, b, _ in whole[0]:
        assert text[a:b].lower() in (sentence(1), sentence(2))


def test_short_items_match_whole_words():
    items = Items([(1, "Ab cd")])
    assert [s[1:3] for s in find_spans(["x ab, CD! xab cd ab cde"], items)[0]] == [(2, 8)]


def test_query_stage_and_blocks_of_items(spark):
    bench = spark.createDataFrame([(i, sentence(i)) for i in range(6)] + [(7, None), (8, "")], ITEM)
    d = docs(spark, [prose(1), "x " + sentence(3) + " y", sentence(4).replace("e", "E", 3), *ODD, sentence(0) + " . " + sentence(5)])
    want = {(1, 3), (2, 4), (12, 0), (12, 5)}
    assert {(r.doc_id, r.item_id) for r in decontam.digest(d, bench).collect()} == want
    got = decontam.with_spans(d, bench, chars=200)
    assert {(r.doc_id, s.item_id) for r in got.collect() for s in r.spans} == want
    assert {r.doc_id for r in decontam.decontaminate(d, bench).collect()} == set(range(13)) - {1, 2, 12}


def test_odd_tables(spark):
    none = spark.createDataFrame([], ITEM)
    assert decontam.digest(empty(spark), none).count() == 0
    d = docs(spark, [sentence(1)] * 2, [4, 4]).withColumn("item_id", F.lit(1)).withColumn("s", F.lit(2))
    assert decontam.decontaminate(d, none).count() == 2
    both = spark.createDataFrame([(1, sentence(1)), (1, sentence(1))], ITEM)
    assert decontam.digest(d, both).count() == 2
    assert decontam.decontaminate(d, both).columns == d.columns and decontam.decontaminate(d, both).count() == 0


def test_joined_texts_do_not_lend_each_other_characters():
    item = sentence(3)
    first, rest = item.split(" ", 1)
    items = Items([(1, item)])
    for cut in range(1, items.k[0] + 1):
        texts = ["clean " + sentence(8) + " " + first, item[cut:] + " " + sentence(9), sentence(10)]
        got = find_spans(texts, items)
        assert got == [find_spans([t], items)[0] for t in texts]
        assert not got[0] and got[1] and not got[2]


def test_every_occurrence_beside_a_long_item():
    short = sentence(1, 12)[:80]
    items = Items([(1, short), (2, sentence(2, 400))])
    assert items.longest > 1500
    text = " ".join([short] * 9)
    assert [s[1:3] for s in find_spans([text], items)[0]] == [(x * (len(short) + 1), x * (len(short) + 1) + len(short)) for x in range(9)]


def test_item_longer_than_a_block():
    item = sentence(5, 600)
    items = Items([(1, item)])
    text = sentence(6, 900) + " " + item + " " + sentence(7, 900)
    assert [s[0] for s in find_spans([text], items, block=1000)[0]] == [1]


def test_dropped_characters_between_words_in_pieces():
    item = sentence(3)
    items = Items([(1, item), (2, "zz top")])
    gap = " . - " * 400
    text = sentence(6, 300) + " " + item.replace(" ", gap, 3) + " " + sentence(7, 100) + " zz" + gap + "top zz topx " + "ab " * 900
    whole = find_spans([text], items, block=10**6)
    assert [s[0] for s in whole[0]] == [1, 2]
    for block in (700, 1500, 2300):
        assert find_spans([text], items, block=block) == whole


def test_characters_beyond_the_basic_plane():
    item = "".join(chr(0x10400 + i % 40) for i in range(3)) + " " + sentence(3)
    items = Items([(1, item)])
    text = "😀" + "".join(chr(0x10428 + i % 40) for i in range(3)) + "😀😀" + sentence(3).replace(" ", "😀") + "😀"
    assert find_spans([text], items)[0] == [(1, 1, len(text) - 1, 0)]


def test_all_spans_of_mixed_items_against_brute_force():
    """Occurrences without edits, many to a text, of items from 9 to 2,000 characters: each is found where it stands."""
    r = random.Random(11)
    rows = [(i, sentence(100 + i, n)) for i, n in enumerate((2, 3, 6, 12, 40, 380))]
    items = Items(rows)
    for n in range(6):
        picks = [r.choice(rows[:5] if r.random() < 0.9 else rows) for _ in range(40)]
        text, want = "", []
        for i, t in picks:
            text += sentence(r.random(), r.randint(0, 2)) + " "
            want.append((i, len(text), len(text) + len(t)))
            text += t + " "
        for block in (10**6, 3000):
            found = find_spans([text], items, block=block)[0]
            assert set(want) <= {s[:3] for s in found if s[3] == 0}


def test_spans_apart_against_brute_force():
    r = random.Random(2)
    found = [(r.randrange(3), x, x + r.randint(1, 30), r.randrange(4)) for x in (r.randrange(2000) for _ in range(600))]
    kept = []
    for f in sorted(set(found), key=lambda f: (f[0], f[3], f[1], f[2])):
        if not any(g[0] == f[0] and g[1] < f[2] and f[1] < g[2] for g in kept):
            kept.append(f)
    assert sorted(decontam._apart(found)) == sorted(kept)


def test_repetitive_items_are_found_one_behind_the_other():
    item = " ".join(["0"] * 500)
    items = decontam.Items([(1, item)])
    for n in (1, 20, 80):
        got = decontam.find_spans([" ".join([item] * n)], items)[0]
        assert got == [(1, 1000 * x, 1000 * x + 999, 0) for x in range(n)]
    # a rest with an edit behind exact ones, and tiles of which each has an edit
    rest = item.split()[:495]
    got = decontam.find_spans([f"{item} {item} something else {' '.join(rest)} end"], items)[0]
    assert [x[1:3] for x in got[:2]] == [(0, 999), (1000, 1999)] and len(got) == 3 and got[2][1] >= 2000 and 0 < got[2][3] <= 10
    r = random.Random(9)
    base = [r.choice("abcdefghij") for _ in range(300)]
    tiles = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in (r.randrange(300) for _ in range(30))]
    assert len(decontam.find_spans([" ".join(tiles)], decontam.Items([(1, " ".join(base))]))[0]) == 30


def test_hits_expanded_in_pieces_tally_alike(monkeypatch):
    r = random.Random(10)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(20, 90)))) for i in range(12)]
    texts = [" ".join(r.choice("abc") if r.random() < 0.1 else r.choice("ab") for _ in range(600)) + " " + rows[k % 12][1] for k in range(20)]
    whole = decontam.find_spans(texts, decontam.Items(rows))
    monkeypatch.setattr(decontam, "EXPAND", 7)
    assert decontam.find_spans(texts, decontam.Items(rows)) == whole and any(whole)


def test_a_long_text_of_one_word_keeps_within_memory():
    import tracemalloc

    item = " ".join(["0"] * 500)
    tracemalloc.start()
    got = decontam.find_spans(["0 " * 150_000], decontam.Items([(1, item)]))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 300 and peak < 500e6
