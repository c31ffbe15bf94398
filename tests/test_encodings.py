import random

from quirework.functions import encodings

CZECH = "příliš žluťoučký kůň úpěl ďábelské ódy šťastný že ťuká ľahko zřejmě"
FRENCH = "où être très ça déjà noël garçon forêt français élève"


def sentence(r, words, n):
    w = words.split()
    return " ".join(r.choice(w) for _ in range(n))


def test_detection_of_held_out_texts(spark):
    r = random.Random(1)
    train = [(sentence(r, CZECH, 40),) for _ in range(60)] + [(sentence(r, FRENCH, 40),) for _ in range(60)] + [(None,), ("plain",)]
    model = encodings.train(spark.createDataFrame(train, "text string"))
    rows, want = [], {}
    for i in range(60):
        words, names = (FRENCH, ["utf-8", "iso-8859-1"]) if i % 2 else (CZECH, ["utf-8", "cp1250", "iso-8859-2"])
        name = r.choice(names)
        rows.append((i, sentence(r, words, 12).encode(name)))
        want[i] = name
    rows += [(100, b"only ascii"), (101, "﻿BOM ž".encode()), (102, b""), (103, None), (104, bytes(range(256)))]
    want |= {100: "ascii", 101: "utf-8"}
    got = {x.id: x.encoding for x in encodings.detected(spark.createDataFrame(rows, "id long, content binary"), model).collect()}
    assert {i: got.get(i) for i in want} == want
    assert 102 not in got and 103 not in got and 104 in got


def test_training_grows_with_no_corpus():
    assert encodings._counts(b"abc").sum() == 0 and encodings._counts("é".encode()).sum() == 3
