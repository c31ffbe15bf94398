import pytest
import sentencepiece
from pyspark.sql import functions as F

from quirework.llm import sp_dropout
from quirework.llm.sp_dropout import Codec, agenda, default_model, skipped

from .helpers import ODD, docs, empty

TEXTS = [x for x in ODD if x is not None] + ["Hello  world, naïve café.\n\ttabs", "the quick brown fox " * 20, "日本語 text", "  lead and trail  ", "▁x ▁"]


@pytest.fixture(scope="module")
def plain():
    return Codec(default_model(), 0.0)


@pytest.fixture(scope="module")
def dropping():
    return Codec(default_model(), 0.3)


def test_without_dropout_the_library_agrees(plain):
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for t in TEXTS:
        if "▁" not in t:
            assert plain.encode([t]).to_pylist()[0] == sp.encode(t)


def test_round_trip(plain, dropping):
    for c in (plain, dropping):
        for t in TEXTS:
            assert c.decode(c.encode([t]).to_pylist()[0]) == t if t else c.encode([t]).to_pylist() == [[]]


def test_numpy_steps_equal_the_agenda(dropping):
    import numpy as np
    import xxhash

    words = [" " + w for w in "internationalization of unbelievable things aaaaaaaa naïve déjà vu 12345 mississippi".split()]
    for variant in range(4):
        for w, got in zip(words, dropping._pieces(words, variant), strict=True):
            key = xxhash.xxh64_intdigest(w.encode(), dropping.seed * 1_000_003 + variant)
            symbols = [dropping.blank if c == " " else int(dropping.char[ord(c)]) for c in w]
            found = agenda(symbols, key, dropping.limit, dropping.vocab)
            want = dropping._fallback(np.array([i for _, i in found], np.int32), np.array([ord(w[a]) for a, _ in found]))
            assert got.tolist() == want.tolist()


def test_segmentations_vary_and_repeat(dropping):
    text = " ".join(["internationalization"] * 40)
    ids = dropping.encode([text]).to_pylist()[0]
    words = " ".join(str(i) for i in ids)
    assert Codec(default_model(), 0.3).encode([text]).to_pylist()[0] == ids
    assert Codec(default_model(), 0.3, seed=99).encode([text]).to_pylist()[0] != ids
    assert len(ids) > len(Codec(default_model(), 0.0).encode([text]).to_pylist()[0]) and words
    share = sum(skipped(k * 7919, 1, 2, 3, 1 << 30) for k in range(4000)) / 4000
    assert 0.2 < share < 0.3


def test_result_does_not_depend_on_neighbours(dropping, monkeypatch):
    want = [dropping.encode([t]).to_pylist()[0] for t in TEXTS]
    monkeypatch.setattr(sp_dropout, "BLOCK", 50)
    monkeypatch.setattr(sp_dropout, "REMEMBER", 3)
    assert Codec(default_model(), 0.3).encode(TEXTS[::-1]).to_pylist()[::-1] == want


def test_query(spark):
    got = {r.doc_id: r for r in sp_dropout.digest(docs(spark, ODD)).collect()}
    assert all(r.lossless for r in got.values())
    assert got[0].ids is None and got[0].n_pieces == 0 and got[1].ids == []
    assert sp_dropout.digest(empty(spark)).count() == 0
    twice = docs(spark, ["same text here"] * 2, [1, 1]).withColumn("ids", F.lit(1))
    enc = sp_dropout.encode(twice)
    assert enc.columns == [*twice.columns, "encoded"]
    back = sp_dropout.decode(enc.select(F.col("encoded.ids").alias("p")), "p")
    assert [r.decoded for r in back.collect()] == ["same text here"] * 2


def test_every_occurrence_draws_its_own_segmentation(dropping):
    import numpy as np
    import xxhash

    text = " ".join(["internationalization"] * 400)
    ids = dropping.encode([text]).to_pylist()[0]
    words, ways = [], set()
    for i in ids:
        piece = dropping.vocab.raw[i]
        if piece.startswith(b" "):
            words.append([])
        words[-1].append(i)
    ways = {tuple(w) for w in words}
    assert len(words) == 400 and len(ways) > 20
    chunk = " internationalization"
    symbols = [dropping.blank if c == " " else int(dropping.char[ord(c)]) for c in chunk]
    own, mask = xxhash.xxh64_intdigest(text.encode(), dropping.seed), (1 << 64) - 1
    for place, got in enumerate(words):
        key = xxhash.xxh64_intdigest(chunk.encode(), dropping.seed) ^ ((place + own) * sp_dropout._M1 & mask)
        assert got == [i for _, i in agenda(symbols, key, dropping.limit, dropping.vocab)]
    assert np.isclose(dropping.limit / 2**32, 0.3)
