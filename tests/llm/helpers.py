import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


#: Null, empty, blank, one word, long, with odd characters.
ODD = [None, "", " \n\t ", "one", "two words", "word " * 30_000, "x" * 50_000, "é▁\x00😀\n\r\n  ünï ␛<|", "  a b"]


def prose(seed, n=80, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
