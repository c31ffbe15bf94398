"""Queries without SQL read the whole text of every row."""

from pyspark.sql import functions as F

from quirework import plans
from quirework.functions import fuzzy, text
from quirework.plans.adapter import books

SF = "/root/testdata/sf0.001"


def test_partial_ratio_against_whole_texts(spark):
    b = books(spark, SF).select("id", text.normalise(F.col("base")).alias("a"), text.normalise(F.col("text")).alias("b")).collect()
    want = {r.id: None if r.a is None or r.b is None else round(fuzzy.partial_ratio(r.a, r.b), 6) for r in b}
    assert any(len(r.b or "") > 1000 for r in b)
    assert {r.id: r.score for r in plans.queries()["partial_ratio"](spark, SF).collect()} == want
