"""What the comparison of records with their content may cost: pages normalised once, ratios no further than their bound, tables read once."""

import random

import pytest
from pyspark.sql import functions as F

from quirework import plans
from quirework.functions import fuzzy
from quirework.operators import content

SF = "/root/testdata/sf0.001"


@pytest.fixture
def planned(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda name: plans.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_bounded_ratios_are_whole_from_their_bound_on():
    rnd = random.Random(3)
    for _ in range(400):
        letters = rnd.choice(["ab ", "abcdefgh ", "abΩ😀é", "abcdefghijklmnopqrstuvwxyz "])
        a, b = ("".join(rnd.choice(letters[:k]) for _ in range(n)) for k, n in ((9, rnd.choice([3, 9, 20, 70])), (rnd.randrange(1, 10), rnd.choice([1, 40, 200]))))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        m, n = len(short), len(long)
        want = max(fuzzy.ratio(short, long[max(0, w - m + 1) : w + 1]) for w in range(n + m - 1))
        assert fuzzy.partial_ratio(a, b) == want
        for least in (50.0, 80.0, 90.0):
            got = fuzzy.partial_ratio(a, b, least)
            assert got == want if want >= least else got < least


def test_confirming_an_identity_normalises_each_text_once(planned):
    assert planned("confirm_identity").count("translate(") <= 4


def test_pages_of_records_that_nobody_asks_about_are_not_compared(spark):
    d = spark.createDataFrame([(i, "f.epub", "Some title", "some title here") for i in (1, 2)], "id int, primary_file string, title string, first_page string")
    d = d.withColumns({c: F.lit(None).cast("string") for c in ("isbn", "isbn_from_text", "embedded_title")})
    assert [r.title_score for r in content.verify(d, F.col("id") == 1).orderBy("id").collect()] == [1.0, 0.0]


def test_a_classification_normalises_pages_for_its_identity_once(planned):
    assert planned("pipeline_buckets").count("translate(first_page") + planned("pipeline_buckets").count("translate(substring(") <= 1


def test_an_identity_normalises_each_text_once(planned):
    assert planned("acquire_identity").count("translate(") <= 5


def test_rogues_read_the_formats_once(planned):
    assert planned("crosscheck_rogues").count("parquet") <= 1
