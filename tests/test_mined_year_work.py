import re
import time

from pyspark.sql import functions as F

from quirework.functions import constants as C
from quirework.functions import text


def test_the_year_near_a_label_is_that_of_one_pattern_over_the_whole_page(spark):
    near = re.compile(f"(?is)(.{{0,20}})({C.LABEL_PUBLISHER}\\s*:\\s*.+?{C.LABEL_END}.{{0,40}})")
    pages = ["Vydalo: Argo 1999", "1987 Vydalo: Vydalo: Argo", "x" * 30 + " 1803 VYDALO : Argo", "😀" * 25 + " 1804 vydalo: Argo", "1805" + "y" * 20 + "vydalo: A", "1806 vydavatel bez", "vydalo:", "1807 vydalo: A\n" + "z" * 50 + " 1999 vydalo: B 2001", ""]

    def want(page):
        m = near.search(page)
        years = [re.search(r"\b((?:1[89]|20)\d{2})\b", m[g], re.ASCII) for g in (2, 1)] if m else []
        return next((int(y[1]) for y in years if y), None)

    d = spark.createDataFrame(list(enumerate(pages)), "i int, p string").select("i", text.year_of(F.split("p", "\n")).alias("y"))
    assert [r.y for r in d.orderBy("i").collect()] == [want(p) for p in pages]


def test_a_page_without_a_label_costs_no_more_than_a_search(spark):
    d = spark.createDataFrame([("slova bez znaku " * 60_000,)], "p string").repartition(1).select(F.array("p").alias("l")).cache()
    d.count()

    def took(c):
        d.select(c.alias("x")).collect()
        began = time.time()
        d.select(c.alias("x")).collect()
        return time.time() - began

    assert took(text.year_of(F.col("l"))) < 5 * took(text.publisher_of(F.col("l"))) + 0.2
