from pyspark.sql import functions as F

from quirework.functions import text


def test_the_year_of_the_publisher_comes_before_a_number_of_the_line_above(spark):
    pages = ["kniha o čase 1803\nVydalo: Mladá fronta 1987", "kniha 1803\nVydalo: Argo", "Vydalo: Argo\nPraha 1999"]
    d = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").select("i", text.mined_year(F.col("p")).alias("y"))
    assert [r.y for r in d.orderBy("i").collect()] == [1987, 1803, 1999]
