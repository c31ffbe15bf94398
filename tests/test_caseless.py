from quirework.operators import proposals


def test_titles_in_capitals_with_a_sharp_s_agree(spark):
    d = spark.createDataFrame([("ßß ßa ßbß", "SSSS SSA SSBSS", "A", "A", None, None)], "a_title string, b_title string, a_author string, b_author string, a_isbn string, b_isbn string")
    assert proposals.identity_agrees(d).first().agrees
