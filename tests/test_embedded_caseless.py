from quirework.operators import flow


def test_embedded_capitals_with_a_sharp_s_agree(spark):
    d = spark.createDataFrame([("ßß ßa ßbß", "SSSS SSA SSBSS", ["ßß ß"], ["SSSS SS"])], "title string, embedded_title string, authors array<string>, embedded_authors array<string>")
    assert flow.embedded_agreement(d).first().match
