"""Queries of names and numbers in pages: evidence at the very end of long texts counts, and numbers that resemble an id do not."""

import duckdb
import pytest

from quirework import plans

FAR = "lorem ipsum " * 5000
ODD = "§§§§ ¤¤¤¤ ∆∆∆∆ §¤∆§"
#: The number of record 17.
OWN = "9780000000170"


@pytest.fixture
def both(spark, tmp_path):
    def made(name, rows):
        spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(plans.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        return sorted(map(tuple, plans.queries()[name](spark, str(tmp_path)).select(*columns).collect())), sorted(want.fetchall())

    return made


def test_verifying_books_with_numbers_like_ids_at_the_end(both):
    got, want = both("verify_books", [(100007, "some words 4 100007"), (100018, "100018 some words"), (100038, "some words")])
    assert got == want and {r for _, r in got} == {"MISMATCH"}


def test_crosschecking_formats_with_numbers_like_ids_at_the_end(both):
    got, want = both("crosscheck_formats", [(100007, "some words 4 100007"), (100018, "100018 some words"), (100038, "some words")])
    assert got == want


def test_an_identity_far_into_the_text(both):
    got, want = both("acquire_identity", [(17, FAR + OWN), (35, "x")])
    assert got == want and got[0][1:3] == ("metadata", OWN)


def test_an_identity_confirmed_far_into_the_text(both):
    got, want = both("confirm_identity", [(10, FAR + ODD), (15, FAR)])
    assert got == want and (10, True) in got and (15, False) in got


def test_rogues_by_a_title_far_into_the_text(both):
    got, want = both("crosscheck_rogues", [(5, FAR + ODD), (45, FAR)])
    assert got == want == [(5, "mobi")]
