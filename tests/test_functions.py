import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import answers, fuzzy, isbn, names, repair, text
from quirework.sources.manifest import canonical


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


ISBNS = [("8071741302", "9788071741305"), ("80-85906-45-7", "9788085906455"), ("9788090131355", None), ("ISBN 978-80-903850-5-4", "9788090385054"), ("ISBN-13: 9788090385054", None), ("", None), (None, None), ("080442957X", "9780804429573")]


@pytest.mark.parametrize(("raw", "want"), ISBNS)
def test_isbn_canonical(spark, raw, want):
    assert one(spark, isbn.canonical, raw) == want
    if raw and not raw.startswith("ISBN-13"):
        assert canonical(raw) == want


def test_isbn_extract(spark):
    assert one(spark, isbn.all_in, "ISBN-13: 978-80-903850-5-4, again 9788090385054; ISBN 8071741302") == ["9788090385054", "9788071741305"]
    assert one(spark, isbn.first_in, "no number 12345") is None


@pytest.mark.parametrize(("s", "kind", "value"), [("Jiшн Kosek", "misdecoded", "Jiří Kosek"), (r"\376\377\000K\000u\000l\000h\000\341\000n\000e\000k", "octal_escape", "Kulhánek"), ("François Villon", "none", "François Villon"), ("Pan Wołodyjowski", "none", "Pan Wołodyjowski"), ("Darko� je bytost", "misdecoded", None)])
def test_mojibake(spark, s, kind, value):
    assert repair.repaired(s) == (value, kind)
    assert one(spark, text.mojibake, s) == kind
    assert one(spark, repair.repair, s)["value"] == value


def test_partial_and_chained_damage():
    good = "Vytváříme příběh"
    for codec in ("cp1250", "iso-8859-2"):
        damaged = "š".join(("Čistý text a ", " " + good.encode().decode(codec, "replace")))
        got = repair.double_decoded(damaged)
        assert got is None or good in got or "�" in damaged
    twice = "příliš malíř".encode("cp1250").decode("cp1251").encode().decode("cp1250", "replace")
    assert repair.chained(twice)[0].startswith("p") and repair.chained("čistý text") is None
    lost = "Vytváříme příběh".encode().decode("cp1252", "replace")
    assert repair.double_decoded("Pan Wołodyjowski má knihu") in (None, "Pan Wołodyjowski má knihu")
    assert isinstance(lost, str)


def test_record_repair(spark):
    rows = [("Jiшн", "Argo", ["Kamenáè Bill", ""], []), ("Darko� je", None, ["A"], []), ("x", "y", ["", "B"], [])]
    got = repair.repaired_records(spark.createDataFrame(rows, "title string, publisher string, authors array<string>, bad_fields array<string>")).collect()
    assert (got[0].title, got[0].authors, got[0].encoding_repaired, got[0].bad_fields) == ("Jiří", ["Kamenáč Bill"], True, [])
    assert (got[1].title, got[1].publisher, got[1].bad_fields, got[1].encoding_repaired) == ("Darko� je", None, ["title"], False)
    assert (got[2].authors, got[2].bad_fields) == (["", "B"], [])


def test_double_decode_and_recode():
    for s in ("Vytváříme příběh", "žluťoučký kůň"):
        assert repair.double_decoded(s.encode().decode("iso-8859-2")) == s
    assert repair.double_decoded("čistý text") is None
    assert repair.recode("Jiшн", "cp1251", "cp1250") == "Jiří" and repair.recode("日本", "cp1250", "cp1252") is None


@pytest.mark.parametrize(
    ("page", "title"),
    [("Neznámý ČAS PŘÍLIVU Agatha Christie", "Čas Přílivu"), ("Název: POSLEDNÍ CESTY OBOU QUITZOWŮ Autor: Karel May Nakladatelství: Toužimský, 1993", "Poslední Cesty Obou Quitzowů"), ("*** ANGLIČTINA ***", "Angličtina"), ("... !!", None), (None, None), ("", None)],
)
def test_title_mining(spark, page, title):
    assert one(spark, text.mined_title, page) == title


def test_publisher_and_year(spark):
    page = "Název: X Autor: Y Nakladatelství: Argo, Praha 1999"
    assert one(spark, text.mined_publisher, page) == "Argo" and one(spark, text.mined_year, page) == 1999
    assert one(spark, text.mined_year, "Rok vydání: 2001") == 2001 and one(spark, text.mined_year, "1999 alone") is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b, 1):
            new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_fuzzy_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, n))) for n in (12, 40))
        assert fuzzy.lcs(a, b) == lcs(a, b)
        s, t = (a, b) if len(a) <= len(b) else (b, a)
        if s:
            want = max(200 * lcs(s, w) / (len(s) + len(w)) for i in range(1 - len(s), len(t)) if (w := t[max(0, i) : i + len(s)]))
            assert fuzzy.partial_ratio(a, b) == pytest.approx(want)
    long = "x" * 30 + "needle in a long haystack of more than sixty-three characters indeed, yes" + "y" * 30
    assert fuzzy.partial_ratio(long[20:110], long) == 100


def test_fuzzy_columns(spark):
    assert one(spark, fuzzy.token_sort, "karel may", "may karel") == 100
    assert one(spark, fuzzy.in_text, "abc", "xx abc yy") == 1.0 and one(spark, fuzzy.in_text, "", "x") == 0.0
    assert 0.5 < one(spark, fuzzy.in_text, "cas prilivu", "toto je cas prilivy tady") < 1


def test_names(spark):
    assert [one(spark, names.anonym, s) for s in ("Neznámý", "neznámý - neuveden", "autor neuveden", "autor", "Jan Novák", None)] == [True, True, True, False, False, False]
    assert one(spark, names.author_sort, "Jan Amos Komenský") == "Komenský, Jan Amos" and one(spark, names.title_sort, "The Book") == "Book, The"
    assert one(spark, names.segment, ' a/b:c?  "d". ') == 'a_b_c_ _d_' and one(spark, names.segment, " .. ") == "_" and len(one(spark, names.segment, "x" * 300)) == 200
    assert one(spark, names.needfix_path, "/lib/needfix/Neznamy/B (1)", "Neznamy", "B (1)") == "/lib/needfix/Anonym/B (1)"


@pytest.mark.parametrize(
    ("raw", "title"),
    [('```json\n{"title": "A",}\n```', "A"), ('{"title": "None, True", "x": None}', "None, True"), ('{"title": "cut', "cut"), ('{"authors": ["A", "B', None), ("no json", None), ('x {"title": "A"} y', "A"), (None, None)],
)
def test_answers(raw, title):
    assert answers.coerced(answers.read(raw))["title"] == title


def test_answer_fields():
    got = answers.coerced(answers.read('{"authors": "One", "year": "0999", "isbn": " "}'))
    assert got == {"title": None, "authors": ["One"], "isbn": None, "year": None}
