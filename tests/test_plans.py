import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from quirework import config
from quirework.functions import text
from quirework.operators import proposals
from quirework.sources import files, sink


def test_config_precedence(tmp_path):
    (tmp_path / ".env").write_text("# note\nexport QUIREWORK_WORKERS='4'\nQUIREWORK_LIBRARY=\"$HOME/lib\"\nQUIREWORK_NEEDFIX_DIR=fix # why\nother\n")
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    c = config.load({"workers": 2}, {"HOME": "/h", "QUIREWORK_NEEDFIX_DIR": "env", "QUIREWORK_DRY_RUN": "yes"}, str(inner))
    assert (c.workers, c.library, c.needfix_dir, c.dry_run, c.negative_ttl_days) == (2, "/h/lib", "env", True, 7)


def test_sink(spark, tmp_path):
    lib = tmp_path / "lib"
    for n in ("A/x", "B/y", "C/z", "D/w"):
        (lib / n).mkdir(parents=True)
        (lib / n / "f").write_text(n)
    (lib / "T").mkdir()
    plan = spark.createDataFrame([(1, str(lib / "A/x"), str(lib / "T/x"), "applied"), (2, str(lib / "B/y"), str(lib / "T/x"), "applied"), (3, str(lib / "C/z"), "", "deleted"), (4, str(lib / "D/w"), "", "skipped")], "pos int, source string, dest string, step string")
    snap = str(tmp_path / "gone.tgz")
    assert {x[2] for x in sink.carry_out(plan, str(lib), snap)} == {"planned", "skipped", "planned deletion"} and (lib / "A/x").exists()
    got = [x[2] for x in sink.carry_out(plan, str(lib), snap, dry_run=False)]
    assert got == ["moved", "collision_renamed", "skipped", "deleted"]
    assert (lib / "T/x (dup 1)/f").read_text() == "B/y" and not (lib / "A").exists() and (lib / "D/w").exists() and not (lib / "C/z").exists()
    assert "z/f" in tarfile.open(snap).getnames()
    sink.write_file(str(tmp_path / "m.json"), "1")
    sink.write_file(str(tmp_path / "m.json"), "2")
    assert (tmp_path / "m.json").read_text() == "2" and (tmp_path / "m.json.bak").read_text() == "1"


def test_epub_cover():
    for wiring in ('<meta name="cover" content="c"/>', "", "<guide/>"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='O/p.opf'/></rootfiles></container>")
            props = ' properties="cover-image"' if not wiring else ""
            z.writestr("O/p.opf", f'<package><metadata>{wiring if "meta" in wiring else ""}</metadata><manifest><item id="c" href="img/a.jpg" media-type="image/jpeg"{props}/></manifest>{"<guide><reference type=" + chr(34) + "cover" + chr(34) + " href=" + chr(34) + "img/a.jpg" + chr(34) + "/></guide>" if "guide" in wiring else ""}</package>')
            z.writestr("O/img/a.jpg", b"JPEG")
        assert files.epub_cover(out.getvalue()) == b"JPEG"


def test_spaced_capitals_and_authors(spark):
    df = spark.createDataFrame([("Neznámý D A R K O Ň N A tady",), ("Autor: Jan Novák (editor)",), ("J. R. R. Tolkien\nPÁN PRSTENŮ",), ("Obloha byla černá nad městem",)], "t string")
    got = df.select(text.joined_capitals(F.col("t")).alias("j"), text.mined_authors(F.col("t")).alias("a")).collect()
    assert got[0].j == "Neznámý DARKOŇNA tady" and got[1].a == ["Jan Novák"] and got[2].a == ["J. R. R. Tolkien"] and got[3].a == []


def test_proposal_checks(spark):
    rows = [("Čas přílivu", ["Agatha Christie"], None, None, "CAS PRILIVU - Agatha Christie", ""), ("Zcela jiná kniha", ["Nikdo Nic"], None, None, "CAS PRILIVU - Agatha Christie", ""), ("x", [], "9788071741305", "9788085906455", "page", ""), ("x", [], None, None, "", "")]
    df = spark.createDataFrame(rows, "title string, authors array<string>, isbn string, isbn_from_text string, first_page string, broader string")
    got = [(r.passed, r.feedback) for r in proposals.verified(df).collect()]
    assert [p for p, _ in got] == [True, False, False, True] and "title" in got[1][1] and "ISBN" in got[2][1]
