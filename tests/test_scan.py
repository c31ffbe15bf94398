import json
import os

from quirework.sources import scan, snapshot


def book(lib, folder, title, **more):
    d = lib / folder
    d.mkdir(parents=True)
    (d / "metadata.json").write_text(json.dumps({"title": title, "authors": ["A B"], **more}))
    (d / "book.epub").write_bytes(b"x" * 10)
    return d


def rows(records):
    return {os.path.basename(r.path): r for r in records.collect()}


def test_second_scan_opens_only_what_changed(spark, tmp_path):
    lib = tmp_path / "lib"
    one, two = book(lib, "A/One (1)", "One", series=[{"name": "S", "sequence": "2"}], tags=["x"]), book(lib, "A/Two (2)", "Two")
    three = book(lib, "B/Three (3)", "Jiшн Kosek")
    records, known = scan.scanned(spark, str(lib), snapshot.empty(spark))
    got = rows(records)
    assert {r.state for r in got.values()} == {"new"} and got["Three (3)"].title == "Jiří Kosek" and got["Three (3)"].encoding_repaired
    assert got["One (1)"].series[0]["name"] == "S" and got["One (1)"].tags == ["x"]
    known = snapshot.saved(known, str(tmp_path / "snap1"))
    # other words under the same token: not seen, as the folder isn't opened; another size: seen
    s = os.stat(one / "metadata.json")
    (one / "metadata.json").write_text((one / "metadata.json").read_text().replace("One", "Eno"))
    os.utime(one / "metadata.json", ns=(s.st_atime_ns, s.st_mtime_ns))
    (two / "metadata.json").write_text(json.dumps({"title": "Two again", "authors": ["A B"]}))
    (three / "metadata.json").unlink()
    (three / "book.epub").unlink()
    three.rmdir()
    book(lib, "C/D/Four (4)", "Four")
    records, known = scan.scanned(spark, str(lib), known)
    got = rows(records)
    assert {n: r.state for n, r in got.items()} == {"One (1)": "hit", "Two (2)": "changed", "Four (4)": "new"}
    assert got["One (1)"].title == "One" and got["One (1)"].series[0]["index"] == "2" and got["Two (2)"].title == "Two again" and got["Four (4)"].author_folder == "D"
    assert known.count() == 3
    again, _ = scan.scanned(spark, str(lib), known)
    assert {r.state for r in again.collect()} == {"hit"} and rows(again)["Two (2)"].title == "Two again"


def test_a_crowded_top_folder_is_shared(spark, tmp_path):
    for i in range(60):
        book(tmp_path, f"crowded/Book {i} ({i})", f"T{i}")
    book(tmp_path, "B/x", "X")
    book(tmp_path, "single", "S")
    reader = scan.ListingReader(str(tmp_path), 10)
    parts = reader.partitions()
    crowded = [p for p in parts if p.value[0].endswith("crowded")]
    assert len(crowded) == 6
    found = [r[0] for p in parts for r in reader.read(p)]
    assert len(found) == len(set(found)) == 62
    assert max(len(list(reader.read(p))) for p in crowded) < 30
    assert scan.listing(spark, str(tmp_path), 10).count() == 62


def test_empty_library(spark, tmp_path):
    records, known = scan.scanned(spark, str(tmp_path), snapshot.empty(spark))
    assert records.count() == 0 and known.count() == 0
