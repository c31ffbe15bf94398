import pyarrow as pa

from quirework.functions import slices
from quirework.plans import built_files
from quirework.sources import files, pdf


def test_a_map_that_documents_share_is_read_once():
    pdf._kept_unicode.cache_clear()
    pages = [["Kůň \\(x) běží", "druhý řádek"]]
    got = [files.pdf(built_files.pdf(f"T{k}", "A", None, pages, kind))["page"] for k in range(6) for kind in (0, 1)]
    assert got == ["Kůň \\(x) běží\ndruhý řádek"] * 12
    assert pdf._kept_unicode.cache_info().misses == 1


def test_batches_become_objects_a_few_rows_at_a_time():
    parts = list(slices.rows([pa.array(range(600)), pa.array(map(str, range(600)))]))
    assert [len(p) for p in parts] == [256, 256, 88] and [r for p in parts for r in p] == [(i, str(i)) for i in range(600)]
