"""The scan of a library: a listing of its folders, a snapshot of what was read before, and the reader of the rest.

The listing opens no file. Only folders that the snapshot doesn't know at their token (the newest time and the sum of the sizes of their files) are read: the manifest, else the package
document; then damaged text is repaired. A top folder with many books is listed by several tasks, each for its share of the names."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quirework.functions import repair
from quirework.sources import manifest, snapshot
from quirework.sources.library import MARKERS, _out, _text, walk
from quirework.tables import written

LISTED = "path string, author_folder string, title_folder string, files array<struct<name: string, is_dir: boolean, size: long, mtime: double>>, mtime long, size long"
RECORD = (
    "title string, authors array<string>, series array<struct<name: string, index: string>>, isbn string, year int, publisher string, language string, tags array<string>, verified boolean, "
    "source string, encoding_repaired boolean, bad_fields array<string>"
)
_FIELDS = ["title", "authors", "series", "isbn", "year", "publisher", "language", "tags", "verified", "source", "encoding_repaired", "bad_fields"]
#: Folders below a top folder for each task that lists it.
SHARE = 2000


class ListingSource(DataSource):
    """spark.read.format("library_listing").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "library_listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], int(self.options.get("share", SHARE)))


class Share(InputPartition):
    def __init__(self, top: str, number: int, of: int):
        super().__init__((top, number, of))


class ListingReader(DataSourceReader):
    def __init__(self, root: str, share: int):
        self.root, self.share = root, share

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        out = []
        for e in sorted(os.scandir(self.root), key=lambda e: e.name):
            if e.is_dir() and not _out(e.name, False):
                # a folder has a link for each folder in it; where a file system doesn't count them, it is one share
                of = max(1, -(-(e.stat().st_nlink - 2) // self.share))
                out += [Share(e.path, k, of) for k in range(of)]
        return out or [Share("", 0, 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        top, number, of = partition.value
        for path, author, title, files, *_ in _shared(top, number, of) if top else ():
            yield path, author, title, files, max((int(1000 * f[3]) for f in files), default=0), sum(f[2] for f in files if not f[1])


def _shared(top: str, number: int, of: int) -> Iterator[tuple]:
    """Book folders of a top folder's share of names; a top folder that is a book itself belongs to the first."""
    if of == 1 or any(os.path.isfile(os.path.join(top, m)) for m in MARKERS):
        if not number:
            yield from walk(top, texts=False)
        return
    for e in sorted(os.scandir(top), key=lambda e: e.name):
        if e.is_dir() and not _out(e.name, False) and zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % of == number:
            yield from walk(e.path, texts=False)


def listing(spark: SparkSession, root: str, share: int = SHARE) -> DataFrame:
    spark.dataSource.register(ListingSource)
    return spark.read.format("library_listing").option("share", share).load(root)


def opened(folders: DataFrame) -> DataFrame:
    """folders (path) with their `manifest` and `opf`, null where there is none."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            read = [[_text(os.path.join(p, m)) for p in a.to_pylist()] for m in ("metadata.json", "metadata.opf")]
            yield pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in read], ["manifest", "opf"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return folders.withColumn("__read", F.arrow_udf(run, "struct<manifest: string, opf: string>")("path")).select("*", "__read.manifest", "__read.opf").drop("__read")


def read(folders: DataFrame) -> DataFrame:
    """folders (manifest, opf) with the fields of RECORD: those of the manifest, of the package document where there is no manifest or none that can be read, or none; source says
    which (json, opf(fallback), opf, path). Damaged titles, publishers and authors are repaired; what can't be is named in bad_fields."""
    d = folders.withColumn("__json", manifest.scanned(F.col("manifest")))
    lost = F.col("manifest").isNotNull() & F.col("__json").isNull()
    source = F.when(F.col("__json").isNotNull(), "json").when(lost, "opf(fallback)").when(F.col("opf").isNotNull(), "opf").otherwise("path")
    # package documents are parsed only where they count
    d = d.withColumn("source", source).withColumn("__opf", manifest.parsed_opf(F.when(F.col("source").startswith("opf"), F.coalesce("opf", F.lit("")))))
    from_json, found = F.col("source") == "json", F.col("source").startswith("opf")
    v = F.try_parse_json("manifest")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    both = lambda name, own=None: F.when(from_json, F.col(f"__json.{name}") if own is None else own).when(found, F.col(f"__opf.{name}"))
    none = F.array().cast("array<string>")
    named = F.filter(F.array(F.struct(F.col("__opf.series").alias("name"), F.lit("").alias("index"))), lambda s: s["name"].isNotNull())
    fields = {
        "title": F.coalesce(both("title"), F.lit("")), "authors": F.coalesce(both("authors"), none), "isbn": both("isbn"), "year": both("year"), "publisher": both("publisher", get("$.publisher")),
        "language": both("language", get("$.language")), "tags": F.coalesce(both("tags", get("$.tags", "array<string>")), none), "verified": F.coalesce(F.when(from_json, F.col("__json.verified")), F.lit(False)),
        "series": F.coalesce(F.when(from_json, F.col("__json.series")).when(found, named), F.array().cast("array<struct<name: string, index: string>>")),
    }
    return repair.repaired_records(d.withColumns(fields)).drop("__json", "__opf")


def scanned(spark: SparkSession, root: str, known: DataFrame, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(records, snapshot): every book folder's path, folders, files, token, `state` (hit, changed, new) and RECORD; and the snapshot for the next scan, without folders that are gone.
    known: the snapshot of the last one, or snapshot.empty()."""
    found = written(snapshot.looked_up(listing(spark, root, share), known), "listing")
    fresh = read(opened(found.where("state <> 'hit'"))).drop("payload", "manifest", "opf")
    old = found.where("state = 'hit'").withColumn("__r", snapshot.decoded(F.col("payload"), RECORD)).select(*[c for c in found.columns if c != "payload"], "__r.*")
    # a folder is known by its path; the snapshot's uuid only has to be there
    records = written(fresh.unionByName(old), "records")
    kept = records.select("path", "mtime", "size", F.md5("path").alias("uuid"), snapshot.encoded(records, _FIELDS).alias("payload"))
    return records, snapshot.put(snapshot.empty(spark), kept)

