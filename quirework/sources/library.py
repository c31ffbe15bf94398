"""The library on disk as a Spark data source, and its listing rules."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MARKERS = ("metadata.opf", "metadata.json")
SCHEMA = "path string, author_folder string, title_folder string, files array<struct<name: string, is_dir: boolean, size: long, mtime: double>>, manifest string, opf string"


def excluded(name: Column, is_file: Column) -> Column:
    """Names that a walk leaves out; lock files only as files, and `needfix` stays."""
    return (name == "temp_calibre") | name.startswith("calibre-") | name.startswith(".") | (is_file & name.startswith("~$"))


def _out(name: str, is_file: bool) -> bool:
    return name == "temp_calibre" or name.startswith(("calibre-", ".")) or is_file and name.startswith("~$")


class LibrarySource(DataSource):
    """spark.read.format("library").load(root): one row for each book folder, a partition for each folder of the top level."""

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LibraryReader(self.options["path"])


class LibraryReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        top = sorted(e.name for e in os.scandir(self.root) if e.is_dir() and not _out(e.name, False))
        return [InputPartition(os.path.join(self.root, n)) for n in top] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            yield from walk(partition.value)


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def walk(folder: str, texts: bool = True) -> Iterator[tuple]:
    """Book folders below (and including) a folder, by name; a book folder is not descended into. texts: with what their metadata files say."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    names = {e.name for e in entries if e.is_file()}
    if names & set(MARKERS):
        files = []
        for e in entries:
            s = e.stat()
            files.append((e.name, e.is_dir(), s.st_size, s.st_mtime))
        parent, own = os.path.split(folder)
        yield (folder, os.path.basename(parent), own, files, *(_text(os.path.join(folder, n)) if texts and n in names else None for n in ("metadata.json", "metadata.opf")))
        return
    for e in entries:
        if e.is_dir() and not _out(e.name, False):
            yield from walk(e.path, texts)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LibrarySource)
