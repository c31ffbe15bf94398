"""The review as a sink of Spark: a folder of YAML files that appears as a whole or not at all.

    rows.write.format("review").mode("append").save(path)

Every task writes its entries to a file of its own in a folder beside the old one; a task that fails or is repeated leaves only files that nobody counted. The commit keeps the files of
the tasks that succeeded, writes the header with their count, turns the old folder into `.bak` and gives the new one its name; an abort removes it. Entries never pass the driver."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import yaml
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Entries of one dump; bounds what a task holds.
AT_ONCE = 1000
#: Fields of an entry that are always there, null or not.
FIELDS = ("id", "uuid", "path", "diagnosis", "action", "proposed", "notes", "verified")


def header(count: int, day: date | None = None) -> str:
    lines = [
        f"Made on {(day or date.today()).isoformat()}", f"{count} books need review.", "Set `action` of each entry to one of:", "  accept  - apply `proposed`; a null value there removes the field",
        "  delete  - remove the folder of the book", "  keep    - apply, but leave the entry here", "and `verified: true` where a book is right as it is.",
    ]
    return "".join(f"# {line}\n" for line in lines)


def plain(v):
    """Rows as dictionaries; a proposed value that is JSON of a list or an object as what it stands for."""
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, str) and v[:1] in "[{" and v:
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


def document(row: dict) -> str:
    entry = {f: plain(row[f]) for f in FIELDS if f in row} | {k: plain(v) for k, v in row.items() if k not in FIELDS and v is not None}
    return "---\n" + yaml.safe_dump(entry, allow_unicode=True, sort_keys=False)


@dataclass
class Written(WriterCommitMessage):
    file: str
    count: int


class ReviewSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "review"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReviewWriter(self.options["path"].rstrip("/"))


class ReviewWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.fresh = path, f"{path}.new-{uuid.uuid4().hex}"
        os.makedirs(self.fresh)  # by the driver only: a task that is still about to begin when all is given up finds no folder and fails

    def write(self, iterator: Iterator[Row]) -> Written:
        name, count, held = f"part-{uuid.uuid4().hex}.yaml", 0, []
        with open(f"{self.fresh}/{name}", "w", encoding="utf-8") as f:
            for row in iterator:
                held.append(document(row.asDict()))
                count += 1
                if len(held) == AT_ONCE:
                    f.write("".join(held))
                    held = []
            f.write("".join(held))
        return Written(name, count)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        counted = {m.file for m in done if m.count}
        for name in os.listdir(self.fresh):
            if name not in counted:
                os.unlink(f"{self.fresh}/{name}")
        with open(f"{self.fresh}/header.yaml", "w", encoding="utf-8") as f:
            f.write(header(sum(m.count for m in done)))
        back = f"{self.path}.bak"
        if os.path.isdir(self.path):
            shutil.rmtree(back, ignore_errors=True)
            os.replace(self.path, back)
        os.replace(self.fresh, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        for _ in range(5):  # tasks may be adding a file
            shutil.rmtree(self.fresh, ignore_errors=True)
            if not os.path.isdir(self.fresh):
                return
            time.sleep(0.2)


def register(spark) -> None:
    spark.dataSource.register(ReviewSink)


def finished(path: str) -> None:
    """The run is over: the earlier review goes."""
    shutil.rmtree(f"{path.rstrip('/')}.bak", ignore_errors=True)
