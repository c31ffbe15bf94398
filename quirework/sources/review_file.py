"""Review files: a stream of YAML documents, or an older single list, to rows and back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

SCHEMA = "pos int, id long, uuid string, path string, action string, category string, proposed map<string,string>, proposed_keys array<string>, notes string, verified boolean"


def migrated(e: dict) -> dict:
    """An entry of an older file: `edited` becomes `proposed`; edit means accept, reject keep; swap proposes exchanged fields."""
    e = dict(e)
    action, edited = e.get("action"), e.pop("edited", None)
    if edited:
        e["proposed"] = {**(e.get("proposed") or {}), **edited}
    if action == "swap":
        now = e.get("current") or {}
        e["proposed"] = {**(e.get("proposed") or {}), "title": now.get("author"), "author": now.get("title")}
    e["action"] = {"edit": "accept", "reject": "keep", "swap": "accept", "pending": None}.get(action, action)
    return e


def entries(raw: str) -> Iterator[dict]:
    for doc in yaml.safe_load_all(raw or ""):
        if doc is None:
            continue
        if isinstance(doc, dict):
            yield migrated(doc)
        elif isinstance(doc, list):
            yield from (migrated(e) for e in doc if isinstance(e, dict))
        else:
            raise ValueError("a review document is neither an entry nor a list")


@udtf(returnType=SCHEMA)
class ReviewEntries:
    def eval(self, raw: str):
        for pos, e in enumerate(entries(raw)):
            proposed = e.get("proposed") or {}
            text = {str(k): None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in proposed.items()}
            yield pos, e.get("id"), e.get("uuid"), e.get("path"), e.get("action"), (e.get("diagnosis") or {}).get("category"), text, list(text), e.get("notes"), bool(e.get("verified"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, id, uuid, ...) of review files; a present null and an absent key of `proposed` stay apart by proposed_keys."""
    spark.udtf.register("review_entries", ReviewEntries)
    spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()).createOrReplaceTempView("__review_files")
    return spark.sql("SELECT f.file, e.* FROM __review_files f, LATERAL review_entries(f.value) e")


def rendered(rows: DataFrame) -> DataFrame:
    """(uuid, doc): each entry as a YAML document, nulls kept."""
    import pyarrow as pa

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array(["---\n" + yaml.safe_dump({k: dict(v) if k == "proposed" and v is not None else v for k, v in r.items()}, allow_unicode=True, sort_keys=False) for r in a.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    fields = [c for c in ("id", "uuid", "path", "action", "proposed", "notes") if c in rows.columns]
    return rows.select("uuid", F.arrow_udf(run, "string")(F.struct(*fields)).alias("doc"))
