"""Carrying out an ordered plan of moves on a library that the cluster's machines share.

The plan is a written table, and the outcomes of each step are written to the journal before the next step begins, so a run that was stopped goes on with the same plan: finished steps are read,
and of the step that was cut off each move is found done (its folder is gone and its place is taken) or not, which is unambiguous as no later step has begun. Moves of one step are dealt
to tasks by their top folder; tasks that are repeated do no harm for the same reason. Deleted folders are archived first, each under a name that the outcome gives."""

from __future__ import annotations

import os
import shutil
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOME = "step long, pos long, source string, dest string, action string, outcome string, snapshot string"
#: The step of what is deleted: before all moves.
DELETED = -1


def _pruned(folder: str, root: str) -> None:
    """Folders that are left empty go, up to the root."""
    while folder != root and folder.startswith(root + os.sep):
        try:
            os.rmdir(folder)
        except OSError:
            return
        folder = os.path.dirname(folder)


def move(source: str, dest: str, root: str) -> str:
    here, there = os.path.isdir(source), os.path.exists(dest)
    if not here:
        return "done" if there else "error: no such folder"
    if there:
        return "error: the place is taken"
    try:
        os.makedirs(os.path.dirname(dest), exist_ok=True)
        shutil.move(source, dest)
    except OSError as e:
        return f"error: {e}"
    _pruned(os.path.dirname(source), root)
    return "done"


def delete(source: str, archive: str, root: str) -> str:
    """The archive appears whole before the folder goes."""
    try:
        if os.path.isdir(source):
            os.makedirs(os.path.dirname(archive), exist_ok=True)
            with tarfile.open(f"{archive}.part", "w:gz") as t:
                t.add(source, arcname=os.path.basename(source))
            os.replace(f"{archive}.part", archive)
            shutil.rmtree(source)
            _pruned(os.path.dirname(source), root)
        return "deleted" if os.path.exists(archive) else "error: no such folder"
    except OSError as e:
        return f"error: {e}"


def _step(todo: DataFrame, root: str, snapshots: str, to: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                r["snapshot"] = f"{snapshots}/{r['pos']}.tar.gz" if r["action"] == "delete" else None
                r["outcome"] = delete(r["source"], r["snapshot"], root) if r["action"] == "delete" else move(r["source"], r["dest"], root)
            names = [c.split()[0] for c in OUTCOME.split(", ")]
            types = [pa.int64() if c.endswith("long") else pa.string() for c in OUTCOME.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    top = F.split(F.substr("source", F.lit(len(root) + 2)), "/")[0]
    dealt = todo.repartition(top).select("step", "pos", "source", "dest", "action")
    dealt.mapInArrow(run, OUTCOME).write.mode("overwrite").parquet(to)


def carried_out(plan: DataFrame, root: str, journal: str, snapshots: str) -> DataFrame:
    """The outcomes (those of OUTCOME) of a written plan (step, pos, source, dest, action); action `delete` archives and removes, rows without a step otherwise do nothing and have no outcome."""
    spark, root = plan.sparkSession, root.rstrip("/")
    steps = plan.withColumn("step", F.when(F.col("action") == "delete", F.lit(DELETED)).otherwise(F.col("step")).cast("long")).where("step IS NOT NULL")
    numbers = [r.step for r in steps.select("step").distinct().orderBy("step").collect()]  # as many as the longest chain has moves
    exists = lambda p: (path := spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    for n in numbers:
        if not exists(f"{journal}/step={n}/_SUCCESS"):
            _step(steps.where(F.col("step") == n), root, snapshots, f"{journal}/step={n}")
    made = [spark.read.schema(OUTCOME).parquet(f"{journal}/step={n}") for n in numbers]
    out = spark.createDataFrame([], OUTCOME)
    for d in made:
        out = out.unionByName(d)
    return out
