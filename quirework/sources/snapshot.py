"""The scan's cache: records by folder with the token (mtime, size) they were read at, as a snapshot table.

Every change is a new DataFrame (join, anti-join, union with the last row of a path winning); `saved` writes one version and `loaded` reads it again. A
snapshot of another version of the layout counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
LAYOUT = "path string, mtime long, size long, uuid string, payload string, version int"


def encoded(df: DataFrame, columns: list[str]) -> Column:
    """A record as JSON with its keys in order."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def decoded(payload: Column, ddl: str) -> Column:
    """A record from JSON; unknown keys are passed over, missing ones are null."""
    return F.from_json(payload, ddl)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LAYOUT)


def loaded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).parquet(path).where(F.col("version") == VERSION)


def saved(snapshot: DataFrame, path: str) -> DataFrame:
    """One version written to its own folder, and read again."""
    snapshot.write.mode("errorifexists").parquet(path)
    return loaded(snapshot.sparkSession, path)


def put(snapshot: DataFrame, rows: DataFrame) -> DataFrame:
    """The snapshot with rows (path, mtime, size, uuid, payload) in place of those of their paths; rows without a uuid are not kept."""
    new = rows.where("uuid is not null").groupBy("path").agg(F.max_by(F.struct("mtime", "size", "uuid", "payload"), F.struct("mtime", "size", "uuid")).alias("r"))
    new = new.select("path", "r.*", F.lit(VERSION).alias("version"))
    return without(snapshot, new.select("path")).unionByName(new)


def without(snapshot: DataFrame, paths: DataFrame) -> DataFrame:
    """The snapshot without these paths."""
    return snapshot.join(paths.select("path").distinct(), "path", "left_anti")


def repointed(snapshot: DataFrame, moves: DataFrame) -> DataFrame:
    """The snapshot with the rows of moved folders (path, new_path) under their new paths; what was there before goes."""
    m = moves.groupBy("path").agg(F.max("new_path").alias("new_path"))
    stay = without(snapshot, m.select("path").union(m.select("new_path")))
    moved = snapshot.join(m, "path").select(F.col("new_path").alias("path"), *[c for c in snapshot.columns if c != "path"])
    return stay.unionByName(moved)


def looked_up(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """listing (path, mtime, size) with `payload` where the snapshot has the folder at the same token, and `state`: hit, changed or new."""
    s = snapshot.select("path", F.col("mtime").alias("__m"), F.col("size").alias("__s"), F.col("payload").alias("__p"))
    same = (F.col("__m") == F.col("mtime")) & (F.col("__s") == F.col("size"))
    state = F.when(F.col("__m").isNull(), "new").when(same, "hit").otherwise("changed")
    return listing.join(s, "path", "left").withColumn("state", state).withColumn("payload", F.when(F.col("state") == "hit", F.col("__p"))).drop("__m", "__s", "__p")
