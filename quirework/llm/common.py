"""Shared by the corpus operators: tables, shared scratch space, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of all contracts: space, \t, \n, \v, \f, \r.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the input tables, by any path that Spark reads. spread: a table of fewer splits than the cluster has cores (a small one, in
    one row group) is dealt out evenly first; larger ones are read as they lie, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where a local session names none (tests), one is made, once."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="quirework-"))
        found = _OWN[0]
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/quirework/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a written table: lineage ends here and every executor can read it again. options: of the writer."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(**{"compression": "snappy"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is; the fast path serves pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null or blank: an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_RUN), "")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def join_small(left: DataFrame, small: DataFrame, on, how: str, rows: int, bound: int) -> DataFrame:
    """Join that broadcasts `small` only if its counted `rows` are within `bound`; else a merge join."""
    return left.join(F.broadcast(small) if rows <= bound else small.hint("merge"), on, how)


def usual_length(vectors: DataFrame, vec_col: str) -> int:
    """The most frequent length of the vectors, of equally frequent ones the longest; 0 if there is none but empty ones."""
    sizes = vectors.select(F.size(F.col(vec_col)).alias("n")).where("n > 0").groupBy("n").count()
    top = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return top.n if top else 0


def floors(vectors: pa.Array, length: int, scale: float, limit: int) -> tuple[pa.Array, np.ndarray]:
    """(mask of the vectors that take part, their components as integers floor(scale * x)). Vectors take no part that are null or of another length,
    or hold components that are null, not finite or beyond the limit."""
    fits = pc.equal(pc.list_value_length(vectors), length).fill_null(False)
    x = vectors.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
        sound = (np.abs(x) <= limit).all(axis=1)  # false for NaN, which null becomes
    kept = np.asarray(fits).copy()
    kept[kept] = sound
    return pa.array(kept), x[sound].astype(np.int64)
