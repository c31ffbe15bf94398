"""Neighbours in a filtered, ordered list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.tables import written


def neighbours(entries: DataFrame, key: str, order: str, kept: Column) -> DataFrame:
    """entries with `next` and `prev`: the order values of the nearest kept entries of the key behind and before each one, the ends joined; of an entry that is not kept, those between which
    it would stand. Null where a key keeps none.

    Entries are sorted into ranges of (key, order), so that no key is one task; a range looks for neighbours in itself first, then at the edges of the ranges around it, one row for each key and range."""
    ranged = entries.repartitionByRange(key, order).sortWithinPartitions(key, order)
    d = written(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__own", F.when(kept, F.col(order))), "ranges")
    edges = d.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__range")).agg(F.min("__own").alias("__lo"), F.max("__own").alias("__hi"))
    each = Window.partitionBy("__key").orderBy("__range")
    whole = Window.partitionBy("__key")
    edges = edges.select(
        "__key", "__range", F.max("__hi").over(each.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.max("__hi").over(whole).alias("__last"),
        F.min("__lo").over(Window.partitionBy("__key").orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)).alias("__behind"), F.min("__lo").over(whole).alias("__first"),
    )
    own = Window.partitionBy("__part", key)
    near = lambda w: F.last("__own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__p", near(own.orderBy(order))).withColumn("__n", near(own.orderBy(F.desc(order))))
    joined = d.join(edges, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__range")))
    return joined.select(*entries.columns, F.coalesce("__n", "__behind", "__first").alias("next"), F.coalesce("__p", "__before", "__last").alias("prev"))
