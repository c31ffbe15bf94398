"""The whole plan of a library's moves: who gets which place, and in what order places become free.

A wanted place goes to its first claimant if nobody lives there, or who lives there moves away; the others get the smallest ' (dup n)' that is free. Numbers follow from
gaps: with the taken numbers t1 < t2 < ... of a place, ti - i free ones lie below ti, so the k-th claimant's number is its rank when claimants k and taken ti - i are sorted
together. Rows are numbered within a key by ranges of a sort with offsets by range, so that a place that a third of all records claim is not one task.

A move whose place another one frees comes after it. As places and folders are unique, these orders are chains and cycles. Depths of chains come from pointer jumping, in rounds of a
logarithm of the longest chain, each a written table; what still has a pointer then is a cycle, whose first move sets its folder aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.tables import written

_NUMBERED = r"^(.*) \(dup ([1-9][0-9]{0,8})\)$"


def numbered(df: DataFrame, key: str, *order: str, out: str = "n") -> DataFrame:
    """df with its rows numbered from 1 within each key, in order (which has no ties)."""
    sorted_ = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    d = written(sorted_.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()), "numbered")
    # a key has one row for each range that it reaches into, which are few
    ranges = d.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__range")).agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("__before", before)
    joined = d.join(ranges, (F.col(key).eqNullSafe(F.col("__key"))) & (F.col("__part") == F.col("__range")))
    return joined.withColumn(out, F.col("__before") + F.col("__at") - F.col("__first") + 1).select(*df.columns, out)


def _with_number(place: Column, n: Column) -> Column:
    return F.concat(place, F.lit(" (dup "), n.cast("string"), F.lit(")"))


def placed(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(pos, source, dest, final, action) of wanted moves (pos, source, dest; a folder that is named twice moves as the first says) in a library with folders existing (path). action:
    moved, collision_renamed, already_correct, or error where there is no such folder."""
    first = wanted.groupBy("source").agg(F.min_by(F.struct("pos", "dest"), "pos").alias("m")).select("m.pos", "source", "m.dest")
    folders = existing.select("path").distinct()
    d = first.join(folders.select(F.col("path").alias("__there")), F.col("source") == F.col("__there"), "left")
    d = written(d.select("pos", "source", "dest", F.col("__there").isNotNull().alias("there")), "wanted")
    moving = d.where("there AND source <> dest")
    stays = folders.join(moving.select(F.col("source").alias("path")), "path", "left_anti").select(F.col("path").alias("dest"), F.lit(True).alias("lives"))
    claims = numbered(moving.select("pos", "source", "dest"), "dest", "pos", out="k").join(stays, "dest", "left")
    claims = claims.withColumn("k", F.when(F.col("lives"), F.col("k")).otherwise(F.col("k") - 1)).drop("lives")
    claims = written(claims, "claims")
    late = claims.where("k > 0")
    # numbers that are taken by a folder, or wanted by name
    names = folders.select("path").unionByName(d.select(F.col("dest").alias("path"))).where(F.col("path").rlike(_NUMBERED)).distinct()
    taken = names.select(F.regexp_extract("path", _NUMBERED, 1).alias("dest"), F.regexp_extract("path", _NUMBERED, 2).cast("long").alias("t"))
    taken = numbered(taken.join(late.select("dest").distinct(), "dest", "left_semi"), "dest", "t", out="i")
    none = F.lit(None).cast("long")
    both = late.select("dest", (2 * F.col("k")).alias("sort"), "pos").unionByName(taken.select("dest", (2 * (F.col("t") - F.col("i")) + 1).alias("sort"), none.alias("pos")).withColumn("pos", none))
    # taken numbers may share a sort value; they are told apart by nothing, and needn't be
    ranked = numbered(both.withColumn("tie", F.monotonically_increasing_id()), "dest", "sort", "tie", out="n").where("pos IS NOT NULL").select(F.col("pos").alias("__pos"), "n")
    renamed = claims.join(ranked, claims.pos == ranked["__pos"], "left")
    final = F.when(F.col("n").isNull(), F.col("dest")).otherwise(_with_number(F.col("dest"), F.col("n")))
    done = renamed.select("pos", "source", "dest", final.alias("final"), F.when(F.col("n").isNull(), "moved").otherwise("collision_renamed").alias("action"))
    rest = d.where("NOT (there AND source <> dest)")
    return done.unionByName(rest.select("pos", "source", "dest", "dest", F.when(F.col("there"), "already_correct").otherwise("error")).toDF("pos", "source", "dest", "final", "action"))


def depths(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pos, depth) of chains, (pos) of cycles) of links (pos, next), each next being one pos's at most: depth counts the links to a chain's end."""
    d = written(links.select("pos", "next", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("depth")), "links")
    left = d.where("next IS NOT NULL").count()
    while left:
        to = d.select(F.col("pos").alias("next"), F.col("next").alias("further"), F.col("depth").alias("more"))
        d = written(d.join(to, "next", "left").select("pos", F.col("further").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "jumped")
        now = d.where("next IS NOT NULL").count()
        if now == left:  # a chain has links of every length, so some would have ended
            break
        left = now
    return d.where("next IS NULL").select("pos", "depth"), d.where("next IS NOT NULL").select("pos")


def _leaders(ring: DataFrame) -> DataFrame:
    """(pos, leader) of rings (pos, next): the least pos of each ring."""
    d = written(ring.select("pos", "next", F.least("pos", "next").alias("leader")), "ring")
    while True:
        to = d.select(F.col("pos").alias("next"), F.col("next").alias("further"), F.col("leader").alias("theirs"))
        step = written(d.join(to, "next").select("pos", F.col("further").alias("next"), F.least("leader", "theirs").alias("leader"), (F.col("theirs") < F.col("leader")).alias("changed")), "ring")
        if not step.where("changed").limit(1).count():
            return step.select("pos", "leader")
        d = step.drop("changed")


def ordered(places: DataFrame, aside: str = ".moving") -> DataFrame:
    """(step, pos, source, dest, action) of placed moves: moves of one step meet none of each other's places, and each one's place is free once the steps before are done. A ring
    begins by setting a folder aside; those that move nowhere have no step."""
    p = written(places, "places")
    moves = p.where("action IN ('moved', 'collision_renamed')")
    links = moves.alias("a").join(moves.alias("b"), F.col("a.final") == F.col("b.source"), "left").select("a.pos", F.col("b.pos").alias("next"))
    links = written(links, "frees")
    chains, rings = depths(links)
    rings = written(links.join(rings, "pos", "left_semi"), "rings")
    steps = chains.select("pos", F.col("depth").alias("step"))
    first = rings.limit(0).select("pos")
    if rings.limit(1).count():
        leaders = _leaders(rings)
        first = written(leaders.where("pos = leader").select("pos"), "leaders")
        cut = rings.join(first.withColumn("leads", F.lit(True)), "pos", "left")
        opened, _ = depths(cut.select("pos", F.when(F.col("leads"), None).otherwise(F.col("next")).alias("next")))
        # the leader's own place is the last to become free
        last = cut.where("leads").join(opened.select(F.col("pos").alias("next"), "depth"), "next").select("pos", (F.col("depth") + 1).alias("step"))
        steps = steps.unionByName(opened.join(first, "pos", "left_anti").select("pos", F.col("depth").alias("step"))).unionByName(last)
    led = first.withColumn("leads", F.lit(True))
    away = F.concat("source", F.lit(aside))
    d = moves.join(steps, "pos").join(led, "pos", "left")
    out = d.select("step", "pos", F.when(F.col("leads"), away).otherwise(F.col("source")).alias("source"), F.col("final").alias("dest"), "action")
    out = out.unionByName(d.where("leads").select(F.lit(0).cast("long").alias("step"), "pos", "source", away.alias("dest"), F.lit("set_aside").alias("action")))
    rest = p.where("action NOT IN ('moved', 'collision_renamed')")
    return out.unionByName(rest.select(F.lit(None).cast("long").alias("step"), "pos", "source", F.col("final").alias("dest"), "action"))


def plan(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """The ordered plan of wanted moves (pos, source, dest) among existing folders (path)."""
    return ordered(placed(wanted, existing))
