"""The review table: carry-over of decisions, pruning, paths, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carried_over(new: DataFrame, prior: DataFrame, key: str = "uuid") -> DataFrame:
    """New entries with earlier decisions: a decided entry stays as it was but for its path; an undecided one is renewed with its notes;
    one that was not processed now is appended. Entries without a key are dropped from the prior table; of repeated ones the last counts."""
    last = prior.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("action", "proposed", "notes", "path"), "pos").alias("p"))
    both = new.select(key, F.struct("action", "proposed", "path").alias("n")).join(last, key, "full_outer")
    decided = F.col("p.action").isNotNull()
    return both.select(
        key,
        F.when(decided | F.col("n").isNull(), F.col("p.action")).otherwise(F.col("n.action")).alias("action"),
        F.when(decided | F.col("n").isNull(), F.col("p.proposed")).otherwise(F.col("n.proposed")).alias("proposed"),
        F.col("p.notes").alias("notes"), F.coalesce("n.path", "p.path").alias("path"),
        F.when(F.col("n").isNull(), "carried").when(decided, "kept").otherwise("built").alias("state"),
    )


def pruned(entries: DataFrame, drop: DataFrame, key: str = "uuid") -> DataFrame:
    """Entries whose key is not to be dropped; those without a key stay."""
    return entries.join(drop.select(key).distinct(), key, "left_anti")


def repointed(entries: DataFrame, moves: DataFrame, key: str = "uuid") -> DataFrame:
    """Entries with the new path of each moved record, and whether it changed."""
    new = moves.groupBy(key).agg(F.max("new_path").alias("__new"))
    out = entries.join(new, key, "left")
    return out.withColumn("changed", F.col("__new").isNotNull() & ~F.col("path").eqNullSafe(F.col("__new"))).withColumn("path", F.coalesce("__new", "path")).drop("__new")


def apply_plan(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """What applying would do to each entry: skip without action, error for an unknown action or a folder that is not there, delete, or write."""
    there = folders.select("path", F.lit(True).alias("__there"))
    d = entries.join(there, "path", "left")
    step = (
        F.when(F.col("action").isNull(), "skipped").when(~F.col("action").isin("accept", "keep", "delete"), "error").when(F.col("__there").isNull(), "error")
        .when(F.col("action") == "delete", "deleted").when(F.col("action") == "keep", "kept").otherwise("applied")
    )
    return d.withColumn("step", step).drop("__there")


ENTRY_FIELDS = ("title", "isbn", "year", "publisher", "language")


def current_block(df: DataFrame) -> Column:
    """The record as an entry shows it, as JSON: first author, all authors if several, the other fields; what is null is left out."""
    author = F.get("authors", F.lit(0))
    several = F.when(F.size("authors") > 1, F.col("authors"))
    series = [F.when(F.coalesce(c, F.lit("")) != "", F.col(c)).alias(k) for c, k in (("series_name", "series"), ("series_index", "series_index")) if c in df.columns]
    return F.to_json(F.struct(author.alias("author"), several.alias("authors"), *ENTRY_FIELDS, *series))


def entries(df: DataFrame, prior: DataFrame, root: str = "/lib") -> DataFrame:
    """Review entries of records (id, uuid, path, diagnoses, proposed, action beside the fields): a decided earlier entry keeps its action and its proposal
    as they were; `diagnoses` only where there are several; verified marks and notes are carried along."""
    last = prior.where(F.col("uuid").isNotNull()).groupBy("uuid").agg(F.max_by(F.struct("action", "proposed", "notes", "verified"), "pos").alias("p"))
    decided = F.col("p.action").isNotNull()
    short = lambda d: F.struct(d["category"].alias("category"), d["reason"].alias("reason"), d["confidence"].alias("confidence"))
    path = F.when(F.col("path").startswith(root + "/"), F.substr("path", F.lit(len(root) + 2))).otherwise(F.col("path"))
    return df.join(last, "uuid", "left").select(
        "id", "uuid", path.alias("path"), short(F.get("diagnoses", F.lit(0))).alias("diagnosis"), F.when(F.size("diagnoses") > 1, F.transform("diagnoses", short)).alias("diagnoses"),
        current_block(df).alias("current"), F.when(decided, F.col("p.proposed")).otherwise(F.col("proposed")).alias("proposed"), F.coalesce("p.action", "action").alias("action"),
        F.when(F.col("p.verified"), True).alias("verified"), F.col("p.notes").alias("notes"),
    )


def preserved(proposed: Column) -> Column:
    """A lookup record again from a stored proposal (a map): authors of the single one unless the list is there; the source defaults to `preserved`."""
    listed = F.from_json(proposed["authors"], "array<string>")
    authors = F.coalesce(listed, F.when(F.coalesce(proposed["author"], F.lit("")) != "", F.array(proposed["author"])), F.array().cast("array<string>"))
    source = F.when(F.coalesce(proposed["source"], F.lit("")) != "", proposed["source"]).otherwise("preserved")
    return F.struct(*[proposed[k].alias(k) for k in ("title", "isbn", "publisher", "language", "series", "series_index")], proposed["year"].try_cast("int").alias("year"), authors.alias("authors"), proposed["reasoning"].alias("description"), source.alias("source"))


def applied_plan(entries: DataFrame, records: DataFrame, occupants: DataFrame) -> DataFrame:
    """What applying does to each entry (uuid, path, action): `step` skipped, error, deleted, kept or applied; for the last two `placement`: already_placed, merged (the
    place is taken by the same book; the approved record is the base), moved_to_root or moved_to_needfix; `final` where the folder ends up (a place taken by
    another book is numbered); `pruned` if the entry then leaves the table.

    records: the folders there are, with `area` and `dest` of their final fields, isbn, title, first author, year. occupants: (dest, o_path, o_isbn, o_title, o_author, o_year).
    Places are matched exactly here: equal ISBN, or equal normalised title and author unless both years differ."""
    known = records.select("path", "area", "dest", "isbn", "title", "author", "year", F.lit(True).alias("__there"))
    d = entries.join(known, "path", "left").join(occupants, "dest", "left")
    a = F.col("action")
    step = (
        F.when(a.isNull(), "skipped").when(~a.isin("accept", "keep", "delete"), "error").when(F.col("__there").isNull(), "error")
        .when(a == "delete", "deleted").when(a == "keep", "kept").otherwise("applied")
    )
    writes = F.col("__step").isin("kept", "applied")
    taken = F.col("o_path").isNotNull() & (F.col("o_path") != F.col("path"))
    alike = (F.col("title") == F.col("o_title")) & (F.col("author") == F.col("o_author")) & F.coalesce(F.col("year") == F.col("o_year"), F.lit(True))
    same = F.coalesce(F.col("isbn") == F.col("o_isbn"), F.lit(False)) | F.coalesce(alike, F.lit(False))
    placement = F.when(F.col("dest") == F.col("path"), "already_placed").when((F.col("area") == "ok") & taken & same, "merged").when(F.col("area") == "ok", "moved_to_root").otherwise("moved_to_needfix")
    final = F.when(F.col("placement").isin("already_placed", "merged") | ~taken, F.col("dest")).otherwise(F.concat("dest", F.lit(" (dup 1)")))
    d = d.withColumn("__step", step).withColumn("placement", F.when(writes, placement))
    d = d.withColumn("final", F.when(F.col("placement").isNotNull(), final))
    pruned = F.col("__step").isin("applied", "deleted") & F.col("uuid").isNotNull()
    return d.select("uuid", "path", "action", F.col("__step").alias("step"), "placement", "final", pruned.alias("pruned"))


def apply_summary(plan: DataFrame) -> DataFrame:
    """One row of counters over a plan."""
    n = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(v)
    return plan.agg(*[n("step", v) for v in ("applied", "kept", "deleted", "error")], *[n("placement", v) for v in ("moved_to_root", "moved_to_needfix", "already_placed", "merged")], F.count_if("pruned").alias("pruned"))


def unverified(manifest: Column) -> Column:
    """(manifest without its `verified` key, was it there), of a JSON text."""
    v = F.try_parse_json(manifest)
    had = F.try_variant_get(v, "$.verified", "string").isNotNull()
    kept = F.map_filter(F.from_json(manifest, "map<string, variant>"), lambda k, x: k != "verified")
    return F.struct(F.when(had, F.to_json(kept)).otherwise(manifest).alias("manifest"), had.alias("removed"))
