"""Where records belong, and what to do when several claim one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import names
from quirework.operators import rules


def _fields() -> dict[str, Column]:
    return {"authors": F.col("authors"), "title": F.col("title"), "id": F.col("id"), "isbn": F.col("isbn"), "year": F.col("year"), "language": F.col("language"), "series": F.col("series_name"), "series_index": F.col("series_index")}


def placed(books: DataFrame, pattern: str = "{author}/{title} ({id})", root: str = "/lib") -> DataFrame:
    """books with `area` (ok, needfix) and `dest`: no formats: needfix/empty, verified or clean: the pattern's place, else needfix."""
    d = rules.detect(books)
    good = (F.col("primary.verdict") == "OK") | rules.acceptable_missing(F.col("primary"), F.col("diagnoses"))
    rel = F.regexp_replace(F.substr(F.col("path"), F.lit(len(root) + 2)), "^needfix/(?:empty/(?=.))?(?=.)", "")
    none, ok = F.size("formats") == 0, F.col("verified") | good
    dest = (
        F.when(none, F.concat(F.lit(f"{root}/needfix/empty/"), rel))
        .when(ok, names.target_path(_fields(), pattern, root))
        .otherwise(names.needfix_path(F.col("path"), F.col("author_folder"), F.col("title_folder"), root))
    )
    return d.withColumn("area", F.when(none | ~ok, "needfix").otherwise("ok")).withColumn("dest", dest)


def base_order(isbn: str = "isbn", key: str = "id") -> list[Column]:
    """Order in which a group's base record comes first: a valid ISBN, then the lowest id."""
    return [F.col(isbn).isNull(), F.col(key).asc_nulls_last()]


def merged(books: DataFrame, group: str) -> DataFrame:
    """One record for each group: the base's scalars, gaps filled in order of preference, authors united ignoring case.

    Scalars are aggregates with map-side combine (min_by over the order), so a large group never meets in one row; only its distinct
    authors do."""
    order = F.struct(F.col("isbn").isNull().alias("a"), F.col("id").alias("b"))
    first = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)) if dict(books.dtypes)[c] == "string" else F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), order)).alias(c)
    scalars = books.groupBy(group).agg(F.min_by("id", order).alias("base_id"), first("title"), first("isbn"), first("publisher"), first("language"), first("year"), F.count("*").alias("members"))
    at = books.select(group, order.alias("o"), F.posexplode("authors").alias("p", "a"))
    one = at.groupBy(group, F.lower("a").alias("k")).agg(F.min(F.struct("o", "p", "a")).alias("m"))
    authors = one.groupBy(group).agg(F.sort_array(F.collect_list("m")).alias("ms")).select(group, F.transform("ms", lambda m: m["a"]).alias("authors"))
    return scalars.join(authors, group, "left")


def duplicates_numbered(claims: DataFrame, dest: str = "dest", order: str = "id") -> DataFrame:
    """claims with `final`: the first claimant keeps the place, the n-th following gets ' (dup n)'."""
    n = F.row_number().over(Window.partitionBy(dest).orderBy(order)) - 1
    return claims.withColumn("final", F.when(n == 0, F.col(dest)).otherwise(F.concat(F.col(dest), F.lit(" (dup "), n.cast("string"), F.lit(")"))))


def disambiguated(claims: DataFrame, dest: str = "dest") -> DataFrame:
    """claims with `final`: alone on a place: the place; several: by year if all have years and these differ, else by id;
    what is in the name already can't tell them apart: the place itself (a move then numbers it)."""
    stats = claims.groupBy(dest).agg(F.count("*").alias("__n"), F.count("year").alias("__years"), F.count_distinct("year").alias("__distinct"))
    by_year = (F.col("__years") == F.col("__n")) & (F.col("__distinct") == F.col("__n"))
    name = F.element_at(F.split(dest, "/"), -1)
    value = F.when(by_year, F.col("year").cast("string")).otherwise(F.col("id").cast("string"))
    suffix = F.when(by_year, F.concat(F.lit(" ("), value, F.lit(")"))).otherwise(F.concat(F.lit(" (id"), value, F.lit(")")))
    there = F.contains(name, F.concat(F.lit("("), value, F.lit(")"))) | (~by_year & F.contains(name, F.concat(F.lit("(id"), value, F.lit(")"))))
    final = F.when(F.col("__n") == 1, F.col(dest)).when(value.isNull() | there, F.col(dest)).otherwise(F.concat(F.col(dest), suffix))
    return claims.join(stats, dest).withColumn("final", final).drop("__n", "__years", "__distinct")
