"""The lookup cascade as joins with source tables, its cache, and what a proposal becomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import constants as C


def cache_key(isbn: Column, title: Column, author: Column, year: Column) -> Column:
    """One text for one query: the keys in order, shortened and in lower case."""
    lower = lambda c, n: F.left(F.lower(F.coalesce(c, F.lit(""))), F.lit(n))
    return F.to_json(F.struct(lower(author, 50).alias("author"), isbn.alias("isbn"), lower(title, 80).alias("title"), year.alias("year")), {"ignoreNullFields": "false"})


def live(cache: DataFrame, as_of: Column, days: int = C.NEGATIVE_TTL_DAYS) -> DataFrame:
    """Rows of a cache that still answer: found ones always, not-found ones for `days` (never expiring if 0)."""
    if days <= 0:
        return cache
    return cache.where(F.col("found") | (F.datediff(as_of, F.col("cached_at")) <= days))


def first_hit(queries: DataFrame, sources: list[tuple[str, DataFrame]], key: str = "id") -> DataFrame:
    """queries with the answer of the first source that has one. Each source is (name, rows of key and values); one shuffle of the
    small answers picks the first by priority with min_by, so the queries are joined once."""
    rows = [s.select(key, F.lit(i).alias("rank"), F.lit(n).alias("source"), F.struct(*[c for c in s.columns if c != key]).alias("hit")) for i, (n, s) in enumerate(sources)]
    best = reduce(DataFrame.unionByName, rows).groupBy(key).agg(F.min_by(F.struct("source", "hit"), "rank").alias("best"))
    return queries.join(best, key, "left")


def best_candidate(candidates: DataFrame, key: str = "id", floor: float = C.LOOKUP_MATCH) -> DataFrame:
    """Of each query's candidates (score, year, want_year, pos) the best of at least `floor`: within a year of the wanted one if
    there are such, then by score, then in the given order."""
    good = candidates.where(F.col("score") >= floor)
    near = F.coalesce(F.abs(F.col("year") - F.col("want_year")) <= 1, F.lit(False))
    w = Window.partitionBy(key).orderBy(near.desc(), F.col("score").desc(), "pos")
    return good.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def confidence(source: Column) -> Column:
    return F.when(source.isin(C.SOURCE_HIGH), "high").when(source.isin(C.SOURCE_MEDIUM), "medium").otherwise("low")


def prefilled(category: Column, verdict: Column, others: Column, source: Column, confirmed: Column, proposed: Column, keeps_identity: Column, cover_url: Column) -> Column:
    """The action a reviewer finds: delete for lock files, accept where it is safe, else null.

    others: array of (category, verdict) of all findings; proposed: is anything proposed."""
    level = confidence(source)
    has = source.isNotNull()
    covers = category.isin("C11", "MISSING_COVER")
    benign = F.forall(others, lambda d: d["category"].isin("C13", "EMPTY_BOOK", "MISSING_ISBN", "MISSING_YEAR", "MISSING_COVER") | (d["verdict"] == "OK"))
    return F.coalesce(
        F.when((category == "C6") & (verdict == "AUTO_FIXABLE"), "delete"),
        F.when(has & proposed & (confirmed | (level == "high")), "accept"),
        F.when(has & proposed & (level == "medium") & keeps_identity, "accept"),
        F.when(covers & proposed & cover_url.isNotNull(), "accept"),
        F.when(covers & ~proposed, "accept"),
        F.when(has & confirmed & ~proposed, "accept"),
        F.when(category.isin("C13", "EMPTY_BOOK") & benign, "accept"),
    )


def applied(df: DataFrame, keys: str, values: dict[str, str], fields: dict[str, str] | None = None) -> DataFrame:
    """df with proposed fields applied: a present key sets, a present null clears, an absent key keeps.

    keys: array column of the present keys; values: field to column of its proposed value. `author` replaces the first author only."""
    out = {}
    for f, v in values.items():
        has, new = F.array_contains(keys, f), F.nullif(F.col(v), F.lit("")) if dict(df.dtypes)[v] == "string" else F.col(v)
        if f == "author":
            rest = F.when(F.size("authors") > 1, F.slice("authors", 2, F.greatest(F.size("authors") - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
            cleared = F.array().cast("array<string>")
            out["authors"] = F.when(has, F.when(new.isNotNull(), F.concat(F.array(new), rest)).otherwise(cleared)).otherwise(F.col("authors"))
        else:
            out[f] = F.when(has, F.coalesce(new, F.lit("")) if f == "title" else new).otherwise(F.col(f))
    return df.withColumns(out)
