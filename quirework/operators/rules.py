"""The quality rules: each a nullable struct of category, reason, confidence and verdict, as a column expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import constants as C
from quirework.functions.names import anonym, czech, fold, foreign, target_path


def _found(when: Column, category: str, confidence: str, verdict: str, reason: Column | str) -> Column:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(category).alias("category"), r.alias("reason"), F.lit(confidence).alias("confidence"), F.lit(verdict).alias("verdict")))


def _names() -> Column:
    """The folder, then the authors."""
    return F.concat(F.array("author_folder"), F.col("authors"))


def empty_book() -> Column:
    side = lambda f: F.lower(f).isin("metadata.json", "metadata.opf", "cover.jpg") | F.lower(f).rlike(r"\.(bak|tmp)$")
    return _found(F.forall("files", side), "EMPTY_BOOK", "HIGH", "AUTO_FIXABLE", "only metadata, backups and cover are left")


def lock_file() -> Column:
    return _found(F.exists(_names(), lambda a: a.startswith("~$")), "C6", "HIGH", "AUTO_FIXABLE", "author begins with ~$")


def bad_author() -> Column:
    artefact = lambda a: a.rlike(r"^[_*]")
    lower = lambda a: a.rlike(f"^[^{C.CAPITALS}]+$") & a.rlike(r"\p{L}")
    hit = F.get(F.filter(_names(), lambda a: (a != "") & ~anonym(a) & (artefact(a) | lower(a))), F.lit(0))
    return _found(hit.isNotNull(), "C12", "HIGH", "NEEDS_REVIEW", F.concat(F.when(artefact(hit), "artefact prefix in author: ").otherwise("all-lowercase author: "), hit))


def placeholder() -> Column:
    is_ = lambda s: F.lower(s).isin(C.PLACEHOLDER)
    return _found(is_(F.col("title")) | F.exists("authors", is_), "C5", "HIGH", "NEEDS_REVIEW", F.concat(F.lit("placeholder record: "), F.col("title")))


def encoding() -> Column:
    return _found(F.size("bad_fields") > 0, "C4", "HIGH", "NEEDS_REVIEW", F.concat(F.lit("unrepairable fields: "), F.array_join("bad_fields", ", ")))


def primary_stem(file: Column) -> Column:
    """A file's name without folders, extension and the last ' - part'."""
    name = F.element_at(F.split(file, "/"), -1)
    stem = F.regexp_replace(name, r"(?i)\.(" + "|".join(C.STEM_EXTENSIONS) + r")$", "")
    return F.trim(F.regexp_replace(stem, r"\s*-\s*[^-]+$", ""))


def filename_title() -> Column:
    t = F.col("title")
    stem = primary_stem(F.col("primary_file"))
    strong = F.concat_ws(
        "; ", F.when(t.rlike("(?i)" + C.TITLE_EXTENSION), "file extension in title"), F.when(t.rlike("(?i)" + C.WORD_PREFIX), "word processor prefix"),
        F.when(t.rlike(C.TRUNCATED), "truncated slug marker"), F.when((stem != "") & (F.lower(stem) == F.lower(t)), "title is the file's stem"),
    )
    bars = F.char_length(t) - F.char_length(F.replace(t, F.lit("_"), F.lit("")))
    weak = _found(bars >= 3, "C2", "MEDIUM", "NEEDS_REVIEW", F.concat(bars.cast("string"), F.lit(" underscores in title")))
    return F.coalesce(_found(strong != "", "C2", "HIGH", "NEEDS_REVIEW", strong), weak)


def glued_authors() -> Column:
    hit = F.get(F.filter("authors", lambda a: a.rlike(C.GLUED)), F.lit(0))
    return _found(hit.isNotNull(), "C7", "MEDIUM", "NEEDS_REVIEW", F.concat(F.lit("glued author: "), hit))


def _clean(name: Column) -> Column:
    tokens = F.filter(F.split(name, r"\s+"), lambda t: t != "")
    return (name != "") & ~name.contains("_") & ~name.rlike("(?i)" + C.TITLE_EXTENSION) & ~name.rlike(r"[^\x{0}-\x{2000}]") & (F.size(tokens) < 4)


def swap() -> Column:
    low = F.lower(fold(F.col("title")))
    tokens = F.flatten(F.transform(F.filter("authors", _clean), lambda a: F.split(F.lower(fold(a)), "[^a-z]+")))
    hit = F.get(F.filter(tokens, lambda t: (F.char_length(t) >= 5) & ~t.isin(C.COMMON_WORDS) & F.contains(low, t) & (F.char_length(low) >= F.char_length(t) + 2)), F.lit(0))
    folder = F.filter(F.split("author_folder", r"[\s_-]+"), lambda t: t != "")
    title = F.filter(F.split("title", r"\s+"), lambda t: t != "")
    named = F.size(title).between(1, 3) & F.forall(title, lambda t: t.rlike(r"^(\p{Lu}|\P{L})"))
    second = _clean(F.col("author_folder")) & (F.size(folder) >= 4) & ~F.exists(folder, lambda t: F.lower(t).isin(C.CZ_NAMES)) & named
    return F.coalesce(
        _found(hit.isNotNull(), "C1", "MEDIUM", "NEEDS_REVIEW", F.concat(F.lit("surname in title: "), hit)),
        _found(second, "C1", "MEDIUM", "NEEDS_REVIEW", "folder looks like a title, title like a name"),
    )


def series_author() -> Column:
    hit = F.get(F.filter(_names(), lambda a: a.rlike("(?iu)" + C.SERIES_AUTHOR)), F.lit(0))
    return _found(hit.isNotNull(), "C3", "MEDIUM", "NEEDS_REVIEW", F.concat(F.lit("series marker in author: "), hit))


def translator() -> Column:
    cz, other, n = F.filter("authors", czech), F.filter("authors", foreign), F.size("authors")
    likely = (n >= 2) & (F.size(other) == 1) & F.size(cz).between(1, 2)
    reason = F.concat(F.lit("likely translator: "), F.array_join(cz, ", "), F.lit(" of "), F.array_join(other, ", "))
    return F.coalesce(_found(likely, "C8", "MEDIUM", "NEEDS_REVIEW", reason), _found(n >= 4, "C10", "LOW", "NEEDS_REVIEW", F.concat(n.cast("string"), F.lit(" authors"))))


def anonymous() -> Column:
    is_ = F.exists(_names(), lambda a: (a != "") & anonym(a)) & ~F.exists("authors", lambda a: (a != "") & ~anonym(a))
    genuine = F.col("title").rlike("(?iu)" + C.ANONYM_WORKS)
    return F.coalesce(
        _found(is_ & genuine, "C9", "HIGH", "OK", "genuine anonymous work"),
        _found(is_, "C9", "MEDIUM", "NEEDS_REVIEW", F.concat(F.lit("anonymous author, lost for: "), F.col("title"))),
    )


def location(pattern: str = "{author}/{title} ({id})", root: str = "/lib") -> Column:
    target = target_path({"authors": F.col("authors"), "title": F.col("title"), "id": F.col("id"), "isbn": F.col("isbn"), "year": F.col("year"), "language": F.col("language"), "series": F.col("series_name"), "series_index": F.col("series_index")}, pattern, root)
    return _found(F.col("path") != target, "C13", "HIGH", "AUTO_FIXABLE", F.concat(F.lit("belongs in "), F.substr(target, F.lit(len(root) + 2))))


def missing_isbn() -> Column:
    return _found(F.coalesce(F.col("isbn"), F.lit("")) == "", "MISSING_ISBN", "LOW", "AUTO_FIXABLE", "no valid ISBN")


def missing_year() -> Column:
    return _found(F.col("year").isNull(), "MISSING_YEAR", "LOW", "AUTO_FIXABLE", "no year")


def generated_cover() -> Column:
    """Needs a column cover_score (from the cover analysis)."""
    has = F.exists("files", lambda f: f == "cover.jpg")
    return _found(has & (F.col("cover_score") >= 0.5), "C11", "HIGH", "NEEDS_REVIEW", "generated cover")


def missing_cover() -> Column:
    return _found(~F.exists("files", lambda f: f == "cover.jpg"), "MISSING_COVER", "LOW", "AUTO_FIXABLE", "no cover.jpg")


STRUCTURAL = {
    "empty_book": empty_book, "c6": lock_file, "c12": bad_author, "c5": placeholder, "c4": encoding, "c2": filename_title,
    "c7": glued_authors, "c1": swap, "c3": series_author, "c8": translator, "c9": anonymous,
}
ENRICHMENT = {"missing_isbn": missing_isbn, "missing_year": missing_year, "missing_cover": missing_cover}


def detect_all(books: DataFrame, with_location: bool = False, with_covers: bool = False) -> DataFrame:
    """books with `diagnoses`: all that fire, in order of priority; [OK] if none."""
    rules = [*STRUCTURAL.values(), *([location] if with_location else []), missing_isbn, missing_year, *([generated_cover] if with_covers else []), missing_cover]
    ok = F.array(F.struct(F.lit("OK").alias("category"), F.lit("").alias("reason"), F.lit("HIGH").alias("confidence"), F.lit("OK").alias("verdict")))
    # one column for each rule keeps every projection small enough for compiled code
    named = books.select("*", *[r().alias(f"__rule_{i}") for i, r in enumerate(rules)])
    found = F.array_compact(F.array(*[F.col(f"__rule_{i}") for i in range(len(rules))]))
    # the partition's number is never below 0; being nondeterministic, it keeps filters on the result above this projection, where
    # the optimiser would otherwise copy every rule into them
    pinned = (F.size(found) == 0) & (F.spark_partition_id() >= 0)
    done = named.withColumn("diagnoses", F.when(pinned, ok).otherwise(found))
    return done.drop(*[f"__rule_{i}" for i in range(len(rules))])


def detect(books: DataFrame, **how) -> DataFrame:
    """books with `diagnoses` and `primary`: the first, unless it is OK and a location follows, which is then promoted."""
    done = detect_all(books, **how)
    first = F.get("diagnoses", F.lit(0))
    moved = F.get(F.filter("diagnoses", lambda d: d["category"] == "C13"), F.lit(0))
    return done.withColumn("primary", F.when((first["verdict"] == "OK") & moved.isNotNull(), moved).otherwise(first))


def acceptable_missing(primary: Column, diagnoses: Column) -> Column:
    """Only data is missing: no other finding of the record needs review."""
    return primary["category"].isin("MISSING_ISBN", "MISSING_YEAR", "MISSING_COVER") & ~F.exists(diagnoses, lambda d: d["verdict"] == "NEEDS_REVIEW")


def any_rule(names: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [(STRUCTURAL | ENRICHMENT)[n]().isNotNull() for n in names])
