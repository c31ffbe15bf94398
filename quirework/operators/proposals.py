"""What a record should become: proposals built from evidence, checked against content, projected and edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import constants as C
from quirework.functions import fuzzy, text
from quirework.operators import content, rules

FIELDS = ("title", "author", "isbn", "year", "publisher", "language", "cover_url", "location")
#: Names that are no author, and sources that are believed without comparison.
NO_AUTHOR = ["Neznamy", "Unknown", "anonym", "Anonymous"]


def _set(s: Column) -> Column:
    return F.coalesce(s.cast("string"), F.lit("")) != ""


def trusted(source: Column, confirmed: Column) -> Column:
    return source.startswith("llm:") | (source == "databazeknih") | F.coalesce(confirmed, F.lit(False))


def built(df: DataFrame) -> DataFrame:
    """df with `proposed`: a map of proposed fields as texts, null if nothing is proposed; `source` in it names where they come from.

    Needs title, author, isbn, year, publisher, language, categories (array); evidence x_title, x_author, x_isbn, x_text_isbn; a lookup
    e_title, e_author, e_isbn, e_year, e_publisher, e_language, e_cover_url, e_source, e_confirmed; location. What the book itself says comes
    before what was looked up; a location or swap only where the rules found one."""
    c, src = F.col, F.col("e_source")
    better = lambda new, old: _set(c(new)) & text.is_better(c(new), F.coalesce(c(old), F.lit("")))
    believe = trusted(src, c("e_confirmed"))
    has = lambda cat: F.array_contains("categories", cat)
    swapped = has("C1") & _set(c("title")) & _set(c("author"))
    real = _set(c("e_author")) & ~c("e_author").isin(NO_AUTHOR)
    changed = lambda f: _set(c(f"e_{f}")) & (~_set(c(f)) | (c(f"e_{f}").cast("string") != c(f).cast("string")))
    pick = {
        "isbn": [(_set(c("x_isbn")) & ~c("x_isbn").eqNullSafe(c("isbn")), c("x_isbn"), F.lit("embedded")), (_set(c("x_text_isbn")) & ~_set(c("x_isbn")) & ~_set(c("isbn")), c("x_text_isbn"), F.lit("content")), (_set(c("e_isbn")), c("e_isbn"), src)],
        "title": [(better("x_title", "title"), c("x_title"), F.lit("embedded")), (_set(c("e_title")) & (believe | better("e_title", "title")), c("e_title"), src), (swapped, c("author"), F.lit("swap"))],
        "author": [(better("x_author", "author"), c("x_author"), F.lit("embedded")), (real & (believe | better("e_author", "author")), c("e_author"), src), (swapped, c("title"), F.lit("swap"))],
        **{f: [(changed(f), c(f"e_{f}").cast("string"), src)] for f in ("year", "publisher", "language")},
        "cover_url": [(_set(c("e_cover_url")) & (has("C11") | has("MISSING_COVER")), c("e_cover_url"), src)],
        "location": [(has("C13") & ~has("EMPTY_BOOK") & _set(c("location")), c("location"), F.lit("location"))],
    }
    first = {f: F.coalesce(*[F.when(w, F.struct(v.cast("string").alias("v"), s.alias("s"))) for w, v, s in ways]) for f, ways in pick.items()}
    d = df.withColumns({f"__{f}": e for f, e in first.items()})
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("k"), c(f"__{f}")["v"].alias("v"), c(f"__{f}")["s"].alias("s")) for f in pick]), lambda e: e["v"].isNotNull())
    sources = F.array_join(F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["s"]))), "+")
    whole = F.concat(F.transform(entries, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))), F.array(F.struct(F.lit("source").alias("k"), sources.alias("v"))))
    return d.withColumn("proposed", F.when(F.size(entries) > 0, F.map_from_entries(whole))).drop(*[f"__{f}" for f in pick])


def identity_agrees(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """df with `agrees`: of title, first author and number, those that both sides have are alike."""
    pair = lambda f: (F.col(f"{a}_{f}"), F.col(f"{b}_{f}"))
    alike = lambda f: F.when(_set(pair(f)[0]) & _set(pair(f)[1]), fuzzy.token_sort(text.caseless(pair(f)[0]), text.caseless(pair(f)[1])) >= 100 * C.STRONG)
    number = F.when(_set(pair("isbn")[0]) & _set(pair("isbn")[1]), pair("isbn")[0] == pair("isbn")[1])
    return df.withColumn("agrees", F.coalesce(alike("title"), F.lit(True)) & F.coalesce(alike("author"), F.lit(True)) & F.coalesce(number, F.lit(True)))


def verified(df: DataFrame) -> DataFrame:
    """df (a proposal's title, authors, isbn beside the content's isbn_from_text, first_page, broader) with `passed` and `feedback`. Title and
    authors are sought in every window, each author for itself."""
    windows = content.windows()
    d = content.scored(df, authors=F.col("authors"), texts=windows)
    someone = F.exists(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")
    conflict = F.coalesce(F.col("isbn") != F.col("isbn_from_text"), F.lit(False))
    title, author = F.col("title_score") >= C.STRONG, F.col("author_score") >= C.STRONG
    alone = (F.char_length(text.normalise(F.coalesce("title", F.lit("")))) >= 10) & (F.col("title_score") >= C.TITLE_ONLY)
    number = content.isbn_in_content(F.col("isbn"), F.col("isbn_from_text"), windows)
    why = F.concat_ws("; ", F.when(_set(F.col("title")) & ~title, F.lit("the title is not in the text")), F.when(someone & ~author, F.lit("no author is in the text")))
    feedback = F.when(F.size(windows) == 0, "").when(conflict, "the text has another ISBN").when((title & author) | alone | number, "").otherwise(why)
    return d.withColumn("feedback", feedback).withColumn("passed", F.col("feedback") == "")


def projected_clean(df: DataFrame, proposed: str = "proposed") -> DataFrame:
    """df with `clean`: with the proposal applied no rule fires, a cover to be fetched and a move to be made counting as done."""
    get = lambda k: F.col(proposed)[k]
    has = lambda k: F.coalesce(F.map_contains_key(proposed, F.lit(k)), F.lit(False))
    rest = F.when(F.size("authors") > 1, F.slice("authors", 2, F.greatest(F.size("authors") - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    after = df.withColumns(
        {
            "title": F.when(has("title"), F.coalesce(get("title"), F.lit(""))).otherwise(F.col("title")), "isbn": F.when(has("isbn"), get("isbn")).otherwise(F.col("isbn")),
            "year": F.when(has("year"), get("year").try_cast("int")).otherwise(F.col("year")),
            "authors": F.when(has("author"), F.when(_set(get("author")), F.concat(F.array(get("author")), rest)).otherwise(F.array().cast("array<string>"))).otherwise(F.col("authors")),
        }
    )
    d = rules.detect_all(after)
    bad = lambda x: (x["verdict"] != "OK") & (x["category"] != "C13") & ~(x["category"].isin("C11", "MISSING_COVER") & has("cover_url"))
    return d.withColumn("clean", ~F.exists("diagnoses", bad))


def overlay(fields: dict[str, Column], cleared: Column) -> Column:
    """An editor's non-empty fields as a map, cleared ones as null."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in fields.items()]), lambda e: _set(e["v"]) | F.array_contains(cleared, e["k"]))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"].alias("k"), F.when(~F.array_contains(cleared, e["k"]), e["v"]).alias("v"))))


def edited(proposed: Column, changes: Column) -> Column:
    """A proposal with an editor's map laid over it."""
    old = F.coalesce(proposed, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(changes, k)), changes)
