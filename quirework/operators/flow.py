"""The way of one record through the engine, as staged DataFrames: classification, identity, lookups, offline proposals, outcome, counters.

Only rows that a stage decides about reach its content or its joins: the others carry nulls there, and an Arrow matcher sees no row that an earlier
stage has settled. Every stage adds columns; nothing is gathered, and lookups are equi-joins with source tables reduced to one row a key before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import constants as C
from quirework.functions import fuzzy, text
from quirework.operators import content, rules, similar
from quirework.tables import join_checked, written

#: Fields of a proposal that a content or a lookup gives.
FIELDS = ("title", "authors", "isbn", "publisher", "year")
#: Columns of whole texts, which nothing reads once identity and verification are known.
TEXTS = ("text", "first_page", "broader")


def classified(df: DataFrame, accept_missing: bool = True, verify_ok: bool = False, strict: bool = True, title: str = "title", page: str = "first_page") -> DataFrame:
    """df with `diagnoses`, `primary`, `identity`, `identified`, `verdict`. verify_ok: clean records whose content contradicts them (strict: or leaves
    it open) need review. accept_missing: records that only lack data are fine if their content identifies them. Records without a file keep
    what the rules say. title, page: the columns that a verification compares."""
    d = rules.detect(df)
    has_file = F.col("primary_file").isNotNull()
    gate = rules.acceptable_missing(F.col("primary"), F.col("diagnoses")) & has_file & F.lit(accept_missing)
    audit = (F.col("primary")["verdict"] == "OK") & has_file & F.lit(verify_ok)
    d = content.acquire_identity(d.withColumn("__gate", gate))
    d = d.withColumn("identified", F.col("__gate") & F.col("identity").isNotNull())
    if verify_ok:
        d = content.verify(d, audit, title, page).drop("title_score").withColumn("verification", F.when(audit, F.col("result"))).drop("result")
    else:
        d = d.withColumn("verification", F.lit(None).cast("string"))
    bad = F.col("verification").isin("MISMATCH", *(["UNCERTAIN"] if strict else []))
    verdict = F.when(F.coalesce(bad, F.lit(False)), "NEEDS_REVIEW").when(F.col("identified"), "OK").otherwise(F.col("primary")["verdict"])
    return d.withColumn("verdict", verdict).drop("__gate")


def online_fill(df: DataFrame, by_isbn: DataFrame, by_title: DataFrame) -> DataFrame:
    """df (id, identity) with `online`: the record that a lookup gives for the identity, null if none. by_isbn (isbn, source, title, authors, publisher,
    year, rank) is asked for identities with a number; by_title (the same, ranks unique) for others, by similarity of the title and by the identity's year (see
    `similar`), and the first author of what is found must be that of the identity (token-sorted ratio of at least 80, lower case only) if both name one.

    Only distinct titles and years are looked up. df is written as it comes, so a caller drops texts that it no longer needs: planning joins follows their keys down
    through all that they are made from, which in an identity of hundreds of nested expressions takes the driver's memory."""
    df = written(df, "identified")
    hit = F.struct("source", "title", "authors", "isbn", "publisher", "year")
    exact = by_isbn.groupBy(F.col("isbn").alias("__isbn")).agg(F.min_by(hit, "rank").alias("__exact"))
    asks = F.when(F.col("identity")["isbn"].isNull(), F.col("identity")["title"])
    asked = df.select(asks.alias("title"), F.col("identity")["year"].alias("want_year")).where("title <> ''").distinct()
    named = similar.looked_up(asked, by_title.select("title", "year", F.col("rank").cast("long").alias("place"), hit.alias("hit"))).where("found is not null")
    named = written(named.select(F.col("title").alias("__title"), F.col("want_year").alias("__year"), F.col("found.hit").alias("__named")), "named")
    d = df.join(exact, F.col("identity")["isbn"] == F.col("__isbn"), "left")
    d = join_checked(d, named, (asks == F.col("__title")) & F.col("identity")["year"].eqNullSafe(F.col("__year")))
    theirs, ours = (F.lower(F.get(c["authors"], F.lit(0))) for c in (F.col("__named"), F.col("identity")))
    same = F.when(theirs.isNull() | ours.isNull() | (theirs == ours), True).otherwise(fuzzy.token_sort(F.when(theirs != ours, theirs), ours) >= 80)
    found = F.coalesce("__exact", F.when(F.coalesce(same, F.lit(True)), F.col("__named")))
    return d.withColumn("online", found).drop("__isbn", "__exact", "__title", "__year", "__named")


def content_proposal(df: DataFrame) -> DataFrame:
    """df with `offline`: struct of FIELDS, what the content says better than the record, null if nothing: mined from the page first (each mined author against
    the record's first), then embedded title and authors."""
    c, better = F.col, text.is_better
    first = F.get("authors", F.lit(0))
    set_ = lambda x: F.when(F.coalesce(x, F.lit("")) != "", x)
    wins = lambda new, old: F.when(better(set_(new), old), new)
    number = F.coalesce(set_(c("isbn_from_text")), set_(c("x_isbn")))
    mined = F.filter(F.coalesce("authors_from_text", F.array().cast("array<string>")), lambda a: F.coalesce(better(set_(a), first), F.lit(False)))
    embedded = F.coalesce("embedded_authors", F.array().cast("array<string>"))
    some = F.exists(F.arrays_zip(embedded.alias("e"), c("authors").alias("m")), lambda x: F.coalesce((x["m"].isNotNull()) & better(set_(x["e"]), x["m"]), F.lit(False)))
    named = F.filter(embedded, lambda a: (a != "") & (a != "Neznamy") & ~a.contains("_"))
    full = lambda a: F.when(F.size(a) > 0, a)
    year = F.when(c("year").isNull(), c("year_from_text"))
    made = {
        "title": F.coalesce(wins(c("title_from_text"), c("title")), wins(c("embedded_title"), c("title"))),
        "authors": F.coalesce(full(mined), F.when(some, full(named))),
        "isbn": F.when(~number.eqNullSafe(c("isbn")), wins(number, c("isbn"))),
        "publisher": wins(c("publisher_from_text"), c("publisher")),
        "year": year,
    }
    d = df.withColumns({f"__{k}": v for k, v in made.items()})
    any_ = F.coalesce(*[F.when(c(f"__{k}").isNotNull(), True) for k in FIELDS]).isNotNull()
    return d.withColumn("offline", F.when(any_, F.struct(*[c(f"__{k}").alias(k) for k in FIELDS]))).drop(*[f"__{k}" for k in FIELDS])


def deterministic_fix(df: DataFrame, by_isbn: DataFrame, by_title: DataFrame, skip_online: bool = False) -> DataFrame:
    """df with `identity`, `online`, `offline` and `fix`: struct(source, title, authors, isbn, publisher, year) for an identified record: the lookup's, else the content's."""
    d = df if "identity" in df.columns else content.acquire_identity(df)
    if skip_online:
        d = d.withColumn("online", F.lit(None).cast("struct<source: string, title: string, authors: array<string>, isbn: string, publisher: string, year: int>"))
    else:
        d = online_fill(d, by_isbn, by_title)
    d = content_proposal(d)
    own = F.struct(F.lit("content").alias("source"), *[F.col("offline")[k].alias(k) for k in FIELDS])
    order = F.struct(*[F.col("online")[k].alias(k) for k in ("source", *FIELDS)])
    return d.withColumn("fix", F.when(F.col("identity").isNotNull(), F.when(F.col("online").isNotNull(), order).otherwise(F.when(F.col("offline").isNotNull(), own))))


def wants_model(category: Column, categories: tuple[str, ...] = ("ALL",)) -> Column:
    """Is a model asked about this category: every one for ALL, else those named."""
    return F.lit(True) if "ALL" in categories else category.isin(*categories)


def processed(df: DataFrame, by_isbn: DataFrame, by_title: DataFrame, verify_ok: bool = False, strict: bool = True, accept_missing: bool = True, skip_online: bool = False, categories: tuple[str, ...] = ("ALL",)) -> DataFrame:
    """Records end to end: those to review get `fix`; `outcome` is ok, the source of the fix, accepted (data missing, identity confirmed, nothing found), model (a
    provider may be asked: usable text and a wanted category), or unfixed. A content that contradicts a clean record makes it CONTENT_MISMATCH. Pages are read before
    the lookups, which write their rows, and are not among the columns returned."""
    d = classified(df, accept_missing=False, verify_ok=verify_ok, strict=strict).withColumn("__usable", text.usable(F.col("first_page"))).drop(*TEXTS)
    mismatch = (F.col("primary")["verdict"] == "OK") & (F.col("verdict") == "NEEDS_REVIEW")
    d = d.withColumn("category", F.when(mismatch, "CONTENT_MISMATCH").otherwise(F.col("primary")["category"]))
    review = (F.col("verdict") == "NEEDS_REVIEW") | F.col("category").isin("MISSING_ISBN", "MISSING_YEAR", "MISSING_COVER")
    # what needs no review asks nothing of the joins
    d = d.withColumn("__review", review).withColumn("identity", F.when(review, F.col("identity")))
    d = deterministic_fix(d, by_isbn, by_title, skip_online)
    accepts = F.lit(accept_missing) & rules.acceptable_missing(F.col("primary"), F.col("diagnoses")) & F.col("identity").isNotNull()
    asks = wants_model(F.col("category"), categories) & F.col("__usable")
    ok = (F.col("verdict") == "OK") & F.col("primary_file").isNotNull()
    outcome = (
        F.when(ok, "ok").when(F.col("__review"), F.coalesce(F.col("fix")["source"], F.when(accepts, "accepted").when(asks, "model")))
    )
    return d.withColumn("outcome", F.coalesce(outcome, F.lit("unfixed"))).drop("__review", "__usable")


def fix_counters(done: DataFrame) -> DataFrame:
    """One row of counters over processed records."""
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    o, has = F.col("outcome"), lambda c: F.exists("diagnoses", lambda d: d["category"] == c)
    online = F.col("fix")["source"].isNotNull() & (o != "content") & (o == F.col("fix")["source"])
    return done.agg(
        n(o == "ok").alias("ok"), n(F.col("category") == "CONTENT_MISMATCH").alias("content_mismatch"), n(has("C11")).alias("covers_generated"), n(has("MISSING_COVER")).alias("covers_missing"),
        n(o == "content").alias("offline_content"), n(online).alias("online_fixed"), *[n(o == s).alias(f"online_{s}") for s in ("databazeknih", "legie", "openlibrary", "google_books")],
        n(o == "accepted").alias("accepted_missing"), n(o == "model").alias("to_model"), n(o == "unfixed").alias("unfixed"),
    )


def verification_counts(done: DataFrame) -> DataFrame:
    """(result, n): records by what their verification said; (skipped) where there was none."""
    return done.groupBy(F.coalesce("verification", F.lit("(skipped)")).alias("result")).agg(F.count("*").alias("n"))


def buckets(entries: DataFrame, verdict: str = "verdict", action: str = "action") -> DataFrame:
    """One row: clean records; of the others those that a reviewer finds accepted, open, or with another action; already decided ones; pre-filled as verified; all."""
    ok, a = F.col(verdict) == "OK", F.col(action)
    left = ~ok & ~F.col("decided")
    return entries.agg(
        F.count_if(ok).alias("ok"), F.count_if(left & (a == "accept")).alias("accept"), F.count_if(left & a.isNull()).alias("open"), F.count_if(left & a.isNotNull() & (a != "accept")).alias("other"),
        F.count_if(~ok & F.col("decided")).alias("skipped"), F.count_if(left & F.col("verified")).alias("verified"), F.count("*").alias("total"),
    )


def embedded_agreement(df: DataFrame) -> DataFrame:
    """df (title, authors, embedded_title, embedded_authors) with `score`, the mean of the title's ratio and the best of all pairs of authors, as far as both sides
    have them, 0 if they share nothing, and `match`: a score of at least STRONG."""
    ratio = lambda a, b: fuzzy.token_sort(a, b) / 100
    t = F.when((F.coalesce("title", F.lit("")) != "") & (F.coalesce("embedded_title", F.lit("")) != ""), True)
    title = F.when(t, ratio(text.caseless(F.col("title")), text.caseless(F.when(t, F.col("embedded_title")))))
    lists = [F.transform(F.coalesce(c, F.array().cast("array<string>")), text.caseless) for c in ("authors", "embedded_authors")]
    d = df.withColumn("__title", title).withColumn("__a", lists[0]).withColumn("__b", lists[1])
    both = (F.size("__a") > 0) & (F.size("__b") > 0)
    author = F.when(both, fuzzy.best_pair(F.col("__a"), F.when(both, F.col("__b"))))
    d = d.withColumn("__author", author)
    known = F.array_compact(F.array("__title", "__author"))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    d = d.withColumn("score", F.when(F.size(known) > 0, mean).otherwise(0.0))
    return d.withColumn("match", F.col("score") >= C.STRONG).drop("__title", "__a", "__b", "__author")
