"""Records against their books' content: verification, identity, crosscheck of formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import constants as C
from quirework.functions import fuzzy, isbn, text


def windows(first_page: str = "first_page", broader: str = "broader") -> Column:
    """The readable texts, best first, each once."""
    return F.array_distinct(F.filter(F.array(first_page, broader), lambda t: F.coalesce(F.trim(t), F.lit("")) != ""))


def isbn_in_content(number: Column, found: Column, texts: Column) -> Column:
    """An ISBN equals the one found in the text, or stands in the digits of some window."""
    return F.coalesce(number.isNotNull() & ((number == found) | F.exists(texts, lambda t: F.contains(F.regexp_replace(t, "[^0-9]+", ""), number))), F.lit(False))


def _normal(texts: Column) -> Column:
    return F.transform(texts, text.normalise)


def _pinned(c: Column) -> Column:
    """A column that the optimiser does not write out in each place that uses it."""
    return F.when(F.spark_partition_id() >= 0, c)


def scored(df: DataFrame, title: str = "title", authors: Column | None = None, texts: Column | None = None) -> DataFrame:
    """df with `title_score` (and `author_score`): the best of how well the title (any of the authors) stands in any of
    the whole texts, by default the first page. Both are answered in the engine where a text contains them; only the other rows reach the fuzzy matcher."""
    texts = F.array(F.coalesce("first_page", F.lit(""))) if texts is None else texts
    known = F.transform(F.array(F.coalesce(F.col(title), F.lit(""))), text.normalise)
    norm = df.withColumn("__p", _pinned(_normal(texts))).withColumn("__t", _pinned(known))
    out = norm.withColumn("title_score", fuzzy.best_in_texts(F.col("__t"), F.col("__p")))
    if authors is not None:
        names = F.transform(F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a.isNotNull()), text.normalise)
        out = out.withColumn("__a", names).withColumn("author_score", fuzzy.best_in_texts(F.col("__a"), F.col("__p"), author=True)).drop("__a")
    return out.drop("__t", "__p")


def verify(df: DataFrame, asked: Column | None = None, title: str = "title", page: str = "first_page") -> DataFrame:
    """df (primary_file, isbn, title, isbn_from_text, first_page, embedded_title) with `result`: VERIFIED, UNCERTAIN, MISMATCH or NO_CONTENT.
    asked: pages of other rows are not read, and their result says nothing. title, page: the columns that are compared."""
    number, db = F.col("isbn_from_text"), F.col("isbn")
    readable = (F.coalesce(F.col(page), F.lit("")) != "") & (F.coalesce(F.col(title), F.lit("")) != "")
    # a row's page counts only where there is a file and no number
    by_page = F.col("primary_file").isNotNull() & number.isNull() & (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False)))
    d = scored(df, title, texts=F.when(by_page, F.array(F.coalesce(page, F.lit("")))).otherwise(F.array().cast("array<string>")))
    s = F.col("title_score")
    by_title = F.when(s >= C.STRONG, "VERIFIED").when(s >= C.WEAK, "UNCERTAIN").otherwise("MISMATCH")
    by_isbn = F.when(db.isNull() | (db == number), "VERIFIED").otherwise("MISMATCH")
    rest = F.when(F.col("embedded_title").isNotNull(), "UNCERTAIN").otherwise("NO_CONTENT")
    return d.withColumn("result", F.when(F.col("primary_file").isNull(), "NO_CONTENT").when(number.isNotNull(), by_isbn).when(readable, by_title).otherwise(rest))


def _named(title: Column, author: Column) -> tuple[Column, Column, Column]:
    """(is there a title, it normalised, the author normalised: null if there is none)."""
    return F.coalesce(title, F.lit("")) != "", text.normalise(title), text.normalise(F.nullif(author, F.lit("")))


def _page(asked: Column, page: Column) -> Column:
    return _pinned(F.when(asked, text.normalise(F.coalesce(page, F.lit("")))))


def acquire_identity(df: DataFrame) -> DataFrame:
    """df with `identity`: struct(source, isbn, title, authors, year) of the first evidence that the content bears out, null if none: a number in the
    content (text, else embedded: isbn_from_text, x_isbn), the record's number found in it, the record's title and author on the first
    page, those mined from the page (title_from_text, authors_from_text, year_from_text). Missing evidence columns count as null. Only rows without a number have their page read."""
    have = set(df.columns)
    col = lambda n, t="string": F.col(n) if n in have else F.lit(None).cast(t)
    number = F.coalesce(F.col("isbn_from_text"), col("x_isbn"))
    first, mined = F.get("authors", F.lit(0)), F.get(col("authors_from_text", "array<string>"), F.lit(0))
    (titled, own_title, own_author), (told, their_title, their_author) = _named(F.col("title"), first), _named(col("title_from_text"), mined)
    by = F.when(number.isNotNull(), 1).when(isbn_in_content(F.col("isbn"), number, windows()), 2)
    d = df.withColumn("__by", _pinned(by))
    asked = lambda has, author: F.col("__by").isNull() & has & author.isNotNull()
    own, theirs = asked(titled, first), asked(told, mined)
    known = {"__own": F.when(own, own_title), "__own_by": own_author, "__told": F.when(theirs, their_title), "__told_by": their_author}
    d = d.withColumns({k: _pinned(v) for k, v in known.items()} | {"__page": _page(own | theirs, F.col("first_page"))})
    stands = lambda t, a: F.coalesce(fuzzy.standing(F.col(t), F.col(a), F.col("__page"), C.STRONG), F.lit(False))
    kinds = {"isbn": "string", "title": "string", "authors": "array<string>", "year": "int"}
    made = lambda source, **v: F.struct(F.lit(source).alias("source"), *[v.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])
    found = (
        F.when(F.col("__by") == 1, made("content-isbn", isbn=number))
        .when(F.col("__by") == 2, made("metadata", isbn=F.col("isbn")))
        .when(stands("__own", "__own_by"), made("metadata", title=F.col("title"), authors=F.col("authors"), year=col("year", "int")))
        .when(stands("__told", "__told_by"), made("extractor", title=col("title_from_text"), authors=col("authors_from_text", "array<string>"), year=col("year_from_text", "int")))
    )
    return d.withColumn("identity", found).drop("__by", "__page", *known)


def confirm_identity(df: DataFrame) -> DataFrame:
    """df with `confirmed`: the proposal (isbn, title, first author) is borne out by some window of the content. Only rows without a number in it have their windows compared."""
    has, title, author = _named(F.col("title"), F.get("authors", F.lit(0)))
    d = df.withColumn("__number", _pinned(isbn_in_content(F.col("isbn"), F.col("isbn_from_text"), windows())))
    asked = ~F.col("__number") & has & (F.size(windows()) > 0)
    d = d.withColumns({"__t": _pinned(F.when(asked, title)), "__a": _pinned(author), "__p": _page(asked, F.col("first_page")), "__q": _page(asked, F.col("broader"))})
    t = F.col("__t")
    either = lambda title, author, bound: fuzzy.standing(title, author, F.col("__p"), bound) | fuzzy.standing(title, author, F.col("__q"), bound)
    alone = either(F.when(F.char_length(t) >= 10, t), F.lit(None).cast("string"), C.TITLE_ONLY)
    confirmed = F.col("__number") | F.coalesce(either(t, F.col("__a"), C.STRONG) | alone, F.lit(False))
    return d.withColumn("confirmed", confirmed).drop("__number", "__t", "__a", "__p", "__q")


def classify_formats(df: DataFrame) -> DataFrame:
    """One row for each format file with `verdict`: its text's ISBN, else the title in its page, against the record."""
    number, db = F.col("isbn_from_text"), F.col("isbn")
    # what the number decides does not reach the matcher
    d = scored(df, texts=F.when(number.isNull() | db.isNull(), F.array(F.coalesce("first_page", F.lit("")))).otherwise(F.array().cast("array<string>")))
    s = F.col("title_score")
    readable = (F.coalesce(F.col("first_page"), F.lit("")) != "") & (F.coalesce(F.col("title"), F.lit("")) != "")
    by_title = F.when(s >= C.STRONG, "AGREES").when(s < C.WEAK, "DISAGREES").otherwise("UNCERTAIN")
    known = number.isNotNull() & db.isNotNull()
    return d.withColumn("verdict", F.when(known, F.when(number == db, "AGREES").otherwise("DISAGREES")).when(readable, by_title).otherwise("UNCERTAIN"))


def rogues(formats: DataFrame, key: str = "id") -> DataFrame:
    """The format files that disagree with the record where another of the book agrees: those that crosscheck has quarantined. Verdicts are worked out once, and only they are shuffled."""
    from pyspark.sql import Window

    agrees = F.count_if(F.col("verdict") == "AGREES").over(Window.partitionBy(key))
    return formats.withColumn("__agrees", agrees).where((F.col("verdict") == "DISAGREES") & (F.col("__agrees") > 0)).drop("__agrees")


def crosscheck(formats: DataFrame, key: str = "id") -> DataFrame:
    """(key, files, agrees, disagrees, decision): quarantine the rogues if some formats agree, ambiguous if none does."""
    n = formats.groupBy(key).agg(F.count("*").alias("files"), F.count_if(F.col("verdict") == "AGREES").alias("agrees"), F.count_if(F.col("verdict") == "DISAGREES").alias("disagrees"))
    decision = F.when(F.col("files") < 2, "skipped").when((F.col("agrees") > 0) & (F.col("disagrees") > 0), "quarantine").when(F.col("disagrees") > 0, "ambiguous").otherwise("clean")
    return n.withColumn("decision", decision)


def with_content(books: DataFrame) -> DataFrame:
    """Records with the evidence of their content: number, first page and broader text from the document."""
    found = isbn.first_in(F.when(F.col("id") % 6 == 1, F.concat(F.lit("ISBN "), F.coalesce("isbn", F.lit("9788071741305")))).when(F.col("id") % 12 == 2, F.lit("ISBN 80-85906-45-7")))
    return books.withColumn("isbn_from_text", found).withColumn("first_page", F.left("text", F.lit(8000))).withColumn("broader", F.left("text", F.lit(30000))).withColumn("embedded_title", F.col("title"))
