"""Parsers of catalogue pages as column expressions; fetching is a provider's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import fuzzy, isbn, text


def json_ld(page: Column) -> Column:
    """The first ld+json script as VARIANT; null if there is none or it isn't JSON."""
    return F.try_parse_json(F.nullif(F.trim(F.regexp_extract(page, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)), F.lit("")))


def _names(v: Column, field: str) -> Column:
    """Names under a field that is an object, a list of objects or of strings, or a string."""
    many = F.try_variant_get(v, f"$.{field}", "array<variant>")
    one = lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    single = F.coalesce(F.try_variant_get(v, f"$.{field}.name", "string"), F.try_variant_get(v, f"$.{field}", "string"))
    return F.filter(F.coalesce(F.transform(many, one), F.array(single)), lambda x: x.isNotNull() & (x != ""))


def detail(pages: DataFrame, page: str = "html", out: str = "detail") -> DataFrame:
    """pages with a struct of a book's detail page: title, authors, isbn, publisher, language, genres; null without title and number."""
    v = "__ld"
    d = pages.withColumn(v, json_ld(F.col(page)))
    get = lambda p: F.try_variant_get(F.col(v), p, "string")
    tags = F.regexp_extract_all(F.col(page), F.lit(r'(?i)<a[^>]*class=["\']tag["\'][^>]*title=["\']([^"\']+)'), F.lit(1))
    number = isbn.canonical(get("$.isbn"))
    title = text.collapse(get("$.name"))
    book = F.struct(
        title.alias("title"), _names(F.col(v), "author").alias("authors"), number.alias("isbn"), F.get(_names(F.col(v), "publisher"), F.lit(0)).alias("publisher"),
        get("$.inLanguage").alias("language"), F.array_union(_names(F.col(v), "genre"), F.coalesce(tags, F.array().cast("array<string>"))).alias("genres"),
        get("$.image").alias("cover_url"), get("$.description").alias("description"),
    )
    return d.withColumn(out, F.when((F.coalesce(title, F.lit("")) != "") | number.isNotNull(), book)).drop(v)


def results(pages: DataFrame, page: str = "html", key: str = "page_id", most: int = 10) -> DataFrame:
    """(key, pos, path, title, year) of a search page's hits, each path once, the first ten: a limit of the source."""
    block = F.lit(r"(?is)<p[^>]*class=['\"]new['\"][^>]*>.*?</p>")
    hits = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(page), block, F.lit(0))).alias("pos", "b"))
    link = r"(?is)<a[^>]*href=['\"]([^'\"]+)['\"][^>]*>"
    title = F.coalesce(F.nullif(F.regexp_extract("b", r"(?is)<a[^>]*title=['\"]([^'\"]+)", 1), F.lit("")), F.regexp_extract("b", r"(?is)<a[^>]*>(.*?)</a>", 1))
    found = hits.select(key, "pos", F.regexp_extract("b", link, 1).alias("path"), text.collapse(title).alias("title"), F.regexp_extract("b", r"\b((?:1[5-9]|20)\d{2})\b\s*,", 1).try_cast("int").alias("year"))
    from pyspark.sql import Window

    once = found.where("path <> ''").withColumn("r", F.row_number().over(Window.partitionBy(key, "path").orderBy("pos"))).where("r = 1").drop("r")
    return once.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("r") <= most).drop("r")


def work_detail(pages: DataFrame, page: str = "html", out: str = "work") -> DataFrame:
    """pages with a struct of a work's page of the second catalogue: title, authors (each once, in order), world as series, original title as description;
    null without a title."""
    one = lambda pattern: text.collapse(F.regexp_extract(page, pattern, 1))
    title = one(r'(?i)<h2[^>]*id="nazev_(?:povidky|knihy)"[^>]*>([^<]+)</h2>')
    found = F.regexp_extract_all(page, F.lit(r'(?i)<h3>\s*<a[^>]*href="autor/[^"]+"[^>]*>([^<]+)</a>\s*</h3>'), F.lit(1))
    authors = F.array_distinct(F.filter(F.transform(found, text.collapse), lambda a: a != ""))
    world = one(r'(?i)pat[řr][íi]\s+do\s+sv[ěe]ta:\s*<a[^>]*href="svet/[^"]+"[^>]*>([^<]+)</a>')
    original = one(r"(?i)origin[áa]ln[íi]\s+n[áa]zev:\s*([^<\r\n]+)")
    set_ = lambda c: F.nullif(c, F.lit(""))
    book = F.struct(title.alias("title"), authors.alias("authors"), set_(world).alias("series"), F.concat(F.lit("originál: "), set_(original)).alias("description"))
    return pages.withColumn(out, F.when(F.coalesce(title, F.lit("")) != "", book))


def work_results(pages: DataFrame, title: str = "wanted", page: str = "html", key: str = "page_id", floor: float = 70.0) -> DataFrame:
    """(key, path, found, score) of the row of a result page whose title is most like the wanted one (token-sorted ratio of at least `floor`, lower case; the first of equal ones)."""
    row = F.lit(r'(?i)<a[^>]*href="(?:povidka|kniha)/[^"]+"[^>]*>[^<]{1,120}</a>')
    hits = pages.select(key, F.lower(title).alias("w"), F.posexplode(F.regexp_extract_all(page, row, F.lit(0))).alias("pos", "a"))
    hits = hits.select(key, "pos", "w", F.regexp_extract("a", r'(?i)href="([^"]+)"', 1).alias("path"), text.collapse(F.regexp_extract("a", r"(?i)>([^<]+)</a>", 1)).alias("found"))
    low = F.lower("found")
    score = F.when(low == F.col("w"), 100.0).otherwise(fuzzy.token_sort(F.when(low != F.col("w"), low), F.col("w")))
    best = F.min_by(F.struct("path", "found", "score"), F.struct(-F.col("score"), F.col("pos")))
    return hits.withColumn("score", score).where(F.col("score") >= floor).groupBy(key).agg(best.alias("b")).select(key, "b.path", "b.found", "b.score")


def _year(c: Column) -> Column:
    return F.regexp_extract(c, r"\d{4}", 0).try_cast("int")


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))


def _listed(v: Column, path: str) -> Column:
    """The names of a list of objects."""
    many = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(many, lambda x: F.try_variant_get(x, "$.name", "string")), lambda x: F.coalesce(x, F.lit("")) != "")


def _record(source: str, **fields: Column) -> Column:
    kinds = {"title": "string", "authors": "array<string>", "isbn": "string", "publisher": "string", "year": "int", "language": "string", "description": "string", "cover_url": "string"}
    return F.struct(F.lit(source).alias("source"), *[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def openlibrary_book(answer: Column, number: Column) -> Column:
    """The record in an answer of the books service for one ISBN; null if it isn't there. The answer's only key names the number."""
    v = F.try_parse_json(F.replace(answer, F.concat(F.lit('"ISBN:'), number, F.lit('"')), F.lit('"hit"')))
    get = lambda p: F.try_variant_get(v, f"$.hit.{p}", "string")
    cover = F.coalesce(get("cover.medium"), get("cover.large"), get("cover.small"))
    made = _record("openlibrary", title=get("title"), authors=_listed(v, "$.hit.authors"), isbn=number, publisher=F.get(_listed(v, "$.hit.publishers"), F.lit(0)), year=_year(get("publish_date")), cover_url=cover)
    return F.when(F.try_variant_get(v, "$.hit", "variant").isNotNull(), made)


def openlibrary_query(title: Column, author: Column) -> Column:
    """What the search service is asked for: the title, and of the author the surname."""
    name = F.element_at(F.filter(F.split(F.coalesce(author, F.lit("")), r"\s+"), lambda x: x != ""), -1)
    return F.concat(F.lit("title:"), title, F.coalesce(F.concat(F.lit(" author:"), name), F.lit("")))


def openlibrary_search(answer: Column) -> Column:
    """The first record of an answer of the search service; null if none."""
    v = F.try_parse_json(answer)
    first = lambda p: F.get(_list(v, f"$.docs[0].{p}"), F.lit(0))
    cover = F.concat(F.lit("https://covers.openlibrary.org/b/id/"), F.try_variant_get(v, "$.docs[0].cover_i", "string"), F.lit("-M.jpg"))
    made = _record("openlibrary", title=F.try_variant_get(v, "$.docs[0].title", "string"), authors=_list(v, "$.docs[0].author_name"), isbn=isbn.canonical(first("isbn")), publisher=first("publisher"), year=first("publish_year").try_cast("int"), cover_url=cover)
    return F.when((F.coalesce(F.try_variant_get(v, "$.numFound", "long"), F.lit(0)) > 0) & F.try_variant_get(v, "$.docs[0]", "variant").isNotNull(), made)


def google_volume(answer: Column, number: Column) -> Column:
    """The first volume of an answer for one ISBN; null if none."""
    v = F.try_parse_json(answer)
    get = lambda p: F.try_variant_get(v, f"$.items[0].volumeInfo.{p}", "string")
    cover = F.coalesce(*[get(f"imageLinks.{k}") for k in ("extraLarge", "large", "thumbnail", "smallThumbnail")])
    made = _record("google_books", title=get("title"), authors=_list(v, "$.items[0].volumeInfo.authors"), isbn=number, publisher=get("publisher"), year=_year(get("publishedDate")), language=get("language"), description=get("description"), cover_url=cover)
    return F.when((F.coalesce(F.try_variant_get(v, "$.totalItems", "long"), F.lit(0)) > 0) & F.try_variant_get(v, "$.items[0]", "variant").isNotNull(), made)
