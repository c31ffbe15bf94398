"""Queries of ISBNs, names, paths, rules and reports over the book records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import constants as C
from quirework.functions import isbn, names
from quirework.operators import rules
from quirework.plans.adapter import books, cte
from quirework.plans.registry import query


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


# ---------------------------------------------------------------- DuckDB spellings


def d_fold(s: str) -> str:
    return f"translate({s}, '{C.FOLD_RULES[0]}', '{C.FOLD_RULES[1]}')"


def d_anonym(s: str) -> str:
    low = f"lower(trim({s}))"
    tokens = f"list_filter(regexp_split_to_array({low}, {pattern(C.ANONYM_SEPARATORS)}), lambda t: t <> '')"
    return f"coalesce(({low} <> 'autor' AND ({low} IN ({quoted(C.ANONYM)}) OR (len({tokens}) > 1 AND len(list_filter({tokens}, lambda t: t NOT IN ({quoted(C.ANONYM)}))) = 0))), false)"


def d_czech(s: str) -> str:
    plain = quoted(n for n in C.CZ_NAMES if n == n.translate(str.maketrans(*C.FOLD_RULES)))
    return f"(regexp_matches({s}, '[{C.CZ_LETTERS}]') OR len(list_filter(regexp_split_to_array(lower({d_fold(s)}), '[\\s.,]+'), lambda t: t IN ({plain}))) > 0)"


def d_foreign(s: str) -> str:
    tokens = f"list_filter(regexp_split_to_array({s}, '[\\s.,]+'), lambda t: t <> '')"
    return f"(length({s}) >= 3 AND len(list_filter({tokens}, lambda t: regexp_matches(t, '^\\p{{Lu}}'))) > 0 AND NOT {d_czech(s)} AND NOT coalesce(regexp_matches({tokens}[1], '^[0-9]'), false) AND len({tokens}) < 5)"


def d_check(s: str, n: int) -> str:
    """Sum of weighted digits: ISBN-13 weights for 12 or 13 digits, ISBN-10 weights for 10."""
    digit = lambda i: f"(CASE substr({s}, {i}, 1) WHEN 'X' THEN 10 ELSE TRY_CAST(substr({s}, {i}, 1) AS INT) END)"
    return "(" + " + ".join(f"{(11 - i) if n == 10 else (1 if i % 2 else 3)} * {digit(i)}" for i in range(1, n + 1)) + ")"


def d_canonical(raw: str) -> str:
    s = f"upper(regexp_replace(regexp_replace({raw}, '^[^0-9Xx]+', ''), '[- ]', '', 'g'))"
    body = f"('978' || substr({s}, 1, 9))"
    return (
        f"CASE WHEN regexp_matches({s}, '^[0-9]{{9}}[0-9X]$') THEN CASE WHEN {d_check(s, 10)} % 11 = 0 THEN {body} || ((10 - {d_check(body, 12)} % 10) % 10) END "
        f"WHEN regexp_matches({s}, '^[0-9]{{13}}$') THEN CASE WHEN {d_check(s, 13)} % 10 = 0 THEN {s} END END"
    )


def d_segment(s: str) -> str:
    t = f"trim(regexp_replace(regexp_replace(coalesce({s}, ''), '[\\\\/:*?\"<>|\\n\\r\\t]', '_', 'g'), '\\s+', ' ', 'g'))"
    u = f"trim({t}, '. ')"
    return f"CASE WHEN {u} = '' THEN '_' ELSE left({u}, 200) END"


def d_author_sort(s: str) -> str:
    parts = f"regexp_split_to_array(trim({s}), '\\s+')"
    return f"CASE WHEN len({parts}) >= 2 THEN {parts}[-1] || ', ' || array_to_string({parts}[1:len({parts}) - 1], ' ') ELSE {s} END"


def d_title_sort(s: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({s}, '{a}') THEN substr({s}, {len(a) + 1}) || ', {a.strip()}'" for a in C.ARTICLES) + f" ELSE {s} END"


D_FIRST = f"coalesce(authors[1], '{C.ANONYM_FOLDER}')"
D_AUTHOR = f"CASE WHEN {d_anonym(D_FIRST)} THEN '{C.ANONYM_FOLDER}' ELSE {D_FIRST} END"
D_TITLE = "CASE WHEN coalesce(title, '') = '' THEN 'Untitled' ELSE title END"
D_TARGET = f"'/lib/' || ({d_segment(f'({D_AUTHOR})')}) || '/' || ({d_segment(f'({D_TITLE})')}) || ' (' || id || ')'"
D_REL = "regexp_replace(substr(path, 6), '^needfix/(.)', '\\1')"
D_HEAD = f"split_part({D_REL}, '/', 1)"
D_NEEDFIX = f"'/lib/needfix/' || CASE WHEN contains({D_REL}, '/') AND {d_anonym(D_HEAD)} THEN '{C.ANONYM_FOLDER}' || substr({D_REL}, length({D_HEAD}) + 1) ELSE {D_REL} END"
D_ISBN = cte() + f", rec AS (SELECT *, {d_canonical('isbn_raw')} AS isbn FROM books) "


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).withColumn("isbn", isbn.canonical(F.col("isbn_raw")))


_B = lambda: {c: F.col(x) for c, x in {"authors": "authors", "title": "title", "id": "id", "isbn": "isbn", "year": "year", "language": "language", "series": "series_name", "series_index": "series_index"}.items()}

# ---------------------------------------------------------------- ISBN


@query(D_ISBN + "SELECT id, isbn_raw, isbn FROM rec")
def isbn_canonicalize(spark, sf_dir):
    return records(spark, sf_dir).select("id", "isbn_raw", "isbn")


@query(cte() + f", t AS (SELECT id, body10 || CASE (11 - ({' + '.join(f'{11 - i} * CAST(substr(body10, {i}, 1) AS INT)' for i in range(1, 10))}) % 11) % 11 WHEN 10 THEN 'X' ELSE concat('', (11 - ({' + '.join(f'{11 - i} * CAST(substr(body10, {i}, 1) AS INT)' for i in range(1, 10))}) % 11) % 11) END AS isbn10 FROM books) SELECT id, isbn10, {d_canonical('isbn10')} AS isbn13 FROM t")
def isbn10_to_13(spark, sf_dir):
    total = sum((F.substring("body10", i, 1).cast("int") * (11 - i) for i in range(2, 10)), F.substring("body10", 1, 1).cast("int") * 10)
    check = (11 - total % 11) % 11
    ten = F.concat("body10", F.when(check == 10, "X").otherwise(check.cast("string")))
    return books(spark, sf_dir).select("id", ten.alias("isbn10")).withColumn("isbn13", isbn.canonical(F.col("isbn10")))


@query(D_ISBN + f", t AS (SELECT id, list_filter([{d_canonical('isbn_raw')}, CASE WHEN id % 4 = 0 THEN '9788071741305' END, CASE WHEN id % 9 = 0 THEN '9788085906455' END], lambda x: x IS NOT NULL) AS l FROM books) SELECT id, array_to_string(list_distinct_ordered, '|') AS isbns FROM (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM t)")
def isbn_extract_all(spark, sf_dir):
    """ISBNs planted in running text come back canonical, each once, in order; the digits of the prose itself are none."""
    b = books(spark, sf_dir)
    text = F.concat_ws(" ; ", F.concat(F.lit("ISBN: "), isbn.canonical(F.col("isbn_raw"))), F.when(F.col("id") % 4 == 0, "see ISBN-10 8071741302 there"), F.when(F.col("id") % 9 == 0, "and 80-85906-45-7."))
    return b.select("id", F.array_join(isbn.all_in(text), "|").alias("isbns"))


# ---------------------------------------------------------------- names and paths


@query(cte() + f"SELECT id, {D_TARGET} AS target FROM books")
def target_path(spark, sf_dir):
    return records(spark, sf_dir).select("id", names.target_path(_B()).alias("target"))


@query(D_ISBN + f"SELECT id, '/lib/' || regexp_replace(regexp_replace(({d_segment('(' + d_author_sort('(' + D_AUTHOR + ')') + ')')}) || '/' || ({d_segment('series_name')}) || '/' || coalesce(concat('', year), '') || '/' || ({d_segment('(' + d_title_sort('(' + D_TITLE + ')') + ')')}) || ' [' || ({d_segment('isbn')}) || ']', '/+', '/', 'g'), '^/|/$', '', 'g') AS target FROM rec")
def target_path_pattern(spark, sf_dir):
    return records(spark, sf_dir).select("id", names.target_path(_B(), "{author_sort}/{series}/{year}/{title_sort} [{isbn}]").alias("target"))


@query(cte() + f"SELECT id, {d_segment('substr(text, 1, 260)')} AS segment FROM books")
def sanitize_segment(spark, sf_dir):
    return books(spark, sf_dir).select("id", names.segment(F.substring("text", 1, 260)).alias("segment"))


@query(cte() + f"SELECT id, author_folder, {d_author_sort('author_folder')} AS author_sort FROM books")
def author_sort(spark, sf_dir):
    return books(spark, sf_dir).select("id", "author_folder", names.author_sort(F.col("author_folder")).alias("author_sort"))


@query(cte() + f"SELECT id, {d_title_sort('title')} AS title_sort FROM books")
def title_sort(spark, sf_dir):
    return books(spark, sf_dir).select("id", names.title_sort(F.col("title")).alias("title_sort"))


@query(cte() + f"SELECT id, {D_NEEDFIX} AS dest FROM books")
def needfix_path(spark, sf_dir):
    return books(spark, sf_dir).select("id", names.needfix_path(F.col("path"), F.col("author_folder"), F.col("title_folder")).alias("dest"))


@query(cte() + "SELECT id, regexp_extract(title_folder, '^(.+?)\\s+\\((\\d+)\\)\\s*$', 1) AS title_part, TRY_CAST(regexp_extract(title_folder, '^(.+?)\\s+\\((\\d+)\\)\\s*$', 2) AS INT) AS calibre_id, string_split(path, '/')[-2] AS folder FROM books")
def path_parse(spark, sf_dir):
    p = r"^(.+?)\s+\((\d+)\)\s*$"
    return books(spark, sf_dir).select("id", F.regexp_extract("title_folder", p, 1).alias("title_part"), F.regexp_extract("title_folder", p, 2).try_cast("int").alias("calibre_id"), F.element_at(F.split("path", "/"), -2).alias("folder"))


@query(cte() + ", f AS (SELECT id, unnest(formats) AS f FROM books), r AS (SELECT id, f, list_position([" + quoted(C.FORMATS) + "], f) AS p FROM f) SELECT b.id, coalesce(string_agg(r.f, '|' ORDER BY coalesce(p, 99), r.f), '') AS formats, arg_min(r.f, coalesce(p, 99) * 1000) AS primary_format FROM books b LEFT JOIN r ON b.id = r.id GROUP BY b.id")
def format_preference(spark, sf_dir):
    order = F.array(*map(F.lit, C.FORMATS))
    ranked = F.array_sort(F.transform("formats", lambda f: F.struct(F.when(F.array_position(order, f) > 0, F.array_position(order, f)).otherwise(F.lit(99)).alias("p"), f.alias("f"))))
    b = books(spark, sf_dir).select("id", F.transform(ranked, lambda x: x["f"]).alias("fs"))
    return b.select("id", F.array_join("fs", "|").alias("formats"), F.get("fs", F.lit(0)).alias("primary_format"))


@query("WITH l AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'temp_calibre' WHEN 1 THEN 'calibre-x' WHEN 2 THEN '.hidden' WHEN 3 THEN '~$lock' WHEN 4 THEN 'needfix' ELSE 'Author' END AS name, doc_id % 4 < 2 AS is_file FROM documents) SELECT id, name FROM l WHERE NOT (name = 'temp_calibre' OR starts_with(name, 'calibre-') OR starts_with(name, '.') OR (is_file AND starts_with(name, '~$')))")
def exclusion_filter(spark, sf_dir):
    from quirework.sources.library import excluded

    name = F.expr("CASE doc_id % 6 WHEN 0 THEN 'temp_calibre' WHEN 1 THEN 'calibre-x' WHEN 2 THEN '.hidden' WHEN 3 THEN '~$lock' WHEN 4 THEN 'needfix' ELSE 'Author' END")
    listing = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), name.alias("name"), (F.col("doc_id") % 4 < 2).alias("is_file"))
    return listing.where(~excluded(F.col("name"), F.col("is_file"))).select("id", "name")


# ---------------------------------------------------------------- rules

_S = "struct_pack(category := '{}', verdict := '{}')"
D_NAMES = "list_concat([author_folder], authors)"
D_LOWER = f"(regexp_matches(a, '^[^{C.CAPITALS}]+$') AND regexp_matches(a, '\\p{{L}}'))"
D_STEM = f"trim(regexp_replace(regexp_replace(string_split(primary_file, '/')[-1], '\\.({'|'.join(C.STEM_EXTENSIONS)})$', '', 'i'), '\\s*-\\s*[^-]+$', ''))"
D_STRONG = f"(regexp_matches(title, {pattern(C.TITLE_EXTENSION)}, 'i') OR regexp_matches(title, {pattern(C.WORD_PREFIX)}, 'i') OR regexp_matches(title, {pattern(C.TRUNCATED)}) OR coalesce({D_STEM} <> '' AND lower({D_STEM}) = lower(title), false))"
D_CLEAN = lambda s: f"({s} <> '' AND NOT contains({s}, '_') AND NOT regexp_matches({s}, {pattern(C.TITLE_EXTENSION)}, 'i') AND NOT regexp_matches({s}, '[^\\x{{0}}-\\x{{2000}}]') AND len(list_filter(regexp_split_to_array({s}, '\\s+'), lambda t: t <> '')) < 4)"
D_LOWTITLE = f"lower({d_fold('title')})"
D_TOKENS = f"flatten(list_transform(list_filter(authors, lambda a: {D_CLEAN('a')}), lambda a: regexp_split_to_array(lower({d_fold('a')}), '[^a-z]+')))"
D_FOLDER = "list_filter(regexp_split_to_array(author_folder, '[\\s_-]+'), lambda t: t <> '')"
D_TTOK = "list_filter(regexp_split_to_array(title, '\\s+'), lambda t: t <> '')"
D_ANON = f"(len(list_filter({D_NAMES}, lambda a: a <> '' AND {d_anonym('a')})) > 0 AND len(list_filter(authors, lambda a: a <> '' AND NOT {d_anonym('a')})) = 0)"

#: Condition and (category, verdict) of each rule, in DuckDB.
D_RULES: dict[str, list[tuple[str, str, str]]] = {
    "empty_book": [("len(list_filter(files, lambda f: NOT (lower(f) IN ('metadata.json', 'metadata.opf', 'cover.jpg') OR regexp_matches(lower(f), '\\.(bak|tmp)$')))) = 0", "EMPTY_BOOK", "AUTO_FIXABLE")],
    "c6": [(f"len(list_filter({D_NAMES}, lambda a: starts_with(a, '~$'))) > 0", "C6", "AUTO_FIXABLE")],
    "c12": [(f"len(list_filter({D_NAMES}, lambda a: a <> '' AND NOT {d_anonym('a')} AND (regexp_matches(a, '^[_*]') OR {D_LOWER}))) > 0", "C12", "NEEDS_REVIEW")],
    "c5": [(f"(lower(title) IN ({quoted(C.PLACEHOLDER)}) OR len(list_filter(authors, lambda a: lower(a) IN ({quoted(C.PLACEHOLDER)}))) > 0)", "C5", "NEEDS_REVIEW")],
    "c4": [("len(bad_fields) > 0", "C4", "NEEDS_REVIEW")],
    "c2": [(D_STRONG, "C2", "NEEDS_REVIEW"), ("length(title) - length(replace(title, '_', '')) >= 3", "C2", "NEEDS_REVIEW")],
    "c7": [(f"len(list_filter(authors, lambda a: regexp_matches(a, {pattern(C.GLUED)}))) > 0", "C7", "NEEDS_REVIEW")],
    "c1": [
        (f"len(list_filter({D_TOKENS}, lambda t: length(t) >= 5 AND t NOT IN ({quoted(C.COMMON_WORDS)}) AND contains({D_LOWTITLE}, t) AND length({D_LOWTITLE}) >= length(t) + 2)) > 0", "C1", "NEEDS_REVIEW"),
        (f"({D_CLEAN('author_folder')} AND len({D_FOLDER}) >= 4 AND len(list_filter({D_FOLDER}, lambda t: lower(t) IN ({quoted(C.CZ_NAMES)}))) = 0 AND len({D_TTOK}) BETWEEN 1 AND 3 AND len(list_filter({D_TTOK}, lambda t: NOT regexp_matches(t, '^(\\p{{Lu}}|\\P{{L}})'))) = 0)", "C1", "NEEDS_REVIEW"),
    ],
    "c3": [(f"len(list_filter({D_NAMES}, lambda a: regexp_matches(a, {pattern(C.SERIES_AUTHOR)}, 'i'))) > 0", "C3", "NEEDS_REVIEW")],
    "c8": [
        (f"(len(authors) >= 2 AND len(list_filter(authors, lambda a: {d_foreign('a')})) = 1 AND len(list_filter(authors, lambda a: {d_czech('a')})) BETWEEN 1 AND 2)", "C8", "NEEDS_REVIEW"),
        ("len(authors) >= 4", "C10", "NEEDS_REVIEW"),
    ],
    "c9": [(f"{D_ANON} AND regexp_matches(title, {pattern(C.ANONYM_WORKS)}, 'i')", "C9", "OK"), (D_ANON, "C9", "NEEDS_REVIEW")],
    "c13": [(f"path <> {D_TARGET}", "C13", "AUTO_FIXABLE")],
    "missing_isbn": [("coalesce(isbn, '') = ''", "MISSING_ISBN", "AUTO_FIXABLE")],
    "missing_year": [("year IS NULL", "MISSING_YEAR", "AUTO_FIXABLE")],
    "missing_cover": [("NOT list_contains(files, 'cover.jpg')", "MISSING_COVER", "AUTO_FIXABLE")],
}


def d_rule(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN '{cat}:{verdict}'" for cond, cat, verdict in D_RULES[name]) + " END"


def _rule_query(name: str, made) -> None:
    sql = D_ISBN + f", r AS (SELECT id, {d_rule(name)} AS r FROM rec) SELECT id, split_part(r, ':', 1) AS category, split_part(r, ':', 2) AS verdict FROM r WHERE r IS NOT NULL"

    def run(spark, sf_dir):
        found = records(spark, sf_dir).select("id", made().alias("d")).where("d is not null")
        return found.select("id", "d.category", "d.verdict")

    query(sql, f"rule_{name}")(run)


for _name, _made in (rules.STRUCTURAL | {"c13": rules.location} | rules.ENRICHMENT).items():
    _rule_query(_name, _made)


def d_diagnoses(order: list[str]) -> str:
    cols = ", ".join(d_rule(n) for n in order)
    return D_ISBN + f", found AS (SELECT *, list_filter([{cols}], lambda x: x IS NOT NULL) AS hit FROM rec), diag AS (SELECT * EXCLUDE hit, CASE WHEN len(hit) = 0 THEN ['OK:OK'] ELSE hit END AS diags FROM found) "


_PLAIN = [*rules.STRUCTURAL, "missing_isbn", "missing_year", "missing_cover"]
_LOCATED = [*rules.STRUCTURAL, "c13", "missing_isbn", "missing_year", "missing_cover"]
D_DIAG, D_DIAG13 = d_diagnoses(_PLAIN), d_diagnoses(_LOCATED)
D_PRIMARY = "CASE WHEN split_part(diags[1], ':', 2) = 'OK' AND list_contains(diags, 'C13:AUTO_FIXABLE') THEN 'C13:AUTO_FIXABLE' ELSE diags[1] END"


def _codes():
    return F.array_join(F.transform("diagnoses", lambda d: F.concat(d["category"], F.lit(":"), d["verdict"])), ",").alias("diagnoses")


@query(D_DIAG13 + "SELECT id, array_to_string(diags, ',') AS diagnoses FROM diag")
def detect_all(spark, sf_dir):
    return rules.detect_all(records(spark, sf_dir), with_location=True).select("id", _codes())


@query(D_DIAG13 + f"SELECT id, split_part({D_PRIMARY}, ':', 1) AS category, split_part({D_PRIMARY}, ':', 2) AS verdict FROM diag")
def detect_primary(spark, sf_dir):
    return rules.detect(records(spark, sf_dir), with_location=True).select("id", "primary.category", "primary.verdict")


D_ACCEPT = "(starts_with(diags[1], 'MISSING_') AND len(list_filter(diags, lambda d: ends_with(d, ':NEEDS_REVIEW'))) = 0)"


@query(D_DIAG + f"SELECT id FROM diag WHERE {D_ACCEPT}")
def acceptable_missing(spark, sf_dir):
    d = rules.detect(records(spark, sf_dir))
    return d.where(rules.acceptable_missing(F.col("primary"), F.col("diagnoses"))).select("id")


@query(D_DIAG + "SELECT id FROM diag WHERE NOT verified AND split_part(diags[1], ':', 2) <> 'OK' ORDER BY path, id LIMIT 50")
def skip_verified_limit(spark, sf_dir):
    """The first 50 records in walk order that are neither verified nor clean: a limit is the feature."""
    d = rules.detect(records(spark, sf_dir).where("not verified"))
    return d.where("primary.verdict <> 'OK'").orderBy("path", "id").limit(50).select("id")


# ---------------------------------------------------------------- reports


@query(D_DIAG + ", e AS (SELECT id, unnest(diags) AS d FROM diag), c AS (SELECT split_part(d, ':', 1) AS category, id, d FROM e) SELECT category, count(DISTINCT id) AS n, coalesce(list_position([" + quoted(C.CATEGORIES) + "], category), 99) AS sort_key, min(split_part(d, ':', 2)) AS verdict FROM c GROUP BY category")
def category_report(spark, sf_dir):
    """Records by category; a record counts once for each of its categories, at the first of that category in its row, so partial counts precede the only shuffle."""
    cats = F.transform("diagnoses", lambda d: d["category"])
    d = rules.detect_all(records(spark, sf_dir)).select(cats.alias("cats"), F.posexplode("diagnoses").alias("p", "d"))
    first = F.array_position("cats", F.col("d.category")) == F.col("p") + 1
    out = d.groupBy(F.col("d.category").alias("category")).agg(F.count_if(first).alias("n"), F.min("d.verdict").alias("verdict"))
    at = F.array_position(F.array(*map(F.lit, C.CATEGORIES)), F.col("category"))
    return out.select("category", "n", F.when(at > 0, at).otherwise(F.lit(99)).cast("int").alias("sort_key"), "verdict")


@query(D_DIAG + ", e AS (SELECT id, split_part(unnest(diags), ':', 1) AS category FROM diag), r AS (SELECT DISTINCT category, id FROM e), k AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) AS rank FROM r) SELECT category, id, rank FROM k WHERE rank <= 5")
def category_samples(spark, sf_dir):
    """The first five records of each category: top-k."""
    d = rules.detect_all(records(spark, sf_dir)).select("id", F.explode("diagnoses").alias("d")).select("id", "d.category")
    w = Window.partitionBy("category").orderBy("id")
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("category", "id", F.col("rank").cast("long").alias("rank"))


@query(D_ISBN + "SELECT count(*) AS total, CAST(count_if(source = 'json') AS BIGINT) AS with_json, CAST(count_if(isbn IS NOT NULL) AS BIGINT) AS with_isbn, CAST(count_if(year IS NOT NULL) AS BIGINT) AS with_year, CAST(count_if(len(bad_fields) > 0) AS BIGINT) AS unrepairable FROM rec")
def scan_summary(spark, sf_dir):
    return records(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if(F.col("source") == "json").alias("with_json"), F.count_if(F.col("isbn").isNotNull()).alias("with_isbn"),
        F.count_if(F.col("year").isNotNull()).alias("with_year"), F.count_if(F.size("bad_fields") > 0).alias("unrepairable"),
    )


@query(cte() + "SELECT source, count(*) AS n FROM books GROUP BY source")
def source_counts(spark, sf_dir):
    return books(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


@query(cte() + ", f AS (SELECT unnest(formats) AS format FROM books) SELECT format, count(*) AS n FROM f GROUP BY format")
def format_counts(spark, sf_dir):
    return books(spark, sf_dir).select(F.explode("formats").alias("format")).groupBy("format").agg(F.count("*").alias("n"))


@query(cte() + ", v AS (SELECT 'author' AS kind, unnest(authors) AS value FROM books UNION ALL SELECT 'series', series_name FROM books WHERE series_name IS NOT NULL) SELECT DISTINCT kind, value FROM v WHERE value <> ''")
def vocabulary(spark, sf_dir):
    b = books(spark, sf_dir)
    authors = b.select(F.lit("author").alias("kind"), F.explode("authors").alias("value"))
    series = b.where("series_name is not null").select(F.lit("series").alias("kind"), F.col("series_name").alias("value"))
    return authors.unionByName(series).where("value <> ''").distinct()


@query(cte() + ", v AS (SELECT DISTINCT unnest(authors) AS value FROM books) SELECT value FROM v WHERE starts_with(lower(value), 'ja') AND lower(value) <> 'ja' ORDER BY value LIMIT 12")
def autocomplete_prefix(spark, sf_dir):
    """At most twelve suggestions: top-k."""
    v = books(spark, sf_dir).select(F.explode("authors").alias("value")).distinct()
    return v.where(F.lower("value").startswith("ja") & (F.lower("value") != "ja")).orderBy("value").limit(12)


@query(D_DIAG + f", v AS (SELECT id, CASE WHEN split_part(diags[1], ':', 2) = 'OK' OR {D_ACCEPT} THEN 'ok' ELSE 'needfix' END AS state, * EXCLUDE id FROM diag) SELECT id, CASE WHEN len(formats) = 0 THEN 'needfix' WHEN verified THEN 'ok' ELSE state END AS area, CASE WHEN len(formats) = 0 THEN '/lib/needfix/empty/' || {D_REL} WHEN verified OR state = 'ok' THEN {D_TARGET} ELSE {D_NEEDFIX} END AS dest FROM v")
def placement_target(spark, sf_dir):
    from quirework.operators.placement import placed

    return placed(records(spark, sf_dir)).select("id", "area", "dest")
