"""Queries of proposals: building, checking, projecting, editing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import fuzzy, text
from quirework.operators import content, proposals, rules
from quirework.plans.adapter import books, cte
from quirework.plans.record_queries import D_ISBN, D_RULES, d_rule, records
from quirework.plans.registry import query
from quirework.plans.text_queries import _PAGE, _WANT, D_BROKEN

_EVIDENCE = """CASE WHEN id % 9 = 0 THEN '9788071741305' END AS x_isbn, CASE WHEN id % 9 = 1 THEN '9788085906455' END AS x_text_isbn,
CASE WHEN id % 4 = 0 THEN concat('Clean title ', id) END AS x_title, CASE WHEN id % 5 = 0 THEN 'Clean Author' END AS x_author,
CASE id % 6 WHEN 0 THEN 'databazeknih' WHEN 1 THEN 'openlibrary' WHEN 2 THEN 'llm:flash' END AS e_source, id % 10 = 0 AS e_confirmed,
CASE WHEN id % 6 < 3 AND id % 7 < 4 THEN concat('Found title ', id) END AS e_title, CASE WHEN id % 6 < 3 THEN CASE id % 3 WHEN 0 THEN 'Unknown' ELSE 'Found Author' END END AS e_author,
CASE WHEN id % 6 < 3 AND id % 11 < 5 THEN '9788090385054' END AS e_isbn, CASE WHEN id % 6 < 3 THEN CAST(2000 AS INT) END AS e_year, CASE WHEN id % 6 < 3 THEN 'Argo' END AS e_publisher,
CASE WHEN id % 6 < 3 THEN 'en' END AS e_language, CASE WHEN id % 6 = 0 THEN 'http://cover' END AS e_cover_url, CASE WHEN id % 8 = 0 THEN 'A/B' END AS location,
id % 3 = 0 AS is_c13, id % 13 = 0 AS is_c1, id % 2 = 0 AS no_cover"""
_BETTER = lambda n, o: f"(coalesce({n}, '') <> '' AND (coalesce({o}, '') = '' OR ({D_BROKEN(o)} AND NOT {D_BROKEN(n)})))"
_TRUST = "(starts_with(e_source, 'llm:') OR e_source = 'databazeknih' OR e_confirmed)"


def _way(*ways: tuple[str, str, str]) -> tuple[str, str]:
    return tuple("CASE " + " ".join(f"WHEN {w} THEN {(v, s)[k]}" for w, v, s in ways) + " END" for k in (0, 1))


_SWAP = "(is_c1 AND coalesce(title, '') <> '' AND author IS NOT NULL)"
_WAYS = {
    "isbn": _way(("x_isbn IS NOT NULL AND x_isbn IS DISTINCT FROM isbn", "x_isbn", "'embedded'"), ("x_text_isbn IS NOT NULL AND x_isbn IS NULL AND isbn IS NULL", "x_text_isbn", "'content'"), ("e_isbn IS NOT NULL", "e_isbn", "e_source")),
    "title": _way((_BETTER("x_title", "title"), "x_title", "'embedded'"), (f"e_title IS NOT NULL AND ({_TRUST} OR {_BETTER('e_title', 'title')})", "e_title", "e_source"), (_SWAP, "author", "'swap'")),
    "author": _way((_BETTER("x_author", "author"), "x_author", "'embedded'"), (f"e_author IS NOT NULL AND e_author <> 'Unknown' AND ({_TRUST} OR {_BETTER('e_author', 'author')})", "e_author", "e_source"), (_SWAP, "title", "'swap'")),
    "year": _way(("e_year IS NOT NULL AND (year IS NULL OR e_year <> year)", "CAST(e_year AS VARCHAR)", "e_source")),
    "publisher": _way(("e_publisher IS NOT NULL AND (publisher IS NULL OR e_publisher <> publisher)", "e_publisher", "e_source")),
    "language": _way(("e_language IS NOT NULL AND (language IS NULL OR e_language <> language)", "e_language", "e_source")),
    "cover_url": _way(("e_cover_url IS NOT NULL AND no_cover", "e_cover_url", "e_source")),
    "location": _way(("is_c13 AND location IS NOT NULL", "location", "'location'")),
}


def _with_evidence(spark, sf_dir):
    b = records(spark, sf_dir).withColumn("author", F.get("authors", F.lit(0))).selectExpr("*", *[x.strip() for x in _split(_EVIDENCE)])
    cats = F.array_compact(F.array(F.when(F.col("is_c13"), "C13"), F.when(F.col("is_c1"), "C1"), F.when(F.col("no_cover"), "MISSING_COVER")))
    return b.withColumn("categories", cats)


def _split(s: str) -> list[str]:
    """Expressions at top-level commas."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(s):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(s[last:i])
            last = i + 1
    return [*out, s[last:]]


_SOURCES = "list_filter([" + ", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN {s} END" for v, s in _WAYS.values()) + "], lambda x: x IS NOT NULL)"


@query(D_ISBN + f", ev AS (SELECT *, authors[1] AS author, {_EVIDENCE} FROM rec) SELECT id, " + ", ".join(f"{v} AS p_{f}" for f, (v, _) in _WAYS.items()) + f", nullif(array_to_string(list_sort(list_distinct({_SOURCES})), '+'), '') AS p_source FROM ev")
def build_proposed(spark, sf_dir):
    p = proposals.built(_with_evidence(spark, sf_dir))
    return p.select("id", *[F.col("proposed")[f].alias(f"p_{f}") for f in (*_WAYS, "source")])


_CLEAN = [n for n in (*rules.STRUCTURAL, "missing_isbn", "missing_year", "missing_cover")]


@query(D_ISBN + ", fx AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'Fixed title' ELSE title END AS title, CASE WHEN id % 2 = 0 THEN '9788071741305' ELSE isbn END AS isbn, CASE WHEN id % 2 = 0 THEN CAST(2001 AS INT) ELSE year END AS year, CASE WHEN id % 5 = 0 THEN list_concat(['Fixed Author'], authors[2:]) ELSE authors END AS authors), id % 2 = 0 AS url FROM rec), dd AS (SELECT id, url, [" + ", ".join(d_rule(n) for n in _CLEAN) + "] AS hits FROM fx) SELECT id, len(list_filter(hits, lambda h: h IS NOT NULL AND NOT ends_with(h, ':OK') AND NOT (url AND h = 'MISSING_COVER:AUTO_FIXABLE'))) = 0 AS clean FROM dd")
def projected_clean(spark, sf_dir):
    entry = lambda cond, k, v: F.when(cond, F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")))
    i = F.col("id")
    fix = F.array_compact(F.array(entry(i % 3 == 0, "title", "Fixed title"), entry(i % 2 == 0, "isbn", "9788071741305"), entry(i % 2 == 0, "year", "2001"), entry(i % 5 == 0, "author", "Fixed Author"), entry(i % 2 == 0, "cover_url", "u")))
    return proposals.projected_clean(records(spark, sf_dir).withColumn("proposed", F.map_from_entries(fix))).select("id", "clean")


@query(cte() + "SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE title END AS o_title, CASE WHEN id % 3 = 0 THEN 'x' ELSE 'old' END AS p_note, id % 4 = 0 OR title <> '' AS has_title FROM books")
def editor_overlay(spark, sf_dir):
    """An editor's fields over a proposal: non-empty ones set, cleared ones null, others as they were."""
    i = F.col("id")
    cleared = F.when(i % 4 == 0, F.array(F.lit("title"))).otherwise(F.array().cast("array<string>"))
    o = proposals.overlay({"title": F.col("title"), "note": F.when(i % 3 == 0, "x")}, cleared)
    m = proposals.edited(F.create_map(F.lit("note"), F.lit("old")), o)
    return books(spark, sf_dir).select("id", m.alias("m")).select("id", F.col("m")["title"].alias("o_title"), F.col("m")["note"].alias("p_note"), F.map_contains_key("m", F.lit("title")).alias("has_title")).withColumn("o_title", F.when(F.col("has_title"), F.col("o_title")).otherwise(F.lit("")))


@query(cte() + "SELECT id, title AS author, coalesce(authors[1], '') AS title FROM books")
def swap_fields(spark, sf_dir):
    return books(spark, sf_dir).select("id", F.col("title").alias("author"), F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("title"))


@query(cte() + "SELECT id, CASE id % 6 WHEN 1 THEN 'Čas Přílivu' WHEN 3 THEN NULL ELSE NULL END AS title FROM books")
def allcaps_title(spark, sf_dir):
    line = F.element_at(F.split(F.expr(_PAGE), "\n"), 1)
    b = books(spark, sf_dir).select("id", F.trim(F.split_part(line, F.lit("|"), F.lit(1))).alias("line"))
    return b.select("id", F.when(~text.noise(F.col("line")), text.capitals_title(F.col("line"))).alias("title"))


@query(cte() + f"SELECT id, {_WANT(4)} AS authors FROM books")
def author_mining(spark, sf_dir):
    b = books(spark, sf_dir).selectExpr("id", f"{_PAGE} AS page")
    return b.select("id", F.array_join(text.mined_authors(F.col("page")), "|").alias("authors"))


@query()
def partial_ratio(spark, sf_dir):
    b = books(spark, sf_dir).select("id", text.normalise(F.col("base")).alias("a"), text.normalise(F.col("text")).alias("b"))
    return b.select("id", F.round(fuzzy.partial(F.col("a"), F.col("b")), 6).alias("score"))


@query(D_ISBN + "SELECT id FROM rec WHERE list_contains(files, 'cover.jpg') AND id % 7 < 4")
def rule_c11(spark, sf_dir):
    b = records(spark, sf_dir).withColumn("cover_score", F.when(F.col("id") % 7 < 4, 0.5).otherwise(0.2))
    return b.where(rules.generated_cover().isNotNull()).select("id")


assert set(_CLEAN) <= set(D_RULES)
