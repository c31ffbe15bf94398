"""Queries of verification, lookups, duplicates, reviews, caches, manifests and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirework.functions import fuzzy, names, text
from quirework.operators import content, lookup, placement, review
from quirework.plans.adapter import books, cte
from quirework.plans.record_queries import _B, D_AUTHOR, D_ISBN, D_TITLE, d_segment, quoted, records
from quirework.plans.registry import query

# ---------------------------------------------------------------- verification

_NUMBER = "CASE WHEN id % 6 = 1 THEN coalesce(isbn, '9788071741305') WHEN id % 12 = 2 THEN '9788085906455' END"
D_CONTENT = D_ISBN + f", con AS (SELECT *, {_NUMBER} AS isbn_from_text FROM rec) "


@query(D_CONTENT + "SELECT id, coalesce(isbn IS NOT NULL AND ((isbn = isbn_from_text) OR contains(regexp_replace(left(text, 30000), '[^0-9]', '', 'g'), isbn)), false) AS confirmed FROM con")
def isbn_in_content(spark, sf_dir):
    c = content.with_content(records(spark, sf_dir))
    return c.select("id", content.isbn_in_content(F.col("isbn"), F.col("isbn_from_text"), content.windows()).alias("confirmed"))


@query(D_CONTENT + "SELECT id, CASE WHEN primary_file IS NULL THEN 'NO_CONTENT' WHEN isbn IS NULL OR isbn = isbn_from_text THEN 'VERIFIED' ELSE 'MISMATCH' END AS result FROM con WHERE isbn_from_text IS NOT NULL")
def verify_isbn_path(spark, sf_dir):
    return content.verify(content.with_content(records(spark, sf_dir)).where("isbn_from_text is not null")).select("id", "result")


def _formats(spark, sf_dir):
    """The formats of a book: its own text, and for others a foreign page and number."""
    c = content.with_content(records(spark, sf_dir)).select("id", "title", "isbn", "first_page", "isbn_from_text", F.explode("formats").alias("format"))
    number = F.when((F.col("format") == "mobi") & (F.col("id") % 4 == 1), F.lit("9788071741305")).otherwise(F.col("isbn_from_text"))
    return c.withColumn("isbn_from_text", number)


D_FORMATS = D_CONTENT + ", f0 AS (SELECT id, isbn, isbn_from_text, unnest(formats) AS format FROM con), f AS (SELECT id, format, isbn, CASE WHEN format = 'mobi' AND id % 4 = 1 THEN '9788071741305' ELSE isbn_from_text END AS n FROM f0), v AS (SELECT id, format, CASE WHEN n = isbn THEN 'AGREES' ELSE 'DISAGREES' END AS verdict FROM f WHERE n IS NOT NULL AND isbn IS NOT NULL) "


@query(D_FORMATS + "SELECT id, format, verdict FROM v")
def crosscheck_isbn(spark, sf_dir):
    f = _formats(spark, sf_dir).where("isbn is not null and isbn_from_text is not null")
    return content.classify_formats(f).select("id", "format", "verdict")


@query(D_FORMATS + ", n AS (SELECT id, count(*) AS files, count_if(verdict = 'AGREES') AS a, count_if(verdict = 'DISAGREES') AS d FROM v GROUP BY id), c AS (SELECT CASE WHEN files < 2 THEN 'skipped' WHEN a > 0 AND d > 0 THEN 'quarantine' WHEN d > 0 THEN 'ambiguous' ELSE 'clean' END AS decision FROM n) SELECT decision, count(*) AS n FROM c GROUP BY decision")
def crosscheck_summary(spark, sf_dir):
    f = _formats(spark, sf_dir).where("isbn is not null and isbn_from_text is not null")
    return content.crosscheck(content.classify_formats(f)).groupBy("decision").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- lookups


@query(D_ISBN + "SELECT id, to_json({'author': left(lower(coalesce(authors[1], '')), 50), 'isbn': isbn, 'title': left(lower(title), 80), 'year': year}) AS key FROM rec")
def cache_key(spark, sf_dir):
    return records(spark, sf_dir).select("id", lookup.cache_key(F.col("isbn"), F.col("title"), F.get("authors", F.lit(0)), F.col("year")).alias("key"))


def _sources(b):
    """Four sources of known coverage: two by number, two by title."""
    by = lambda cond, y: b.where(cond).select("id", (F.col("year") + y).cast("int").alias("found_year"))
    return [("databazeknih", by("isbn is not null and id % 4 = 0", 0)), ("legie", by("title <> '' and id % 5 = 1", 1)), ("openlibrary", by("isbn is not null and id % 3 = 1", 0)), ("google_books", by("isbn is not null and id % 2 = 0", 2))]


@query(D_ISBN + "SELECT id, CASE WHEN isbn IS NOT NULL AND id % 4 = 0 THEN 'databazeknih' WHEN title <> '' AND id % 5 = 1 THEN 'legie' WHEN isbn IS NOT NULL AND id % 3 = 1 THEN 'openlibrary' WHEN isbn IS NOT NULL AND id % 2 = 0 THEN 'google_books' END AS source, CAST(CASE WHEN isbn IS NOT NULL AND id % 4 = 0 THEN year WHEN title <> '' AND id % 5 = 1 THEN year + 1 WHEN isbn IS NOT NULL AND id % 3 = 1 THEN year WHEN isbn IS NOT NULL AND id % 2 = 0 THEN year + 2 END AS INT) AS found_year FROM rec")
def lookup_cascade(spark, sf_dir):
    b = records(spark, sf_dir)
    return lookup.first_hit(b.select("id"), _sources(b)).select("id", "best.source", "best.hit.found_year")


_CAND = "SELECT id, {p} AS pos, CAST({s} AS DOUBLE) AS score, CAST(coalesce(year, 2000) + {y} AS INT) AS year, year AS want_year FROM {t}"
_CANDS = [(0, "60 + id % 41", "5"), (1, "60 + (id * 7) % 41", "1"), (2, "60 + (id * 3) % 41", "0")]


@query(cte() + ", c AS (" + " UNION ALL ".join(_CAND.format(p=p, s=s, y=y, t="books") for p, s, y in _CANDS) + "), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(abs(year - want_year) <= 1, false) DESC, score DESC, pos) AS r FROM c WHERE score >= 70) SELECT id, pos, score FROM r WHERE r = 1")
def lookup_year_preference(spark, sf_dir):
    b = books(spark, sf_dir).select("id", "year")
    b.createOrReplaceTempView("__lookup_books")
    c = spark.sql(" UNION ALL ".join(_CAND.format(p=p, s=s, y=y, t="__lookup_books") for p, s, y in _CANDS))
    return lookup.best_candidate(c).select("id", "pos", "score")


@query("WITH c AS (SELECT event_id, CAST(ts AS DATE) AS cached_at, event_type <> 'error' AND event_id % 3 > 0 AS found FROM events), m AS (SELECT max(cached_at) AS as_of FROM c) SELECT event_id, found FROM c, m WHERE found OR date_diff('day', cached_at, as_of) <= 7")
def lookup_negative_ttl(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    c = e.select("event_id", F.to_date("ts").alias("cached_at"), ((F.col("event_type") != "error") & (F.col("event_id") % 3 > 0)).alias("found"))
    as_of = c.agg(F.max("cached_at")).first()[0]
    return lookup.live(c, F.lit(as_of)).select("event_id", "found")


_SOURCES = ["embedded", "databazeknih", "llm:high", "openlibrary", "google_books", "content", "llm:flash", "llm:loop", "llm:medium", "llm:low", "legie"]
_SRC = "CASE id % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SOURCES)) + " END"


@query(cte() + f", s AS (SELECT id, {_SRC} AS source FROM books) SELECT id, source, CASE WHEN source IN ('embedded', 'databazeknih', 'llm:high') THEN 'high' WHEN source IN ('openlibrary', 'google_books', 'content', 'llm:flash', 'llm:loop', 'llm:medium') THEN 'medium' ELSE 'low' END AS label FROM s")
def confidence_label(spark, sf_dir):
    return books(spark, sf_dir).selectExpr("id", f"{_SRC} AS source").select("id", "source", lookup.confidence(F.col("source")).alias("label"))


@query(cte() + f""", s AS (SELECT id, {_SRC} AS source, id % 7 = 0 AS confirmed, id % 3 > 0 AS proposed, id % 4 < 2 AS keeps, CASE WHEN id % 5 = 0 THEN 'u' END AS url,
CASE id % 9 WHEN 0 THEN 'C6' WHEN 1 THEN 'MISSING_COVER' WHEN 2 THEN 'C13' WHEN 3 THEN 'EMPTY_BOOK' ELSE 'C2' END AS cat, id % 11 = 0 AS other FROM books)
SELECT id, CASE WHEN cat = 'C6' THEN 'delete' WHEN source IS NOT NULL AND proposed AND (confirmed OR source IN ('embedded', 'databazeknih', 'llm:high')) THEN 'accept'
WHEN source IN ('openlibrary', 'google_books', 'content', 'llm:flash', 'llm:loop', 'llm:medium') AND proposed AND keeps THEN 'accept'
WHEN cat = 'MISSING_COVER' AND proposed AND url IS NOT NULL THEN 'accept' WHEN cat = 'MISSING_COVER' AND NOT proposed THEN 'accept'
WHEN source IS NOT NULL AND confirmed AND NOT proposed THEN 'accept' WHEN cat IN ('C13', 'EMPTY_BOOK') AND NOT other THEN 'accept' END AS action FROM s""")
def action_prefill(spark, sf_dir):
    cat = F.expr("CASE id % 9 WHEN 0 THEN 'C6' WHEN 1 THEN 'MISSING_COVER' WHEN 2 THEN 'C13' WHEN 3 THEN 'EMPTY_BOOK' ELSE 'C2' END")
    s = books(spark, sf_dir).select("id", F.expr(_SRC).alias("source"), cat.alias("cat"))
    s = s.withColumn("verdict", F.when(F.col("cat") == "C2", "NEEDS_REVIEW").otherwise("AUTO_FIXABLE"))
    finding = lambda c, v: F.struct(c.alias("category"), v.alias("verdict"))
    own = F.array(finding(F.col("cat"), F.col("verdict")))
    others = F.when(F.col("id") % 11 == 0, F.concat(own, F.array(finding(F.lit("C2"), F.lit("NEEDS_REVIEW"))))).otherwise(own)
    action = lookup.prefilled(F.col("cat"), F.col("verdict"), others, F.col("source"), F.col("id") % 7 == 0, F.col("id") % 3 > 0, F.col("id") % 4 < 2, F.when(F.col("id") % 5 == 0, "u"))
    return s.select("id", action.alias("action"))


@query(cte() + ", p AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'New Title' WHEN id % 4 = 1 THEN NULL END AS ptitle, CASE WHEN id % 6 = 0 THEN 'New Author' END AS pauthor, CASE WHEN id % 5 = 1 THEN 2020 END AS pyear FROM books) SELECT id, CASE WHEN id % 4 < 2 THEN coalesce(ptitle, '') ELSE title END AS title, array_to_string(CASE WHEN id % 6 < 2 THEN CASE WHEN pauthor IS NOT NULL THEN list_concat([pauthor], authors[2:]) ELSE [] END ELSE authors END, '|') AS authors, CAST(CASE WHEN id % 5 < 2 THEN pyear ELSE year END AS INT) AS year FROM p")
def apply_fields(spark, sf_dir):
    """Present keys set or clear, absent ones keep."""
    b = books(spark, sf_dir)
    keys = F.array_compact(F.array(F.when(F.col("id") % 4 < 2, "title"), F.when(F.col("id") % 6 < 2, "author"), F.when(F.col("id") % 5 < 2, "year")))
    p = b.select("id", "title", "authors", "year", keys.alias("keys"), F.when(F.col("id") % 4 == 0, "New Title").alias("ptitle"), F.when(F.col("id") % 6 == 0, "New Author").alias("pauthor"), F.when(F.col("id") % 5 == 1, 2020).alias("pyear"))
    done = lookup.applied(p, "keys", {"title": "ptitle", "author": "pauthor", "year": "pyear"})
    return done.select("id", "title", F.array_join("authors", "|").alias("authors"), "year")


# ---------------------------------------------------------------- duplicates

D_CLAIMS = D_ISBN + f", claims AS (SELECT *, '/lib/' || ({d_segment('(' + D_AUTHOR + ')')}) || '/' || ({d_segment('(' + D_TITLE + ')')}) AS dest FROM rec) "


def _claims(spark, sf_dir):
    b = records(spark, sf_dir)
    return b.withColumn("dest", names.target_path(_B(), "{author}/{title}"))


@query(D_CLAIMS + "SELECT dest, count(*) AS n, min(id) AS first_id FROM claims GROUP BY dest HAVING count(*) > 1")
def collision_groups(spark, sf_dir):
    return _claims(spark, sf_dir).groupBy("dest").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query(D_CLAIMS + "SELECT dest, arg_min(id, (CASE WHEN isbn IS NULL THEN 1000000000000 ELSE 0 END) + id) AS base_id FROM claims GROUP BY dest")
def pick_base(spark, sf_dir):
    c = _claims(spark, sf_dir)
    return c.groupBy("dest").agg(F.min_by("id", F.struct(F.col("isbn").isNull(), F.col("id"))).alias("base_id"))


@query(D_CLAIMS + """, o AS (SELECT *, (CASE WHEN isbn IS NULL THEN 1000000000000 ELSE 0 END) + id AS o FROM claims),
a AS (SELECT dest, o, unnest(authors) AS a, generate_subscripts(authors, 1) AS p FROM o), u AS (SELECT dest, lower(a) AS k, min(o * 100 + p) AS op, arg_min(a, o * 100 + p) AS a FROM a GROUP BY dest, lower(a)),
l AS (SELECT dest, string_agg(a, '|' ORDER BY op) AS authors FROM u GROUP BY dest)
SELECT g.*, coalesce(l.authors, '') AS authors FROM (SELECT dest, arg_min(id, o) AS base_id, arg_min(nullif(title, ''), o) FILTER (WHERE title <> '') AS title, arg_min(isbn, o) FILTER (WHERE isbn IS NOT NULL) AS isbn,
arg_min(publisher, o) FILTER (WHERE publisher IS NOT NULL) AS publisher, arg_min(year, o) FILTER (WHERE year IS NOT NULL) AS year, count(*) AS members FROM o GROUP BY dest) g LEFT JOIN l ON g.dest = l.dest""")
def merge_fields(spark, sf_dir):
    m = placement.merged(_claims(spark, sf_dir), "dest")
    return m.select("dest", "base_id", "title", "isbn", "publisher", "year", "members", F.coalesce(F.array_join("authors", "|"), F.lit("")).alias("authors"))


@query(D_CLAIMS + ", s AS (SELECT dest, count(*) AS n, count(year) AS ys, count(DISTINCT year) AS yd FROM claims GROUP BY dest), j AS (SELECT c.id, c.year, c.dest, n, ys = n AND yd = n AS by_year, string_split(c.dest, '/')[-1] AS name FROM claims c JOIN s ON c.dest = s.dest) SELECT id, CASE WHEN n = 1 THEN dest WHEN by_year THEN CASE WHEN contains(name, '(' || year || ')') THEN dest ELSE dest || ' (' || year || ')' END WHEN contains(name, '(' || id || ')') OR contains(name, '(id' || id || ')') THEN dest ELSE dest || ' (id' || id || ')' END AS final FROM j")
def disambiguation(spark, sf_dir):
    return placement.disambiguated(_claims(spark, sf_dir)).select("id", "final")


@query(D_CLAIMS + ", r AS (SELECT id, dest, row_number() OVER (PARTITION BY dest ORDER BY id) - 1 AS k FROM claims) SELECT id, CASE WHEN k = 0 THEN dest ELSE dest || ' (dup ' || k || ')' END AS final FROM r")
def dup_number(spark, sf_dir):
    return placement.duplicates_numbered(_claims(spark, sf_dir)).select("id", "final")


@query(D_ISBN + ", k AS (SELECT id, substr(isbn, 1, 11) AS isbn FROM rec WHERE isbn IS NOT NULL) SELECT isbn, min(id) AS rep, count(*) AS members FROM k GROUP BY isbn HAVING count(*) > 1")
def same_book_isbn(spark, sf_dir):
    """Records of one number (here its first eleven digits, so that groups exist): a representative and the members, not all pairs."""
    k = records(spark, sf_dir).where("isbn is not null").select("id", F.substring("isbn", 1, 11).alias("isbn"))
    return k.groupBy("isbn").agg(F.min("id").alias("rep"), F.count("*").alias("members")).where("members > 1")


@query()
def greedy_clusters(spark, sf_dir):
    """Order-dependent clusters within a place: a record joins the first cluster whose base is the same book."""
    from quirework.operators.clusters import greedy

    return greedy(_claims(spark, sf_dir).select("dest", "id", "title", "authors", "isbn", "year"))


@query("WITH f AS (SELECT l_orderkey AS folder, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price, 'file' || (l_partkey % 3) || '.epub' AS name, l_suppkey % 2 AS content FROM lineitem), w AS (SELECT *, row_number() OVER o AS r, first_value(content) OVER o AS c FROM f WINDOW o AS (PARTITION BY folder, name ORDER BY n, supp, part, price)) SELECT folder, n, part, supp, name, CASE WHEN r = 1 THEN 'kept' WHEN content = c THEN 'identical' ELSE 'renamed' END AS outcome FROM w")
def file_merge_plan(spark, sf_dir):
    """Files of merged folders (orders here): the first of a name stays, identical ones are skipped, others get a new name."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.concat(F.lit("file"), (F.col("l_partkey") % 3).cast("string"), F.lit(".epub"))
    f = l.select(F.col("l_orderkey").alias("folder"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_extendedprice", name.alias("name"), (F.col("l_suppkey") % 2).alias("content"))
    w = Window.partitionBy("folder", "name").orderBy("n", "supp", "part", "l_extendedprice")
    first, kept = F.first("content").over(w), F.row_number().over(w) == 1
    return f.select("folder", "n", "part", "supp", "name", F.when(kept, "kept").when(F.col("content") == first, "identical").otherwise("renamed").alias("outcome"))


# ---------------------------------------------------------------- reviews

_PRIOR = "SELECT uuid, id AS pos, CASE id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN NULL ELSE 'keep' END AS action, concat('old ', id) AS proposed, concat('note ', id) AS notes, concat('/old/', id) AS path FROM {t} WHERE id % 4 < 3"
_NEW = "SELECT uuid, CASE WHEN id % 2 = 0 THEN 'accept' END AS action, concat('new ', id) AS proposed, path FROM {t} WHERE id % 4 > 0"


def _review(spark, sf_dir):
    books(spark, sf_dir).createOrReplaceTempView("__review_books")
    return spark.sql(_NEW.format(t="__review_books")), spark.sql(_PRIOR.format(t="__review_books"))


@query(cte() + f", n AS ({_NEW.format(t='books')}), p AS ({_PRIOR.format(t='books')}) SELECT coalesce(n.uuid, p.uuid) AS uuid, CASE WHEN p.action IS NOT NULL OR n.uuid IS NULL THEN p.action ELSE n.action END AS action, CASE WHEN p.action IS NOT NULL OR n.uuid IS NULL THEN p.proposed ELSE n.proposed END AS proposed, p.notes AS notes, coalesce(n.path, p.path) AS path, CASE WHEN n.uuid IS NULL THEN 'carried' WHEN p.action IS NOT NULL THEN 'kept' ELSE 'built' END AS state FROM n FULL OUTER JOIN p ON n.uuid = p.uuid")
def review_carry_over(spark, sf_dir):
    return review.carried_over(*_review(spark, sf_dir))


@query(cte() + f", p AS ({_PRIOR.format(t='books')}) SELECT uuid, action FROM p WHERE pos % 5 > 0")
def review_prune(spark, sf_dir):
    _, prior = _review(spark, sf_dir)
    return review.pruned(prior, prior.where("pos % 5 = 0").select("uuid")).select("uuid", "action")


@query(cte() + f", p AS ({_PRIOR.format(t='books')}) SELECT uuid, CASE WHEN pos % 7 = 0 THEN '/new/' || pos ELSE path END AS path, pos % 7 = 0 AS changed FROM p")
def review_path_update(spark, sf_dir):
    _, prior = _review(spark, sf_dir)
    moves = prior.where("pos % 7 = 0").select("uuid", F.concat(F.lit("/new/"), F.col("pos").cast("string")).alias("new_path"))
    return review.repointed(prior, moves).select("uuid", "path", "changed")


_ENTRY = "SELECT id, path, CASE id % 6 WHEN 0 THEN 'accept' WHEN 1 THEN 'keep' WHEN 2 THEN 'delete' WHEN 3 THEN 'odd' WHEN 4 THEN NULL ELSE 'accept' END AS action FROM {t}"


@query(cte() + f", e AS ({_ENTRY.format(t='books')}), s AS (SELECT CASE WHEN action IS NULL THEN 'skipped' WHEN action = 'odd' THEN 'error' WHEN id % 10 = 9 THEN 'error' WHEN action = 'delete' THEN 'deleted' WHEN action = 'keep' THEN 'kept' ELSE 'applied' END AS step FROM e) SELECT step, count(*) AS n FROM s GROUP BY step")
def apply_plan_summary(spark, sf_dir):
    b = books(spark, sf_dir)
    b.createOrReplaceTempView("__plan_books")
    folders = b.where("id % 10 <> 9").select("path")
    return review.apply_plan(spark.sql(_ENTRY.format(t="__plan_books")), folders).groupBy("step").agg(F.count("*").alias("n"))


@query(cte() + ", e AS (" + _ENTRY.format(t="books") + ") SELECT e.id FROM e JOIN books b ON e.id = b.id WHERE action IS NULL AND contains(lower(concat_ws(' ', b.path, b.author_folder, b.title)), 'asimov')")
def review_filter(spark, sf_dir):
    b = books(spark, sf_dir).withColumn("action", F.expr("CASE id % 6 WHEN 0 THEN 'accept' WHEN 1 THEN 'keep' WHEN 2 THEN 'delete' WHEN 3 THEN 'odd' WHEN 4 THEN NULL ELSE 'accept' END"))
    return b.where(F.col("action").isNull() & F.contains(F.lower(F.concat_ws(" ", "path", "author_folder", "title")), F.lit("asimov"))).select("id")


_KEPT = "CASE WHEN NOT verified THEN id END"


@query(cte() + f""" SELECT id, coalesce(min({_KEPT}) OVER (PARTITION BY language ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min({_KEPT}) OVER (PARTITION BY language)) AS next_id,
coalesce(max({_KEPT}) OVER (PARTITION BY language ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max({_KEPT}) OVER (PARTITION BY language)) AS prev_id FROM books""")
def next_prev_entry(spark, sf_dir):
    """Neighbours in each language's list of unverified entries, its ends joined; verified ones have those between which they would stand."""
    from quirework.operators.neighbours import neighbours

    n = neighbours(books(spark, sf_dir).select("id", "language", "verified"), "language", "id", ~F.col("verified"))
    return n.select("id", F.col("next").alias("next_id"), F.col("prev").alias("prev_id"))


# ---------------------------------------------------------------- caches and manifests


@query("SELECT l_orderkey AS path, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS mtime, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size FROM lineitem GROUP BY l_orderkey")
def change_token(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_quantity")
    return l.groupBy(F.col("l_orderkey").alias("path")).agg(F.max(F.to_date("l_shipdate")).cast("string").alias("mtime"), F.sum(F.col("l_quantity").cast("long")).alias("size"))


@query("WITH now AS (SELECT l_orderkey AS path, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size FROM lineitem GROUP BY l_orderkey), snap AS (SELECT path, CASE WHEN path % 3 = 0 THEN size + 1 ELSE size END AS size FROM now WHERE path % 5 > 0) SELECT n.path, CASE WHEN s.path IS NULL THEN 'new' WHEN s.size <> n.size THEN 'changed' ELSE 'hit' END AS state FROM now n LEFT JOIN snap s ON n.path = s.path")
def cache_hit_miss(spark, sf_dir):
    """A folder's token against the snapshot; both sides are partitioned by the same aggregate, so the join adds no shuffle of its own."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity")
    now = l.groupBy(F.col("l_orderkey").alias("path")).agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    snap = now.where("path % 5 > 0").select("path", F.when(F.col("path") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("size"), "changed").otherwise("hit")
    return now.join(snap, "path", "left").select("path", state.alias("state"))


_MANIFEST = """concat('{"title": "T', id, '", "authors": ["A', id % 7, '", ""], "publishedYear": "', 900 + id % 300, '-05", "isbn": "', body, '", "verified": ', CASE WHEN id % 4 = 0 THEN 'true' ELSE 'false' END, ', "series": [', CASE id % 3 WHEN 0 THEN '{"name": "S", "sequence": "2"}' WHEN 1 THEN '"Plain"' ELSE '{"name": "S", "index": "7"}' END, '], "extra": 1}')"""


@query(cte() + f", m AS (SELECT id, {_MANIFEST} AS j FROM books) SELECT id, j->>'$.title' AS title, array_to_string(list_filter(CAST(j->'$.authors' AS VARCHAR[]), lambda a: a <> ''), '|') AS authors, CASE WHEN TRY_CAST(substr(j->>'$.publishedYear', 1, 4) AS INT) >= 1000 THEN TRY_CAST(substr(j->>'$.publishedYear', 1, 4) AS INT) END AS year, (j->>'$.verified') = 'true' AS verified FROM m")
def manifest_scan(spark, sf_dir):
    from quirework.sources.manifest import scanned

    m = books(spark, sf_dir).selectExpr("id", f"{_MANIFEST} AS j")
    return m.withColumn("m", scanned(F.col("j"))).select("id", "m.title", F.array_join("m.authors", "|").alias("authors"), "m.year", "m.verified")


@query(cte() + f", m AS (SELECT id, {_MANIFEST} AS j FROM books) SELECT id, CASE WHEN json_type(j->'$.series[0]') = 'VARCHAR' THEN j->>'$.series[0]' ELSE j->>'$.series[0].name' END AS name, CASE WHEN json_type(j->'$.series[0]') = 'VARCHAR' THEN '' ELSE coalesce(j->>'$.series[0].index', j->>'$.series[0].sequence', '') END AS idx FROM m")
def series_pair(spark, sf_dir):
    from quirework.sources.manifest import scanned

    m = books(spark, sf_dir).selectExpr("id", f"{_MANIFEST} AS j").withColumn("m", scanned(F.col("j")))
    return m.select("id", F.get("m.series", F.lit(0))["name"].alias("name"), F.get("m.series", F.lit(0))["index"].alias("idx"))


_DATE = "CASE id % 5 WHEN 0 THEN '0101-01-01T00:00:00' WHEN 1 THEN concat(1300 + id % 400, '-02-03') WHEN 2 THEN 'no date' WHEN 3 THEN NULL ELSE concat('', 1990 + id % 30) END"


@query(cte() + f", d AS (SELECT id, {_DATE} AS d FROM books) SELECT id, CASE WHEN starts_with(d, '0101-01-01') THEN NULL WHEN TRY_CAST(regexp_extract(d, '^(\\d{{4}})', 1) AS INT) BETWEEN 1400 AND 2100 THEN TRY_CAST(regexp_extract(d, '^(\\d{{4}})', 1) AS INT) END AS year FROM d")
def opf_year(spark, sf_dir):
    from quirework.sources.manifest import opf_year as year

    return books(spark, sf_dir).selectExpr("id", f"{_DATE} AS d").select("id", year(F.col("d")).alias("year"))


@query(cte() + "SELECT id, CASE WHEN id % 10 > 0 THEN concat('T', id) END AS title, CASE WHEN id % 10 > 0 THEN 'Jan N' ELSE '' END AS authors, CASE WHEN id % 10 > 0 THEN '9788071741305' END AS isbn, CAST(CASE WHEN id % 10 > 0 THEN 1999 END AS INT) AS year, CASE WHEN id % 10 > 0 THEN 'sf' ELSE '' END AS tags, CASE WHEN id % 10 > 0 THEN 'S' END AS series, id % 10 = 0 AS failed FROM books")
def opf_scan(spark, sf_dir):
    """Package documents parsed in Arrow batches; malformed ones give an error, not a failed job."""
    from quirework.sources.manifest import parsed_opf

    xml = F.when(F.col("id") % 10 == 0, "<package><broken").otherwise(F.concat(F.lit('<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata><dc:title>T'), F.col("id").cast("string"), F.lit('</dc:title><dc:creator opf:role="aut">Jan N</dc:creator><dc:creator opf:role="trl">X Y</dc:creator><dc:identifier opf:scheme="ISBN">8071741302</dc:identifier><dc:date>1999-01-01</dc:date><dc:subject>sf</dc:subject><meta name="calibre:series" content="S"/></metadata></package>')))
    b = books(spark, sf_dir).select("id", parsed_opf(xml).alias("o"))
    return b.select("id", "o.title", F.array_join("o.authors", "|").alias("authors"), "o.isbn", "o.year", F.array_join("o.tags", "|").alias("tags"), "o.series", F.col("o.error").isNotNull().alias("failed"))


_EPUB = ["azw3", "mobi", "prc", "pdf", "rtf", "txt", "docx"]


@query(cte() + ", r AS (SELECT id, list_contains(formats, 'epub') AS has, list_filter([" + quoted(_EPUB) + "], lambda f: list_contains(formats, f)) AS src FROM books) SELECT id, CASE WHEN has THEN 'already_exists' WHEN len(src) = 0 THEN 'no_source' ELSE 'convert' END AS plan, CASE WHEN NOT has THEN src[1] END AS source FROM r")
def epub_source_pick(spark, sf_dir):
    has = F.array_contains("formats", "epub")
    src = F.filter(F.array(*map(F.lit, _EPUB)), lambda f: F.array_contains(F.col("formats"), f))
    return books(spark, sf_dir).select("id", F.when(has, "already_exists").when(F.size(src) == 0, "no_source").otherwise("convert").alias("plan"), F.when(~has, F.get(src, F.lit(0))).alias("source"))


# ---------------------------------------------------------------- rates, streams, answers


@query("WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), r AS (SELECT event_id, bad, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM e) SELECT event_id, CAST(least(60, 5 * power(2, least(run, 10) - 1)) AS BIGINT) AS cooldown FROM r WHERE bad")
def cooldown_escalation(spark, sf_dir):
    """Cool-down after each refusal in a row: 5, 10, 20 ... 60 seconds; a success ends the row (gaps and islands)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("bad"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w))
    run = F.sum(F.col("bad").cast("int")).over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id"))
    return e.withColumn("run", run).where("bad").select("event_id", F.least(F.lit(60), 5 * F.pow(F.lit(2), F.least("run", F.lit(10)) - 1)).cast("long").alias("cooldown"))


@query("WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events), f AS (SELECT *, max(t / 1e6 - k * 2.0) OVER (PARTITION BY user_id ORDER BY t, event_id) AS free FROM e) SELECT event_id, round(free + k * 2.0 - t / 1e6, 3) AS wait FROM f")
def leaky_bucket_admission(spark, sf_dir):
    """When each call of a user is admitted: at its time, or an interval after the one before. The running maximum of (time - n * interval)
    gives it in one window, without state: admitted(n) = n * interval + max over k <= n of (time(k) - k * interval)."""
    interval = 2.0
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = e.withColumn("k", F.row_number().over(w))
    free = F.max(F.col("t") / 1e6 - F.col("k") * interval).over(w)
    return e.withColumn("free", free).select("event_id", F.round(F.col("free") + F.col("k") * interval - F.col("t") / 1e6, 3).alias("wait"))


@query("WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type <> 'view') SELECT user_id, event_type AS decision FROM e WHERE r = 1")
def stream_review_first_decision(spark, sf_dir):
    """Decisions read as a stream, the first of each key wins whatever comes later."""
    from quirework.streaming.review import first_decisions

    return first_decisions(spark, f"{sf_dir}/events.parquet")


_RESULT = [
    "md5(concat('book-', doc_id)) AS uuid", "doc_id AS pos", "doc_id % 5 > 0 AS wanted", "CASE doc_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'delete' END AS action", "concat('new ', doc_id) AS proposed",
    "concat('/now/', doc_id) AS path", "doc_id % 8 = 0 AS verified",
]
_EARLIER = [
    "md5(concat('book-', doc_id)) AS uuid", "doc_id * 10 + k AS pos", "CASE doc_id % 6 WHEN 0 THEN 'keep' WHEN 3 THEN 'accept' END AS action", "concat('old ', doc_id, '-', k) AS proposed",
    "concat('note ', doc_id) AS notes", "concat('/was/', doc_id) AS path", "doc_id % 9 = 0 AS verified",
]
D_STREAM = f"""WITH e AS (SELECT {", ".join(_EARLIER)} FROM (SELECT doc_id, unnest([1, 2]) AS k FROM documents WHERE doc_id % 3 < 2)), p AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY pos DESC) = 1), r AS (SELECT {", ".join(_RESULT)} FROM documents WHERE doc_id % 7 > 0),
w AS (SELECT * FROM r WHERE wanted), fin AS (SELECT w.uuid, CASE WHEN p.action IS NOT NULL THEN p.action ELSE w.action END AS action, CASE WHEN p.action IS NOT NULL THEN p.proposed ELSE w.proposed END AS proposed, p.notes, w.path, CASE WHEN p.action IS NOT NULL THEN p.verified ELSE w.verified END AS verified,
CASE WHEN p.action IS NOT NULL THEN 'kept' ELSE 'built' END AS state FROM w LEFT JOIN p ON w.uuid = p.uuid UNION ALL SELECT p.uuid, p.action, p.proposed, p.notes, p.path, p.verified, 'carried' FROM p ANTI JOIN w ON p.uuid = w.uuid) """


def _streamed(spark, sf_dir):
    """Results as they come, all of them twice, against an earlier review with repeated entries."""
    from quirework.streaming import review
    from quirework.tables import scratch

    documents = f"{sf_dir}/documents.parquet"
    earlier = spark.read.parquet(documents).where("doc_id % 3 < 2").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr(*_EARLIER)
    once = lambda: review.stream_of(spark, documents).where("doc_id % 7 > 0").selectExpr(*_RESULT)
    out = scratch(spark, "entries")
    return review.closed(review.reviewed(once().union(once()), earlier, out, f"{out}-state"), earlier)


@query(D_STREAM + "SELECT * FROM fin")
def stream_review_state(spark, sf_dir):
    """The review after a stream of results: decided entries kept, others built, the rest carried over."""
    return _streamed(spark, sf_dir)


@query(D_STREAM + "SELECT count(*) AS written, count_if(state = 'kept') AS kept, count_if(state = 'carried') AS carried, count_if(state = 'built' AND action = 'accept') AS accept, count_if(state = 'built' AND action IS NULL) AS open, count_if(state = 'built' AND action <> 'accept') AS other, count_if(state = 'built' AND verified) AS verified FROM fin")
def stream_review_summary(spark, sf_dir):
    from quirework.streaming.review import summary

    return summary(_streamed(spark, sf_dir))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf_dir):
    """Replayed events read as a stream, each kept once within the watermark."""
    from quirework.streaming.review import deduplicated

    return deduplicated(spark, f"{sf_dir}/events.parquet")


@query(cte() + "SELECT id, CASE WHEN id % 5 <> 3 THEN concat('T', id) END AS title, CASE WHEN id % 5 = 2 THEN 'A|B' ELSE '' END AS authors, CAST(CASE WHEN id % 5 = 0 THEN 1999 END AS INT) AS year FROM books")
def json_sanitize(spark, sf_dir):
    from quirework.functions.answers import parsed

    raw = F.expr("""CASE id % 5 WHEN 0 THEN concat('```json\\n{"title": "T', id, '", "year": 1999,}\\n```') WHEN 1 THEN concat('{"title": "T', id, '", "isbn": None, "ok": True}') WHEN 2 THEN concat('{"title": "T', id, '", "authors": ["A", "B') WHEN 3 THEN 'no json' ELSE concat('text before {"title": "T', id, '", "year": "0999"} after') END""")
    return books(spark, sf_dir).select("id", parsed(raw).alias("a")).select("id", "a.title", F.array_join("a.authors", "|").alias("authors"), "a.year")
