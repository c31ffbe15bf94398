"""Queries of text functions, title pages, repair and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.functions import constants as C
from quirework.functions import fuzzy, repair, text
from quirework.plans.adapter import books, cte
from quirework.plans.record_queries import quoted
from quirework.plans.registry import query

D_NORM = lambda s: f"trim(regexp_replace(lower(translate({s}, '{C.FOLD_VERIFY[0]}', '{C.FOLD_VERIFY[1]}')), '\\s+', ' ', 'g'))"
_SAMPLE = "concat('Čas  přílivu ŽLUŤOUČKÝ\tkůň ľĺŕ ôäü ', text)"


@query(cte() + f", s AS (SELECT id, {_SAMPLE} AS s FROM books) SELECT id, {D_NORM('s')} AS norm FROM s")
def text_normalize(spark, sf_dir):
    s = books(spark, sf_dir).selectExpr("id", f"{_SAMPLE} AS s")
    return s.select("id", text.normalise(F.col("s")).alias("norm"))


@query(cte() + f", s AS (SELECT id, {_SAMPLE} AS s FROM books) SELECT id, translate(s, '{C.FOLD_RULES[0]}', '{C.FOLD_RULES[1]}') AS rules, translate(s, '{C.FOLD_PROPOSALS[0]}', '{C.FOLD_PROPOSALS[1]}') AS proposals, translate(s, '{C.FOLD_VERIFY[0]}', '{C.FOLD_VERIFY[1]}') AS verify FROM s")
def accent_fold_variants(spark, sf_dir):
    s = books(spark, sf_dir).selectExpr("id", f"{_SAMPLE} AS s")
    return s.select("id", *[F.translate("s", *t).alias(n) for n, t in (("rules", C.FOLD_RULES), ("proposals", C.FOLD_PROPOSALS), ("verify", C.FOLD_VERIFY))])


_REFS = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#8217;', '''')"
D_HTML = "regexp_replace(regexp_replace(regexp_replace(" + _REFS.format(f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{C.BLOCK_ENDS}', chr(10), 'gi'), '<br\\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')") + ", '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, md5({D_HTML}) AS text_md5, length({D_HTML}) AS n_chars FROM pages")
def html_to_text(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.html_to_text(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("text_md5"), F.char_length("t").cast("long").alias("n_chars"))


_ITEMS = "WITH s AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS items FROM documents)"
_LEFT = lambda items: f"array_to_string(list_filter({items}, lambda x: length(trim(x)) > 5), ' | ')"


def _spine(spark, sf_dir):
    """Spine items are the document's lines. Places are counted first; items of five characters or fewer are left out then."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("items"))
    return d, lambda items: F.array_join(F.filter(items, lambda x: F.char_length(F.trim(x)) > 5), " | ")


@query(f"{_ITEMS} SELECT id, left({_LEFT('items[1:8]')}, 8000) AS first_page FROM s")
def first_page_window(spark, sf_dir):
    """The first eight items, at most 8000 characters."""
    d, kept = _spine(spark, sf_dir)
    return d.select("id", F.left(kept(F.slice("items", 1, 8)), F.lit(8000)).alias("first_page"))


@query(f"{_ITEMS} SELECT id, md5({_LEFT('CASE WHEN len(items) <= 10 THEN items ELSE list_concat(items[1:5], items[-5:]) END')}) AS scanned FROM s")
def spine_isbn_window(spark, sf_dir):
    """The first five and the last five items."""
    d, kept = _spine(spark, sf_dir)
    window = F.when(F.size("items") <= 10, F.col("items")).otherwise(F.concat(F.slice("items", 1, 5), F.expr("slice(items, greatest(size(items) - 4, 1), 5)")))
    return d.select("id", F.md5(kept(window)).alias("scanned"))


@query("SELECT doc_id AS id, coalesce(length(text) >= 80 AND len(regexp_extract_all(regexp_replace(regexp_replace(text, '@page\\s*\\{[^}]*\\}', ' ', 'g'), '[{};]', ' ', 'g'), '[A-Za-zÁ-ž]{3,}')) >= 8, false) AS usable FROM documents")
def usable_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), text.usable(F.col("text")).alias("usable"))


_VALUE = "CASE id % 12 WHEN 0 THEN NULL WHEN 1 THEN 'Neznamy' WHEN 2 THEN 'a_b' WHEN 3 THEN 'kniha.EPUB' WHEN 4 THEN 'bullet • x' WHEN 5 THEN '„Uvozovky“ – …' WHEN 6 THEN '' ELSE title END"
D_BROKEN = lambda s: f"({s} IS NULL OR {s} IN ({quoted(C.BROKEN)}) OR contains({s}, '_') OR regexp_matches(lower({s}), '{'|'.join(e.replace('.', chr(92) + '.') for e in C.BROKEN_EXTENSIONS)}') OR regexp_matches({s}, '[^\\x{{0}}-\\x{{2000}}{C.QUOTES_AND_DASHES}]'))"


@query(cte() + f", v AS (SELECT id, {_VALUE} AS v FROM books) SELECT id, v AS value, {D_BROKEN('v')} AS broken FROM v")
def looks_broken(spark, sf_dir):
    v = books(spark, sf_dir).selectExpr("id", f"{_VALUE} AS value")
    return v.select("id", "value", text.looks_broken(F.col("value")).alias("broken"))


_PAIRS = ("CASE id % 8 WHEN 0 THEN 'Čas přílivu' WHEN 1 THEN 'Čas Přílivu' WHEN 2 THEN 'Nadace' WHEN 3 THEN '' WHEN 4 THEN 'x_y' WHEN 5 THEN 'Nový text' ELSE title END",
          "CASE id % 8 WHEN 0 THEN 'Cas prilivu' WHEN 1 THEN 'Čas přílivu' WHEN 2 THEN 'Nad_ace' WHEN 3 THEN 'Duna' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE base END")
_TOK = lambda s: f"list_filter(regexp_split_to_array({s}, '\\s+'), lambda w: w <> '')"
_CAPS = lambda s: f"len(list_filter({_TOK(s)}[2:], lambda w: regexp_matches(w, '^\\p{{Lu}}')))"
_FOLD = lambda s: f"lower(translate({s}, '{C.FOLD_PROPOSALS[0]}', '{C.FOLD_PROPOSALS[1]}'))"


@query(cte() + f", v AS (SELECT id, {_PAIRS[0]} AS n, {_PAIRS[1]} AS o FROM books) SELECT id, CASE WHEN coalesce(n, '') = '' THEN false WHEN coalesce(o, '') = '' THEN true WHEN {D_BROKEN('o')} AND NOT {D_BROKEN('n')} THEN true WHEN NOT {D_BROKEN('o')} AND NOT {D_BROKEN('n')} THEN (regexp_matches(n, '[{C.CZ_MARKS}]') AND NOT regexp_matches(o, '[{C.CZ_MARKS}]') AND {_FOLD('n')} = {_FOLD('o')}) OR (lower(n) = lower(o) AND len({_TOK('n')}) >= 2 AND len({_TOK('n')}) = len({_TOK('o')}) AND {_CAPS('n')} > {_CAPS('o')}) ELSE false END AS better FROM v")
def is_better(spark, sf_dir):
    v = books(spark, sf_dir).selectExpr("id", f"{_PAIRS[0]} AS n", f"{_PAIRS[1]} AS o")
    return v.select("id", text.is_better(F.col("n"), F.col("o")).alias("better"))


#: Title pages with known contents; {id} makes them differ.
PAGES = [
    ("concat('Název: Poslední cesty číslo ', id, ' Autor: Jan Novák Nakladatelství: Argo, Praha 1999 Rok vydání: 2001')", "concat('Poslední Cesty Číslo ', id)", "'Argo'", "2001", "'Jan Novák'"),
    ("concat('Neznámý ČAS PŘÍLIVU Agatha Christie | ', id)", "'Čas Přílivu'", "NULL", "NULL", "''"),
    ("concat('*** angličtina pro každého ', id, ' ***')", "concat('Angličtina Pro Každého ', id)", "NULL", "NULL", "''"),
    ("concat('Cover @page {padding: 0pt} PROLOG', chr(10), 'kniha o čase ', id, chr(10), 'Vydalo: Mladá fronta 1987')", "concat('Kniha O Čase ', id)", "'Mladá fronta'", "1987", "''"),
    ("concat('obsah', chr(10), 'autor: Karel Čapek', chr(10), 'tichý dům ', id)", "concat('Tichý Dům ', id)", "NULL", "NULL", "'Karel Čapek'"),
    ("'... ---'", "NULL", "NULL", "NULL", "''"),
]
_PAGE = "CASE id % 6 " + " ".join(f"WHEN {i} THEN {p[0]}" for i, p in enumerate(PAGES)) + " END"
_WANT = lambda k: "CASE id % 6 " + " ".join(f"WHEN {i} THEN {p[k]}" for i, p in enumerate(PAGES)) + " END"


def _mined(name: str, column: str, k: int, f) -> None:
    def run(spark, sf_dir):
        pages = books(spark, sf_dir).selectExpr("id", f"{_PAGE} AS page")
        return pages.select("id", f(F.col("page")).alias(column))

    query(cte() + f"SELECT id, {_WANT(k)} AS {column} FROM books", name)(run)


_mined("title_mining", "title", 1, text.mined_title)
_mined("publisher_mining", "publisher", 2, text.mined_publisher)
_mined("year_mining", "year", 3, text.mined_year)


@query(cte() + ", w AS (SELECT id, unnest(regexp_split_to_array(text, '\\s+')) AS w, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) AS i FROM books), c AS (SELECT id, i, CASE WHEN regexp_matches(regexp_replace(w, '[^A-Za-zÁ-ž]', '', 'g'), '\\p{Lu}') AND NOT regexp_matches(regexp_replace(w, '[^A-Za-zÁ-ž]', '', 'g'), '\\p{Ll}') AND length(regexp_replace(w, '[^A-Za-zÁ-ž]', '', 'g')) <= 3 AND NOT regexp_matches(lower(w), '[" + C.CZ_PAGE_LETTERS + "]') THEN w ELSE replace(upper(left(w, 1)), 'ẞ', 'SS') || lower(substr(w, 2)) END AS t FROM w WHERE w <> '') SELECT b.id, coalesce(string_agg(c.t, ' ' ORDER BY c.i), '') AS title FROM books b LEFT JOIN c ON b.id = c.id GROUP BY b.id")
def title_case(spark, sf_dir):
    return books(spark, sf_dir).select("id", text.title_case(F.col("text")).alias("title"))


_PHRASE = "Příliš žluťoučký kůň běží číslo "
_LATIN = "Kůň běží přes řeku číslo "
#: (what is read, what it was) by id: Cyrillic and Latin readings of cp1250, escaped bytes, names that are right as they are, and a lost letter.
DAMAGE = [
    ("'Jiшн Kosek'", "'Jiří Kosek'"), ("concat('\\376\\377', '\\000K\\000u')", "'Ku'"), ("'François Villon'", "'François Villon'"), ("'Pan Wołodyjowski'", "'Pan Wołodyjowski'"),
    ("'Kamenáè Bill'", "'Kamenáč Bill'"), ("'x�'", "NULL"), (f"concat('{_PHRASE.encode('cp1250').decode('cp1251')}', id)", f"concat('{_PHRASE}', id)"),
    (f"concat('{_LATIN.encode('cp1250').decode('cp1252')}', id)", f"concat('{_LATIN}', id)"),
]
_DAMAGED, D_WHOLE = ("CASE id % 8 " + " ".join(f"WHEN {k} THEN {d[at]}" for k, d in enumerate(DAMAGE)) + " END" for at in (0, 1))
_DAMAGED_SPARK = _DAMAGED.replace("\\", "\\\\")
_ALIEN = "".join(c for c in C.LATIN1_HIGH if c not in C.CZ_ALL)
D_MOJIBAKE = f"CASE WHEN coalesce(s, '') = '' THEN 'none' WHEN regexp_matches(s, '\\\\[0-3][0-7]{{2}}') THEN 'octal_escape' WHEN regexp_matches(s, '[{C.MOJIBAKE_STRONG}�]') OR (regexp_matches(s, '[\\x{{400}}-\\x{{4FF}}]') AND regexp_matches(s, '[A-Za-z]')) OR (regexp_matches(s, '[{C.CZ_ALL}]') AND regexp_matches(s, '[{_ALIEN}]')) THEN 'misdecoded' ELSE 'none' END"


@query(cte() + f", v AS (SELECT id, {_DAMAGED} AS s FROM books) SELECT id, {D_MOJIBAKE} AS kind FROM v")
def mojibake_detect(spark, sf_dir):
    return books(spark, sf_dir).selectExpr("id", f"{_DAMAGED_SPARK} AS s").select("id", text.mojibake(F.col("s")).alias("kind"))


@query(cte() + f", v AS (SELECT id, {_DAMAGED} AS s, {D_WHOLE} AS value FROM books) SELECT id, {D_MOJIBAKE} AS kind, value FROM v WHERE kind <> 'none'")
def mojibake_repair(spark, sf_dir):
    """Damaged rows only reach Python."""
    v = books(spark, sf_dir).selectExpr("id", f"{_DAMAGED_SPARK} AS s").withColumn("kind", text.mojibake(F.col("s")))
    return v.where("kind <> 'none'").withColumn("r", repair.repair(F.col("s"))).select("id", "kind", F.col("r.value").alias("value"))


@query(cte() + "SELECT id, CASE WHEN NOT contains(author_folder, 'Č') THEN author_folder END AS fixed FROM books WHERE regexp_matches(author_folder, '[^\\x00-\\x7f]')")
def double_decode(spark, sf_dir):
    """Names whose UTF-8 was read as Latin-1 come back as they were, where the damage shows (a C with caron leaves no sign)."""
    b = books(spark, sf_dir).select("id", "author_folder").where(F.octet_length("author_folder") > F.char_length("author_folder"))
    damaged = F.decode(F.encode(F.col("author_folder"), "UTF-8"), "ISO-8859-1")
    return b.select("id", repair.undouble(damaged).alias("fixed"))


@query(cte() + f"""SELECT id, coalesce({D_WHOLE}, {_DAMAGED}) AS title, array_to_string(authors, '|') AS authors, id % 8 NOT IN (2, 3, 5) AS encoding_repaired, CASE WHEN id % 8 = 5 THEN 'title' ELSE '' END AS bad_fields FROM books""")
def record_repair(spark, sf_dir):
    b = books(spark, sf_dir).selectExpr("id", f"{_DAMAGED_SPARK} AS title", "publisher", "authors")
    r = repair.repaired_records(b)
    return r.select("id", "title", F.array_join("authors", "|").alias("authors"), "encoding_repaired", F.array_join("bad_fields", ",").alias("bad_fields"))


@query()
def title_in_text(spark, sf_dir):
    """How well the title stands in the first 4000 characters; the exact case never reaches Python's work."""
    b = books(spark, sf_dir).select("id", text.normalise(F.col("title")).alias("a"), text.normalise(F.substring("text", 1, 4000)).alias("b"))
    return b.select("id", F.round(fuzzy.in_text(F.col("a"), F.col("b")), 6).alias("score"))


@query(cte() + f"SELECT id FROM books WHERE title <> '' AND contains({D_NORM('substr(text, 1, 4000)')}, {D_NORM('title')})")
def title_in_text_exact(spark, sf_dir):
    b = books(spark, sf_dir).select("id", text.normalise(F.col("title")).alias("a"), text.normalise(F.substring("text", 1, 4000)).alias("b"))
    return b.where((F.col("a") != "") & F.contains("b", "a")).select("id")


@query(cte() + "SELECT id, (CASE WHEN id % 7 < 4 THEN 0.5 ELSE 0 END + CASE WHEN id % 3 = 0 AND id % 7 < 4 THEN 0.5 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 0.2 ELSE 0 END) AS score, (CASE WHEN id % 7 < 4 THEN 0.5 ELSE 0 END + CASE WHEN id % 3 = 0 AND id % 7 < 4 THEN 0.5 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 0.2 ELSE 0 END) >= 0.5 AS generated FROM books".replace("0.5", "CAST(0.5 AS DOUBLE)").replace("0.2", "CAST(0.2 AS DOUBLE)"))
def cover_score(spark, sf_dir):
    """Scoring of analysed covers (few colours, template size, one dominant colour) from columns; pixels are a provider's work."""
    from quirework.operators.covers import score

    b = books(spark, sf_dir).select("id", (F.col("id") % 7 + 2).cast("int").alias("buckets"), F.when(F.col("id") % 3 == 0, 1200).otherwise(600).alias("width"), F.when(F.col("id") % 3 == 0, 1600).otherwise(900).alias("height"), F.when(F.col("id") % 5 == 0, 0.7).otherwise(0.3).alias("dominant"))
    s = score(F.col("buckets"), F.col("width"), F.col("height"), F.col("dominant"))
    return b.select("id", s.alias("score"), (s >= 0.5).alias("generated"))
