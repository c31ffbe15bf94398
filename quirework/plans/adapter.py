"""Book records derived from the documents table.

One list of scalar expressions that Spark SQL and DuckDB both read: the engine's queries and their SQL get the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGIT = lambda s, i: f"CAST(substr({s}, {i}, 1) AS INT)"
_BODY = "concat('978', lpad(concat('', doc_id), 9, '0'))"
_CHECK13 = "((10 - (" + " + ".join(f"{1 if i % 2 else 3} * {_DIGIT('body', i)}" for i in range(1, 13)) + ") % 10) % 10)"
_SUM10 = "(" + " + ".join(f"{11 - i} * {_DIGIT('body10', i)}" for i in range(1, 10)) + ")"

#: (name, expression) in layers; a layer sees the columns of those before it.
LAYERS: list[list[tuple[str, str]]] = [
    [
        ("id", "doc_id"), ("uuid", "md5(concat('book-', doc_id))"), ("text", "coalesce(text, '')"),
        ("base", "trim(substr(split_part(coalesce(text, ''), chr(10), 1), 1, 40))"),
        ("body", _BODY), ("body10", "lpad(concat('', doc_id), 9, '0')"), ("language", "lang"),
        ("author_folder", "CASE doc_id % 23 WHEN 0 THEN '~$Novak' WHEN 1 THEN 'anthony burgess' WHEN 2 THEN '_ antologie' WHEN 3 THEN 'Author' "
         "WHEN 4 THEN 'byKarelandJan' WHEN 5 THEN 'Neznámý' WHEN 6 THEN 'neznámý - neuveden' WHEN 7 THEN 'Série 12' WHEN 8 THEN 'Karel Čapek' "
         "WHEN 9 THEN 'unknown' ELSE CASE doc_id % 5 WHEN 0 THEN 'Isaac Asimov' WHEN 1 THEN 'Agatha Christie' WHEN 2 THEN 'Jan Novák' "
         "WHEN 3 THEN 'Jules Verne' ELSE 'Petr Dufek' END END"),
        ("year", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(1950 + doc_id % 70 AS INT) END"),
        ("publisher", "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Odeon' WHEN 2 THEN 'Argo' ELSE 'Mladá fronta' END"),
        ("series_name", "CASE WHEN doc_id % 6 = 0 THEN 'Nadace' WHEN doc_id % 6 = 1 THEN 'Duna' END"),
        ("series_index", "CASE WHEN doc_id % 6 = 0 THEN concat('', doc_id % 9) END"),
        ("verified", "doc_id % 31 = 0"), ("source", "CASE doc_id % 7 WHEN 0 THEN 'opf' WHEN 1 THEN 'path' ELSE 'json' END"),
        ("formats_s", "CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'pdf' WHEN 2 THEN 'pdf|epub' WHEN 3 THEN 'txt|mobi' WHEN 4 THEN 'docx|rtf' ELSE 'mobi|epub' END"),
        ("bad_fields_s", "CASE WHEN doc_id % 41 = 0 THEN 'title|publisher' ELSE '' END"),
    ],
    [
        ("authors_s", "CASE WHEN doc_id % 17 = 0 THEN concat(author_folder, '|Jan Novák|Petr Král|Eva Hrubá') WHEN doc_id % 17 = 1 THEN 'Isaac Asimov|Jan Novák' "
         "WHEN doc_id % 19 = 2 THEN '' WHEN doc_id % 46 = 5 THEN 'Jan Novák' ELSE author_folder END"),
        ("title", "CASE doc_id % 29 WHEN 0 THEN concat(base, '.doc') WHEN 1 THEN concat('Microsoft Word - ', base) WHEN 2 THEN replace(base, ' ', '_') "
         "WHEN 3 THEN 'title' WHEN 4 THEN 'Bible kralická' WHEN 5 THEN concat(base, '_txt') WHEN 6 THEN 'The Asimov story of robots' "
         "WHEN 7 THEN 'Čas přílivu' WHEN 8 THEN '' ELSE base END"),
        ("isbn_raw", f"CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN concat(body, ({_CHECK13} + 1) % 10) "
         f"WHEN doc_id % 7 = 0 THEN concat('ISBN ', substr(body, 1, 3), '-', substr(body, 4, 4), '-', substr(body, 8, 5), '-', {_CHECK13}) "
         f"WHEN doc_id % 13 = 0 THEN concat(body10, CASE (11 - {_SUM10} % 11) % 11 WHEN 10 THEN 'X' ELSE concat('', (11 - {_SUM10} % 11) % 11) END) "
         f"ELSE concat(body, {_CHECK13}) END"),
        ("title_folder", "concat(base, ' (', doc_id, ')')"),
        ("path", "concat('/lib/', CASE WHEN doc_id % 10 = 0 THEN 'needfix/' ELSE '' END, author_folder, '/', base, ' (', doc_id, ')')"),
        ("files_s", "concat_ws('|', 'metadata.json', CASE WHEN doc_id % 3 > 0 THEN 'cover.jpg' END, CASE WHEN doc_id % 16 = 8 THEN 'notes.bak' END, "
         "CASE WHEN formats_s <> '' THEN concat('book.', replace(formats_s, '|', '|book.')) END)"),
    ],
    [
        ("primary_file", "CASE WHEN formats_s = '' THEN NULL WHEN doc_id % 37 = 0 THEN concat(title, ' - X.epub') ELSE concat('file-', doc_id, '.epub') END"),
        ("current_path", "path"),
    ],
]

#: Columns of '|'-joined lists, and the array each gives.
LISTS = {"authors_s": "authors", "formats_s": "formats", "files_s": "files", "bad_fields_s": "bad_fields"}


def cte(name: str = "books") -> str:
    """The records as the first parts of a WITH clause in DuckDB."""
    parts, last = [], "documents"
    for i, layer in enumerate(LAYERS):
        keep = "doc_id" if not i else "*"
        parts.append(f"b{i} AS (SELECT {keep}, " + ", ".join(f"{e} AS {n}" for n, e in layer) + f" FROM {last})")
        last = f"b{i}"
    lists = ", ".join(f"list_filter(string_split({s}, '|'), lambda x: x <> '') AS {a}" for s, a in LISTS.items())
    parts.append(f"{name} AS (SELECT *, {lists} FROM {last})")
    return "WITH " + ",\n".join(parts)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a DataFrame."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    for i, layer in enumerate(LAYERS):
        df = df.selectExpr("doc_id" if not i else "*", *[f"{e} AS {n}" for n, e in layer])
    return df.select("*", *[F.filter(F.split(s, r"\|"), lambda x: x != "").alias(a) for s, a in LISTS.items()])
