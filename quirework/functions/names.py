"""Names, folders and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions import constants as C


def fold(s: Column, table: tuple[str, str] = C.FOLD_RULES) -> Column:
    return F.translate(s, *table)


def anonym(name: Column) -> Column:
    """Does a name stand for an anonymous author: a known spelling, or a compound of only such."""
    low = F.lower(F.trim(name))
    tokens = F.filter(F.split(low, C.ANONYM_SEPARATORS), lambda t: t != "")
    return F.coalesce(low.isin([s for s in C.ANONYM if s != "autor"]) | ((low != "autor") & (F.size(tokens) > 1) & F.forall(tokens, lambda t: t.isin(C.ANONYM))), F.lit(False))


def czech(name: Column) -> Column:
    plain = [n for n in C.CZ_NAMES if n == n.translate(str.maketrans(*C.FOLD_RULES))]
    return name.rlike(f"[{C.CZ_LETTERS}]") | F.arrays_overlap(F.split(F.lower(fold(name)), r"[\s.,]+"), F.array(*map(F.lit, plain)))


def foreign(name: Column) -> Column:
    """A plausible person's name that doesn't look Czech."""
    tokens = F.filter(F.split(name, r"[\s.,]+"), lambda t: t != "")
    capital = F.exists(tokens, lambda t: t.rlike(r"^\p{Lu}"))
    return (F.char_length(name) >= 3) & capital & ~czech(name) & ~F.coalesce(F.get(tokens, F.lit(0)).rlike("^[0-9]"), F.lit(False)) & (F.size(tokens) < 5)


def segment(name: Column) -> Column:
    """A safe folder name: forbidden characters out, blanks collapsed, at most 200 characters, never empty."""
    s = F.regexp_replace(F.coalesce(name, F.lit("")), C.FORBIDDEN_IN_PATH, "_")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[\x00-\x1f]", ""), r"(?U)\s+", " "))
    s = F.btrim(s, F.lit(". "))
    return F.when(s == "", "_").otherwise(F.left(s, F.lit(200)))


def author_sort(author: Column) -> Column:
    parts = F.split(F.trim(author), r"\s+")
    sorted_ = F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    return F.when(F.size(parts) >= 2, sorted_).otherwise(author)


def title_sort(title: Column) -> Column:
    out = title
    for a in reversed(C.ARTICLES):
        out = F.when(title.startswith(a), F.concat(F.substr(title, F.lit(len(a) + 1)), F.lit(", " + a.strip()))).otherwise(out)
    return out


def target_path(b: dict[str, Column], pattern: str = "{author}/{title} ({id})", root: str = "/lib") -> Column:
    """Where a record belongs. b: authors, title, id, isbn, year, language, series, series_index; an unknown field: the default pattern."""
    first = F.coalesce(F.get(b["authors"], F.lit(0)), F.lit(C.ANONYM_FOLDER))
    author = F.when(anonym(first), C.ANONYM_FOLDER).otherwise(first)
    title = F.when(F.coalesce(b["title"], F.lit("")) == "", "Untitled").otherwise(b["title"])
    fields = {
        "author": segment(author), "author_sort": segment(author_sort(author)), "title": segment(title), "title_sort": segment(title_sort(title)),
        "id": F.coalesce(b["id"].cast("string"), F.lit("noid")), "isbn": segment(b["isbn"]), "year": F.coalesce(b["year"].cast("string"), F.lit("")),
        "language": segment(b["language"]), "series": segment(b["series"]), "series_index": segment(b["series_index"]),
    }
    import string

    parts = list(string.Formatter().parse(pattern))
    if any(f is not None and f not in fields for _, f, _, _ in parts):
        parts = list(string.Formatter().parse("{author}/{title} ({id})"))
    pieces = [p for text, f, _, _ in parts for p in ([F.lit(text)] if text else []) + ([fields[f]] if f is not None else [])]
    return F.concat(F.lit(root + "/"), F.regexp_replace(F.regexp_replace(F.concat(*pieces), "/+", "/"), "^/|/$", ""))


def needfix_path(path: Column, author_folder: Column, title_folder: Column, root: str = "/lib", needfix: str = "needfix") -> Column:
    """The place of a record to be reviewed: below `needfix` once, anonymous folders under one name."""
    rel = F.when(path.startswith(root + "/"), F.regexp_replace(F.substr(path, F.lit(len(root) + 2)), f"^{needfix}/(?=.)", ""))
    rel = F.coalesce(rel, F.concat_ws("/", author_folder, title_folder))
    head = F.split_part(rel, F.lit("/"), F.lit(1))
    named = F.when(rel.contains("/") & anonym(head), F.concat(F.lit(C.ANONYM_FOLDER), F.substr(rel, F.char_length(head) + 1))).otherwise(rel)
    return F.concat(F.lit(f"{root}/{needfix}/"), named)


def relative(path: Column, root: str = "/lib") -> Column:
    """A path below the root, relative to it; any other as it is."""
    return F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(path)


def display(values: Column) -> Column:
    """A list for reading."""
    return F.coalesce(F.array_join(values, ", "), F.lit(""))


def origin(author: Column, title: Column, id_: Column) -> Column:
    """Where a file came from: '<Author> - <Title> (<id>)'."""
    named = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    return F.concat(F.coalesce(author, F.lit(C.ANONYM_FOLDER)), F.lit(" - "), named(title, "Untitled"), F.lit(" ("), F.coalesce(id_.cast("string"), F.lit("noid")), F.lit(")"))


def rogue_folder(label: Column, file: Column, root: str = "/lib", needfix: str = "needfix") -> Column:
    """The folder of its own that a file of another book is moved to."""
    return F.concat(F.lit(f"{root}/{needfix}/crosscheck/"), segment(F.concat(label, F.lit(" - "), F.element_at(F.split(file, "/"), -1))))
