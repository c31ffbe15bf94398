"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions import constants as C


def once(made: Column, use) -> Column:
    """use(made), where made is worked out once however often use names it: functions over arrays are evaluated as they are written."""
    return F.get(F.transform(F.array(made), use), F.lit(0))


def normalise(s: Column) -> Column:
    """Listed accents folded, lower case, blanks collapsed."""
    # runs of blanks but a single space, which stays as it is
    return F.trim(F.regexp_replace(F.lower(F.translate(s, *C.FOLD_VERIFY)), r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def caseless(s: Column) -> Column:
    """Normalised for comparing whatever the capitals: those of a sharp s are SS."""
    return F.replace(normalise(s), F.lit("ß"), F.lit("ss"))


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def html_to_text(page: Column) -> Column:
    """Tags out, block ends as line ends, six references decoded, blanks collapsed, at most one empty line in a row."""
    s = F.regexp_replace(F.coalesce(page, F.lit("")), "(?i)" + C.BLOCK_ENDS, "\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#8217;", "'")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^\s+|\s+\z", "")


def usable(text: Column) -> Column:
    """Enough prose to reason over: 80 characters, and 8 words of 3 letters outside style blocks."""
    prose = F.regexp_replace(F.regexp_replace(text, r"@page\s*\{[^}]*\}", " "), "[{};]", " ")
    return F.coalesce((F.char_length(text) >= 80) & (F.regexp_count(prose, F.lit("[A-Za-zÁ-ž]{3,}")) >= 8), F.lit(False))


def looks_broken(s: Column) -> Column:
    odd = s.rlike(r"[^\x{0}-\x{2000}" + C.QUOTES_AND_DASHES + "]")
    name = F.lower(s).rlike("|".join(e.replace(".", r"\.") for e in C.BROKEN_EXTENSIONS))
    return s.isNull() | s.isin(C.BROKEN) | s.contains("_") | name | odd


def is_better(new: Column, old: Column) -> Column:
    """A cleaner value: the old one empty or broken, or the same text without its accents or capitals."""
    accents = new.rlike(f"[{C.CZ_MARKS}]") & ~old.rlike(f"[{C.CZ_MARKS}]") & (F.lower(F.translate(new, *C.FOLD_PROPOSALS)) == F.lower(F.translate(old, *C.FOLD_PROPOSALS)))
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")
    capitals = lambda s: F.size(F.filter(F.slice(words(s), 2, F.greatest(F.size(words(s)), F.lit(1))), lambda w: w.rlike(r"^\p{Lu}")))
    cased = (F.lower(new) == F.lower(old)) & (F.size(words(new)) >= 2) & (F.size(words(new)) == F.size(words(old))) & (capitals(new) > capitals(old))
    empty = lambda s: F.coalesce(s, F.lit("")) == ""
    bad, was = looks_broken(new), looks_broken(old)
    return F.when(empty(new), False).when(empty(old), True).when(was & ~bad, True).when(~was & ~bad, accents | cased).otherwise(False)


# ---------------------------------------------------------------- title pages


def joined_capitals(s: Column) -> Column:
    """Runs of at least five single capitals with blanks between them as one word."""
    runs = F.regexp_extract_all(s, F.lit("(?=[A-ZÁ-Ž] )" + C.SPACED_CAPITALS), F.lit(0))
    return F.aggregate(runs, s, lambda a, r: F.replace(a, r, F.replace(r, F.lit(" "), F.lit(""))))


def page_lines(text: Column) -> Column:
    """Trimmed, non-empty lines of a page without style blocks; spaced capitals are joined, ' | ' parts lines."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)(?=[@b{])(?:" + C.CSS + ")", " "), r"(?i)^\s*cover\b", " ")
    s = once(once(s, joined_capitals), lambda x: F.when(F.contains(x, F.lit("|")), F.regexp_replace(x, r"\s*\|\s*", "\n")).otherwise(x))
    # runs of blanks but a single space, which stays as it is
    s = F.regexp_replace(s, r"\t[ \t]*| [ \t]+", " ")
    return F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def strip(s: Column, chars: str) -> Column:
    """s without any of chars at its ends. btrim() miscounts trim characters of several bytes, so this is a pattern."""
    c = "".join("\\" + x if x in "-]^[\\" else x for x in chars)
    return F.regexp_replace(s, f"(?=[{c}])(?:^[{c}]+|[{c}]+\\z)", "")


def bare(s: Column) -> Column:
    return strip(F.lower(F.trim(s)), C.PAGE_TRIM)


def noise(line: Column) -> Column:
    """A line that can be neither title nor author."""
    tokens = F.filter(F.split(line, r"\s+"), lambda t: t != "")
    # a long line is seldom split into words
    leads = once(F.regexp_extract(line, r"^\s*(\S+)", 1), lambda t: (t == "") | bare(t).isin(C.PAGE_PLACEHOLDERS))
    alone = once(bare(line), lambda b: (b == "") | b.isin(C.PAGE_PLACEHOLDERS) | b.rlike(C.WEB_NAVIGATION))
    return ~line.rlike("[A-Za-zÁ-ž]") | line.rlike("(?i)" + C.FILE_GARBAGE) | alone | (leads & F.forall(tokens, lambda t: bare(t).isin(C.PAGE_PLACEHOLDERS)))


def title_like(line: Column) -> Column:
    return F.char_length(line).between(3, 120) & ~noise(line)


def title_case(s: Column) -> Column:
    """Each word with a capital, but acronyms of up to three unaccented letters as they are."""
    core = lambda w: F.regexp_replace(w, "[^A-Za-zÁ-ž]", "")
    acronym = lambda w: core(w).rlike(r"\p{Lu}") & ~core(w).rlike(r"\p{Ll}") & (F.char_length(core(w)) <= 3) & ~F.lower(w).rlike(f"[{C.CZ_PAGE_LETTERS}]")
    cased = lambda w: F.when(acronym(w), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(F.filter(F.split(s, r"\s+"), lambda w: w != ""), cased), " ")


def capitals_title(line: Column) -> Column:
    """The title in a line's run of two to six upper-case words, else null."""
    tokens = F.filter(F.split(line, r"\s+"), lambda t: t != "")
    upper = F.filter(tokens, lambda t: t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}") & ~bare(t).isin(C.PAGE_PLACEHOLDERS))
    heavy = lambda u: F.exists(u, lambda t: (F.char_length(F.regexp_replace(t, "[^A-Za-zÁ-ž]", "")) >= 4) | F.lower(t).rlike(f"[{C.CZ_PAGE_LETTERS}]"))
    titled = lambda run: F.when(title_like(run), title_case(run))
    return once(upper, lambda u: F.when(F.size(u).between(2, 6) & heavy(u), once(F.array_join(u, " "), titled)))


#: What each label can begin with: most places of a page are told by one character.
_TITLE, _AUTHOR, _PUBLISHER, _YEAR = (f"(?=[{first}]){label}" for first, label in (("ntk\u212a", C.LABEL_TITLE), ("a", C.LABEL_AUTHOR), ("nv", C.LABEL_PUBLISHER), ("rv", C.LABEL_YEAR)))


def _label(label: str, text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?ius){label}\\s*:\\s*(.+?)" + C.LABEL_END, 1), F.lit(""))


def mined_title(text: Column) -> Column:
    return title_of(page_lines(text))


def title_of(lines: Column) -> Column:
    return without_leading(found_title(lines))


def found_title(lines: Column) -> Column:
    """A page's title from its lines: its label, else a run of capitals, else a bordered line, else a short one of the first four lines."""
    clean = F.array_join(lines, "\n")
    labelled = F.trim(F.split_part(strip(F.trim(_label(_TITLE, clean)), ".;,-–—"), F.lit("("), F.lit(1)))
    good = F.filter(lines, lambda x: ~noise(x))
    capitals = F.get(F.filter(F.transform(good, capitals_title), lambda t: t.isNotNull()), F.lit(0))
    border = lambda x: strip(x, "*-–—=_~# ")
    bordered = F.get(F.filter(lines, lambda x: once(border(x), lambda b: (b != "") & (b != x) & title_like(b))), F.lit(0))
    labels = f"(?iu)^({C.LABEL_AUTHOR}|{C.LABEL_PUBLISHER})\\s*:"
    first = F.get(F.filter(F.slice(lines, 1, 4), lambda x: title_like(x) & (F.char_length(x) <= 80) & ~x.rlike(labels)), F.lit(0))
    return F.coalesce(once(labelled, lambda t: F.when(title_like(t), title_case(t))), capitals, title_case(border(bordered)), title_case(first))


def without_leading(found: Column) -> Column:
    """A title without a placeholder that leads it; null if that is all."""
    head = F.split_part(found, F.lit(" "), F.lit(1))
    return F.when(bare(head).isin(C.PAGE_PLACEHOLDERS), F.nullif(F.substr(found, F.char_length(head) + 2), F.lit(""))).otherwise(found)


def author_like(line: Column) -> Column:
    """A name of up to four words with capitals: no sentence, no quotation, no loose letters."""
    s = strip(F.regexp_replace(line, r"\s*\([^)]*\)\s*$", ""), " .,;:-–—")
    letters = lambda t: F.regexp_replace(t, "[^A-Za-zÁ-ž]", "")
    tokens = F.filter(F.split(s, r"\s+"), lambda t: t != "")
    named = F.filter(tokens, lambda t: letters(t) != "")
    prose = F.exists(named, lambda t: t.rlike(r"\p{Ll}") & ~t.rlike(r"\p{Lu}") & (F.char_length(letters(t)) >= 3)) & F.exists(named, lambda t: t.rlike(r"^\p{Lu}"))
    loose = (F.size(named) > 0) & F.forall(named, lambda t: (F.char_length(letters(t)) <= 1) & ~t.endswith("."))
    ok = F.char_length(s).between(3, 60) & ~s.rlike("[!?“”\"']|\\.\\.\\.") & ~s.rlike(r"^\d") & (F.size(tokens) <= 4)
    return ~noise(line) & ok & ~prose & ~loose & F.exists(tokens, lambda t: t.rlike(r"^\p{Lu}"))


def _without_placeholder(line: Column) -> Column:
    """A line without a placeholder that leads it."""
    head = F.split_part(line, F.lit(" "), F.lit(1))
    return F.when(bare(head).isin(C.PAGE_PLACEHOLDERS), F.trim(F.substr(line, F.char_length(head) + 1))).otherwise(line)


def mined_authors(text: Column) -> Column:
    return authors_of(page_lines(text), mined_title(text))


def authors_of(lines: Column, title: Column) -> Column:
    """Names under author labels, else up to three name-like lines of the first eight that are not the title."""
    clean = F.array_join(lines, "\n")
    values = F.regexp_extract_all(clean, F.lit(f"(?ius){_AUTHOR}\\s*:\\s*(.+?)" + C.LABEL_END), F.lit(1))
    plain = F.transform(values, lambda v: F.trim(F.split_part(strip(F.trim(v), ".;,-–—"), F.lit("("), F.lit(1))))
    labelled = F.transform(F.filter(plain, author_like), title_case)
    title = F.lower(F.coalesce(title, F.lit("\x00")))
    short = F.transform(F.filter(F.slice(lines, 1, 8), lambda x: (F.size(F.split(x, r"\s+")) <= 4) & ~noise(x)), _without_placeholder)
    # a line must be a name as it is written; only one all in capitals is held against its usual case
    capitals = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")
    cased = F.transform(F.filter(short, lambda x: author_like(x) | (capitals(x) & author_like(title_case(x)))), title_case)
    other = lambda x: (F.lower(x) != title) & ~F.lower(x).startswith(F.concat(title, F.lit(" "))) & ~F.lower(x).endswith(F.concat(F.lit(" "), title))
    guessed = F.slice(F.filter(cased, other), 1, 3)
    return F.array_distinct(once(labelled, lambda a: F.when(F.size(a) > 0, a).otherwise(guessed)))


def mined_publisher(text: Column) -> Column:
    return publisher_of(page_lines(text))


def publisher_of(lines: Column) -> Column:
    v = F.trim(_label(_PUBLISHER, F.array_join(lines, "\n")))
    v = F.trim(F.regexp_replace(F.regexp_replace(v, r",\s.*$", ""), r"\s+(?:1[89]|20)\d{2}\s*$", ""))
    v = strip(F.trim(F.regexp_replace(v, r"\s+[A-ZÁ-Ž]{2,}(?:\s+[A-ZÁ-Ž]{2,}){2,}.*$", "")), ".;,-–—")
    return once(v, lambda x: F.when((x != "") & (F.char_length(x) <= 80), x))


def mined_year(text: Column) -> Column:
    return year_of(page_lines(text))


def year_of(lines: Column) -> Column:
    """The labelled year, else one in the publisher's value or within 40 characters after it, else one within 20 before its label (which may be a number of the line above)."""
    clean = F.array_join(lines, "\n")
    direct = F.regexp_extract(clean, "(?iu)" + _YEAR, 1)
    # from a place the pattern tries 21 stretches before a label: it gets the text from 20 characters before the first label only, and none without a label
    before = F.filter(F.array(F.split(clean, f"(?iu){_PUBLISHER}\\s*:", 2)), lambda p: F.size(p) > 1)
    rest = F.transform(before, lambda p: F.substr(clean, F.greatest(F.char_length(F.get(p, F.lit(0))) - 19, F.lit(1))))
    near = lambda s, group: F.regexp_extract(s, f"(?ius)(.{{0,20}})({_PUBLISHER}\\s*:\\s*.+?{C.LABEL_END}.{{0,40}})", group)
    year = lambda s: F.regexp_extract(s, r"\b((?:1[89]|20)\d{2})\b", 1).try_cast("int")
    return F.coalesce(direct.try_cast("int"), F.get(F.transform(rest, lambda s: F.coalesce(year(near(s, 2)), year(near(s, 1)))), F.lit(0)))


# ---------------------------------------------------------------- mis-decoded text


def mojibake(s: Column) -> Column:
    """The kind of damage: octal_escape, misdecoded or none."""
    strong = s.rlike(f"[{C.MOJIBAKE_STRONG}�]") | (s.rlike(r"[\x{400}-\x{4FF}]") & s.rlike("[A-Za-z]"))
    alien = "".join(c for c in C.LATIN1_HIGH if c not in C.CZ_ALL)
    mixed = s.rlike(f"[{C.CZ_ALL}]") & s.rlike(f"[{alien}]")
    return F.when(F.coalesce(s, F.lit("")) == "", "none").when(s.rlike(r"\\[0-3][0-7]{2}"), "octal_escape").when(strong | mixed, "misdecoded").otherwise("none")
