"""Fixed values of the catalogue's domain: word lists, tables and patterns, stated as they must be for equal results."""

# Spellings of an anonymous author; "autor" counts within compounds only.
ANONYM = [
    "", "anonym", "anonymní", "anonymni", "anonymous", "neznamy", "neznámý", "enznámý",
    "neuveden", "neuvedeno", "neuvedený", "neuvedeny", "autor", "unknown", "unbekannt",
]
ANONYM_FOLDER = "Anonym"
ANONYM_SEPARATORS = r"[\s,/;-]+"
# Titles of genuinely anonymous works.
ANONYM_WORKS = r"\b(bible|bibl[ei]|kralick|[mn]ový?\s+z[áa]kon|knihy\s+moj|koran|quran|edda)\b"
# Literal placeholders of title or author.
PLACEHOLDER = ["title", "author", "autor", "subject", "name", "unknown"]
# Marks of a file name in a title.
TITLE_EXTENSION = r"\.(docx?|epub|pdf|pdb|mobi|azw3|azw|prc|lit|rtf|txt|djvu|fm|prz)\b"
WORD_PREFIX = r"^microsoft\s+word\s*-\s*"
TRUNCATED = r"[_]n[_]?_$|_txt$|_n$"
STEM_EXTENSIONS = ["azw3", "azw", "prc", "epub", "pdb", "pdf", "mobi", "doc", "rtf", "txt", "lit", "djvu"]
# Capitals that make an author not all-lowercase.
CAPITALS = "A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
GLUED = r"\b(by[A-Z]|[a-z]and[A-Z]|[a-z]and\s|[A-Z][a-z]+[a-z]and[A-Z])"
SERIES_AUTHOR = r"\b(část|cast|díl|dil|kapitol|antologie|série|serie|kniha)\b\s*[0-9ivx]+"
CZ_LETTERS = "áčďéěíňóřšťúůýžôÁČĎÉĚÍŇÓŘŠŤÚŮÝŽÔ"
# Name parts that mark a Czech author (those with accents can't match folded input).
CZ_NAMES = [
    "jan", "jiří", "karel", "pavel", "petr", "michal", "tomáš", "marek", "martin", "josef", "františek", "vlastimil", "zdeněk",
    "milan", "vladimír", "jarmila", "jana", "lenka", "eva", "hana", "marie", "anna", "alena", "lidmila", "kotrle", "kotrla", "soukup",
    "smékal", "blažek", "macák", "kantůrek", "emmerová", "malčíková", "petrů", "kosatíková", "dufek", "maxon", "moravcová", "netopil",
    "beránek", "batrla", "koubová", "ryšková", "kacetlová", "hrubá",
]
# Author tokens that are no evidence of swapped fields.
COMMON_WORDS = [
    "the", "and", "king", "lord", "dark", "book", "magicky", "rohan", "livu", "first", "second", "third", "new", "old", "good", "bad",
    "man", "woman", "world", "time", "life", "death", "love", "war", "house", "city", "road",
]
# Accent folding: of the rules, of proposals, of verification; they differ.
FOLD_RULES = ("áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ", "acdeeinorstuuyzACDEEINORSTUUYZ")
# Preference of format files, and of sources for conversion.
FORMATS = ["epub", "azw3", "mobi", "azw", "prc", "pdb", "lit", "fb2", "pdf", "djvu", "rtf", "doc", "txt", "cbz", "cbr", "cb7"]
ARTICLES = ["The ", "A ", "An ", "Le ", "La ", "Les ", "Die ", "Das "]
FORBIDDEN_IN_PATH = r'[\\/:*?"<>|\n\r\t]'
# ISBN in running text, an optional label before it.
ISBN_IN_TEXT = (
    r"(?i)(?<![\dXx])(?:ISBN(?:-1[03])?\s*[:\-]?\s*)?((?:97[89][- ]?\d{1,5}[- ]?\d{1,7}[- ]?\d{1,7}[- ]?\d)"
    r"|(?:\d{1,5}[- ]?\d{1,7}[- ]?\d{1,7}[- ]?[\dXx]))(?![\dXx])"
)
# Order of categories in reports.
CATEGORIES = ["C1", "C2", "C3", "C4", "C5", "C6", "C7", "C8", "C9", "C10", "C11", "C12", "MISSING_ISBN", "MISSING_YEAR", "MISSING_COVER"]
# Confidence of a proposal by its source.
SOURCE_HIGH = ["embedded", "databazeknih", "llm:high"]
SOURCE_MEDIUM = ["openlibrary", "google_books", "content", "llm:flash", "llm:loop", "llm:medium"]
SAME_BOOK = 0.85
STRONG, WEAK, TITLE_ONLY, LOOKUP_MATCH = 0.8, 0.5, 0.9, 70.0
NEGATIVE_TTL_DAYS = 7
FOLD_PROPOSALS = ("áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽôäÄ", "acdeeinorstuuyzACDEEINORSTUUYZoaA")
FOLD_VERIFY = ("áčďéěíňóřšťúůýžôäüÁČĎÉĚÍŇÓŘŠŤÚŮÝŽÔÄÜ", "acdeeinorstuuyzoauACDEEINORSTUUYZOAU")
CZ_MARKS = "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽôäÄ"
# Values that are no value, and what gives a broken one away.
BROKEN = ["Neznamy", "Unknown", "anonym", "Anonymous", "Neznámý", ""]
BROKEN_EXTENSIONS = [".epub", ".pdb", ".pdf", ".doc", ".mobi", ".azw", ".azw3", ".prc"]
QUOTES_AND_DASHES = "„“”‘’–—…"
# Placeholders and section names on title pages.
PAGE_PLACEHOLDERS = [
    "neznámý", "nezanmy", "unknown", "anonym", "anonymní", "autor", "title", "subject", "name", "nc", "nc17", "prolog", "epilog",
    "předmluva", "predmluva", "kapitola", "obsah", "další", "předchozí", "úvod", "uvod", "doslov",
]
# Lines of a site's navigation, whole.
WEB_NAVIGATION = r"(?iu)^(předchozí|další|obsah|hlavní\s+stránka|homepage|zpět|domů)$"
PAGE_TRIM = ".:;,-–—!?'\"()"
CZ_PAGE_LETTERS = "áčďéěíňóřšťúůýžôäĺľŕš"
FILE_GARBAGE = r"^(microsoft\s+word\s*-\s*[^\s]*\.doc[x]?|[a-z0-9_]+\.(docx?|epub|pdf|pdb|mobi|txt|rtf)$)"
CSS = r"@\w+\s*\{[^}]*\}|body\s*\{[^}]*\}|\{[^}]{0,200}\}"
BLOCK_ENDS = r"</(p|div|h[1-6]|li|tr|td|th|section|article|header|footer|body|blockquote)\s*>"
# Field labels of copyright pages, and where a value ends.
LABEL_TITLE, LABEL_AUTHOR, LABEL_PUBLISHER = r"(?:název|titul|kniha)", r"(?:autor|author)", r"(?:nakladatelství|vydavatelstvo|vydalo|vydavatel)"
LABEL_END = (
    r"(?=\s+(?:název|titul|kniha|autor|author|nakladatelství|vydavatelstvo|vydalo|vydavatel|přeložil|preložil|přeložila|preložila|rok\s+vydání|vydáno|rok"
    r"|original|původní|edice)\s*[:=]|\s*$|\n)"
)
LABEL_YEAR = r"(?:rok\s+vydání|vydáno|rok)\s*:\s*((?:1[89]|20)\d{2})\b"
# Characters of mis-decoded Czech, the Cyrillic block, and Latin-1 letters that Czech lacks.
MOJIBAKE_STRONG = "¬¡¹Øø•"
LATIN1_HIGH = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
CZ_ALL = "áčďéěíňóřšťúůýžôäÁČĎÉĚÍŇÓŘŠŤÚŮÝŽÔÄ"
REVERSE_CODECS, TARGET_CODECS = ["cp1252", "cp1251", "iso-8859-1", "mac_roman", "mac_latin2"], ["cp1250", "iso-8859-2"]
OCTAL_CODECS = ["utf-16", "utf-16-le", "utf-16-be", "cp1250", "iso-8859-2"]
# Single capitals set apart, at least five, the last one of up to three letters.
SPACED_CAPITALS = r"(?:(?<=\s)|(?<=^))(?:[A-ZÁ-Ž] ){4,}[A-ZÁ-Ž]{1,3}(?=\s|$)"
# Codecs through which UTF-8 text was misread, those of a second layer, and letters and signs that give a misreading away.
DOUBLE_CODECS = ["cp1250", "iso-8859-2", "cp1252", "latin-1"]
MIDDLE_CODECS = [
    "cp1251", "iso-8859-5", "koi8-r", "koi8-u", "mac-cyrillic", "cp1250", "cp1252", "cp1257", "cp1254", "cp1255", "cp1256", "cp1258",
    "iso-8859-1", "iso-8859-2", "iso-8859-7", "iso-8859-9", "iso-8859-15", "iso-8859-16", "mac_latin2", "cp852", "cp850", "cp866", "cp874", "latin-1",
]
CZ_SK_EXTENDED = "čďěľňŕřšťůžČĎĚĽŇŔŘŠŤŮŽĺĹ"
DOUBLE_TELLS = "ˇ˝™­ÂÃ"
