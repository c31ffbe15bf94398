"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged by path (tag and first class of each element from the root, digits left out). A node of the
merged tree has, over its m pages, the child sequences it was seen with (presentation) and the texts under it (content).
Presentation importance is the entropy of the child sequences over log m; content importance is 1 less the mean over
texts of log(pages that have the text) / log m: texts on every page give 0, texts on one page give 1. The composite is
(1 - GAMMA) * presentation + GAMMA * content. Branches below LOW on at least MIN_PAGES pages are low:
templates that a site repeats. They are removed from each page, with what structure says is no article: menus, headers, footers,
sidebars, notices, adverts, forms, comments by element, role, or a class or id that says nothing else. A class that has such a word among others ("login-guide", "related-reading") is only a
reason for doubt: the element goes if links make up half of its text. If a page has an article or main
element the text is taken from there, and the tree then decides on its inner containers (div, section) only;
otherwise it decides on every branch of the body. A page whose branches are all low keeps them: a host of copies loses nothing.

The counts of the tree are summed in the task before they are shuffled by (host, path, text), so a host with a third of all pages is dealt out;
low paths are few rows for a host and are joined to its pages: broadcast if their counted number is within BROADCAST_ROWS,
else by a join whose skewed hosts Spark splits. No host's pages are gathered anywhere.

Odd input: null or empty html gives an empty text; unclosed, crossed and unknown tags, comments and references without an end
are read as browsers do as far as text goes; a form without visible controls, or with an article, a heading of the first order or much prose for each control, frames the page and is no form of it;
pages of any depth and with any number of open elements are read in one pass; a page without a url belongs to the host ''; repeated rows count each; extra columns are kept.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import unused, written

GAMMA, LOW, MIN_PAGES = 0.9, 0.45, 8
BROADCAST_ROWS = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that never hold the article's text.
DROP = frozenset("head script style noscript template iframe object embed svg math canvas nav aside form button select option textarea input dialog menu footer audio video map title noembed noframes xmp datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li td th tr tbody thead tfoot".split()) | frozenset(["table"])
#: Which open element a start tag ends, and what shields it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe signup share sharing social related recommended recommendations sidebar aside nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead comment comments disqus respond reply replies popup modal overlay alert toolbar pagination pager login searchbox skip".split()
)
#: Words that say nothing of an element beside a cue; with any other word ("market-share", "notice-period") a class is only a doubt.
FRAME = frozenset(
    "area bar block bottom box btn button buttons container content counter data dialog entry fixed floating footer group header icon icons inline inner item items js left "
    "link links list message module msg news note outer panel post posts right row section site sticky strip sub tools top widget widgets wrap wrapper "
    "article articles author blog desktop field fields form full google holder info jp js law main media mobile page pages place popular primary read secondary slot square stories story text thread "
    "title unit user users wp zone".split()
)
#: What makes a form the frame of a page: such an element in it, or so many characters of prose for each visible control.
_HOLDS_ARTICLE = re.compile(r"<(?:article|main|h1)[\s/>]", re.I)
_CONTROL = re.compile(r"<(?:select|textarea|button)[\s/>]|<input(?=[\s/>])(?![^>]*type\s*=\s*[\"']?hidden)", re.I)
_FORM_END = re.compile(r"</form[\s/>]", re.I)
_MARKUP = re.compile(r"<[^>]*>")
PROSE = 300
#: Share of an element's text in links from which a doubtful one goes.
LINKED = 0.5
#: These count outside an article only: an article has a header of its own.
OUTER_CUES = frozenset("header topbar".split())
INNER = frozenset(["div", "section"])
#: A class with one of these says how a page is laid out ("post with-sidebar", "no-comments"), not what an element is.
LAYOUT = frozenset("with without has no not layout".split())
#: Elements that hold the article whatever their class says.
WHOLE = frozenset("html body main".split())

#: A quote delimits a value only after an equals sign; any other is a character like others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
#: Deeper elements count as this deep; bounds paths of hostile pages.
_DEEP = 60


class Node:
    """An element. tree: the nearest one from it upwards that stands for itself in the style tree (deep ones share that of an outer one); doubt: the nearest doubtful one."""

    __slots__ = ("tag", "path", "drop", "main", "kids", "key", "parent", "tree", "doubt", "size", "linked", "gone")

    def __init__(self, tag: str, path: str, drop: bool, main: bool, parent: Node | None = None):
        self.tag, self.path, self.drop, self.main, self.kids, self.key = tag, path, drop, main, [], None
        self.parent, self.size, self.linked, self.gone = parent, 0, 0, False
        self.tree = parent.tree if parent and parent.parent and path == parent.path else self
        self.doubt: Node | None = parent.doubt if parent else None

    def above(self) -> Iterator[Node]:
        """The elements of the style tree from this one upwards."""
        node = self.tree
        while node.parent:
            yield node
            node = node.parent.tree


class Forms:
    """What the forms of a page hold, counted once."""

    def __init__(self, page: str):
        self.ends = [m.start() for m in _FORM_END.finditer(page)]
        self.articles = [m.start() for m in _HOLDS_ARTICLE.finditer(page)]
        self.controls = [m.start() for m in _CONTROL.finditer(page)]
        self.marks, self.markup, total = [], [0], 0
        for m in _MARKUP.finditer(page):
            total += m.end() - m.start()
            self.marks.append(m.start())
            self.markup.append(total)
        self.length = len(page)

    def frames(self, at: int) -> bool:
        """A form that opens before `at` frames the page."""
        e = bisect_left(self.ends, at)
        end = self.ends[e] if e < len(self.ends) else self.length
        count = lambda found: bisect_left(found, end) - bisect_left(found, at)
        if count(self.articles):
            return True
        controls = count(self.controls)
        prose = end - at - (self.markup[bisect_left(self.marks, end)] - self.markup[bisect_left(self.marks, at)])
        return not controls or prose >= PROSE * controls


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


def _cued(tag: str, attrs: dict[str, str], inside: bool) -> bool | None:
    """Whether an element says of itself that it is no part of the article; None: perhaps."""
    if tag in WHOLE:
        return False
    if attrs.get("role", "").lower() in ROLES:
        return True
    doubt = False
    for name in ("class", "id"):
        for token in attrs.get(name, "").split():
            found = {w.lower() for w in _WORDS.findall(token)}
            if found & LAYOUT:
                continue
            cues = found & CUES
            if cues and all(w in FRAME or len(w) < 3 for w in found - cues) or not inside and tag != "article" and found & OUTER_CUES:
                return True
            doubt |= bool(cues)
    return None if doubt else False


def blocks(page: str | None) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(innermost element, text) of each block in page order, and all elements. Text in dropped elements, inline ones too, is left out, so is that of doubtful ones which are mostly links."""
    page = page or ""
    root = Node("", "", False, False)
    stack, every, out, parts = [root], [], [], []
    linked, forms, open_, doubts = 0, None, Counter(), []

    def flush() -> None:
        nonlocal linked
        if parts and (text := " ".join("".join(parts).split())):
            out.append((stack[-1], text))
            if doubt := stack[-1].doubt:
                doubt.size += len(text)
                doubt.linked += min(linked, len(text))
        parts.clear()
        linked = 0

    def close(to: int) -> None:
        if any(n.tag in BLOCK for n in stack[to:]):
            flush()
        open_.subtract(n.tag for n in stack[to:])
        del stack[to:]

    def add(text: str) -> None:
        nonlocal linked
        parts.append(entities.unescape(text))
        if open_["a"] > 0:
            linked += len(parts[-1].strip())

    at, low = 0, None
    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not stack[-1].drop:
            add(page[at : m.start()])
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in CLOSES_P and open_["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("button", "table", "td", "th", "caption", "object"):
                    break
        if tag in ENDS:
            these, shields = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1) if any(open_[t] > 0 for t in these) else ():
                if stack[i].tag in these:
                    close(i)
                    break
                if stack[i].tag in shields:
                    break
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            stack[-1].kids.append(tag)
            continue
        attrs = _attributes(m[3]) if m[3] else {}
        above = stack[-1]
        first = attrs.get("class", "").split()[:1]
        name = tag + ("." + _DIGITS.sub("", first[0]) if first else "")
        cued = _cued(tag, attrs, above.main) if attrs else False
        if tag == "form" and not above.drop and forms is None:
            forms = Forms(page)
        drop = above.drop or tag in DROP and not (tag == "form" and forms.frames(at)) or bool(cued) or "hidden" in attrs or tag == "header" and not above.main
        main = above.main or tag in ("article", "main") and not drop
        node = Node(tag, f"{above.path}/{name}" if len(stack) < _DEEP else above.path, drop, main, above)
        if cued is None:
            node.doubt = node
            doubts.append(node)
        above.kids.append(name)
        every.append(node)
        if m[3].rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        stack.append(node)
        open_[tag] += 1
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at) if len(low) == len(page) else page.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
    if at < len(page) and not stack[-1].drop:
        add(page[at:])
    flush()
    return [(node, text) for node, text in out if not (node.doubt and node.doubt.gone)] if _settle(doubts) else out, every


def _settle(doubts: list[Node]) -> bool:
    """Decide the doubtful elements, given in page order: inner ones count for the outer, and go with them."""
    for d in reversed(doubts):
        if outer := d.parent.doubt:
            outer.size += d.size
            outer.linked += d.linked
    for d in doubts:
        d.gone = d.linked >= LINKED * d.size or bool(d.parent.doubt and d.parent.doubt.gone)
    return bool(doubts)


def _key(path: str) -> int:
    return xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass")) - (1 << 63)


def _key_of(node: Node) -> int:
    if node.key is None:
        node.key = _key(node.path)
    return node.key


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages, presentation, content, importance) of every node of the merged trees; path is a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found, every = blocks(page.as_py())
                once = set()
                for n in every:
                    if n.tag in BLOCK:
                        kids = [k for i, k in enumerate(n.kids) if not i or k != n.kids[i - 1]]
                        once.add((host, _key_of(n), 0, _key(" ".join(kids))))
                for node, text in found:
                    h = _key(text)
                    once.update((host, _key_of(n), 1, h) for n in node.above() if n.tag in BLOCK)
                seen.update(once)
            cols = list(zip(*seen, strict=True)) or [[], [], [], []]
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(list(seen.values()), pa.int64())], ["host", "path", "kind", "value", "n"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, path long, kind int, value long, n long")
    n = rows.groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    style, text = F.col("kind") == 0, F.col("kind") == 1
    spread = lambda k: F.sum(F.when(k, F.col("n") * F.log("n")))
    nodes = n.groupBy("host", "path").agg(
        F.sum(F.when(style, F.col("n"))).alias("styles"), spread(style).alias("style_log"),
        F.sum(F.when(text, F.col("n"))).alias("texts"), spread(text).alias("text_log"),
    )
    m = F.greatest(F.col("styles"), F.lit(2))
    shown = F.coalesce((F.log(F.col("styles")) - F.col("style_log") / F.col("styles")) / F.log(m), F.lit(0.0))
    said = F.coalesce(1 - F.col("text_log") / F.col("texts") / F.log(m), F.lit(1.0))
    nodes = nodes.select("host", "path", F.col("styles").alias("pages"), shown.alias("presentation"), said.alias("content"))
    return nodes.withColumn("importance", (1 - GAMMA) * F.col("presentation") + GAMMA * F.col("content"))


def low_paths(tree: DataFrame) -> DataFrame:
    """(host, low): the low-importance paths of each host that has some."""
    low = tree.where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW))
    return low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"))


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The blocks of a page's article, joined by newlines."""
    found, _ = blocks(page)
    kept = found
    main = [x for x in kept if x[0].main]
    if main:
        decide = lambda n: n.main and n.tag in INNER
    else:
        decide = lambda n: n.tag not in ("html", "body")
    kept = main or kept
    if low:
        high = [(node, text) for node, text in kept if not any(decide(n) and _key_of(n) in low for n in node.above())]
        kept = high or kept
    return "\n".join(text for _, text in kept)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each, by the style trees of their hosts."""
    if out in pages.columns:
        raise ValueError(f"pages has a column {out}; name another")
    low = written(low_paths(style_tree(pages, url_col, html_col)), "low-paths")
    rows = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0))).first()[0]

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[tuple, frozenset] = {}
        for page, low in batches:
            got = []
            for p, paths in zip(page, low.to_pylist(), strict=True):
                k = tuple(paths or ())
                if k not in known:
                    known.clear() if len(known) > 100 else None
                    known[k] = frozenset(k)
                got.append(main_text(p.as_py(), known[k]))
            yield pa.array(got, pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    host, paths = unused([*pages.columns, out], "__style_host", "__style_low")
    low = low.toDF(host, paths)
    held = pages.withColumn(host, host_of(F.col(url_col))).join(F.broadcast(low) if rows <= BROADCAST_ROWS else low.hint("merge"), host, "left")
    return held.withColumn(out, F.arrow_udf(run, "string")(F.col(html_col), F.col(paths))).select(*[F.col(f"`{c}`") for c in pages.columns], out)


def digest(pages: DataFrame) -> DataFrame:
    """The columns of the query."""
    got = extract(pages.select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
