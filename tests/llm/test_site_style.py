import pytest
from pyspark.sql import functions as F

from quirework.llm import site_style as ss

PAGES = "page_id long, url string, html string"


def page(i, body=None, extra=""):
    return f"<html><head><title>t{i}</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>{extra}<article><h1>Title {i}</h1><p>Body&nbsp;text  {i} &amp; more<br>line<p>Second {i}</p>{body or ''}</article><aside>side</aside><footer>foot</footer><script>var a='</p>';</script></body></html>"


def test_article_without_the_rest():
    assert ss.main_text(page(1)) == "Title 1\nBody text 1 & more line\nSecond 1"


@pytest.mark.parametrize(
    "junk",
    ['<div class="ad">buy</div>', '<div id="comments"><p>nice!</p></div>', '<div class="cookie-notice">ok</div>', "<form><p>name</p><input></form>", '<section class="relatedPosts">x</section>', '<div role="navigation">x</div>', "<!-- <p>no</p> -->", "<template><p>x</p></template>", "<button>go</button>", '<div class="share-bar"><p>x</p></div>', "<script>document.write('<p>x</p>')</script>", "<footer>by me</footer>", "<svg><text>x</text></svg>", '<ul class="menu"><li>x</li></ul>'],
)
def test_junk_inside_and_outside(junk):
    want = ss.main_text(page(1))
    assert ss.main_text(page(1, junk)) == want and ss.main_text(page(1, None, junk)) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<b>x <i>y</b> z</i>", "x y z"), ("<p>a &lt;b&gt; &#65;&#x42; &unknown; &eacute</p>", "a <b> AB &unknown; é"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("</p></div>x", "x"), ("<p title='a>b'>t</p>", "t"), ("<a", "<a"),
        ("<!-- open", ""), ("<script>never closed <p>x", ""), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"), ("<P>Up<BR/>per</P>", "Up per"), ("a\x00b", "a\x00b"), ("<main><p>m</p></main><p>o</p>", "m"),
    ],
)
def test_markup(html, want):
    assert ss.main_text(html) == want


@pytest.mark.parametrize("name", ["post with-sidebar", "no-comments", "layout-two-nav", "entry-header", "hasSidebar"])
def test_layout_classes_are_no_cue(name):
    want = ss.main_text(page(1))
    assert ss.main_text(page(1).replace("<article>", f'<div class="{name if name != "entry-header" else "wrap"}"><article class="{name}">')) == want
    assert ss.main_text(page(1).replace("<body>", f'<body class="{name} sidebar menu">')) == want


def sites(n=30):
    rows = []
    for i in range(n):
        layout = f'<body><div class="top"><p>Welcome to our site</p></div><div class="text"><p>Story {i} begins here</p><p>and goes on {i * 7}</p></div><div class="end"><p>All rights kept</p></div></body>'
        rows.append((i, f"https://a.example.com/{i}", layout))
    return rows


def test_style_tree_removes_repeated_branches_where_structure_is_silent(spark):
    rows = sites() + [(100, "http://single.example.org/", '<body><div class="top"><p>Welcome to our site</p></div><p>Own</p></body>')]
    got = {r.page_id: r.text for r in ss.digest(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "Story 3 begins here\nand goes on 21" and got[100] == "Welcome to our site\nOwn"


def test_importance_against_brute_force(spark):
    import math

    tree = {r.path: r for r in ss.style_tree(spark.createDataFrame(sites(16), PAGES)).collect()}
    top, text, body = (tree[ss._key(f"/body/div.{c}" if c else "/body")] for c in ("top", "text", ""))
    assert top.pages == 16 and abs(top.content) < 1e-9 and abs(text.content - 1) < 1e-9
    repeated = 2 * 16 * math.log(16)
    assert abs(body.content - (1 - repeated / (4 * 16) / math.log(16))) < 1e-9 and abs(body.presentation) < 1e-9


def test_host_of_copies_loses_nothing(spark):
    rows = [(i, "https://c.example.com/x", page(1)) for i in range(20)] + [(50 + i, "https://d.example.com/x", "<body><div><p>Same text</p></div></body>") for i in range(20)]
    assert {r.text for r in ss.digest(spark.createDataFrame(rows, PAGES)).collect()} == {ss.main_text(page(1)), "Same text"}


@pytest.mark.parametrize("bound", [0, 10**6])
def test_joins_agree_and_odd_tables(spark, monkeypatch, bound):
    monkeypatch.setattr(ss, "BROADCAST_ROWS", bound)
    rows = sites(12) + [(60, None, None), (60, "no url", "<p>x"), (None, "https://a.example.com/1", "<body><div class='top'><p>Welcome to our site</p></div><p>new</p>")]
    d = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("h")).withColumn("low", F.lit(1))
    got = ss.extract(d)
    assert got.columns == [*d.columns, "text"] and got.count() == 15
    assert sorted(r.text for r in got.where("page_id is null or page_id = 60").collect()) == ["", "new", "x"]
    assert ss.digest(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<form><main><h1>T</h1><p>Whole article body.</p></main></form>", "T\nWhole article body."),
        ("<form action='/x'><p>Your name</p><input></form><article><p>a</p></article>", "a"),
        ("<p title=it's>Hello</p>", "Hello"), ('<p class="a"">Hello</p>', "Hello"), ("<p a='1' b=\"2>3\" c=d>x</p>", "x"), ('<p class="never closed>x</p>', "x"),
        ('<article><p>a</p><section class="market-share"><p>b</p></section><div class="notice-period"><p>c</p></div></article>', "a\nb\nc"),
        ('<article><p>a</p><section class="share-buttons"><p>b</p></section><div class="site-notice"><p>c</p></div></article>', "a"),
    ],
)
def test_forms_quotes_and_weak_cues(html, want):
    assert ss.main_text(html) == want


def test_very_long_pages_and_open_tags():
    assert ss.main_text("<article>" + "<p>word</p>" * 50_000 + "</article>").count("\n") == 49_999
    assert ss.main_text("<p " + 'a="b" ' * 50_000) == ("<p " + 'a="b" ' * 50_000).strip()


def test_own_columns_do_not_clash(spark):
    d = spark.createDataFrame([(1, "https://x.example.com/", page(1))], PAGES).withColumn("__style_host", F.lit("mine")).withColumn("__style_low", F.lit(7))
    got = ss.extract(d).first()
    assert (got["__style_host"], got["__style_low"], got.text) == ("mine", 7, ss.main_text(page(1)))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<form id="aspnetForm"><div class="text"><h2>News</h2><p>Long story.</p></div></form>', "News\nLong story."),
        ('<form><input type="hidden" name="state"><p>Story.</p></form>', "Story."),
        ("<form>" + "<p>" + "long prose " * 60 + "</p><input name=q></form>", ("long prose " * 60).strip()),
        ("<form><p>Subscribe to what we write</p><input type=email><button>Go</button></form><p>x</p>", "x"),
        ("<article><p>a</p><form><label>Comment</label><textarea></textarea></form></article>", "a"),
        ('<article><p>a</p><div class="ad-hoc"><p>b</p></div><div class="reply-to-critics">c</div><section id="comments-on-the-text">d</section></article>', "a\nb\nc\nd"),
        ('<article class="login-guide"><p>x</p></article>', "x"),
        ('<article><p>a</p><div class="related-reading"><a href=1>One more story</a> <a href=2>And another</a></div></article>', "a"),
        ('<article><p>a</p><div class="advert-history"><p>Prose about it.</p><div class="sponsor-links-here"><a>only</a> <a>links</a></div></div></article>', "a\nProse about it."),
        ('<article><p>a</p><div class="user-comments"><p>nice</p></div><div class="wp-comment-form">x</div></article>', "a"),
    ],
)
def test_frames_and_doubtful_classes(html, want):
    assert ss.main_text(html) == want


@pytest.mark.parametrize(
    "html",
    ["<div>" * 100_000 + "x", "<div>x" * 100_000, "<form>x" * 100_000, "<span>" * 100_000 + "<p>x" * 100_000, "<p>" + "<span>" * 100_000 + "</div>" * 100_000, '<div class="comments-on-the-text">x' * 100_000, "<ul><li>" + "<b>" * 100_000 + "<li>x" * 100_000],
)
def test_one_pass_over_nested_and_unclosed_elements(html):
    import time

    began = time.process_time()
    ss.main_text(html)
    assert time.process_time() - began < 5


def test_deep_elements_share_an_outer_path():
    found, every = ss.blocks("<div>" * 200 + "<p>x</p>")
    node = found[0][0]
    assert node.tag == "p" and len(list(node.above())) < 70 and len(every) == 201
