import html
import re

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import site_tree
from evenkeel.llm.site_tree import Page

HEAD = '<html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>'


def by_rule(source):
    """The given tables' pages: an article whose blocks are headings, paragraphs and unclosed bold lines."""
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:h1|p|br)>", inside)
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks]
    return " ".join(b for b in blocks if b)


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in site_tree.main_text(pages).collect()}
    for r in pages.collect():
        want = by_rule(r["html"])
        assert got[r["page_id"]] == (want, len(want))


@pytest.mark.parametrize("body, want", [
    ("<nav>menu</nav><article><h1>A&amp;B</h1><p>one&nbsp; two<p>thr<b>ee</b></article><footer>f</footer>", "A&B one two three"),
    ("<div class='cookie-notice'>c</div><main><p>x &lt; y</main><aside>s</aside>", "x < y"),
    ("<div>alone<br>here</div><form>f<input></form><!-- <p>no</p> -->", "alone here"),
    ('<article><p title="a>b">t</p><section class="comments"><p>c</p></section><div id=\'sidebar\'>s</div></article>', "t"),
    ("<article>a</article><p>b</p><script>if (a<b) '</p>'</script>", "a"),
    ("<article><p>never closed <i>line", "never closed line"),
    ("<header>h</header><article><header><h1>own</h1></header><p>p</p></article>", "own p"),
    ("", ""), ("< 3 & 4 <", "< 3 & 4 <"), ("<p>1</p>" * 3000, " ".join("1" * 3000)),
])
def test_single_pages(body, want):
    assert Page(HEAD + body).text(set()) == want


@pytest.mark.parametrize("body, want", [
    ('<div class="post"><p>Main text of the story.</p></div><div id="comments"><article class="comment-body"><p>Reader says hi</p></article></div>',
     "Main text of the story."),
    ('<main><p>Main.</p><div class="comments"><article class="comment"><p>Reader says a lot of things here</p></article></div></main>', "Main."),
    ('<main><p>Main.</p></main><section class="related"><article class="card"><p>Teaser that is longer than the story</p></article></section>', "Main."),
    ('<article><p>Main.</p><div class="comments"><article><p>Reply one</p></article><article><p>Reply two</p></article></div></article>', "Main."),
    ('<div class="comments"><article><p>short reply</p></article></div><div class="sidebar"><article><p>The story, the longest text of all.</p></article></div><p>menu</p>',
     "The story, the longest text of all."),
    ('<div class="comments"><article><p>only replies</p></article></div>', "only replies"),
])
def test_articles_in_cut_branches_are_comments_or_teasers(body, want):
    assert Page(f"<html><body>{body}</body></html>").text(set()) == want


@pytest.mark.parametrize("body, want", [
    ("<article class='post category-search'><p>a</p></article>", "a"),
    ("<div class='layout-no-sidebar'><p>a</p></div>", "a"),
    ("<div class='sidebar widget'><main class='search'><p>a</p></main><p>b</p></div>", "a"),
    ("<div class='search'><div class='comments'>c</div><div role='main' id='search'><p>a</p></div></div>", "a"),
    ("<main><div class='widget'><article><p>a</p></article></div><div class='widget'>w</div><p>b</p></main>", "a b"),
    ("<div class='ad'>x</div><div class='ad-2'>x</div><div class='ad3 big'>x</div><div class='adage'>y</div>", "y"),
    ("<svg width='1' /><p>a</p><math/><p>b</p><svg><text>c</text></svg><p>d</p>", "a b d"),
])
def test_classes_cut_no_article(body, want):
    assert Page(HEAD + body).text(set()) == want


@pytest.mark.parametrize("classes", ["has-sidebar", "single comments-open", "search"])
def test_classes_cut_no_page(classes):
    page = HEAD.replace("<body>", f"<body class='{classes}'>").replace("<html>", f"<html class='{classes}'>")
    assert Page(page + "<h1>a</h1><p>b</p><div class='comments'>c</div>").text(set()) == "a b"


def test_branches_that_recur_on_a_host_are_cut(spark):
    def page(i, extra):
        return f"{HEAD}<article><div class='x1'>Published by the desk</div><p>Text {i} of its own</p><p>More {i}</p><div class='t'>{extra}</div></article>"

    rows = [(i, f"https://a.example/{i}", page(i, "See the terms")) for i in range(12)]
    rows += [(100 + i, f"https://b.example/{i}", page(i, f"Tail {i}")) for i in range(3)] + [(i, "https://a.example/0", page(0, "See the terms")) for i in (20, 21)]
    rows += [(None, None, None), (30, "http://[bad", "<p>kept</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as cut")
    got = {r["page_id"]: r["text"] for r in site_tree.main_text(pages).collect()}
    assert got[3] == "Text 3 of its own More 3" and got[20] == "Text 0 of its own More 0"
    assert got[101] == "Published by the desk Text 1 of its own More 1 Tail 1"
    assert got[None] == "" and got[30] == "kept" and len(got) == len({r[0] for r in rows})


def test_near_copies_count_once(spark):
    def page(i, article):
        return f"<body><nav>menu {i}</nav><div>advert {i}</div><script>track({i})</script><article><h1>Title {article}</h1><p>Text {article}</p></article></body>"

    rows = [(i, f"https://a.example/{i}", page(i, i % 4)) for i in range(400)]
    rows += [(1000 + i, f"https://b.example/{i}", page(i, 9)) for i in range(6)]
    # Ten articles, one of them many times.
    rows += [(2000 + i, f"https://c.example/{i}", page(i, max(0, i - 50))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_tree.main_text(pages).collect()}
    for i, _, source in rows:
        assert got[i] == by_rule(source)
    nodes = site_tree.importance(pages.select("url", "html"), by_article=True)
    # The advert outside the article is that of one copy, too.
    assert {(r["host"], r["m"], r["leaf"]) for r in nodes.where("leaf is not null").collect()} == {("c.example", 10, 1.0)}


def test_importance_is_that_of_brute_force(spark, sf):
    import collections
    import math

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    shown, seen = collections.defaultdict(lambda: collections.defaultdict(set)), set()
    for r in pages.collect():
        key = (site_tree.host(r["url"]), r["html"])
        if key in seen:
            continue
        seen.add(key)
        p = Page(r["html"])
        for node in p.nodes:
            shown[key[0], node][None].add(r["page_id"])
        for node, text, _ in p.blocks:
            shown[key[0], node][text].add(r["page_id"])
    want = {}
    for where, texts in shown.items():
        m = len(texts.pop(None))
        if m >= site_tree.MIN_PAGES and texts:
            want[where] = max(0.0, 1 - sum(math.log(len(x)) / math.log(m) for x in texts.values()) / len(texts))
    got = {(r["host"], r["node"]): r["leaf"] for r in site_tree.importance(pages.select("url", "html")).where("leaf is not null").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert site_tree.main_text(none).agg(F.count("*")).first()[0] == 0
