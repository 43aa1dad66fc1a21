import html
import re

from strandline.llm import queries
from strandline.llm.html_text import blocks, classify, extract, main_text, table, train, tree


def test_tree_fits_its_table():
    assert all(classify(tree(), r[:-1]) == bool(r[-1]) for r in table())
    assert train([(1, 0), (2, 0)], 3) == 0


def test_pages_of_the_tables(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(150).collect():
        article = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        parts = re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>|<br>", article)
        want = " ".join(q for q in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if q)
        assert main_text(r.html) == want


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home"><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav><div id="cookie-notice"><p>We use cookies on this site, please accept them all now.</p></div>
<main><article><h1>A &amp; B</h1><p>First   paragraph with <b>bold</b>text &lt;kept&gt;.<p>Second<script>var x = "<p>no</p>";</script> one.
<div class="ad">Buy this now.</div><ul><li>Item one</li><li>Item two</li></ul><form><label>Name</label><input></form></article>
<section class="comments"><h2>Comments</h2><p>A reader wrote a rather long comment here about the article, it goes on and on.</p></section></main>
<aside>Related things</aside><!-- <p>gone</p> --><footer>&copy; all</footer></body></html>"""


def test_parts_that_are_left_out():
    assert main_text(PAGE) == "A & B First paragraph with boldtext <kept>. Second one. Item one Item two"


def test_pages_without_marks():
    body = "<p>" + "A sentence with quite a few words in it that nobody links. " * 3 + "</p>"
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><div>{body}{body}</div><div><a href=3>Three</a></div>"
    assert main_text(page).count("A sentence") == 6 and "One" not in main_text(page) and "Three" not in main_text(page)


def test_odd_markup():
    assert blocks("") == [] and main_text("<p") == "" and blocks("a < b")[0][0] == "a < b"
    assert main_text("<article>x<br/>y &am z<textarea>no</textarea></article>") == "x y &am z"
    assert main_text("<article><p>one<script>unclosed") == "one"


def test_query_edges(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "u", PAGE, 0), (4, "u", "<article>" + "<p>long text</p>" * 20_000 + "</article>", 0), (4, "u", "plain", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = extract(df).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert {r.page_id: r.n_chars for r in out if r.url is None or r.page_id == 1} == {1: 0, 2: 0}
    assert max(r.n_chars for r in out) == 20_000 * 10 - 1
    assert extract(df.filter("false")).count() == 0


PROSE = "A sentence with quite a few words in it that nobody links anywhere. " * 3


def test_names_around_the_prose_say_nothing():
    for page in (f'<div class="post-12 tag-news"><p>{PROSE}</p><p>{PROSE}</p></div>', f'<div class="has-header-image"><article><p>{PROSE}</p></article></div>', f'<div id="social-policy"><p>{PROSE}</p></div>'):
        assert main_text(f"<nav><a href=1>One</a></nav>{page}<footer>end</footer>").count("A sentence") == page.count("A sentence")
    short = [f"The paragraph number {k} has few words." for k in range(8)]
    assert main_text("<ul><li><a href=1>One</a><li><a href=2>Two</a></ul>" + "".join(f"<p>{p}</p>" for p in short)) == " ".join(short)


def test_attributes_as_html_has_them():
    assert main_text("<article><p data-x=it's>Hello world</p><p>Don't go</p></article>") == "Hello world Don't go"
    assert main_text('<article><p title="a > b" class=x>Kept</p></article>') == "Kept"


def test_long_odd_pages_take_linear_time():
    import time

    for page in ("<a href=\"x" * 40_000, "<a " * 100_000, "<p class='" * 40_000 + ">", "<div>" * 3_000 + "x"):
        began = time.process_time()
        blocks(page)
        assert time.process_time() - began < 5


def test_query_over_the_whole_table(spark, small):
    rows = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    out = queries.op10_html_text(spark, small).collect()
    assert sorted(r.page_id for r in out) == sorted(rows)
    assert all(r.text == main_text(rows[r.page_id].html) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url for r in out)


LONG = "A reader wrote a rather long comment here about the article, it goes on and on. " * 20
SHORT = "<p>Five words of an article.</p>"


def test_comments_and_notices_go_whatever_their_size():
    wanted = "Title Five words of an article."
    for name in ('class="comments"', 'id="comments"', 'class="comment-list"', 'class="reader-comments"', 'class="cookie-notice"', 'id="gdpr-consent"', 'class="newsletter-box"'):
        part = f"<section {name}><h2>Said</h2><p>{LONG}</p><p>{LONG}</p></section>"
        assert main_text(f"<nav><a href=1>One</a></nav><article><h1>Title</h1>{SHORT}</article>{part}<footer>end</footer>") == wanted
        assert main_text(f"<article><h1>Title</h1>{SHORT}{part}</article><footer>end</footer>") == wanted
        assert main_text(f"<main><article><h1>Title</h1>{part}{SHORT}</article></main>") == wanted
        assert main_text(f"<main>{part}<article><h1>Title</h1>{SHORT}</article></main>") == wanted
    replies = "".join(f'<article class="comment"><p>{LONG}</p></article>' for _ in range(3))
    plain = "".join(f"<article><p>{LONG}</p></article>" for _ in range(3))
    for inside in (replies, plain):
        assert main_text(f'<article><h1>Title</h1>{SHORT}</article><section id="comments">{inside}</section>') == wanted
    assert main_text(f"<article><h1>Title</h1>{SHORT}</article>{replies}") == wanted


def test_wrappers_named_after_what_else_they_have():
    wanted = f"Title {PROSE}".strip()
    for name in ("with-sidebar", "has-comments", "page has-nav", "layout-ads"):
        assert main_text(f'<div class="{name}"><article><h1>Title</h1><p>{PROSE}</p></article><div class="comments"><p>{LONG}</p></div></div>') == wanted
        assert main_text(f'<div class="{name}"><h1>Title</h1><p>{PROSE}</p><div class="comments"><p>{LONG}</p></div></div>') == wanted


def test_pages_of_the_tables_with_comments_put_in(spark):
    """An independent reading of all articles, with comments or notices of any size put into and behind them."""
    parts = ['<div class="comments"><p>{}</p></div>', '<section id="comments"><ul><li>{}</li></ul></section>', '<div class="cookie-consent">{}</div>', '<aside>{}</aside>']
    for k, r in enumerate(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()):
        article = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        pieces = re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>|<br>", article)
        want = " ".join(q for q in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in pieces) if q)
        part = parts[k % 4].format("words of a reader " * (1 + k * 37 % 900))
        assert main_text(r.html.replace("</article>", part + "</article>" if k % 3 else "</article>" + part)) == want
