import html
import random
import re
import time

import pytest

from lociframe.llm import html_text, queries


def brute_cut(scores, edges):
    n, best = len(scores), None
    for k in range(1 << n):
        label = [bool(k >> i & 1) for i in range(n)]
        cost = sum(abs(s) for s, x in zip(scores, label) if (s > 0) != x) + sum(w for (i, j), w in edges.items() if label[i] != label[j])
        if best is None or cost < best - 1e-12:
            best = cost
    return best


def cost(scores, edges, label):
    return sum(abs(s) for s, x in zip(scores, label) if s != 0 and (s > 0) != x) + sum(w for (i, j), w in edges.items() if label[i] != label[j])


def test_cut_is_least():
    rnd = random.Random(7)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        scores = [rnd.randrange(-128, 129) / html_text.UNIT for _ in range(n)]
        edges = {(i, j): rnd.randrange(129) / html_text.UNIT for i in range(n) for j in range(i) if rnd.random() < 0.5}
        edges = {(j, i): w for (i, j), w in edges.items()}
        assert abs(cost(scores, edges, html_text.cut(scores, edges)) - brute_cut(scores, edges)) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><h1>Site name</h1><p>Welcome to our very long site banner sentence.</p></header><div class="cookie-notice"><p>We use cookies. Please accept.</p></div>
<nav><ul><li><a href=/>Home</a><li><a href=x>News</a></ul></nav>%s
<aside><p>Sidebar text that has a sentence in it.</p></aside><section id="comments"><article><p>I think this is a great article, thanks.</p></article></section>
<div class="related-posts"><p>You may also like this long one here.</p></div><footer>&copy; me, all rights reserved.</footer></body></html>"""

BODY = """<h1>Real  title</h1><p><b>The quick &eacute;</b> brown&#32;fox &amp; more, &lt;yes&gt;.<br>Next<p>Short one.<div class="ad">Buy now!</div><!-- <p>no</p> -->
<form><label>Mail</label><input><button>Send</button></form><script>x</script><ul><li>First item of the list.<li>Second</ul><div hidden>secret</div><p>End
 of it.</p>"""

WANT = "Real title\nThe quick é brown fox & more, <yes>. Next\nShort one.\nFirst item of the list.\nSecond\nsecret\nEnd of it."


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div role="main">', "</div>"), ('<div class="postBody"><div>', "</div></div>")])
def test_main_text(open_, close):
    assert html_text.main_text(PAGE % (open_ + BODY + close)) == WANT


def test_class_words():
    def term(tag, attributes=""):
        at = html_text.place(tag, attributes)[0]
        return at.for_, at.against

    assert term("div", ' class="entry-header"') == (1.75, 0) and term("div", ' class="site-header"') == (0, -4.25) and term("div", ' class="content has-sidebar"') == (1.75, 0)
    assert term("div", " id=mainMenu") == (0, -4.25) and term("div", " class='postComments'") == (0, -5.5) and term("div", ' class="research"') == (0, 0)
    assert term("div", ' class="story-comment-box"') == (0, -1.5) and term("div", ' class="comment-list"') == (0, -5.5) and term("p", ' class="ad-hoc"') == (0, -1.5)
    assert term("nav") == (0, -8) and term("article") == (html_text.ARTICLE, 0) and term("header") == (0, -4.25) and term("body", ' class="post"') == (0, 0)
    assert html_text.place("p", " hidden")[1] and html_text.place("p", ' style="DISPLAY: none"')[1]
    page = '<article><header><h1>A title of it</h1></header><div class="post-header"><h2>Second head</h2></div><div class="notice"><p>Please note that this site is closed.</p></div><p>The text of it is here.</p></article>'
    assert html_text.main_text(page) == "A title of it\nSecond head\nThe text of it is here."


def test_nothing_of_the_article_is_lost():
    assert html_text.main_text('<article><p class="ad-hoc">An ad hoc committee met.</p></article>') == "An ad hoc committee met."
    page = '<article><p>It begins here.</p><div class="story-comment-box"><p>The committee said so, twice.</p></div><aside class="pullquote">A quote of it.</aside><p><math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><div hidden>More of it.</div><p>All rights reserved.</p></article>'
    assert html_text.main_text(page) == "It begins here.\nThe committee said so, twice.\nA quote of it.\nx=2\nMore of it.\nAll rights reserved."
    assert html_text.main_text('<article><p>One <span class="comment">(sic)</span> and two <a name=x>three</a>.</p></article>') == "One (sic) and two three."
    assert html_text.main_text("<html><head><meta><p>The head was never closed, but this is a text of the page.</p>") != ""


def plain(page):
    """A page without a word on where its article is."""
    return re.sub("<(/?)(?:article|nav|footer)", r"<\1div", page).replace(' class="ad"', "")


def right(text, page):
    inner = page.split("<article>", 1)[1].split("</article>")[0]
    parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
    return text == "\n".join(p for p in parts if p)


def test_the_cut_decides(pages):
    """Headings, and on pages without marks short paragraphs too, come out by their edges; nothing else has changed."""
    weights = html_text.fit([s for p in pages.values() for s in html_text.weak_labels(html_text.blocks(p))])
    turned = marked = bare = bare_alone = 0
    for page in pages.values():
        found = html_text.blocks(page)
        costs, joined = html_text.scores(found, weights), html_text.edges(found)
        kept, alone = html_text.cut(costs, joined), html_text.cut(costs, {})
        assert alone == [c > 0 for c in costs]
        turned += kept != alone
        marked += right("\n".join(b.text for b, k in zip(found, kept) if k), page)
        found = html_text.blocks(plain(page))
        costs = html_text.scores(found, weights)
        for joined in (html_text.edges(found), {}):
            kept = html_text.cut(costs, joined)
            ok = right("\n".join(b.text for b, k in zip(found, kept) if k), page)
            bare, bare_alone = bare + (ok if joined else 0), bare_alone + (0 if joined else ok)
    assert marked == len(pages) and turned > 0.9 * len(pages)
    print(bare, bare_alone, len(pages))
    assert bare > 0.6 * len(pages) > 0.1 * len(pages) > bare_alone


def test_edges_know_no_names():
    """Neither class words nor the elements around a block change an edge."""
    one = '<nav class="menu"><p>a</p><div id="comments"><p>b</p></div></nav><article><h1>c</h1><p>d</p></article>'
    two = '<div class="post"><p>a</p><div><p>b</p></div></div><footer><h1>c</h1><p>d</p></footer>'
    assert html_text.edges(html_text.blocks(one)) == html_text.edges(html_text.blocks(two))


def test_fit():
    assert html_text.fit([]) == html_text.PRIOR == html_text.fit([((1.0,) + (0.0,) * 9, True)])
    rnd = random.Random(3)
    samples = [((1.0, *(rnd.random() for _ in range(9))), False) for _ in range(300)]
    samples = [(x, x[4] > 0.5) for x, _ in samples]
    weights = html_text.fit(samples)
    assert weights[4] > html_text.PRIOR[4] and weights == html_text.fit(samples)


@pytest.mark.parametrize("page", ['<a "', '<a b="', "<a b='", "<", "<!--", "</x>", "<x>", "<p><section><x><h1>a</h1>", "<a = ", "&#", "<h2>a</h2><p>word word</p>", "<li>word", "<b ", "<![CDATA[", "<?", "<dt>a<dd>b", "<script>", "<tr><td>a"])
def test_time_grows_with_the_page(page):
    n = 200_000 // len(page)
    began = time.process_time()
    html_text.main_text(page * n)
    html_text.main_text("<div><p><section>" + page * n + "</x>" * n)
    assert time.process_time() - began < 10


def test_broken_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    assert html_text.main_text("<article><p>One sentence is here.") == "One sentence is here."
    assert html_text.main_text("<article><p>Kept text stays here.</b></i></section><!-- open <p>gone") == "Kept text stays here."
    assert html_text.main_text("<article><p>Kept text stays here.<script>var a='<p>';") == "Kept text stays here."
    assert html_text.main_text("<article><p>a < b and c > d, is it not so?</p></article>") == "a < b and c > d, is it not so?"
    assert html_text.main_text("<p title='a>b'>The quick brown fox jumps over it all, and then some more words follow.</p>").startswith("The quick")


def test_long_pages():
    page = "<article>" + "<p>A sentence is here.</p>" * 20_000 + "</article>"
    assert html_text.main_text(page).count("\n") == 19_999
    assert html_text.main_text("<div>" * 5000 + "<p>The quick brown fox jumps over it all, and then some more words follow.") != ""


def test_table(spark):
    rows = [(1, "u", PAGE % ("<article>" + BODY + "</article>"), "clash"), (2, None, None, "c"), (2, None, None, "c"), (None, "v", "", "c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, WANT), (2, ""), (2, "")]
    assert html_text.extract(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    return {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}


def test_query(spark, pages):
    """The table's articles hold their text in h1 and p elements."""
    got = queries.op7_main_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert right(r["text"], pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("body", ["single no-comments", "newsletter-enabled", "cookie-consent-shown ads"])
@pytest.mark.parametrize("open_,close", [('<article class="post has-comments">', "</article>"), ('<main id="promo">', "</main>"), ('<div class="content without-ads">', "</div>"), ('<div class="promo"><main>', "</main></div>")])
def test_class_words_do_not_take_the_article(body, open_, close):
    assert html_text.main_text((PAGE % (open_ + BODY + close)).replace("with-sidebar", body)) == WANT


def test_long_paragraphs_overrule_class_words():
    long, short = " ".join(["word"] * 95) + ".", " ".join(["word"] * 50) + "."
    assert html_text.main_text(f'<div class="newsletter"><p>{long}</p><p>{short}</p><p>{long}</p></div>') == "\n".join([long, short, long])
    assert html_text.main_text(f'<div class="comments"><div><p>Well said.</p></div><div><p>{long}</p></div><div><p>{short}</p></div></div>') == ""
    assert html_text.main_text(f"<footer><p>{long}</p><p>{long}</p></footer>") == ""


PROSE = "The quick brown fox jumps over the lazy dog and runs away, as it was told."
BEFORE = '<html><body><header class="site-header"><a href="/">Site</a><p>The best site of all the web, they say.</p></header><nav><a href=/a>A</a> <a href=/b>B</a></nav><div class="cookie-banner">We use cookies. OK?</div>'
AFTER = '<div id="sidebar"><h3>Popular</h3><ul><li><a href=x>Story one</a><li><a href=y>Story two</a></ul></div><section class="comments"><h2>3 Comments</h2><div class="comment"><p class="author">Bob</p><p>I read this twice and it is wrong in many ways, as I have said before.</p></div></section><form><input><label>Email</label></form><footer><p>Copyright 2020 by us. All rights reserved.</p></footer></body></html>'
INSIDE = f'<h1>Title of it</h1><p class="byline">By Jane Doe</p><p>{PROSE}</p><h2>A list</h2><ul><li>one</li><li>two words</li></ul><p>Short.</p><blockquote>Quoted words.</blockquote><pre>code x = 1</pre><table><tr><th>Name</th><th>Age</th></tr><tr><td>Bob</td><td>7</td></tr></table><h3>Last head</h3><div>Plain division text</div><p><a href=z>Read on here</a></p><figure><img><figcaption>A caption</figcaption></figure><dl><dt>Term</dt><dd>Meaning</dd></dl>'
ALL = f"Title of it\nBy Jane Doe\n{PROSE}\nA list\none\ntwo words\nShort.\nQuoted words.\ncode x = 1\nName\nAge\nBob\n7\nLast head\nPlain division text\nRead on here\nA caption\nTerm\nMeaning"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article>{INSIDE}</article>", ALL), (f"<main>{INSIDE}</main>", ALL), (f"<main><article><section>{INSIDE}</section></article></main>", ALL), (f"<div role=main>{INSIDE}</div>", ALL),
        (f'<article>{INSIDE}<section id="comments"><h2>Comments</h2><ol class="comment-list"><li><article class="comment-body"><p>Great article, I liked the fox, and the dog too, very much indeed.</p></article></li></ol></section></article>', ALL),
        (f"<article>{INSIDE}<aside><p>Related: see our other story about a cat that sleeps.</p></aside><footer><p>Posted in News</p></footer></article>", ALL),
        (f'<article><nav class="toc"><ol><li><a href="#a">A</a></li></ol></nav>{INSIDE}</article>', ALL),
        ("<article>" + INSIDE.replace("<p>Short.</p>", '<div class="ad">Buy the new thing now, it is very good for you.</div><p>Short.</p>') + "</article>", ALL),
        ("<article>" + INSIDE.replace("<p>Short.</p>", '<aside>Buy the new thing now, it is very good for you, and so is the old one.</aside><p>Short.</p>') + "</article>", ALL),
        (f'<article>{INSIDE}<div class="newsletter-signup"><h3>Join us</h3><p>Get our best stories in your mail each week, it is free.</p></div><div class="share-buttons"><a href=f>Share</a> <a href=t>Tweet</a></div></article>', ALL),
        (f'<article><div class="notice"><p>This story is more than five years old, so please read it with care.</p></div>{INSIDE}</article>', ALL),
        (f'<article>{INSIDE}<h2>Comments</h2><div class="comments"><p>Nice one, I like it a lot.</p></div></article>', ALL),
        ("<article>Just a line of text</article>", "Just a line of text"), ("<article>First line<br><br>second line</article>", "First line second line"),
        (f"<article><h2>One</h2><p>{PROSE}</p></article><article><h2>Two</h2><p>{PROSE} Again.</p></article>", f"One\n{PROSE}\nTwo\n{PROSE} Again."),
        (f"<div><div><h1>Title of it</h1><p>{PROSE}</p><p>{PROSE} More.</p><h2>Head</h2><p>{PROSE} Most.</p></div></div>", f"Title of it\n{PROSE}\n{PROSE} More.\nHead\n{PROSE} Most."),
        (f"<article><h1>T</h1><p>{PROSE}</p><h2>Sources</h2><ul><li><a href=1>First source of the story</a></li><li><a href=2>Second source of it</a></li></ul></article>", f"T\n{PROSE}\nSources\nFirst source of the story\nSecond source of it"),
    ],
)
def test_kinds_of_pages(pages, page, want):
    weights = html_text.fit([s for p in pages.values() for s in html_text.weak_labels(html_text.blocks(p))])
    assert html_text.main_text(BEFORE + page + AFTER) == want == html_text.main_text(BEFORE + page + AFTER, weights)
    long = AFTER.replace("I read this twice", "I read this twice. " + PROSE * 12)
    assert html_text.main_text(BEFORE + page + long) == want
