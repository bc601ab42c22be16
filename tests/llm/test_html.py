import html as references
import re
import time

import pytest

from scriptorium.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1><a href=x>home</a></header>
<div class="cookie-notice">We use cookies. Please accept them all, this notice is long enough to look like text of an article.</div>
<nav><ul><li><a href=1>One</a></ul></nav>
<main><article class="post-content"><header><h2>Title &amp; more</h2></header>
<p>First para with some text in it &lt;ok&gt;.<p>Second
 para  with <b>bold</b><br>line.<div class="ad-slot">Buy now</div>
<ul><li>item one<li>item two</ul><form><input><label>Name</label></form>
<script>var a="<p>no</p>";</script><!-- <p>gone</p> --><p>Short.</p>
<section class="comments"><h3>Comments</h3><p>A reader says a long comment with very many words in it here and there.</p></section>
</article></main><aside class="sidebar"><p>Side text</p></aside><footer>foot</footer></body></html>"""


def test_article():
    assert html.main_text(PAGE).split("\n") == ["Title & more", "First para with some text in it <ok>.", "Second para with bold line.", "item one", "item two", "Short."]


@pytest.mark.parametrize("page", [None, "", "<p", "<!-- x", "<script>a", "<nav>only a menu</nav>", "</p></div>", "<p></p>", "<article></article>"])
def test_pages_without_text(page):
    assert html.main_text(page) in ("", "<p")


def test_surge_and_dive_without_container():
    menu = "".join(f"<div><a href={i}>link {i}</a></div>" for i in range(30))
    body = "".join(f"<p>paragraph {i} with a good number of words that make up its text</p>" for i in range(8))
    text = html.main_text(f"<body>{menu}{body}{menu}</body>")
    assert text.split("\n") == [f"paragraph {i} with a good number of words that make up its text" for i in range(8)]


def test_division_as_container():
    body = "".join(f"<p>paragraph {i} with a good number of words that make up its text</p>" for i in range(5))
    page = f"<body><div id=top><a href=1>a</a> <a href=2>b</a></div><div><div id=text><h1>Short</h1>{body}<p>End.</p></div><div class='post-footer'>Tags</div></div><div>other small words</div></body>"
    assert html.main_text(page).split("\n")[0] == "Short" and html.main_text(page).split("\n")[-1] == "End."


def test_core():
    assert html.core([0, 0, 0, 50, 60, 0, 70, 0, 0, 0, 5]) == (1, 7) or html.core([0, 0, 0, 50, 60, 0, 70, 0, 0, 0, 5])[1] == 7


def test_white_space_and_references():
    assert html.main_text("<article><p>a\n\t b&nbsp;c &eacute;&#233;</p>\n<p> x </p></article>") == "a b c éé\nx"


def test_very_long_and_nested():
    assert len(html.main_text("<article>" + "<div>" * 3000 + "x" * 100_000)) == 100_000


def para(name, size=300):
    return f"<p>{name} {'word ' * (size // 5)}</p>"


def test_no_core_line_is_lost():
    kept = lambda page: [x.split()[0] for x in html.main_text(f"<body>{page}</body>").split("\n")]
    body = "".join(para(f"b{i}") for i in range(6))
    names = [f"b{i}" for i in range(6)]
    # Title and lead beside an inner content container.
    assert kept(f"<article><h1>title</h1>{para('lead')}<div class=article-body>{body}<p>end</p></div></article>") == ["title", "lead", *names, "end"]
    # Two sibling containers around an advert.
    for tag in ("article", "div class=post-content"):
        part = lambda k, x: f"<{tag}>{x}<p>{k}</p></{tag.split()[0]}>"  # noqa: B023, E731
        assert kept(f"<div>{part('x', body)}<div class=ad>buy</div>{part('y', para('c0') + para('c1'))}</div>") == [*names, "x", "c0", "c1", "y"]
    # A lead beside the division with nearly all of the text, and one outside every division.
    assert kept(f"<div id=page>{para('lead')}<div>{body}<p>end</p></div></div><div><a href=1>menu</a></div>") == ["lead", *names, "end"]
    assert kept(f"{para('lead')}<div>{body}<p>end</p></div>") == ["lead", *names, "end"]


def test_every_stretch_stays_beside_a_very_long_line():
    links = "".join(f"<p><a href={i}>link</a></p>" for i in range(6))
    text = html.main_text(f"<body>{para('first')}{links}{para('long', 50_000)}{links}{para('last')}</body>")
    assert [x.split()[0] for x in text.split("\n")] == ["first", "long", "last"]


def test_containers_above_many_divisions():
    body = "".join("<div>" * 40 + para(f"b{i}") + "</div>" * 40 for i in range(4))
    text = html.main_text(f"<body><div id=page>{body}<p>end</p></div><div>{'<p><a href=1>menu</a></p>' * 5}</div></body>")
    assert [x.split()[0] for x in text.split("\n")] == ["b0", "b1", "b2", "b3", "end"]


def test_query_against_the_pages_own_markup(spark):
    rows = html.op9_line_blocks(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html.extract(df).collect()) == [(0, "", "a", 1), (1, "u", "", 0), (1, "u", "", 0)]
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", ['<div class="content-sidebar-wrap"><article>%s</article></div>', '<div class="layout has-sidebar"><article>%s</article></div>', '<div id="share-price"><article>%s</article></div>', '<div class="page-header-fixed"><article>%s</article></div>', '<main><div class="with-comments">%s</div></main>'])
def test_wrappers_that_mention_boilerplate(wrapper):
    lines = ["A title"] + [f"Sentence {i} of the article goes on for some time, with commas and more." for i in range(6)]
    body = "<h1>A title</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])
    page = f'<html><body><nav><a href="/">Home</a></nav>{wrapper % body}<div class="comments"><p>I like this very much, dear author, thank you.</p></div></body></html>'
    assert html.main_text(page) == "\n".join(lines)


@pytest.mark.parametrize("page", ["<a " * 300_000, "</b>" * 200_000, "<svg>" * 100_000, "<b>" * 50_000 + "<p>" * 50_000, '<a b="<' * 100_000, "<!x" * 200_000])
def test_broken_markup_costs_its_length(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 10


INSIDE = [
    ('<section id="related"><h2>Related work</h2><p>Many have written on this before us, at length.</p></section>', ["Related work", "Many have written on this before us, at length."]),
    ('<div class="header"><h1>The title</h1></div>', ["The title"]),
    ('<div class="alert">Mind the step at the door.</div>', ["Mind the step at the door."]),
    ('<p class="comment">This is a remark of the author.</p>', ["This is a remark of the author."]),
    ('<div class="copyright-law"><p>Copyright law protects works.</p></div>', ["Copyright law protects works."]),
    ('<section class="share-price"><p>The share price rose.</p></section>', ["The share price rose."]),
    ('<h2 id="comments">Comments on the text</h2>', ["Comments on the text"]),
    ('<h2 id="navigation">How birds navigate</h2>', ["How birds navigate"]),
    ('<h3 id="advertisement">On advertisement</h3>', ["On advertisement"]),
    ('<h3 class="social-comment">Social comment</h3>', ["Social comment"]),
    ("<p>Tick the <label>box</label> here.</p>", ["Tick the box here."]),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", ["Let x=2 be."]),
    ("<xmp><b>code</b> &amp;</xmp>", ["<b>code</b> &amp;"]),
    ('<div class="related"><a href=1>Another story</a> <a href=2>One more</a></div>', []),
    ('<div class="share-buttons"><a href=1>Tweet</a></div>', []),
    ('<div class="ad-slot">Buy now</div><p class="advertisement">Buy this</p><div id="newsletter">Sign up to our letters today</div>', []),
    ('<section class="comments"><h3>Comments</h3><p>A reader says very much about this text.</p></section>', []),
    ("<aside>Side</aside><nav>Menu</nav><footer>Foot</footer><form>Ask <label>name</label></form>", []),
]


@pytest.mark.parametrize("piece, kept", INSIDE)
def test_names_decide_little_inside_an_article(piece, kept):
    first, last = "The first sentence of a text that goes on for a while.", "The last sentence of a text that went on for a while."
    page = f"<nav><a href=1>Home</a></nav><article><p>{first}</p>{piece}<p>{last}</p></article><footer>Foot of the page</footer>"
    assert html.main_text(page).split("\n") == [first, *kept, last]


def test_an_article_of_links_keeps_its_text():
    body = "".join(f"<p><a href={i}>Entry number {i} of the list of all things</a></p>" for i in range(6))
    assert len(html.main_text(f"<div><a href=1>menu</a></div><article>{body}</article>").split("\n")) == 6
    assert len(html.main_text(f"<p>Welcome to this site, dear reader.</p><article>{body}</article>").split("\n")) >= 6


def line_blocks(texts, window=html.WINDOW):
    """Surge and dive by definition: windows of at least a share of the largest one, and the lines that they cover."""
    sizes = [min(len(t), html.LINE_CAP) for t in texts]
    sums = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    least, kept, i = html.SURGE * max(sums), set(), 0
    while i < len(texts):
        if sums[i] >= least and sizes[i]:
            j = i
            while j < len(texts) and sums[j] >= least:
                j += 1
            kept |= set(range(i, j))
            i = j
        i += 1
    return [t for i, t in enumerate(texts) if i in kept]


def test_pages_without_marks_equal_line_blocks(monkeypatch):
    import random

    rng, differs = random.Random(8), 0
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(2, 5)):
            texts += [f"t{rng.randrange(10)}" for _ in range(rng.randrange(6, 12))] + [" ".join(["word"] * rng.randrange(25, 60)) for _ in range(rng.randrange(3, 8))]
        texts += ["x"] * 8
        page = "<body>" + "".join(f"<p>{t}</p>" for t in texts) + "</body>"
        assert html.main_text(page).split("\n") == line_blocks(texts)
        with monkeypatch.context() as m:
            m.setattr(html, "stretches", lambda sizes: [(0, len(sizes))])
            differs += html.main_text(page).split("\n") != line_blocks(texts)
    assert differs == 60
