"""Structured data, listings, announced addresses, captions, returned units, parts, books."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import book
from scriptorium.operators import build as B
from scriptorium.operators import site as S

SITE = "https://archive.example"


def test_order_of_code_units(spark):
    xs = ["", "\U0001f600", "b", "a", "", None]
    df = spark.createDataFrame([(xs,)], "x array<string>")
    assert df.select(S.sorted_by_code_units(F.col("x"))).first()[0] == [None, "", "a", "b", "\U0001f600", ""]
    assert df.select(F.array_sort("x")).first()[0][-3:-1] == ["", "\U0001f600"]  # the order of code points


RECORD = "n long, id string, slug string, type string, org string, day string, kind string, title_en string, title_zh string, summary_en string, summary_zh string, source_url string, source_label string, archive_url string, transcript_source string, embed_url string, thumbnail_url string, duration double, reviewed_at string, translated_at string, fetched_at string, segments array<struct<sid:string,speaker_en:string,start:double,text_en:string,text_zh:string,speaker_zh:string>>"


def record(n, **change):
    row = dict(n=n, id=f"r{n}", slug=f"s{n}", type="speech", org="", day="2024-01-02", kind="article", title_en=f"T{n}", title_zh="题", summary_en="About", summary_zh="", source_url="https://x.example/a", source_label=None, archive_url="https://archive.example/items/1", transcript_source=None, embed_url=None, thumbnail_url=None, duration=61.0, reviewed_at=None, translated_at="2024-02-02", fetched_at="2024-01-01", segments=[("s1", None, None, "text", "文", None)])
    return tuple((row | change).values())


def test_collections_page_by_page(spark):
    df = spark.createDataFrame([record(i, type="speech" if i < 30 else "keynote", title_zh="</script>" if i == 3 else "题") for i in range(32)], RECORD)
    rows = {(r.type, r.page): r.json for r in S.collection_json_ld(df, "type", "n", SITE).collect()}
    assert set(rows) == {("speech", 1), ("speech", 2), ("keynote", 1)} and "<" not in "".join(rows.values())
    page, items = json.loads(rows["speech", 2])["@graph"]
    assert page["dateModified"] == "2024-02-02" and items["numberOfItems"] == 30 and [i["position"] for i in items["itemListElement"]] == list(range(25, 31))
    assert json.loads(rows["speech", 1])["@graph"][1]["itemListElement"][3] == {"@type": "ListItem", "position": 4, "url": f"{SITE}/records/s3/", "name": "</script>"}


def test_details_are_videos_or_articles(spark):
    media = {"embed_url": "https://www.youtube-nocookie.com/embed/a", "thumbnail_url": "https://i.example/a.jpg"}
    df = spark.createDataFrame([record(1, **media), record(2, thumbnail_url="https://i.example/a.jpg"), record(3, embed_url="data:x", transcript_source="https://t.example/x"), record(4, title_zh="")], RECORD)
    graphs = {r.n: json.loads(r.json)["@graph"] for r in S.detail_json_ld(df, SITE).collect()}
    kinds = {n: [x["@type"] for x in g] for n, g in graphs.items()}
    assert kinds[1] == ["BreadcrumbList", "WebPage", "VideoObject"] and kinds[2] == kinds[3] == ["BreadcrumbList", "WebPage", "Article"]
    video, article = graphs[1][2], graphs[2][2]
    assert video["embedUrl"] == media["embed_url"] and video["thumbnailUrl"] == [media["thumbnail_url"]] and video["duration"] == "PT1M1S" and "headline" not in video
    assert article["image"] == ["https://i.example/a.jpg"] and article["headline"] == "题" and "embedUrl" not in article and "image" not in graphs[3][2]
    assert [c["url"] for c in graphs[3][2]["citation"]] == ["https://x.example/a", "https://archive.example/items/1", "https://t.example/x"] and graphs[4][2]["name"] == "T4"
    types = {(r.n, r.type) for r in S.json_types(S.detail_json_ld(df, SITE), "n", "json").collect()}
    assert {t for n, t in types if n == 1} == {"BreadcrumbList", "ListItem", "WebPage", "ImageObject", "VideoObject", "CreativeWork"} and (4, "ImageObject") not in types


def test_types_at_any_depth(spark):
    deep = "".join('{"a":[' for _ in range(12)) + '{"@type":"Deep"}' + "]}" * 12
    rows = [(1, deep), (2, '{"@type":["A","B"],"x":{"@type":"A","@type2":"no"}}'), (3, "no json"), (4, None), (5, '{"@type":5,"y":{"z":[[{"@type":"C"}]]}}')]
    assert {tuple(r) for r in S.json_types(spark.createDataFrame(rows, "k long, j string"), "k", "j").collect()} == {(1, "Deep"), (2, "A"), (2, "B"), (5, "C")}


def test_listing_lines(spark):
    df = spark.createDataFrame([record(i, type=["speech", "keynote"][i % 2], org="Acme" if i == 2 else "", kind="none" if i == 1 else "article") for i in range(4)], RECORD)
    lines = [r.line for r in S.listing_lines(df, "n", SITE, ["# Name", ""]).orderBy("section", "position").collect()]
    assert lines[:5] == ["# Name", "", "## 分类档案", f"- [主题演讲档案](<{SITE}/categories/keynote/>)", f"- [公开演讲档案](<{SITE}/categories/speech/>)"]
    assert lines[5] == "## 全部档案（4 条）" and lines[8].startswith(f"- [题](<{SITE}/records/s2.md>): 2024-01-02 · 公开演讲 · Acme · [网页版](<{SITE}/records/s2/>) · English: T2")
    assert lines[10] == "## 中文文字稿（3 篇）" and len(lines) == 14


def test_announced_addresses(spark):
    df = lambda *xs: spark.createDataFrame([(x,) for x in xs], "u string")
    assert {r.u for r in S.announced(df(f"{SITE}/a", f"{SITE}/a", None, f"{SITE}/b"), "u", SITE).collect()} == {f"{SITE}/a", f"{SITE}/b"}
    for bad, why in ((df(), "0 addresses"), (df(None), "0 addresses"), (df(f"{SITE}/a", "https://archive.example.org/"), "another site")):
        with pytest.raises(ValueError, match=why):
            S.announced(bad, "u", SITE)
    with pytest.raises(ValueError, match="3 addresses"):
        S.announced(df(*[f"{SITE}/{i}" for i in range(3)]), "u", SITE, 2)


@pytest.mark.parametrize("own, want", [("https://i.example/a.jpg", "https://i.example/a.jpg"), ("https://www.archive.example/OG-default.jpg", "player"), ("https://archive.example/other.jpg", "https://archive.example/other.jpg"), ("https://u@i.example/a.jpg", "player"), ("x", "player"), (None, "player")])
def test_pictures(spark, own, want):
    df = spark.createDataFrame([(own, "abcdefg")], "o string, p string")
    assert df.select(S.picture(F.col("o"), F.col("p"), "archive.example")).first()[0] == want.replace("player", "https://i.ytimg.com/vi/abcdefg/hqdefault.jpg")


def test_units_and_their_parts(spark):
    segs = [("s1", "Ann", None, "one", "一", None), ("s2", None, None, " ", "", None), ("s3", None, None, "three", None, None)]
    df = spark.createDataFrame([record(1, segments=segs, summary_en=""), record(2, segments=None, title_en=None)], RECORD)
    units = {(r.n, r.unit): (r.kind, r.text, r.speaker) for r in S.units_of(df, "n").collect()}
    assert units == {(1, "meta:title"): ("title", "T1", ""), (1, "segment:s1"): ("segment", "one", "Ann"), (1, "segment:s3"): ("segment", "three", ""), (2, "meta:summary"): ("summary", "About", "")}
    base = spark.createDataFrame([(1, "a", "old", "O"), (1, "b", "old", "O"), (1, "c", "old", "O"), (1, "d", "old", "O")], "n long, unit string, text_zh string, speaker_zh string")
    parts = [(1, "a", None, None, " new ", "N"), (1, "b::part:0002", "b", 1, "二", "X"), (1, "b::part:0001", "b", 0, " 一", ""), (1, "c::part:0001", "c", 0, "一", "Y"), (1, "c::part:0002", "c", 1, " ", ""), (1, "z", None, None, "?", "")]
    out = {r.unit: (r.text_zh, r.speaker_zh) for r in S.applied_parts(base, spark.createDataFrame(parts, "n long, id string, parent string, part int, text_zh string, speaker_zh string"), ["n"]).collect()}
    assert out == {"a": ("new", "N"), "b": ("一二", "X"), "c": ("old", "O"), "d": ("old", "O")}


def test_returned_units(spark):
    asked = [("b1", "u1", "costs 5", ""), ("b1", "u2", "two", "Ann"), ("b1", "u3", "x", ""), ("b1", "u4", "y", ""), ("b1", "u5", "z", "Bo"), ("b2", "u1", "one", ""), ("b3", "u1", "one", ""), ("b4", "u1", "one", "")]
    came = [("b1", "u1", "价6", ""), ("b1", "u2", "二", "安"), ("b1", "u3", " ", ""), ("b1", "u4", "a", ""), ("b1", "u4", "b", ""), ("b1", "u5", "c", None), ("b1", "u9", "?", ""), ("b2", "misnamed", " 一 ", ""), ("b3", "u1", "一", ""), ("b3", "u7", "一", "")]
    rows = S.returned(spark.createDataFrame(asked, "b string, id string, text string, speaker string"), spark.createDataFrame(came, "b string, id string, text_zh string, speaker_zh string"), "b").collect()
    assert {(r.b, r.id): r.fault for r in rows} == {("b1", "u1"): "numbers", ("b1", "u2"): None, ("b1", "u3"): "empty", ("b1", "u4"): "duplicate", ("b1", "u5"): "no speaker", ("b1", "u9"): "unexpected", ("b2", "u1"): None, ("b3", "u1"): None, ("b3", "u7"): "unexpected", ("b4", "u1"): "omitted"}
    assert {r.text_zh for r in rows if r.b == "b2"} == {"一"}


def test_captions_replace_a_text(spark):
    index = [("a", "speech", "d", "t", "https://www.youtube.com/watch?v=abcdefg"), ("b", "speech", "d", "t", "https://www.youtube.com/watch?x=1&v=hijklmn")]
    old = B.build(spark.createDataFrame(index, "id string, type string, day string, title string, source_url string"), spark.createDataFrame([], B.FETCHED), spark.createDataFrame([], B.FETCHED), spark.createDataFrame([], B.RECORD), "s1", "now").drop("outcome").withColumns({"status": F.lit("reviewed"), "model": F.lit("m")})
    said = spark.createDataFrame([("abcdefg", 2, 5.0, "second"), ("abcdefg", 1, 0.0, "first"), ("hijklmn", 1, 0.0, " "), ("unknown", 1, 0.0, "x")], "player string, place int, start double, text string")
    rows = {r.id or r.fault: r for r in S.with_captions(old, said).collect()}
    assert set(rows) == {"a", "no text for hijklmn", "no record for unknown"}
    a, before = rows["a"], old.where("id = 'a'").first()
    assert (a.kind, a.status, a.model, a.transcript_source, a.snapshot) == ("article", "pending", None, index[0][4], "s1") and [(s.sid, s.text_en) for s in a.segments] == [("s0001", "first"), ("s0002", "second")] and a.hash != before.hash


BOOK = """<html><head><style>.chapter-header h1 {x:1}</style></head><body onload='x()'><aside class="sidebar wide"><div class=sidebar-brand>B</div><nav ONCLICK=go>n</nav></aside><button id=menuToggle onclick="a('>')">m</button>
<main class="reader"><div class="book-front"><h1>The name：more of it</h1><p class="book-meta">2 &lt; 3</p></div><div class=chapter-header><h1 id=c1>One</h1></div><p>text<br>x<script>bad()</script></main><dialog id="searchDialog"><div class="search-head"></div></dialog></body></html>"""


def test_books():
    body, css, title, subtitle = book.prepared(BOOK)
    assert css == ".chapter-header h2 {x:1}" and (title, subtitle) == ("The name：", "more of it")
    for gone in ("onload", "onclick", "ONCLICK", "script", "style", "<h1 id"):
        assert gone not in body
    for there in ('<h2 id="c1">One</h2>', '<main class="reader" id="main-content" data-pagefind-body=""', '<nav aria-label="全书章节">', 'id="book-toc"', "<span>The name：</span>", f'<span class="{book.SUBTITLE}">more of it</span>', "2 &lt; 3", "text<br>x", 'aria-expanded="false"', '<h2 class="reader-sr-only" id="searchLabel">'):
        assert there in body, there
    assert body.startswith('<a class="reader-skip"') and body.index("reader-sidebar-top") < body.index("sidebar-brand") and body.index("book-meta") < body.index("reader-front-actions")
    assert book.prepared(None) == ("", "", "", "") and book.prepared("<p>x")[0] == "<p>x</p>" and len(book.prepared("<div>" * 5000 + "y")[0]) == 55_001


@pytest.mark.parametrize("selector, html, hits", [(".a", "<p class='b a'>", 1), ("p.a", "<div class=a>", 0), ("#i", "<b id=i>", 1), (".a b", "<p class=a><i><b>x", 1), (".a>b", "<p class=a><i><b>x", 0), (".a>b", "<p class=a><b>x", 1)])
def test_selectors(selector, html, hits):
    from scriptorium.functions.tree import parse

    assert sum(map(book.matcher(selector), parse(html).walk())) == hits
