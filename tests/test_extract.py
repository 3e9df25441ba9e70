from pyspark.sql import functions as F

from webloom.functions import html
from webloom.operators import extract, links

PAGE = """<!DOCTYPE html><html><head><title> A &amp;lt; &copy 2 &#233;&#x1F600;&nope;
 end</title>
<META Name="my-keywords" content='k1 "q" k2'><meta charset=utf-8><meta property="og:description" content="no">
<meta name="Description" content="case"><meta name="description" content="d"></head>
<body><h1>Head <span>child <b>bold</b></span><i>it</i></h1><!-- <a href="/no">no</a> -->
<script>"<a href='/s'>"</script><style>b{}</style>
<p>para<b>one</b> <b>two <p>three</p> 3 < 4 <a title="a>b" href="/q?x=1&amp;y=2">L <i>1</i></a>
<a href='/q?y=2&x=1'></a><a href=mailto:x@y.com>m</a><a href="http://e.com/?a=%zz">bad</a><a name=x>nohref</a>
<a href="javascript:void(0)">js</a><a href="../r">un<a href="//h.org/">h</a></p><br>x&nbsp; y</body></html>"""
SCHEMA = "page_id long, url string, html string"


def pages(spark):
    rows = [
        (1, "www.x.com/p", PAGE),
        (2, "ftp://x.com", "<a href='/x'>a</a>"),
        (3, "http://y.com/z", "no anchors"),
        (4, "http://y.com:bad/z", "<a href='/x'>a</a>"),
        (5, "http://z.com/d/p", '<base href="http://base.org/x/y"><a href="w">w</a><a href=http://www.base.org/x/w>v</a>'),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def records(spark):
    return {r.page_id: r for r in extract.site_records(pages(spark)).collect()}


def test_records(spark):
    found = records(spark)
    assert sorted(found) == [1, 3, 5]
    first = found[1]
    assert first.link == "http://x.com/p"
    assert first.title == "A &lt; © 2 é😀&nope; end"
    assert first.keywords == 'child bold bold it one two k1 "q" k2 d '
    assert first.metadata == (
        ' name="my-keywords" content="k1 &quot;q&quot; k2" charset="utf-8" property="og:description" content="no"'
        ' name="Description" content="case" name="description" content="d"'
    )
    assert first.text == (
        "A &lt; © 2 é😀&nope; end Head child boldit paraone two three 3 < 4 L 1 mbadnohref jsunh x y"
    )
    assert first.html == PAGE


def test_anchors(spark):
    found = records(spark)
    assert found[1].anchors == {"http://x.com/q?x=1&y=2": "L 1, empty", "http://x.com/r": "un", "http://h.org": "h"}
    assert found[3].anchors == {"http://y.com/z": "empty"}
    assert found[5].anchors == {"http://base.org/x/w": "w, v"}


def test_rejects(spark):
    counts = {r.reason: r.n for r in extract.extract_rejects(pages(spark)).collect()}
    assert counts == {
        "page_accepted": 3,
        "page_bad_protocol": 1,
        "page_malformed_url": 1,
        "anchor_accepted": 6,
        "anchor_malformed_url": 1,
        "anchor_bad_protocol": 2,
    }


def test_many_repeated_targets_keep_document_order(spark):
    body = "".join(f'<a href="/t{i % 7}">{i}</a>' for i in range(500))
    df = spark.createDataFrame([(1, "http://e.com/", body)], SCHEMA)
    found = {r.dst: r.anchor_text for r in extract.page_anchors(df).collect()}
    assert found == {
        f"http://e.com/t{k}": ", ".join(str(i) for i in range(500) if i % 7 == k) for k in range(7)
    }


def test_broken_markup_stays_linear(spark):
    body = "<b>" * 20_000 + "<a href=/x " * 20_000 + "<!--" * 1000 + '<meta content="' + "y" * 100_000
    df = spark.createDataFrame([(1, "http://e.com/", body)], SCHEMA)
    assert extract.site_records(df).count() == 1
    assert df.select(F.length(html.visible_text(html.clean_html(F.col("html"))))).first()[0] >= 0


def test_crawl_records_agree_with_parts(spark):
    whole = extract.crawl_records(pages(spark))
    assert sorted(whole.drop("anchors").collect()) == sorted(extract.sites(pages(spark)).collect())
    assert sorted(extract.anchors_long(whole).collect()) == sorted(extract.page_anchors(pages(spark)).collect())


def test_coinciding_targets_last_one_wins(spark):
    body = '<a href="http://t.org/a">one</a><a href="https://www.t.org/a">two</a><a href="http://t.org/b">b</a>'
    df = spark.createDataFrame([(1, "https://www.e.com/", body)], SCHEMA)
    cells = {(r.src, r.dst): r.anchor_text for r in links.links_from_pages(df).collect()}
    assert cells == {("e.com", "t.org/a"): "two", ("e.com", "t.org/b"): "b"}


def test_character_references(spark):
    cases = {
        "&#00000065;": "A",
        "&#x0000000041;b": "Ab",
        "&#65": "A",
        "&check;&rightarrow;": "✓→",
        "&NotEqualTilde;": "≂̸",
        "&amp;lt;": "&lt;",
        "&#99999999999999999999;": "&#99999999999999999999;",
        "&#x110000;&#xD800;&#0;": "&#x110000;&#xD800;&#0;",
        "&nosuchname;": "&nosuchname;",
        f"&{'a' * 60};": f"&{'a' * 60};",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for attribute in (False, True):
        got = {r.t: r.o for r in df.select("t", html.decode_entities(F.col("t"), attribute).alias("o")).collect()}
        want = {k: v for k, v in cases.items() if k != "&#65" or not attribute}
        assert {k: got[k] for k in want} == want


def test_reference_decoding_evaluates_its_text_once(spark):
    """The text of a page is two replacements of its markup; both ran again for every use inside the decoding."""
    df = spark.createDataFrame([("<p>a &amp; b</p>",)], "clean string").select(html.visible_text(F.col("clean")).alias("t"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 3
    assert df.first().t == "a & b"


def test_white_space_and_what_is_not_visible(spark):
    rows = [" a  b\tc\n\n d e  ", "x <!-- <p> -->y<SCRIPT a>z</script >w<?php 1>v<STYLE>u", "a < b <! c", "p<!--q"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r.o for r in df.select(html.collapse_space(html.clean_html(F.col("t"))).alias("o")).collect()]
    assert got == ["a b c d e", "x ywv", "a < b <! c", "p"]
