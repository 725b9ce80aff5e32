from __future__ import annotations

from pyspark.sql import functions as F

from glossaloom.operators import dom as D
from glossaloom.operators import selectors as S

PAGE = """<html><head><title>T one</title></head><body><header><p>Top words</p></header><main><h1>Main Head Line</h1>
<div class="cookie-bar"><p>We use cookies</p></div><div style="display:none"><p>Hidden words</p></div><p title="A longer tip">Some real words, with more of them.</p>
<span class="price">12 coins</span><a class="add_to_cart_button">Add it</a></main><div role="complementary"><a>Go there</a></div><div aria-hidden="true">no</div></body></html>"""


def test_text_nodes(spark):
    rows = D.text_nodes(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")).collect()
    got = {r.text: r for r in rows}
    assert got["Top words"].in_global and got["Top words"].context == "paragraph"
    assert got["Main Head Line"].context == "heading" and not got["Main Head Line"].excluded
    assert got["We use cookies"].excluded and got["Go there"].excluded and got["no"].excluded and got["T one"].excluded
    assert got["Hidden words"].style == "display:none" and got["A longer tip"].context == "attribute_title"
    stats = D.dom_stats(spark.createDataFrame(rows)).first()
    assert stats.n_nodes == len(rows) and stats.n_attributes == 1 and stats.n_global == 1


def test_capturable(spark):
    nodes = D.text_nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    kept = {r.text for r in D.capturable(nodes).collect()}
    assert {"Main Head Line", "Some real words, with more of them.", "A longer tip"} <= kept and not kept & {"Top words", "We use cookies", "Hidden words", "no"}


def test_shop_and_seo(spark):
    got = {(r.kind, r.text) for r in S.shop_items(spark.createDataFrame([(1, PAGE), (2, "")], "page_id long, html string")).collect()}
    assert got == {("cart_button", "Add it")}
    posts = spark.createDataFrame([(1, "", "%%title%% | %%sitename%%", None, None, "<b>" + " ".join(f"w{k}" for k in range(30)) + "</b>", "P"), (2, "Own", "x", "Desc", "Ex", "c", "Q"), (3, None, None, "", "Ex", "c", "R")], "id int, a string, b string, d string, excerpt string, content string, title string")
    rows = {r.id: (r.seo_title, r.meta_description) for r in D.seo_fields(posts, ["a", "b"], ["d"], {"title": F.col("title"), "sitename": F.lit("Site")}, "%%title%%").collect()}
    assert rows == {1: ("P | Site", " ".join(f"w{k}" for k in range(20))), 2: ("Own", "Desc"), 3: ("R", "Ex")}


def test_excluding_elements(spark):
    """One page per way to exclude; the role of an element excludes what is below it only."""
    cases = {
        "<p class='et_pb_text'>x</p>": True, "<p class='my-thread-x'>x</p>": True, "<p class='wp-caption'>x</p>": True, "<p class='no-js'>x</p>": True, "<p class='plain'>x</p>": False,
        "<p id='wpadminbar'>x</p>": True, "<p id='main'>x</p>": False, "<p data-skip-translation>x</p>": True, "<p translate='no'>x</p>": True, "<p aria-hidden='true'>x</p>": True,
        "<div role='none'><p>x</p></div>": True, "<p role='none'>x</p>": False, "<div role='navigation'><p>x</p></div>": False, "<code>x</code>": False,
        "<div class='hidden'>" + "<div>" * 6 + "<p>x</p>": True, "<div class='hidden'>" + "<div>" * 8 + "<p>x</p>": False,
    }
    rows = D.text_nodes(spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")).collect()
    assert {r.page_id: r.excluded for r in rows} == dict(enumerate(cases.values()))


def test_global_containers(spark):
    cases = {"<nav><p>x</p></nav>": True, "<aside><p>x</p></aside>": False, "<div id='page-header-top'><p>x</p></div>": True, "<div class='menu x'><p>x</p></div>": True, "<div class='menus'><p>x</p></div>": False, "<div id='sidebar'>x</div>": True}
    rows = D.text_nodes(spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")).collect()
    assert {r.page_id: r.in_global for r in rows} == dict(enumerate(cases.values()))
