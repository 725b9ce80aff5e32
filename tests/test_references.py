"""Character references without a semicolon, at the end of a text and within it: the queries over pages equal their SQL."""

from __future__ import annotations

import duckdb
import pytest

from glossaloom.operators import html as H
from glossaloom.operators import rewrite as W
from glossaloom.plans.queries import ORACLES, QUERIES
from tests.test_oracles import rows_of

HTML = '<html><head><title>a&amp;&amp</title></head><body><div class="ad">b &ampx c &copy d</div><article><h1>a&amp;&amp</h1><p>e &quot f &amp;amp g</p></article><footer>h &amp</footer></body></html>'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("references")
    duckdb.sql(f"copy (select 1::bigint as page_id, 'https://example.com/' as url, $${HTML}$$ as html) to '{path}/pages.parquet' (format parquet)")
    return str(path)


def equal(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{folder}/pages.parquet')")
    return rows_of(QUERIES[name](spark, folder).toPandas()) == rows_of(con.sql(ORACLES[name]).df())


def test_blocks(spark, folder):
    assert equal(spark, folder, "page_blocks")


def test_titles(spark, folder):
    assert equal(spark, folder, "page_titles")
    assert QUERIES["page_titles"](spark, folder).first().title == "a&&amp"


def test_selected(spark, folder):
    assert equal(spark, folder, "selected_elements")


def test_decoded():
    assert H.decoded("&lt;&lt &amp;lt; &#39;&#39 &#x41;") == "<&lt &lt; '&#39 A"
    assert [s[4] for s in W.page_slots(HTML) if s[0] == "title"] == ["a&&amp"]
