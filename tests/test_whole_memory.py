"""The queries that take all lines, on lines that their narrower namesakes leave out."""

from __future__ import annotations

import duckdb
import pytest

from glossaloom.operators import memory as M
from glossaloom.plans.queries import ORACLES, QUERIES
from tests.test_oracles import rows_of

LINES = [
    "ok",
    "ok then: go",
    "go",
    "a long line " * 60 + "ok then",
    "a long line " * 60 + "ok then: go",
    "Shop – Sale",
    "Shop",
    "Shop | Sale – now",
    "Shop | Sale",
    "Tom &amp; Ann — “best” of…",
    "tom & ann - \"best\" of...",
    "<b>Tom</b> &amp; Ann – «best» of…",
    "Ёлка ‘x’<br>y",
    "елка 'x' y",
]


@pytest.fixture(scope="module")
def fixture_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lines")
    values = ", ".join("(%d, $$%s$$, 'en', 's', 1)" % (k, x) for k, x in enumerate(LINES))
    duckdb.sql(f"copy (select a::bigint as doc_id, b as text, c as lang, d as source, e::bigint as n_chars from (values {values}) t(a, b, c, d, e)) to '{folder}/documents.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["contained_keys_all", "prefix_match_all", "plaintext_conflict_all"])
def test_fixture_equals_sql(spark, fixture_dir, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{fixture_dir}/documents.parquet')")
    assert rows_of(QUERIES[name](spark, fixture_dir).toPandas()) == rows_of(con.sql(ORACLES[name]).df())


def test_contained_keys_of_any_length(spark, fixture_dir):
    got = {(r.text, r.key) for r in QUERIES["contained_keys_all"](spark, fixture_dir).collect()}
    lines = {x.strip() for x in LINES}
    assert got == {(t, k) for t in lines for k in lines if t != k and k in t}
    assert (LINES[4], LINES[3]) in got and ("ok then: go", "ok") in got


def test_short_keys(spark):
    texts, keys = spark.createDataFrame([("ab cd",), ("ab",), ("zé",)], "text string"), spark.createDataFrame([("ab",), ("é",), ("",), (None,), ("b c",), ("ab cd",)], "key string")
    assert {tuple(r) for r in M.contained_keys(texts, keys).collect()} == {("ab cd", "ab"), ("zé", "é"), ("ab cd", "b c")}


def test_prefixes_up_to_any_separator(spark, fixture_dir):
    got = {r.text: r.key for r in QUERIES["prefix_match_all"](spark, fixture_dir).collect()}
    assert got == {"Shop – Sale": "Shop", "Shop | Sale": "Shop", "Shop | Sale – now": "Shop | Sale", LINES[4]: LINES[3]}


def test_plain_text_with_entities_quotes_and_dashes(spark, fixture_dir):
    rows = QUERIES["plaintext_conflict_all"](spark, fixture_dir).where("language_code = 'de'").collect()
    ids = {r.id // 4_000_000 for r in rows}
    assert len(ids & {9, 10, 11}) == 1 and 11 in ids  # one plain text: markup first, then the longest original
    assert len(ids & {12, 13}) == 1
