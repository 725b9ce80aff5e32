"""What is JSON: a value that is all of a text, not one in front of other words."""

from __future__ import annotations

from functools import reduce

import duckdb
import pytest
from pyspark.sql import functions as F

from glossaloom.functions import predicates as P
from glossaloom.functions.predicates import is_json
from glossaloom.plans.queries import ORACLES, QUERIES
from tests.test_oracles import rows_of

LINES = ["4703443633947811 Achverber auf", "12", "1, 2", "1], [2", '1, "b": 2', "1}, {", '{"a": 1}', '{"a": 1} x', "[1, 2]", '"a"', '"a" b', "true", "true story", "  7  ", "plain text"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("json")
    values = ", ".join("(%d, $$%s$$, 'en', 's', 1)" % (k, x) for k, x in enumerate(LINES))
    duckdb.sql(f"copy (select a::bigint as doc_id, b as text, c as lang, d as source, e::bigint as n_chars from (values {values}) t(a, b, c, d, e)) to '{path}/documents.parquet' (format parquet)")
    return str(path)


def equal(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    return rows_of(QUERIES[name](spark, folder).toPandas()) == rows_of(con.sql(ORACLES[name]).df())


def test_whole_values_only(spark):
    rows = spark.createDataFrame([(x,) for x in [*LINES, "", " "]], "t string").select("t", is_json(F.col("t")).alias("j")).collect()
    assert {r.t for r in rows if r.j} == {"12", '{"a": 1}', "[1, 2]", '"a"', "true", "  7  "}


def test_technical_lines(spark, folder):
    assert equal(spark, folder, "technical_lines")


def test_rules_in_one_pass_are_those_of_each_pattern(spark):
    """Patterns tried together, and JSON tried only where it may begin, find what they find one by one."""
    texts = ["Posted by ", "x Posted by", "GDPR", "a GDPR", "12:30 pm", "5 min read", "By me", "Author: x", "wp-x", "a wp-x", "x woocommerce_loop", "RSD", "rsd", "#abc", "| |", "", "---", "ab1@c.de", "12px", "/a/g", "©  2020", "ABCDE", "two\nPosted by", "Posted by\n", None]
    texts += ["{}", " [1]", "\ufeff{}", "true", "false x", "null", "nul", "-1", "1e5", '"a"', "'a'", "NaN", "Infinity", "text", "\t 7", "{} x", "+1", ".5", "# 1", "/* */ 1"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    c = F.col("text")
    lists = (P.SKIP_PATTERNS, P.CAPTURE_SKIP_PATTERNS, P.FILTER_PATTERNS, P.METADATA, P.ITEM_PATTERNS, P.HIDDEN_STYLES)
    one_by_one = [reduce(lambda a, b: a | b, [c.rlike(p) for p in ps]) for ps in lists]
    fits = lambda head, tail: F.try_parse_json(F.concat(F.lit(head), c, F.lit(tail))).isNotNull()
    for r in rows.select("text", F.array(*[P.matches_any(c, ps) for ps in lists]).alias("got"), F.array(*one_by_one).alias("want"), P.is_json(c).alias("json"), (F.try_parse_json(c).isNotNull() & fits("[", "]") & fits('{"v":', "}")).alias("parsed")).collect():
        assert (r.got, r.json) == (r.want, r.parsed), r.text


def test_a_list_of_patterns_is_read_at_most_twice(spark):
    plan = spark.range(1).select(P.matches_any(F.col("id").cast("string"), P.ITEM_PATTERNS).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") <= 2
