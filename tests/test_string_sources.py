"""A line that begins with a number is a text like others: it has a translation."""

from __future__ import annotations

import duckdb

from glossaloom.plans.queries import ORACLES, QUERIES
from tests.test_oracles import rows_of


def test_lines_with_a_leading_number(spark, tmp_path):
    lines = ["4703443633947811 Achverber auf der", "12 34", "plain text"]
    values = ", ".join("(%d, $$%s$$, 'en', 's', 1)" % (k, x) for k, x in enumerate(lines))
    duckdb.sql(f"copy (select a::bigint as doc_id, b as text, c as lang, d as source, e::bigint as n_chars from (values {values}) t(a, b, c, d, e)) to '{tmp_path}/documents.parquet' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    assert rows_of(QUERIES["string_source_precedence"](spark, str(tmp_path)).toPandas()) == rows_of(con.sql(ORACLES["string_source_precedence"]).df())
