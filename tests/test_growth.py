"""Queries over the whole memory: what they move between tasks."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from glossaloom.functions import text as T
from glossaloom.operators import memory as M
from glossaloom.operators import precedence as PR
from glossaloom.plans.queries import ORACLES, QUERIES
from tests.test_oracles import rows_of


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def documents(folder, texts):
    values = ", ".join("(%d, $$%s$$, 'en', 's', 1)" % (k, x) for k, x in enumerate(texts))
    duckdb.sql(f"copy (select a::bigint as doc_id, b as text, c as lang, d as source, e::bigint as n_chars from (values {values}) t(a, b, c, d, e)) to '{folder}/documents.parquet' (format parquet)")
    return str(folder)


def equal(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    return rows_of(QUERIES[name](spark, folder).toPandas()) == rows_of(con.sql(ORACLES[name]).df())


def test_merged_dictionaries_meet_one_global_row_a_text(spark):
    # 2,000 pages and 2,000 global rows of one text would make 4,000,000 rows
    rows = spark.range(4000).selectExpr("if(id >= 0, 'same', 'x') as original_text", "concat('t', id) as translated_text", "id", "if(id % 2 = 0, 'global_x', concat('post_', id, '_x')) as context")
    merged = PR.merge_page_and_global(rows)
    assert {(r.post_id, r.translated_text) for r in merged.collect()} == {(k, f"t{k}") for k in range(1, 4000, 2)}
    assert re.search(r"keys?=\[original_text#\d+L?\]", plan_of(merged))  # rows of the global side are grouped by text alone


def test_texts_of_a_post_move_once(spark, sf):
    assert plan_of(QUERIES["unified_structure"](spark, sf)).count("Exchange ") == 1


def test_texts_with_quotes_are_counted(spark, tmp_path):
    folder = documents(tmp_path, ['say "a": "b"\nback \\ slash\\"\nplain', "x" * 51_000 + "\nshort one"])
    assert equal(spark, folder, "unified_structure")


def test_plural_maps_group_twice(spark, sf):
    assert plan_of(QUERIES["plural_maps"](spark, sf)).count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name, hashes", [("items_with_forms", 1), ("context_preference", 3)])
def test_strings_go_by_their_hashes(spark, sf, name, hashes):
    plan = plan_of(QUERIES[name](spark, sf))
    assert plan[plan.rindex("Exchange hashpartitioning"):].count("md5(") >= hashes


def test_prefixes(spark, tmp_path):
    folder = documents(tmp_path, ["a - b", "a", "a - b | c", "| a", "-", "a  : x", "é – ü", "é", "  a |"])
    assert equal(spark, folder, "prefix_match_all")


def test_prefixes_bring_hashes(spark):
    texts = spark.createDataFrame([("k1 | x",), ("k1 - y | z",), ("none",)], "text string")
    keys = spark.createDataFrame([("k1",), ("k1",), ("k1 - y",), ("",), (None,)], "key string")
    got = M.prefix_match(texts, keys)
    assert {tuple(r) for r in got.collect()} == {("k1 | x", "k1"), ("k1 - y | z", "k1 - y")}
    assert "prefix" in plan_of(got)  # pairs come from the stored table of hits, not from exploded prefixes


@pytest.mark.parametrize("normalize", [T.normalize_once, T.strip_for_matching, T.normalize_phase2, T.normalize_seo, T.normalize_dynamic])
def test_normalizers_pass_over_plain_texts_once(spark, normalize):
    # characters are translated at most once, and only in texts beyond ASCII; references are looked for once
    texts = spark.createDataFrame([("Ёлка\u00a0– «x»… &amp;lt;<BR/>  y",), ("plain",), (None,)], "text string")
    plan = plan_of(texts.select(normalize(F.col("text")).alias("x")))
    assert "Contains(" in plan
    assert all(f"translate({x}" not in plan for x in ("translate(", "replace(translate(translate"))
    assert "translate(" not in plan or "octet_length(" in plan


def test_lookup_joins_hashes(spark, sf):
    plan = plan_of(QUERIES["exact_then_normalized_lookup"](spark, sf))
    assert "md5(cast(trim(" in plan


def test_normalized_groups_move_lines_once(spark, sf):
    assert plan_of(QUERIES["normalized_groups"](spark, sf)).count("Exchange hashpartitioning") == 1


def test_plain_texts_are_made_once_a_line_and_stay_behind(spark, sf):
    plan = plan_of(QUERIES["plaintext_conflict_all"](spark, sf))
    assert plan.index("plain_hash") < plan.rindex("AS plain_hash") and "original_text" not in plan
    assert plan.rindex("Generate explode") < plan.rindex("AS plain_hash")  # the plan is read from its end: lines first, then languages


def test_catalog_keys_go_by_their_hashes(spark):
    from glossaloom.sources import catalogs as C

    catalog = spark.createDataFrame([("b", "X", None), ("a", "X", None), ("a", "X", None), ("c", "Y", 1), ("12 c", "", None), ("X", "Z", None)], "msgid string, msgstr string, form int")
    texts = spark.createDataFrame([("X",), ("7 X",), ("12 c",), ("Y",), ("none",), (None,), ("X",)], "text string")
    want = {"X": "a", "7 X": "a", "12 c": "12 c", "Y": "c"}
    assert {r.text: r.msgid for r in C.catalog_lookup(texts, catalog).collect()} == want
    found = C.catalog_found(texts, catalog, shown=F.md5)
    assert "text#" not in plan_of(found).split("Exchange")[1] and found.count() == 4


def test_values_of_structured_data_are_read_in_few_steps(monkeypatch):
    from glossaloom.operators import graphs as G

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.n = pattern, 0

        def match(self, *a):
            self.n += 1
            return self.pattern.match(*a)

    token = Counted(G._TOKEN)
    monkeypatch.setattr(G, "_TOKEN", token)
    monkeypatch.setattr(G.json, "loads", lambda x: (_ for _ in ()).throw(AssertionError(x)))
    nodes = ", ".join('{"name": "é %d", "position": %d, "url": "u", "about": [{"headline": "y"}]}' % (k, k) for k in range(50))
    page = '<script type="application/ld+json">{"@graph": [' + nodes + "]}</script>"
    assert len(list(G.graph_places(page))) >= 100 and token.n < 14 * 50  # 27 tokens a node
    assert G.json_strings('{"a": "x" "b": 1}', 0, 17) is None and G.json_strings('{"a": 1,}', 0, 9) is None
    assert G.json_strings('{"a": 01}', 0, 9) is None and G.json_strings('{"a" : "x", "b":{}}', 0, 19) == [("a", 7, 10)]
