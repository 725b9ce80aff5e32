"""Structured data in pages, and addresses inside share links."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from glossaloom.functions import urls as U
from glossaloom.operators import graphs as G

LANGS = ("en", "fr", "de", "es")


def localized(spark, pages, memory):
    frame = spark.createDataFrame(pages, "page_id long, html string").withColumn("extra", F.lit(1))
    tm = spark.createDataFrame(memory, "id long, original_text string, translated_text string, context string")
    return {r.page_id: r for r in G.localize_graphs(frame, tm, "https://example.com/", "de", LANGS).collect()}


def page(graph):
    return f"<head><title>Hello</title><script type='application/ld+json'>{graph}</script></head><p>Hello</p>"


def test_texts_and_addresses_in_place(spark):
    graph = '{ "@id" : "https://example.com/a#x",\n "name":"Hello", "x":[{"caption":"Only \\u00e9","name":["Hello"]}], "sku":"Hello", "url":"https://example.com/fr?q", "urlTemplate":"https://example.com", "description":"No"}'
    memory = [(1, "Hello", "Hallo </script>", "global_x"), (2, "Hello", "Seite", "post_1_content_blocks"), (3, "Only é", 'Nur "é"', "post_9_x"), (4, "No", "", "global_x")]
    got = localized(spark, [(1, page(graph)), (2, page(graph)), (3, None), (4, ""), (5, page('{"name":"Hello",}')), (6, "<script>{\"name\":\"Hello\"}</script>")], memory)
    want = graph.replace('"name":"Hello"', '"name":"Seite"').replace('"Only \\u00e9"', '"Nur \\"é\\""').replace("example.com/a", "example.com/de/a").replace('"https://example.com"', '"https://example.com/de"')
    assert got[1].html == page(want) and (got[1].n_strings, got[1].n_translated) == (3, 4)
    assert '"name":"Hallo <\\/script>"' in got[2].html
    assert got[3].html is None and got[4].html == "" and got[5].html == page('{"name":"Hello",}') and "Hello" in got[6].html


def test_any_depth_and_no_tables(spark):
    deep = "[" * 20_000 + '{"name":"Hello"}' + "]" * 20_000
    got = localized(spark, [(1, page(deep)), (2, page("{}"))], [(1, "Hello", "Hallo", "")])
    assert got[1].html == page(deep.replace("Hello", "Hallo")) and got[2].n_translated == 0
    assert localized(spark, [], []) == {}


@pytest.mark.parametrize("seed", range(4))
def test_scanner_accepts_what_json_does(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choice(["{", "}", "[", "]", ",", ":", '"a"', '"name"', "1", "-0.5e3", "true", " ", "01", '"\\n"', '"\\x"']) for _ in range(rng.randint(1, 9)))
        try:
            json.loads(text)
            fine = True
        except ValueError:
            fine = False
        assert (G.json_strings(text, 0, len(text)) is not None) == fine, text


def test_share_links(spark):
    cases = [
        ('href="https://s.org/?u=https://h.org/a/b&x=1"', 'href="https://s.org/?u=https://h.org/de/a/b&x=1"'),
        ("href='https://s.org/?a=1&amp;url=https%3A%2F%2Fh.org%2Fa%3Fq'", "href='https://s.org/?a=1&amp;url=https%3A%2F%2Fh.org%2Fde%2Fa%3Fq'"),
        ('href="https://s.org/?text=https:%2F%2Fh.org%2Fa"', 'href="https://s.org/?text=https:%2F%2Fh.org%2Fde%2Fa"'),
        ('href="https://s.org/?u=https://h.org/fr/a"', None),
        ('href="https://s.org/?u=https%3A%2F%2Fh.org%2Ffr"', None),
        ('href="https://s.org/?u=https://h.org/a.png&x=1"', None),
        ('href="https://s.org/?u=https%3A%2F%2Fh.org%2Fa.PDF"', None),
        ('href="https://s.org/?u=https://h.org.evil/a"', None),
        ('href="https://s.org/?menu=https://h.org/a"', None),
        ("", None),
        (None, None),
    ]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, h string")
    got = {r.k: r.o for r in rows.select("k", U.rewrite_shared_links(F.col("h"), F.lit("de"), LANGS, "h.org").alias("o")).collect()}
    assert [got[k] for k in range(len(cases))] == [b if b is not None else a for a, b in cases]
