from __future__ import annotations

import json

from pyspark.sql import functions as F

from glossaloom.functions import masking as MK
from glossaloom.operators import precedence as PR
from tests.test_operators import memory


def test_seo_text(spark):
    tm = memory(spark, [(1, "Old title", "Alt", "de", "post_1_seo_title", "custom", None, None, 1, 1), (2, "New  title", "Neu", "de", "post_2_seo_title", "custom", None, None, 1, 1), (3, "Other", "Andere", "de", "x", "custom", None, None, 1, 1)])
    pages = spark.createDataFrame([(1, "seo_title", "Changed"), (2, "seo_title", "new title"), (9, "seo_title", "OTHER"), (8, "seo_title", None)], "page_id long, kind string, original string")
    got = {r.page_id: (r.translated_text, r.found_by) for r in PR.seo_text(pages, tm).collect()}
    assert got == {1: ("Changed", "none"), 2: ("Neu", "page"), 9: ("Andere", "global"), 8: (None, "none")}


def test_string_translation(spark):
    tm = memory(spark, [(1, "Word", "similar", "de", "x", "custom", None, None, 3, 9), (2, "Word", "reviewed", "de", "x", "custom", None, None, 2, 1), (3, "Only", "similar", "de", "x", "custom", None, None, 3, 1), (4, "Bad", "btn_x", "de", "x", "custom", None, None, 2, 1)])
    page = spark.createDataFrame([("Page", "Seite"), ("Word", "no")], "original_text string, translated_text string")
    texts = spark.createDataFrame([("Word ",), ("Only",), ("Bad",), ("Page",), ("None",), ("some_id",)], "text string")
    got = {r.text: (r.translated_text, r.prio) for r in PR.string_translation(texts, tm, page).collect()}
    assert got == {"Word ": ("reviewed", 0), "Only": ("similar", 1), "Bad": (None, None), "Page": ("Seite", 2), "None": (None, None)}


def test_attach_forms_and_merge(spark):
    items = spark.createDataFrame([(1, "page_strings", "c", "%d cat", 1, "de"), (2, "page_strings", "c", "%d cat", None, "de"), (3, "media", "media.src[x].alt", "A", None, "de")], "item_id long, field_group string, context string, original string, plural_form int, language_code string")
    tm = memory(spark, [(1, "%d cat", "%d Katzen", "de", "x", "gettext", None, 1, 2, 1), (2, "B", "Bild", "de", "media.src[x].alt", "custom", None, None, 2, 1)])
    got = {r.item_id: (r.translated_text, r.state) for r in PR.attach(items, tm).collect()}
    assert got == {1: ("%d Katzen", "translated"), 2: (None, "pending"), 3: ("Bild", "translated")}
    forms = spark.createDataFrame([("%d cat", "de", {0: "a", 1: "b"})], "original_text string, language_code string, forms map<int,string>")
    assert sorted((r.item_id, r.n_forms) for r in PR.attach_forms(items, forms).collect()) == [(1, 2), (2, 2), (3, 0)]
    both = memory(spark, [(1, "a", "own", "de", "post_1_x", "custom", None, None, 1, 1), (2, "a", "shared", "de", "global_x", "custom", None, None, 1, 1), (3, "b", None, "de", "post_1_x", "custom", None, None, 0, 1)])
    assert {tuple(r) for r in PR.merge_page_and_global(both).collect()} == {(1, "a", "own"), (1, "b", None)}


def test_graph(spark):
    graph = json.dumps({"@id": "https://x.org/a", "name": "Hello", "url": "/fr/b", "sub": [{"headline": "Hello", "sku": "Hello"}]})
    df = spark.createDataFrame([(graph,), ("not json",), (None,)], "v string")
    rows = [r[0] for r in df.select(PR.graph_rewriter({"Hello": "Salut"}, "/fr/")("v")).collect()]
    assert json.loads(rows[0]) == {"@id": "https://x.org/fr/a", "name": "Salut", "url": "/fr/b", "sub": [{"headline": "Salut", "sku": "Hello"}]}
    assert rows[1:] == ["not json", None]


def test_small_tables(spark):
    codes = spark.createDataFrame([("de",), ("xx",)], "code string")
    registry = spark.createDataFrame([("de",), ("en",), ("fr",)], "code string")
    assert sorted(r[0] for r in PR.valid_languages(codes, registry, "en").collect()) == ["de", "en"]
    legacy = spark.createDataFrame([(2, "de"), (1, "de"), (1, "de"), (3, "fr")], "post_id long, language_code string")
    posts = spark.createDataFrame([(1, "a"), (2, "b")], "post_id long, title string")
    assert [r.post_id for r in PR.posts_with_translations(legacy, posts, "de").collect()] == [1, 2]
    tm = memory(spark, [(1, "a", "b", "de", "x", "gettext", None, None, 1, 1), (2, "a", "b", "de", "x", "custom", None, None, 1, 1)])
    assert sorted(r.id for r in PR.rescanned(tm, tm.where("id = 1").withColumn("id", F.lit(7).cast("long"))).collect()) == [2, 7]
    assert spark.range(1).select(PR.equals_ignoring(F.lit(" A "), F.lit("a"))).first()[0]
    assert PR.kinds_left(spark.createDataFrame([("post",), ("menu",)], "kind string"), ("menu",)).count() == 1


def test_masking(spark):
    html = '<a href="/word">word</a><script>word</script><i data-x=\'{"k":"word"}\'>Word</i>'
    df = spark.createDataFrame([(html,)], "v string")
    for pattern in (MK.PROTECTED_URLS, MK.PROTECTED_CODE):
        m = df.select(MK.mask(F.col("v"), pattern).alias("m"))
        assert m.select(MK.unmask(F.col("m.text"), F.col("m.parts"))).first()[0] == html and len(m.first().m.parts) >= 1
    assert df.select(MK.replace_ci(F.col("v"), "WORD", "$x\\")).first()[0] == html.replace(">word</a>", ">$x\\</a>").replace(">Word<", ">$x\\<").replace("<script>word<", "<script>$x\\<")
    assert spark.createDataFrame([("a word here",)], "v string").select(MK.replace_ci(F.col("v"), "word", "x"), MK.replace_ci(F.col("v"), "WORD", "x", False)).first() == ("a word here", "a x here")
    out = df.select(MK.replace_longest_first({"word": "mot", "Word": "Mot", "wor": "no"})("v")).first()[0]
    assert out == '<a href="/word">mot</a><script>word</script><i data-x=\'{"k":"word"}\'>Mot</i>'
