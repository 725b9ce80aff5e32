from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from glossaloom.config import EngineConfig, language_table
from glossaloom.operators import html as H
from glossaloom.operators import memory as M
from glossaloom.operators import rewrite as RW
from glossaloom.operators import search as SE
from glossaloom.operators import stats as ST
from glossaloom.sources import catalogs as C
from glossaloom.sources import pages as SP
from glossaloom.streaming import lookups as SL

TM = "id long, original_text string, original_text_hash string, translated_text string, language_code string, context string, source string, gettext_domain string, plural_form int, original_plural string, status int, updated_at timestamp"


def memory(spark, rows):
    """rows: (id, original, translated, language, context, source, domain, form, status, day)."""
    import hashlib

    return spark.createDataFrame([(i, o, hashlib.md5(o.encode()).hexdigest(), t, lang, ctx, src, dom, form, None, st, dt.datetime(2024, 1, day)) for i, o, t, lang, ctx, src, dom, form, st, day in rows], TM)


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def test_filters(spark):
    tm = memory(spark, [(1, "a", "b", "de", "general", "custom", None, None, 1, 1), (2, "a", "a", "de", "general", "custom", None, None, 2, 1), (3, "a", None, "de", "general", "custom", None, None, 0, 1), (4, "a", "c", "de", "post_1_seo_title", "custom", None, None, 3, 1), (5, "a", "d", "de", "media.src[x].alt", "gettext", "d", 1, 2, 1)])
    assert ids(tm.where(M.usable())) == [1]
    assert ids(tm.where(M.usable(contexts=False))) == [1, 4, 5]
    assert ids(tm.where(M.reviewed())) == [1, 2, 5]
    assert ids(tm.where(M.first_form())) == [1, 2, 3, 4]
    assert ids(tm.where(M.admin_filter(source="gettext", domain="d", language="de"))) == [5]
    assert ids(tm.where(M.of_post(1))) == [4]


def test_post_ids_are_whole(spark):
    tm = memory(spark, [(k, "a", "b", "de", c, "custom", None, None, 1, 1) for k, c in enumerate(["post_1_x", "post_10_x", "core_fields.title.post_1", "core_fields.title.post_11"])])
    assert ids(tm.where(M.of_post(1))) == [0, 2]
    assert ids(M.delete_pages(tm, spark.createDataFrame([(1,)], "post_id long"))) == [1, 3]


def test_preferences(spark):
    tm = memory(spark, [(1, "a", "old", "de", "x", "custom", None, None, 2, 1), (2, "a", "new", "de", "general", "custom", None, None, 1, 2), (3, "a", "tie", "de", "group.1", "custom", None, None, 1, 2), (4, "b", None, "de", "x", "custom", None, None, 0, 1)])
    assert ids(M.latest(tm)) == [2, 4]
    assert ids(M.most_trusted(tm)) == [1, 4]
    got = {r.original_text: r.translated_text for r in M.preferred_context(tm).collect()}
    assert got == {"a": "new", "b": "b"}
    assert ids(M.drop_duplicate_rows(tm.unionByName(tm))) == [1, 2, 3, 4]


def test_lookup_phases(spark):
    tm = memory(spark, [(1, "Hello – world", "exact", "de", "x", "custom", None, None, 1, 1), (2, "“Quote”", "q", "de", "x", "custom", None, None, 1, 1)])
    texts = spark.createDataFrame([("Hello – world",), ("Hello   - world",), ('"Quote"',), ("none",), (None,)], "text string")
    got = {r.text: (r.translated_text, r.phase) for r in M.lookup(texts, tm).collect()}
    assert got == {"Hello – world": ("exact", 1), "Hello   - world": ("exact", 2), '"Quote"': ("q", 2), "none": (None, 0), None: (None, 0)}


def test_translate_column(spark):
    tm = memory(spark, [(1, "a", "A!", "de", "x", "custom", None, None, 1, 1)])
    df = spark.createDataFrame([("a",), ("b",)], "title string")
    assert sorted(r[0] for r in M.translate_column(df, "title", tm, "de").collect()) == ["A!", "b"]
    assert sorted(r[0] for r in M.translate_column(df, "title", tm, "de", fallback="empty").collect()) == ["", "A!"]
    assert M.translate_column(df, "title", tm, "en") is df


def test_upsert_is_idempotent_and_null_safe(spark):
    tm = memory(spark, [(1, "a", "b", "de", "x", "gettext", "dom", None, 1, 1), (2, "a", "p0", "de", "x", "gettext", "dom", 0, 1, 1)])
    new = memory(spark, [(8, "a", "B", "de", "x", "custom", None, None, 2, 2), (9, "z", "Z", "de", "x", "custom", None, None, 2, 2)])
    once = M.upsert(tm, new)
    got = {r.id: (r.translated_text, r.gettext_domain, r.plural_form) for r in once.collect()}
    assert got == {1: ("B", "dom", None), 2: ("p0", "dom", 0), 9: ("Z", None, None)}
    assert {tuple(r) for r in M.upsert(once, new).collect()} == {tuple(r) for r in once.collect()}


def test_changes(spark):
    tm = memory(spark, [(1, "a", "b", "de", "post_1_seo", "custom", None, None, 1, 1), (2, "c", "d", "de", "x", "custom", None, None, 1, 1), (3, "c", "d", "fr", "x", "custom", None, None, 1, 1)])
    edits = spark.createDataFrame([("zzz", "post_1_seo", "seo", "de", ""), ("c", "other", "content", "de", None), ("c", "x", "content", "fr", "keep")], "original_text string, context string, kind string, language_code string, translated_text string")
    assert ids(M.delete_on_empty(tm, edits)) == [3]
    got = {r.id: (r.translated_text, r.status) for r in M.update_by_id(tm, spark.createDataFrame([(1, ""), (2, "new")], "id long, translated_text string")).collect()}
    assert got == {1: ("", 0), 2: ("new", 2), 3: ("d", 1)}


def test_forms(spark):
    items = spark.createDataFrame([("a", "t", {}), ("b", None, {0: "x", 1: "y"})], "original_text string, translated_text string, forms map<int,string>")
    got = sorted((r.original_text, r.plural_form, r.translated_text) for r in M.expand_forms(items).collect() if r.plural_form is not None)
    assert got == [("b", 0, "x"), ("b", 1, "y")] and M.expand_forms(items).count() == 3
    forms = {"en": 2, "ar": 6}
    tm = memory(spark, [(1, "known", "b", "de", "x", "custom", None, None, 1, 1)])
    texts = spark.createDataFrame([("known", True), ("new", True), ("one", False), ("new", True)], "text string, is_plural boolean")
    assert M.register_missing(texts, tm, forms).count() == 8 + 2


def test_priority_dedupe(spark):
    rows = [(1, "page_strings", 0, "x", "T"), (1, "content_blocks", 5, "x", "T "), (1, "seo_fields", 1, "meta", "S"), (1, "seo_fields", 2, "title", "S"), (1, "media", 3, "m", "T"), (1, "media", 4, "m", "T"), (2, "attributes", 9, "x", "T"), (2, "attributes", 8, "x", "T")]
    got = M.priority_dedupe(spark.createDataFrame(rows, "page_id long, field_group string, idx int, type string, original string"))
    assert sorted((r.page_id, r.idx) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 8)]


def test_theta_joins(spark):
    texts = spark.createDataFrame([("say hello world now",), ("hello world",), ("short",)], "text string")
    keys = spark.createDataFrame([("hello world",), ("hello wo",), ("absent!!",), ("tiny",)], "key string")
    got = {tuple(r) for r in M.contained_keys(texts, keys).collect()}
    assert got == {("say hello world now", "hello world"), ("say hello world now", "hello wo"), ("hello world", "hello wo")}
    got = M.prefix_match(spark.createDataFrame([("A | B | C",), ("x",)], "text string"), spark.createDataFrame([("A",), ("A | B",)], "key string"))
    assert [tuple(r) for r in got.select("text", "key").collect()] == [("A | B | C", "A | B")]


def test_sets(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate([" a ", "b", "a", "", "A"])], "page_id long, pos int, text string")
    assert sorted((r.text, r.pos) for r in M.distinct_strings(rows).collect()) == [("A", 4), ("a", 0), ("b", 1)]
    left, right = spark.createDataFrame([("k", 1), ("l", 2)], "k string, v int"), spark.createDataFrame([("k", 9)], "k string, v int")
    assert sorted(tuple(r) for r in M.merge_maps(left, right, ["k"]).collect()) == [("k", 9), ("l", 2)]
    assert sorted(tuple(r) for r in M.merge_maps(left, right, ["k"], right_wins=False).collect()) == [("k", 1), ("l", 2)]
    many = spark.createDataFrame([(p, 0, "Menu" if p % 2 else "menu ") for p in range(9)] + [(50, 0, "once")], "page_id long, pos int, text string")
    assert sorted(r.page_id for r in M.repetitive(many).collect()) == [5, 6, 7, 8]


def test_reconcile(spark):
    got = M.reconcile(spark.createDataFrame([("en", 1), ("en", 2), ("xx", 3)], "code string, item_id long"), spark.createDataFrame([("en",), ("fr",)], "code string"))
    assert {tuple(r) for r in got.collect()} == {("en", 1, "update"), ("en", 2, "delete"), ("xx", 3, "delete"), ("fr", None, "insert")}


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue"), (3, "red")], "doc_id long, text string")
    tm = memory(spark, [(1, "x", "red fox", "fr", "post_2_x", "custom", None, None, 1, 1), (2, "x", "red fox", "fr", "post_99_x", "custom", None, None, 1, 1)])
    assert sorted(r[0] for r in SE.search(tm, docs, "red fox", "fr").collect()) == [1, 2]
    assert sorted(r[0] for r in SE.search(tm, docs, "RED", "fr", ci=True).collect()) == [1, 2, 3]
    assert SE.search(tm, docs, "a", "fr").count() == 0
    assert SE.parse_terms('"two words" x yy') == ["two words", "yy"]


def test_stats(spark):
    tm = memory(spark, [(1, "a", "x", "de", "post_1_g", "gettext", "d", 0, 1, 1), (2, "a", "y", "de", "post_1_g", "gettext", "d", 1, 1, 1), (3, "b", None, "de", "post_1_g", "custom", None, None, 0, 1)])
    row = ST.plural_maps(tm).first()
    assert row.forms == {0: "x", 1: "y"} and row.last_form == "y"
    assert {tuple(r) for r in ST.domains(tm).collect()} == {("d", 1, 2)}
    got = ST.unified_structure(tm).first()
    assert got.post_id == 1 and set(got.groups) == {"g"}
    assert ST.coverage_sets(tm).count() == 1 + 2 + 1


def test_empty_tables(spark):
    tm = spark.createDataFrame([], TM)
    texts = spark.createDataFrame([], "text string")
    assert M.lookup(texts, tm).count() == 0 and M.latest(tm).count() == 0 and M.upsert(tm, tm).count() == 0
    pages = spark.createDataFrame([], "page_id long, html string")
    assert H.items_of(pages).count() == 0 and H.strings_of(pages).count() == 0 and RW.localize(pages, tm).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>The title</title><meta name="description" content="About us"><meta name="description" content="second"></head>
<body><nav class="breadcrumb"><a href="/">Home page</a></nav><div>Bare words<p>First <b>bold</b> text<p>Second one</div>
<div class="notranslate"><p>Keep me</p></div><span>Loose inline</span><img src="/a.png" alt="A picture"><input type="submit" value="Send it"><button title="Tip here">Press</button>
<script>var x = "<p>no</p>";</script><ul><li>Item one<li>Item two</ul><p>First <b>bold</b> text</p></body></html>"""


def test_items(spark):
    rows = H.items_of(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")).collect()
    got = {(r.type, r.original) for r in rows}
    assert {("content_block", "First <b>bold</b> text"), ("content_block", "Second one"), ("content_block", "Item one"), ("content_block", "Item two"), ("breadcrumb", "Home page"), ("inline_text", "Loose inline"), ("bare_text", "Bare words"), ("title", "The title"), ("meta", "About us"), ("media", "A picture"), ("form", "Press"), ("form", "Send it"), ("attribute", "Tip here")} <= got
    assert not any("Keep me" in o or "no" == o for _, o in got) and ("meta", "second") not in got
    assert sum(r.original == "First <b>bold</b> text" for r in rows) == 1
    assert {r.field_group for r in rows if r.type in ("title", "meta")} == {"seo_fields"}


def test_selectors_of_items():
    """A page per selector: what each makes of its text."""
    found = lambda h: [(t, o) for _, _, t, _, _, o in H.page_items(h)]
    for block in H.BLOCKS:
        assert ("content_block", "xy") in found(f"<{block}>xy</{block}>"), block
    for tag in H.TEXT_ELEMENTS:
        assert tag == "code" and not found("<code>xy</code>") or ("inline_text", "xy") in found(f"<section><{tag}>xy</{tag}></section>"), tag
    for none in ("<p id='wpadminbar'>xy</p>", "<code>xy</code>", "<pre>xy</pre>", "<p data-no-translation>xy</p>", "<p translate='no'>xy</p>", *(f"<p class='a {c}'>xy</p>" for c in H.NO_TRANSLATE_CLASSES), "<head><p>xy</p></head>"):
        assert not [o for t, o in found(none) if o == "xy"], none
    for a, tags in H.ATTRIBUTES.items():
        assert ("attribute", "xyz") in found(f"<{(tags or ('i',))[-1]} {a}='xyz'>") and (not tags or not found(f"<i {a}='xyz'>")), a
        assert not found(f"<{(tags or ('i',))[-1]} {a}='xy'>"), a
    for a in H.COMMERCE_ATTRIBUTES:
        assert not found(f"<i title='xyz' {a}='1'>"), a
    for name in H.META:
        assert ("meta", "xyz") in found(f"<head><meta {'property' if ':' in name else 'name'}='{name}' content='xyz'></head>"), name
    for c in H.BREADCRUMBS:
        assert ("breadcrumb", "xy") in found(f"<div class='{c}'><a>xy</a></div>") and ("breadcrumb", "xy") in found(f"<div class='{c}'><i><span>xy</span></i></div>")
    assert ("breadcrumb", "xy") in found("<nav aria-label='Breadcrumb'><a>xy</a></nav>")
    assert found("<h1>Text<br><span class='h'>more text</span></h1>") == [("content_block", "Text<br /><span>more text</span>"), ("bare_text", "more text")]


def test_declarations_are_stepped_over():
    assert [o for *_, o in H.page_items("<p>one</p><![x y><p>two</p><![if !IE]><p>three</p>")] == ["one", "two", "three"]
    assert H.rewrite("<p>one</p><![x y><P>two</P>", {"two": "zwei"}) == "<p>one</p><![x y><P>zwei</P>"


def test_rewrite_names_whole_attributes():
    words = {"Bar": "BAR!", "x y": "z"}
    assert H.rewrite('<a data-x-title="Bar" title="Bar">', words) == '<a data-x-title="Bar" title="BAR!">'
    assert H.rewrite("<a Title=Bar>t</A >", words) == '<a Title="BAR!">t</A >'
    assert H.rewrite("<img alt='x  y' title = 'Bar'>", words) == '<img alt="z" title = "BAR!">'


def test_rewrite(spark):
    words = {"The title": "Der Titel", "Second one": "Zweite & mehr", "A picture": "Ein \"Bild\"", "Keep me": "NO", "Item one": "Eins", "About us": "Über uns"}
    out = H.rewrite(PAGE, words)
    assert "<title>Der Titel</title>" in out and "Zweite &amp; mehr" in out and 'alt="Ein &quot;Bild&quot;"' in out and "Keep me" in out and 'content="Über uns"' in out
    assert 'var x = "<p>no</p>";' in out
    assert H.rewrite(PAGE, {"nothing": "x"}) == PAGE and H.rewrite(None, words) is None
    tm = spark.createDataFrame([("Second one", "Zwei")], "original_text string, translated_text string")
    row = RW.localize(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string"), tm).orderBy("page_id").collect()
    assert "Zwei" in row[0].html and row[0].n_translated == 1 and row[1].html is None


def test_media_and_head(spark):
    import hashlib

    h = hashlib.md5(b"/a.png").hexdigest()
    tm = memory(spark, [(1, "x", "/b.png", "de", f"media.src[{h}].src", "custom", None, None, 1, 1), (2, "x", "Bild", "de", f"media.src[{h}].alt", "custom", None, None, 1, 1)])
    got = H.translate_media(spark.createDataFrame([(1, "/a.png", "A", "T"), (2, "/z.png", None, None)], "page_id long, src string, alt string, title string"), tm)
    assert {tuple(r) for r in got.collect()} == {(1, "/b.png", "Bild", "T"), (2, "/z.png", None, None)}
    page = spark.createDataFrame([('<html lang="ar"><head><link rel="alternate" hreflang="x" href="y"></head>',)], "h string")
    out = page.select(H.insert_hreflang(H.set_direction(F.col("h"), F.lit(True)), F.lit('<link hreflang="de">'))).first()[0]
    assert out == '<html dir="rtl" lang="ar"><head><link hreflang="de"></head>'


PO = r'''# comment
msgid ""
msgstr "Plural-Forms: nplurals=2;\n"

msgctxt "menu"
msgid "File \"x\""
msgstr ""
"Da"
"tei"

msgid "%d item"
msgid_plural "%d items"
msgstr[0] "%d Ding"
msgstr[1] "%d Dinge"
msgid "Next"
msgstr "Weiter"
'''


def test_catalogs(spark, tmp_path):
    (tmp_path / "shop-de_DE.po").write_text(PO)
    cat = C.read_catalogs(spark, str(tmp_path))
    rows = {(r.locale, r.domain, r.msgctxt, r.msgid, r.msgid_plural, r.form, r.msgstr) for r in cat.collect()}
    assert rows == {("de_DE", "shop", "menu", 'File "x"', None, None, "Datei"), ("de_DE", "shop", None, "%d item", "%d items", 0, "%d Ding"), ("de_DE", "shop", None, "%d item", "%d items", 1, "%d Dinge"), ("de_DE", "shop", None, "Next", None, None, "Weiter")}
    assert {tuple(r) for r in C.reverse_map(cat).collect()} >= {("Weiter", "Next"), ("%d Dinge", "%d item")}
    got = C.catalog_lookup(spark.createDataFrame([("Weiter",), ("7 Weiter",), ("Next",), ("none",)], "text string"), cat)
    assert {tuple(r) for r in got.select("text", "msgid").collect()} == {("Weiter", "Next"), ("7 Weiter", "Next"), ("Next", "Next")}


def test_source_scan(spark, tmp_path):
    (tmp_path / "a.php").write_text("<?php echo __('Hello', 'shop'); /* __('no') */ _n('%d cat', '%d cats', $n, 'shop'); _x(\"Post\", 'verb', 'shop'); function __($x) {} __($dynamic); __('It\\'s')")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.php").write_text("esc_html__('Hello', 'shop');")
    got = {(r.msgctxt, r.domain, r.msgid, r.msgid_plural) for r in C.scan_sources(spark, str(tmp_path)).collect()}
    assert got == {(None, "shop", "Hello", None), (None, "shop", "%d cat", "%d cats"), ("verb", "shop", "Post", None), (None, None, "It's", None)}
    C.write_catalog(C.scan_sources(spark, str(tmp_path)), str(tmp_path / "out"))
    (tmp_path / "again-de_DE.po").write_text("\n\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect()))
    assert spark.read.text(str(tmp_path / "out")).count() > 0


def test_pages_source(spark, tmp_path):
    spark.createDataFrame([(1, "<html>" + "x" * 100), (2, "short")], "page_id long, html string").write.parquet(str(tmp_path / "p"))
    assert SP.read_pages(spark, str(tmp_path / "p")).count() == 2 and SP.read_pages(spark, str(tmp_path / "p"), valid_only=True).count() == 1
    SP.write_localized(spark.createDataFrame([(1, "h", "de")], "page_id long, html string, language_code string"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).first().language_code == "de"


def test_languages(spark):
    rows = {r.code: r for r in language_table(spark, ("en", "ar", "de")).collect()}
    assert rows["ar"].rtl and not rows["de"].rtl and rows["de"].name == "German" and rows["de"].locale == "de_DE" and rows["en"].country == "us"
    assert EngineConfig().targets() == ("fr", "de", "es")


def test_stream_equals_batch(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    tm = memory(spark, [(1, table.first().text, "hit", "de", "x", "custom", None, None, 1, 1)])
    stream = SL.table_stream(spark, f"{sf}/conversations.parquet", table.schema)
    out = SL.run_available(spark, SL.lookup_stream(stream, tm), "test_stream")
    batch = SL.lookup_stream(table, tm)
    assert sorted(map(str, out.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_localize_stream(spark, tmp_path):
    spark.createDataFrame([(1, "<p>Second one</p>"), (2, "<p>x</p>")], "page_id long, html string").write.parquet(str(tmp_path / "in"))
    tm = spark.createDataFrame([("Second one", "Zwei")], "original_text string, translated_text string")
    stream = spark.readStream.schema("page_id long, html string").parquet(str(tmp_path / "in"))
    SL.localize_stream(stream, tm, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.page_id: r.html for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "<p>Zwei</p>", 2: "<p>x</p>"}


@pytest.mark.parametrize("key", ["original_text_hash"])
def test_memory_shape(spark, sf, key):
    tm = M.build_memory(spark.read.parquet(f"{sf}/documents.parquet"))
    assert tm.count() == tm.select("id").distinct().count()
    assert tm.where(f"{key} != md5(original_text)").count() == 0
