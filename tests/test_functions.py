from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from glossaloom.functions import plurals as PL
from glossaloom.functions import predicates as P
from glossaloom.functions import text as T
from glossaloom.functions import urls as U

LANGS = ("en", "fr", "de", "es")


def apply(spark, values, *fs):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [tuple(r) for r in frame.orderBy("k").select(*[f(F.col("v")).alias(f"c{i}") for i, f in enumerate(fs)]).collect()]


def test_normalizers(spark):
    cases = {
        "A  b": "A b",
        "«Ёлка» – „x“ ‘y’…": "\"Елка\" - \"x\" 'y'...",
        "a<BR>b<br/>   c": "a<br />b<br /> c",
        "Tom &amp; &quot;Jo&quot; &amp;lt;": 'Tom & "Jo" &lt;',
        "  x \t": "x",
        "": "",
        "0": "0",
    }
    got = apply(spark, list(cases), T.normalize_once, T.normalize_lookup)
    assert [g[0] for g in got] == list(cases.values())
    assert [g[1] for g in got] == [v.lower() for v in cases.values()]
    assert apply(spark, [None], T.normalize_once) == [("",)]


def test_normalizers_differ(spark):
    text = "«Ё» ‟a‟ …"
    n1, n4, n7 = apply(spark, [text], T.normalize_once, T.normalize_phase2, T.normalize_dynamic)[0]
    assert n1 == '"Е" "a" ...' and n4 == '"Е" ‟a‟ …' and n7 == '«Ё» "a" ...'


def test_normalize_is_idempotent(spark):
    values = ["a  b–c", "«q» … ё", "x<br>  y", "‘t’", "plain"]
    once = [r[0] for r in apply(spark, values, T.normalize_once)]
    assert [r[0] for r in apply(spark, once, T.normalize_once)] == once


def test_strip_and_clean(spark):
    got = apply(spark, ["<p>A<br>B &amp; <b>C</b></p>"], T.strip_for_matching, T.clean_text, T.trim_block, T.sanitize)
    assert got == [("a b & c", "AB & C", "<p>A<br>B & <b>C</b></p>", "AB &amp; C")]
    assert apply(spark, ["caf&eacute; &#233;", None], T.decode_all) == [("café é",), (None,)]


def test_small_functions(spark):
    row = apply(spark, ["Category: News & more"], lambda c: T.archive_title(c)["prefix"], lambda c: T.archive_title(c)["name"], T.html_escape, T.word_count, lambda c: T.first_words(c, 2), T.without_leading_number)[0]
    assert row == ("Category", "News & more", "Category: News &amp; more", 3, "Category: News", "Category: News & more")
    assert apply(spark, ["my-plugin-de_DE.po", "x/y-fr.po", "plain.po"], T.domain_of_catalog) == [("my-plugin",), ("y",), ("plain",)]
    assert apply(spark, ['say "two words" a to be'], T.search_terms) == [(["two words", "say", "to", "be"],)]
    assert apply(spark, ["  hi&nbsp;"], lambda c: T.carry_blanks(c, F.lit("salut"))) == [("  salut&nbsp;",)]
    assert apply(spark, ["%%title%% | %%sitename%% %%page%%"], lambda c: T.fill_variables(c, {"title": F.lit("T"), "sitename": F.lit("S")})) == [("T | S",)]


def test_string_hash(spark):
    def js(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        h = h - (1 << 32) if h >> 31 else h
        n, out = abs(h), ""
        while n:
            n, d = divmod(n, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out or "0"

    values = ["a", "hello world", "é", "x" * 50]
    assert [r[0] for r in apply(spark, values, T.string_hash36)] == [js(v) for v in values]


def test_contexts(spark):
    values = ["post_12_content_blocks", "core_fields.title.post_3", "taxonomy_post_tag_7_name", "gettext.shop.email", "media.src[ab].alt", "general"]
    got = apply(spark, values, lambda c: T.parse_context(c)["scope"], lambda c: T.parse_context(c)["id"], lambda c: T.parse_context(c)["grp"], lambda c: T.parse_context(c)["field"], T.context_post_id)
    assert got[0] == ("post", 12, "content_blocks", None, 12)
    assert got[1] == ("post", 3, "core_fields", "title", 3)
    assert got[2][:2] == ("taxonomy", 7)
    assert got[3][:3] == ("gettext", None, "shop")
    assert got[5][0] == "other"


TECHNICAL = {
    "": (True, False), "0": (True, True), "123": (True, True), '{"a": "b"}': (True, True), "btn_primary": (True, True), "Single-stage": (False, True), "a@b.co": (True, True), "https://x.y": (True, True),
    "photo.JPG": (True, True), "Read more": (False, False), "<div>x</div>": (False, True), "A <b>bold</b> word": (False, False), "order 12345678": (False, True), "Skip to content": (False, True), "x": (True, True),
    '"text"': (True, True), "&nbsp;&copy;": (False, True), "if (var == const) return": (False, True),
}


def test_technical(spark):
    got = apply(spark, list(TECHNICAL), lambda c: P.any_of(P.technical_memory(c)), lambda c: P.any_of(P.technical_item(c)))
    assert {k: g for k, g in zip(TECHNICAL, got)} | {"": (True, got[0][1])} == TECHNICAL | {"": (True, got[0][1])}
    render = dict(zip(['"text"', "<div>x", 'class="a"', "a{b:c}", "<b>x</b>"], apply(spark, ['"text"', "<div>x", 'class="a"', "a{b:c}", "<b>x</b>"], lambda c: P.any_of(P.technical_render(c)))))
    assert [v[0] for v in render.values()] == [False, True, True, True, False]


def test_bytes_and_characters(spark):
    values = ["é", "éé", "é" * 300, "a" * 500, "a" * 501]
    got = apply(spark, values, P.length_ok, lambda c: P.capture_ok(c, F.lit("text_node")), lambda c: F.octet_length(c) < 2)
    assert got == [(False, True, False), (True, True, False), (True, False, False), (True, True, False), (False, False, False)]


def test_filters(spark):
    values = ["Read more", "12:30 PM", "2024-01-02", "€12", "SKU12345", "a1b2" * 8, "123e4567-e89b-12d3-a456-426614174000", "key=value&b=c", "a:1:{s:1}", "Plain words here."]
    got = [r[0] for r in apply(spark, values, lambda c: P.any_of(P.content_filter(c)))]
    assert got == [True] * 9 + [False]
    assert apply(spark, ["By Ann", "3 min read", "5 May", "Tags: a", "hello"], P.metadata_like) == [(True,), (True,), (True,), (True,), (False,)]
    assert apply(spark, ["display: none", "height:0.5", "color:red"], P.hidden_style) == [(True,), (True,), (False,)]
    assert apply(spark, ["x" * 99, "<html>" + "x" * 100, "x" * 200], P.valid_page) == [(False,), (True,), (False,)]
    assert apply(spark, ["Привет", "hello"], P.has_script) == [(True,), (False,)]
    masked = apply(spark, ["a [b c=1] d [/b]"], P.mask_shortcodes, P.shortcodes, lambda c: P.unmask_shortcodes(P.mask_shortcodes(c), P.shortcodes(c)))[0]
    assert masked[1] == ["[b c=1]", "[/b]"] and masked[2] == "a [b c=1] d [/b]"


URLS = ["https://x.org/", "https://x.org", "https://x.org/fr/a/?q=1#t", "/de/fr/a", "https://x.org:8080/a/b.html?x=/fr/", "#top", "http://x.org/english/a", ""]


def test_urls(spark):
    got = apply(spark, URLS, lambda c: U.language_of(c, LANGS), lambda c: U.add_language(c, F.lit("fr"), "en"), lambda c: U.url_for_language(c, F.lit("de"), LANGS, "en"), lambda c: U.url_for_language(c, F.lit("en"), LANGS, "en"))
    assert [g[0] for g in got] == [None, None, "fr", "de", None, None, None, None]
    assert got[0][1] == "https://x.org/fr/" and got[1][1] == "https://x.org/fr/"
    assert got[2][1] == URLS[2] and got[4][1] == "https://x.org:8080/fr/a/b.html?x=/fr/"
    assert got[3][2] == "/de/a" and got[2][2] == "https://x.org/de/a?q=1#t" and got[2][3] == "https://x.org/a?q=1#t"


def test_prefix_round_trip(spark):
    values = ["https://x.org/a", "/a/b/", "https://x.org/"]
    strip = lambda c: U.strip_languages(U.path_of(c), LANGS)
    got = apply(spark, values, strip, lambda c: strip(U.add_language(c, F.lit("es"), "en")))
    assert all(a == b for a, b in got)


def test_home_folder(spark):
    assert apply(spark, ["https://x.org/blog/a"], lambda c: U.add_language(c, F.lit("fr"), "en", "/blog"), lambda c: U.language_of(c, LANGS, "/blog")) == [("https://x.org/blog/fr/a", None)]


def test_links_and_media(spark):
    html = '<a href="/a">1</a><a href="/fr/b">2</a><a href="https://h.org/c">3</a><a href="/x.png">4</a><a href="//o.org/d">5</a><a href="/wp-admin/">6</a>'
    out = apply(spark, [html], lambda c: U.rewrite_links(c, F.lit("de"), LANGS, "h.org"))[0][0]
    assert re.findall('href="([^"]*)"', out) == ["/de/a", "/fr/b", "https://h.org/de/c", "/x.png", "//o.org/d", "/wp-admin/"]
    assert apply(spark, ["//c.org/a-2-300x200.jpg?v=1", "/b-7.png"], lambda c: U.media_key(c, "https://h.org")) == [("https://c.org/a.jpg",), ("https://h.org/b.png",)]
    assert apply(spark, ["https://c.org/a-300x200.jpg 300w, https://c.org/z.jpg 2x"], lambda c: U.rewrite_srcset(c, F.lit("https://c.org/a.jpg"), F.lit("N"))) == [("N 300w, https://c.org/z.jpg 2x",)]
    assert apply(spark, ["#a", "mailto:x", "https://o.org/a", "/wp-login", "/a"], lambda c: U.classify_link(c, F.lit("h.org"))) == [("anchor",), ("special",), ("external",), ("admin",), ("internal",)]


def test_link_queries(spark):
    frame = spark.createDataFrame([("mailto:a?subject=Hello%20you&body=x",)], "v string")
    assert frame.select(U.link_query_texts(F.col("v"))).first()[0] == ["Hello you", "x"]
    assert frame.select(U.link_query_rewriter({"Hello you": "Salut é"})("v")).first()[0] == "mailto:a?subject=Salut%20%C3%A9&body=x"


def c_eval(expression, n):
    text = re.sub(r"\|\|", " or ", re.sub("&&", " and ", re.sub(r"!(?!=)", " not ", expression)))

    def ternary(t):
        depth = 0
        for i, ch in enumerate(t):
            depth += (ch == "(") - (ch == ")")
            if ch == "?" and depth == 0:
                level, k = 0, i + 1
                d = 0
                while True:
                    d += (t[k] == "(") - (t[k] == ")")
                    if d == 0 and t[k] == "?":
                        level += 1
                    if d == 0 and t[k] == ":":
                        if level == 0:
                            break
                        level -= 1
                    k += 1
                return f"(({ternary(t[i + 1:k])}) if ({ternary(t[:i])}) else ({ternary(t[k + 1:])}))"
        out, i = "", 0
        while i < len(t):
            if t[i] == "(":
                d, k = 1, i + 1
                while d:
                    d += (t[k] == "(") - (t[k] == ")")
                    k += 1
                out += "(" + ternary(t[i + 1 : k - 1]) + ")"
                i = k
            else:
                out += t[i]
                i += 1
        return out

    return int(eval(ternary(text), {"n": n}))


@pytest.mark.parametrize("lang", ["en", "fr", *sorted(PL.HEADERS)])
def test_plural_rules(spark, lang):
    count, expression = PL.parse_header(PL.header_of(lang))
    rows = spark.range(201).select("id", PL.plural_form(F.col("id"), lang).alias("f"), F.expr(PL.form_sql(lang, "id")).alias("g")).collect()
    assert all(r.f == r.g == c_eval(expression, r.id) and 0 <= r.f < count for r in rows)


def test_plural_edges(spark):
    assert PL.parse_header("nonsense") == (2, "n != 1") and PL.parse_header("nplurals=3;plural=n;") == (3, "n")
    assert spark.range(1).select(PL.plural_form(F.lit(None).cast("int"), "en")).first()[0] == 1
    assert PL.expression_sql("n ??") == PL.expression_sql("n != 1")
    assert PL.form_count("th") == 1 and PL.form_count("ru") == 3 and PL.form_count("xx") == 2


def test_division_of_plural_rules_is_of_integers(spark):
    rows = spark.range(60).select("id", PL._built("n / 10 % 2", F.col("id")).alias("built"), F.expr(PL.expression_sql("n / 10 % 2", "id")).alias("sql")).collect()
    assert all(r.built == r.sql == r.id // 10 % 2 for r in rows)
