"""Text normalizers and other string functions, as Column -> Column.

The normalizers differ on purpose; each keeps the steps and the order that its callers rely on. White space is ASCII
unless a function says otherwise; PHP-style trimming also strips NUL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character references that are decoded without a UDF; &amp; is last, so that nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#039;": "'", "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&laquo;": "«", "&raquo;": "»", "&amp;": "&"}
# Characters that normalizers make plain.
DASHES = "–—‐"
DOUBLE_QUOTES = "“”‟„«»"
SINGLE_QUOTES = "‘’‛‹›"
BLANKS = " \t\n\r\0\x0b"
BR = r"(?i)<br\s*/?\s*>"
TAG = r"<[^>]*>"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def decode(c: Column) -> Column:
    """The common character references."""
    out = c
    for ref, char in ENTITIES.items():
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), out).otherwise(c)


def decode_all(c: Column) -> Column:
    """Every character reference of HTML5, by the standard library's table; a pandas UDF."""

    @F.pandas_udf("string")
    def decode_series(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from html import unescape

        for part in parts:
            yield part.map(unescape, na_action="ignore")

    return decode_series(c)


def _plain(c: Column, double: str, single: str, more: str = "", to: str = "", dots: bool = False) -> Column:
    """Dashes and quotes made plain, and characters of `more` those of `to`; in one pass, for texts beyond ASCII, as these characters are."""
    frm = DASHES + double + single + more
    out = F.translate(c, frm, "-" * len(DASHES) + '"' * len(double) + "'" * len(single) + to)
    out = F.replace(out, F.lit("…"), F.lit("...")) if dots else out
    return F.when(F.octet_length(c) != F.char_length(c), out).otherwise(c)


def nbsp_to_space(c: Column) -> Column:
    return F.replace(c, F.lit("\u00a0"), F.lit(" "))


def break_tags(c: Column) -> Column:
    """<br> in any form becomes <br />, and white space behind it one space."""
    out = F.regexp_replace(F.regexp_replace(c, BR, "<br />"), r"<br\s*/>\s+", "<br /> ")
    return F.when(F.contains(c, F.lit("<")), out).otherwise(c)


def normalize_once(c: Column) -> Column:
    """N1."""
    # what is made plain is neither white space nor part of a tag, but for the no-break space, which comes first
    c = _plain(decode(F.coalesce(c, F.lit(""))), DOUBLE_QUOTES, SINGLE_QUOTES, "\u00a0ёЁ", " еЕ", dots=True)
    return trim(F.regexp_replace(break_tags(c), r"\s{2,}", " "))


def normalize_lookup(c: Column) -> Column:
    """N1 in lower case."""
    return F.lower(normalize_once(c))


def strip_for_matching(c: Column) -> Column:
    """Plain text in lower case, without tags."""
    c = decode(F.coalesce(c, F.lit("")))
    c = F.when(F.contains(c, F.lit("<")), F.regexp_replace(F.regexp_replace(c, BR, " "), TAG, "")).otherwise(c)
    c = _plain(c, DOUBLE_QUOTES, SINGLE_QUOTES, "\u00a0ёЁ", " еЕ", dots=True)
    return F.lower(trim(F.regexp_replace(c, r"\s+", " ")))


def normalize_phase2(c: Column) -> Column:
    """N4, for both sides of the fallback lookup. (N5, a second version of the same in SQL, would miss references.)"""
    c = _plain(decode(F.coalesce(c, F.lit(""))), "“”„«»", "‘’‹›", "\u00a0ёЁ", " еЕ")
    return trim(F.regexp_replace(c, r"\s{2,}", " "))


def normalize_seo(c: Column) -> Column:
    """N6."""
    return F.lower(trim(F.regexp_replace(nbsp_to_space(decode(F.coalesce(c, F.lit("")))), r"\s+", " ")))


def normalize_dynamic(c: Column) -> Column:
    """Keeps case and ё; NBSP last."""
    c = F.regexp_replace(break_tags(decode(F.coalesce(c, F.lit("")))), r"\s{2,}", " ")
    return trim(_plain(c, "“”‟", "‘’‛", "\u00a0", " ", dots=True))


def trim_block(c: Column) -> Column:
    """Decoded twice, Unicode white space collapsed, tags kept."""
    return F.btrim(F.regexp_replace(decode(decode(c)), r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Tags stripped first, then decoded."""
    return F.btrim(F.regexp_replace(decode(F.regexp_replace(c, TAG, "")), r"(?U)\s+", " "))


def normalize_breaks(c: Column) -> Column:
    """N10."""
    return F.regexp_replace(c, r"(?i)<br\s*>", "<br />")


def search_terms(c: Column) -> Column:
    """Quoted phrases, then the other words; terms of two characters or more."""
    q = F.regexp_replace(trim(c), r"\s+", " ")
    phrases = F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1))
    words = F.split(F.btrim(F.regexp_replace(q, '"[^"]+"', "")), " ")
    return F.filter(F.concat(phrases, words), lambda t: F.char_length(t) >= 2)


def carry_blanks(original: Column, replacement: Column) -> Column:
    """The replacement between the white space (or &nbsp;) that surrounds the original."""
    edge = r"(?:\s|&nbsp;|\x{A0})*"
    return F.concat(F.regexp_extract(original, f"^({edge})", 1), replacement, F.regexp_extract(original, f"({edge})$", 1))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def sanitize(c: Column) -> Column:
    """Text of a field as it is stored."""
    return F.btrim(F.regexp_replace(strip_tags(c), r"\s+", " "))


def has_html(c: Column) -> Column:
    return c != strip_tags(c)


def html_escape(c: Column) -> Column:
    """X16."""
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(char), F.lit(ref))
    return c


def fingerprint(*cols: Column) -> Column:
    """MD5 over columns joined by |."""
    return F.md5(F.concat_ws("|", *cols))


def fill_variables(c: Column, values: dict[str, Column]) -> Column:
    """%%name%% by its value; other variables go."""
    for name, value in values.items():
        c = F.replace(c, F.lit(f"%%{name}%%"), F.coalesce(value, F.lit("")))
    return F.btrim(F.regexp_replace(F.regexp_replace(c, "%%[a-z_]+%%", ""), r"\s+", " "))


def archive_title(c: Column) -> Column:
    """struct(prefix, name) of "prefix: name"; nulls if it isn't one."""
    pattern = r"^([^:]+):\s*(.+)$"
    part = lambda k: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k))
    return F.struct(part(1).alias("prefix"), part(2).alias("name"))


def without_leading_number(c: Column) -> Column:
    """X11."""
    return F.regexp_replace(c, r"^\d+\s+", "")


def domain_of_catalog(file_name: Column) -> Column:
    """My-plugin-de_DE.po -> my-plugin."""
    return F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"(-[a-z]{2,3}(_[A-Z]{2})?)?\.po$", "")


def context_post_id(context: Column) -> Column:
    """X13."""
    return F.when(context.rlike(r"post[_.]\d+"), F.regexp_extract(context, r"post[_.](\d+)", 1).cast("long"))


def parse_context(context: Column) -> Column:
    """Both naming schemes of contexts, `group.field.post_N` and `post_N_group`, as struct(scope, id, grp, field)."""
    new = r"^post_(\d+)_(.+)$"
    old = r"^([^.]+)\.(.+)\.post_(\d+)$"
    tax = r"^taxonomy_([a-z_]+?)_(\d+)_(.+)$"
    pick = lambda p, k: F.regexp_extract(context, p, k)
    scope = F.when(context.rlike(new) | context.rlike(old), "post").when(context.rlike(tax), "taxonomy").when(context.startswith("gettext."), "gettext").when(context.startswith("media."), "media").otherwise("other")
    number = F.when(context.rlike(new), pick(new, 1)).when(context.rlike(old), pick(old, 3)).when(context.rlike(tax), pick(tax, 2))
    group = F.when(context.rlike(new), pick(new, 2)).when(context.rlike(old), pick(old, 1)).when(context.rlike(tax), pick(tax, 3)).when(scope.isin("gettext", "media"), F.regexp_extract(context, r"^[a-z]+\.([^.]+)", 1))
    field = F.when(context.rlike(old), pick(old, 2))
    return F.struct(scope.alias("scope"), number.cast("long").alias("id"), group.alias("grp"), field.alias("field"))


def status_of(translated: Column) -> Column:
    """X22."""
    return F.when(F.coalesce(translated, F.lit("")) == "", 0).otherwise(2)


def string_hash36(c: Column) -> Column:
    """32-bit hash h * 31 + code, absolute, in base 36. Characters beyond the BMP count as their code point."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    return F.lower(F.conv(F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: _int32(h * 31 + x))).cast("string"), 10, 36))


def _int32(x: Column) -> Column:
    low = F.pmod(x, F.lit(1 << 32))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def replace_in_order(c: Column, pairs: Column) -> Column:
    """Replaces, in the order of the array pairs(frm, to), every occurrence of frm by to."""
    return F.aggregate(pairs, c, lambda acc, p: F.replace(acc, p.frm, p.to))


def first_words(c: Column, n: int = 20) -> Column:
    """K7."""
    return F.array_join(F.slice(F.split(F.btrim(F.regexp_replace(c, r"\s+", " ")), " "), 1, n), " ")


def word_count(c: Column) -> Column:
    """Runs of ASCII letters, apostrophes and hyphens."""
    return F.regexp_count(c, F.lit("[A-Za-z'-]+"))
