"""Replacement in markup that must not touch URLs, scripts or data: what is masked, replaced and put back.

X5 and X6 are Columns: a mask is a private character per protected part, and the parts stay in an array beside it, so
both halves run in the JVM. X4 and X7 need matches that see their surroundings, longest first, and are pandas UDFs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes that hold URLs, and parts of a page that hold code or data.
URL_ATTRIBUTES = "href src srcset action data-src data-srcset data-href data-url data-link data-large_image data-zoom-image poster cite formaction".split()
PROTECTED_URLS = rf"(?is)\b(?:{'|'.join(URL_ATTRIBUTES)})\s*=\s*(?:\"[^\"]*\"|'[^']*')"
PROTECTED_CODE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|\bdata-[\w-]+\s*=\s*(?:'\s*[\[{][^']*'|\"\s*(?:[\[{]|&quot;)[^\"]*\")"
_MARK = ""


def mask(html: Column, pattern: str) -> Column:
    """struct(text, parts)."""
    return F.struct(F.regexp_replace(html, pattern, _MARK).alias("text"), F.regexp_extract_all(html, F.lit(f"({pattern})"), F.lit(1)).alias("parts"))


def unmask(text: Column, parts: Column) -> Column:
    pieces = F.split(text, _MARK, -1)
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.zip_with(parts, F.slice(pieces, F.lit(2), F.size(pieces)), lambda a, b: F.concat(a, b)), ""))


def replace_ci(c: Column, search: str, to: str, element_boundary: bool | None = None) -> Column:
    """Without regard to case; with the rule (the default for keys of fewer than 50 characters) only where tags or ends are flush on both sides."""
    rule = len(search) < 50 if element_boundary is None else element_boundary
    pattern = "(?iu)" + (r"(?<=^|>)" if rule else "") + re.escape(search) + (r"(?=$|<)" if rule else "")
    return F.regexp_replace(c, F.lit(pattern), F.lit(re.sub(r"([\\$])", r"\\\1", to)))


def replace_longest_first(words: dict[str, str], depth: int = 3):
    """X7 as a pandas UDF: all keys in one pass, longer ones first, URLs and code protected; replaced text is not read again.

    words is one page's dictionary or a bounded set. depth is how many levels of encoded markup in attributes are followed.
    """
    keys = sorted((k for k in words if k), key=lambda k: (-len(k), k))
    protected = re.compile(f"{PROTECTED_CODE}|{PROTECTED_URLS.removeprefix('(?is)')}")

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from html import escape, unescape

        pattern = re.compile("|".join(map(re.escape, keys))) if keys else None
        nested = re.compile(r'(="|=\')([^"\']*&lt;[^"\']*)')

        def one(html: str, level: int = 0) -> str:
            if pattern is None:
                return html
            kept: list[str] = []

            def hide(m: re.Match) -> str:
                kept.append(m[0])
                return _MARK

            text = protected.sub(hide, html)
            if level < depth:
                text = nested.sub(lambda m: m[1] + escape(one(unescape(m[2]), level + 1)), text)
            text = pattern.sub(lambda m: words[m[0]], text)
            pieces = text.split(_MARK)
            return pieces[0] + "".join(k + p for k, p in zip(kept, pieces[1:]))

        for part in parts:
            yield part.map(one, na_action="ignore")

    return rewrite
