"""Structured data inside pages, translated in place.

Scripts of type application/ld+json are read by a small state machine, to any depth and without recursion. It gives the
places of the string values that may change; joins with the memory give translations, a page's own first, then those of
global contexts, then any other's; and the edits are merged into the page, so all other bytes stay, the layout of the JSON included.

Cases: null pages stay null; a script that isn't well-formed JSON stays whole, as do values that hold half a surrogate
pair; strings inside lists have no key and stay; repeated keys are all translated; ids of pages should be different.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import text as T
from glossaloom.operators import html as H
from glossaloom.operators import rewrite as W
from glossaloom.operators.memory import best_per_key
from glossaloom.operators.precedence import GRAPH_TEXTS, GRAPH_URLS
from glossaloom.session import stored

_SCRIPT = re.compile(r"""<script\b(?=[^>]*?\stype\s*=\s*["']?application/ld\+json\b)[^>]*+>""", re.I)
_END = re.compile(r"</script(?=[\s/>])", re.I)
_STRING = r'''("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")'''
_SCALAR = r"(?:-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null)(?![\w.])"
_TOKEN = re.compile(rf"[ \t\r\n]*+(?:{_STRING}|([\[\]{{}},:])|{_SCALAR})")
#: A key with a value that is no container.
_PAIR = re.compile(rf"[ \t\r\n]*+{_STRING}[ \t\r\n]*+:[ \t\r\n]*+(?:{_STRING}|{_SCALAR})")
_HALF = re.compile("[\ud800-\udfff]")
_BLANK = re.compile(r"[ \t\r\n]*")
_PLACES = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("raw", pa.string())])


def _read(text: str, start: int, stop: int) -> str:
    """The value of a string that is known to be well-formed."""
    raw = text[start + 1 : stop - 1]
    return json.loads(text[start:stop]) if "\\" in raw else raw


def json_strings(text: str, start: int, stop: int) -> list[tuple[str, int, int]] | None:
    """(key, start, stop) of the string values of objects in text[start:stop], quotes included; None if that isn't JSON."""
    found: list[tuple[str, int, int]] = []
    inside: list[str | None] = []  # of each open container its last key; None in a list
    wanted, at = "value", start
    stop_at = stop
    while wanted != "end" or inside:
        if wanted in ("key", "key or }") and (m := _PAIR.match(text, at, stop_at)):
            at, wanted = m.end(), ", or end"
            if m[2]:
                found.append((_read(text, *m.span(1)), m.start(2), at))
            continue
        m = _TOKEN.match(text, at, stop_at)
        if not m:
            return None
        at, string, mark = m.end(), m[1], m[2]
        if wanted in ("key", "key or }"):
            if string:
                inside[-1], wanted = _read(text, *m.span(1)), ":"
                continue
            if mark != "}" or wanted == "key":
                return None
            inside.pop()
        elif wanted == ":":
            if mark != ":":
                return None
            wanted = "value"
            continue
        elif wanted == ", or end":
            if mark == ",":
                wanted = "value" if inside[-1] is None else "key"
                continue
            if mark != ("]" if inside[-1] is None else "}"):
                return None
            inside.pop()
        elif mark == "{":
            inside.append("")
            wanted = "key or }"
            continue
        elif mark == "[":
            inside.append(None)
            wanted = "value or ]"
            continue
        elif mark:
            if mark != "]" or wanted != "value or ]":
                return None
            inside.pop()
        elif string and inside and inside[-1] is not None:
            found.append((inside[-1], m.start(1), at))
        wanted = ", or end" if inside else "end"
    return found if _BLANK.match(text, at, stop).end() == stop else None


def graph_places(html: str | None) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, stop, value): texts and addresses of a page's structured data."""
    at = 0
    while html and (m := _SCRIPT.search(html, at)):
        end = _END.search(html, m.end())
        at = end.start() if end else len(html)
        for key, a, b in json_strings(html, m.end(), at) or ():
            kind = "text" if key in GRAPH_TEXTS else "url" if key in GRAPH_URLS else None
            if kind and b - a > 2:
                value = _read(html, a, b)
                if value.isascii() or not _HALF.search(value):
                    yield kind, a, b, value


def _hashed_places(html: str | None) -> Iterator[tuple[str, int, int, str]]:
    """graph_places with the hashes of texts, by which they are looked up."""
    for kind, a, b, value in graph_places(html):
        yield kind, a, b, md5(value.encode()).hexdigest() if kind == "text" else value


def as_json(c: Column) -> Column:
    """A JSON string that can't end its script."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.replace(F.substring(whole, F.lit(6), F.length(whole) - 6), F.lit("</"), F.lit("<\\/"))


def prefixed(url: Column, site: str, language: str, languages: tuple[str, ...]) -> Column:
    """An address of the site with the language in front of its path, unless one is there; null if nothing changes."""
    path = F.substring(url, F.lit(len(site) + 1), F.length(url))
    marked = path.rlike(f"^/(?:{'|'.join(map(re.escape, languages))})(?:/|$|#|\\?)")
    own = F.startswith(url, F.lit(site)) & (path.rlike(r"^[/?#]") | (path == ""))
    return F.when(own & ~marked, F.concat(F.lit(f"{site}/{language}"), path))


def localize_graphs(pages: DataFrame, tm: DataFrame, site: str, language: str, languages: tuple[str, ...]) -> DataFrame:
    """(page_id, html, n_strings, n_translated) of pages(page_id, html); tm(id, original_text, translated_text, context) of the language."""
    site = site.rstrip("/")
    found = stored(H._rows(pages, _hashed_places, _PLACES, "page_id long, kind string, start int, stop int, raw string"), "graph_places")
    rows = tm.where((F.col("original_text") != "") & (F.col("translated_text") != ""))
    rows = rows.select(F.md5("original_text").alias("k"), "translated_text", "id", T.context_post_id(F.col("context")).cast("long").alias("post"), F.startswith("context", F.lit("global_")).alias("shared"))
    words = stored(rows, "graph_words")
    own = best_per_key(words.where("post is not null"), ["post", "k"], [F.col("id")]).select(F.col("post").alias("page_id"), "k", F.col("translated_text").alias("own"))
    anywhere = best_per_key(words, ["k"], [F.coalesce("shared", F.lit(False)), F.col("id")]).select("k", F.col("translated_text").alias("anywhere"))
    texts = found.where("kind = 'text'").withColumnRenamed("raw", "k").join(own, ["page_id", "k"], "left").join(anywhere, "k", "left")
    shown = F.coalesce("own", "anywhere")
    edits = W._edit(texts.where(shown.isNotNull()), as_json(shown), 0)
    moved = prefixed(F.col("raw"), site, language, languages)
    edits = edits.unionByName(W._edit(found.where("kind = 'url'").where(moved.isNotNull()), as_json(moved), 0))
    counts = found.where("kind = 'text'").groupBy("page_id").agg(F.count("*").alias("n_strings"))
    return W.apply_edits(pages, edits, counts)
