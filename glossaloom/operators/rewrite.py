"""Localized pages by edits: what is translated is replaced in place, and every other byte of a page stays as it is.

A page is read once, in linear time, into slots: texts, elements with inline markup, attributes, title and meta tags,
images and message links, each with its place in the page. Translations come from joins of slots with the memory; each
gives an edit (start, stop, replacement). A page's edits are collected, bounded by the page, and merged in one pass.

The cascade of a text (H23), the first that applies:
1. exact: the lower-cased normalized key (N2) of the text, or of an element with its markup;
2. plain: for elements with markup, the key without tags (N3). A translation with markup replaces the element's content,
   one without is put in piece by piece: an Aho-Corasick automaton over the keys that the element holds, longest first,
   between tags only; keys under 50 characters only where they fill the space between two tags (X4, X7);
3. contained (J16): the longest key within a text of at most 500 bytes that is no more than 15 bytes longer.
An outer element that is replaced wins over what it holds. Title and meta tags follow J20, then the prefix up to a
separator (J19). Images follow the hash of their normalized address (J10, H25, H26, R15).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from html import escape
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import predicates as P
from glossaloom.functions import text as T
from glossaloom.functions import urls as U
from glossaloom.operators import html as H
from glossaloom.operators import memory as M
from glossaloom.operators import precedence as R
from glossaloom.operators.memory import best_per_key
from glossaloom.session import stored

# Limits of the cascade.
CONTAINED_BYTES, SLACK_BYTES, FLUSH_CHARS = 500, 15, 50
#: Texts and keys of fewer characters meet as wholes.
SHORT_CHARS = 24
#: Separators of titles, in the order in which they are tried.
SEPARATORS = (" - ", " | ", " – ", " — ")
#: Attributes that are translated, with the only elements where they count (any, if none are named).
ATTRIBUTES = {"alt": (), "title": (), "placeholder": ("input", "textarea"), "aria-label": ()}
#: Attributes of an image that hold its address.
ADDRESSES = ("src", "data-src", "data-large_image", "data-zoom-image")
#: Meta tags, and the kind of SEO text that each shows.
METAS = {"description": "meta_description", "og:title": "og_title", "og:description": "og_description", "og:site_name": "og_site_name", "twitter:title": "og_title", "twitter:description": "og_description"}
#: Elements that are left to the block of text around them if they hold markup themselves.
PARTS_OF_TEXT = ("strong", "b", "em", "i", "u", "mark", "small", "del", "ins", "sub", "sup", "code", "kbd", "samp", "var", "span")
MESSAGE_LINK = r"(?i)^(?:mailto:|https?://(?:t\.me|wa\.me|api\.whatsapp))"

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in ("script", "style", "textarea", "title")}


class _Open:
    """An open element: where its content begins, and how many tags and blocks came before."""

    __slots__ = ("tag", "at", "tags", "blocks", "skip", "in_head", "in_text")

    def __init__(self, tag, at, tags, blocks, skip, in_head, in_text):
        self.tag, self.at, self.tags, self.blocks, self.skip, self.in_head, self.in_text = tag, at, tags, blocks, skip, in_head, in_text


def page_slots(html: str | None, no_translate: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(kind, name, start, stop, raw, whole, attrs) of a page; whole: a text that is all of its element."""
    html = html or ""
    root = _Open("#", 0, 0, 0, False, False, False)
    stack, counts, out = [root], Counter(), []
    tags = blocks = pos = 0
    seen: set[str] = set()
    classes = (*H.NO_TRANSLATE_CLASSES, *no_translate)

    def text(start: int, stop: int) -> None:
        top = stack[-1]
        if stop > start and not top.skip and not top.in_head and top.tag != "head" and not html[start:stop].isspace():
            out.append(["text", top.tag, start, stop, html[start:stop], False, None])

    def close(stop: int) -> None:
        e = stack.pop()
        counts[e.tag] -= 1
        if out and out[-1][0] == "text" and out[-1][2:4] == [e.at, stop]:
            out[-1][5] = True
        if not e.skip and not e.in_head and e.tag != "head" and tags > e.tags and blocks == e.blocks and not (e.tag in PARTS_OF_TEXT and e.in_text):
            raw = html[e.at : stop]
            if raw and not raw.isspace():
                out.append(["element", e.tag, e.at, stop, raw, False, None])

    limit = html.rfind(">") + 1  # no tag ends behind it
    while m := _TOKEN.search(html, pos, limit):
        begin, end = m.span()
        text(pos, begin)
        pos = end
        if m[1]:
            tag = m[1].lower()
            if counts[tag] > 0:
                while stack[-1].tag != tag:
                    close(begin)
                close(begin)
        elif m[2]:
            tag = m[2].lower()
            for open_tag, closers in H.CLOSES.items():
                if counts[open_tag] > 0 and tag in closers:
                    k = len(stack) - 1
                    while k and stack[k].tag != open_tag and stack[k].tag not in H.STOPS[open_tag]:
                        k -= 1
                    if stack[k].tag == open_tag:
                        while len(stack) > k:
                            close(begin)
            tags += 1
            blocks += tag in H.PARTS
            top = stack[-1]
            offset, attrs = m.start(3), []
            for a in _ATTRIBUTE.finditer(m[3]):
                value = a[2] or ""
                attrs.append((a[1].lower(), offset + a.start(2) if a[2] else -1, offset + a.end(2) if a[2] else -1, H.decoded(value[1:-1] if value[:1] in "\"'" else value)))
            own = {k: v for k, _, _, v in reversed(attrs)}
            skip = top.skip or tag in H.OPAQUE or own.get("translate") == "no" or H.NO_TRANSLATE_ATTRIBUTE in own or own.get("id") in H.NO_TRANSLATE_IDS or not set(classes).isdisjoint(own.get("class", "").split())
            in_head = top.in_head or top.tag == "head"
            if not skip:
                if tag == "meta":
                    name = (own.get("name") or own.get("property") or "").lower()
                    content = next((a for a in attrs if a[0] == "content" and a[1] >= 0 and a[3].strip()), None)
                    if name in METAS and name not in seen and content:
                        seen.add(name)
                        out.append(["meta", METAS[name], content[1], content[2], content[3], False, None])
                else:
                    for name, start, stop, value in attrs:
                        if start >= 0 and name in ATTRIBUTES and (not ATTRIBUTES[name] or tag in ATTRIBUTES[name]) and len(value.strip().encode()) > 2:
                            out.append(["attribute", name, start, stop, value.strip(), False, None])
                    if tag == "img" and own.get("src"):
                        out.append(["image", "img", m.end(2), m.end(2), own["src"], False, [dict(zip(("name", "start", "stop", "value"), a)) for a in attrs if a[1] >= 0]])
                    if tag == "a" and re.match(MESSAGE_LINK, own.get("href", "")):
                        href = next(a for a in attrs if a[0] == "href")
                        out.append(["link", "href", href[1], href[2], href[3], False, None])
            if tag not in H.VOID and not m[0].endswith("/>"):
                stack.append(_Open(tag, end, tags, blocks, skip, in_head, top.in_text or top.tag in H.TEXT_BLOCKS))
                counts[tag] += 1
                if tag in _RAW:
                    closed = _RAW[tag].search(html, end)
                    stop = closed.start() if closed else len(html)
                    if tag == "title" and not skip and "title" not in seen and html[end:stop].strip():
                        seen.add("title")
                        out.append(["title", "seo_title", end, stop, H.decoded(html[end:stop]), False, None])
                    pos = stop
    unclosed = html.find("<!--", pos)
    text(pos, unclosed if unclosed >= 0 else len(html))
    while len(stack) > 1:
        close(len(html))
    yield from (tuple(r) for r in out)


_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))
_SLOTS = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("raw", pa.string()), ("whole", pa.bool_()), ("attrs", _ATTRS)])
_SLOTS_DDL = "page_id long, kind string, name string, start int, stop int, raw string, whole boolean, attrs array<struct<name: string, start: int, stop: int, value: string>>"


def slots(pages: DataFrame, no_translate: tuple[str, ...] = ()) -> DataFrame:
    """All places of pages(page_id, html) where a translation may go."""
    return H._rows(pages, lambda h: page_slots(h, no_translate), _SLOTS, _SLOTS_DDL)


# How a translation is written.


def _references(c: Column) -> Column:
    """& as a reference, but where it begins one."""
    return F.regexp_replace(c, r"&(?!#?\w+;)", "&amp;")


def as_text(c: Column) -> Column:
    """A translation between tags: inline markup stays."""
    plain = F.replace(F.replace(_references(c), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(T.has_html(c), c).otherwise(plain)


def as_attribute(c: Column) -> Column:
    """A translation as a quoted value."""
    plain = F.replace(F.replace(F.replace(_references(c), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit('"'), plain, F.lit('"'))


def usable_memory(tm: DataFrame) -> DataFrame:
    """The rows that pages may show, with the columns that all steps need; those that tm lacks are filled in."""
    fill = {"id": F.xxhash64("original_text"), "status": F.lit(1), "updated_at": F.lit(None).cast("timestamp"), "context": F.lit(""), "language_code": F.lit("")}
    rows = tm.withColumns({k: v for k, v in fill.items() if k not in tm.columns}).withColumn("original_text_hash", F.md5("original_text"))
    rows = rows.where((F.col("original_text") != "") & (F.col("translated_text") != ""))
    return rows.select("original_text", "original_text_hash", "translated_text", "language_code", "context", "status", "updated_at", "id")


# The steps. Each gives edits (page_id, start, stop, to, rank) or looks translations up for distinct texts.

_EDIT = ["page_id", "start", "stop", "to", "rank"]


def _edit(rows: DataFrame, to: Column, rank: int) -> DataFrame:
    return rows.select("page_id", "start", "stop", to.alias("to"), F.lit(rank).alias("rank"))


def _by_key(words: DataFrame, key: Column) -> DataFrame:
    """The best translation of each key: by status, date and id."""
    keyed = words.select(F.md5(key).alias("k"), "translated_text", "status", "updated_at", "id")
    return best_per_key(keyed, ["k"], [F.col("status"), F.col("updated_at"), -F.col("id")]).select("k", F.col("translated_text").alias("found"))


def contained(texts: DataFrame, words: DataFrame, script: str | None = None) -> DataFrame:
    """(text, to): texts in which the longest key that they hold is replaced, without regard to case.

    The first n - SLACK_BYTES characters of a key that a text of n characters may hold begin at one of its first places: a
    text brings the hashes of these SLACK_BYTES + 1 parts, a key those of its beginnings for every n that it may meet.
    Texts of fewer than SHORT_CHARS characters bring all parts that are long enough, and keys as short are filed whole.
    """
    cut = texts.select("text").distinct().withColumn("norm", T.normalize_once(F.col("text"))).withColumn("low", F.lower("norm"))
    cut = cut.where((F.octet_length("norm") <= CONTAINED_BYTES) & (F.char_length("low") > 2))
    size, key_size, slack = F.char_length("low"), F.char_length("low_key"), F.lit(SLACK_BYTES)
    hashed = lambda n, part: F.xxhash64(n, part)
    begun = F.transform(F.sequence(F.lit(0), slack), lambda s: hashed(size, F.substring(F.col("low"), s + 1, size - slack)))
    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.least(slack, size - 2)), lambda s: F.transform(F.sequence(F.lit(0), F.least(slack - s, size - 2 - s)), lambda e: hashed(F.lit(0), F.substring(F.col("low"), s + 1, size - s - e)))))
    asked = cut.select("text", "norm", "low", F.explode(F.array_distinct(F.when(size < SHORT_CHARS, parts).otherwise(begun))).alias("h"))
    keyed = words.select(T.normalize_once(F.col("original_text")).alias("key"), "translated_text", "status", "updated_at", "id").withColumn("low_key", F.lower("key"))
    keyed = keyed.where((key_size >= 2) & (F.octet_length("low_key") <= CONTAINED_BYTES))
    keyed = best_per_key(keyed, ["low_key"], [F.col("status"), F.col("updated_at"), -F.col("id")]).select("low_key", "key", F.col("translated_text").alias("found"))
    whole = F.when(key_size < SHORT_CHARS, F.array(hashed(F.lit(0), F.col("low_key")))).otherwise(F.array().cast("array<long>"))
    meets = F.when(key_size + slack >= SHORT_CHARS, F.transform(F.sequence(F.greatest(key_size, F.lit(SHORT_CHARS)), key_size + slack), lambda n: hashed(n, F.substring(F.col("low_key"), F.lit(1), n - slack)))).otherwise(F.array().cast("array<long>"))
    keyed = keyed.withColumn("h", F.explode(F.concat(whole, meets)))
    shown = F.lower("found")
    met = asked.join(keyed, "h").where(F.contains("low", F.col("low_key")) & (F.col("low") != F.col("low_key")) & (F.octet_length("low") <= F.octet_length("low_key") + SLACK_BYTES))
    met = met.dropDuplicates(["text", "low_key"]).where(~F.contains("low", shown) | (shown == F.col("low_key")))
    pattern = F.concat(F.lit("(?iu)\\Q"), F.replace("key", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    written = F.regexp_replace(as_text(F.col("found")), r"([\\$])", r"\\$1")
    made = met.withColumn("to", F.regexp_replace(_references(F.col("norm")), pattern, written)).where(F.col("to") != _references(F.col("norm")))
    if script:
        made = made.where(~P.has_script(F.col("to"), script))
    return made.groupBy("text").agg(F.max_by("to", F.struct(F.octet_length("low_key"), "low_key")).alias("to"))


# Characters that the normalizers make plain one by one, so that offsets stay.
_FOLD = {ord(c): p for cs, p in ((T.DASHES, "-"), (T.DOUBLE_QUOTES, '"'), (T.SINGLE_QUOTES, "'"), ("ё", "е"), ("Ё", "е"), ("\xa0", " ")) for c in cs}


def _folded(text: str) -> str:
    return "".join(low if len(low := c.lower()) == 1 else c for c in text.translate(_FOLD))


def replace_between_tags(raw: str, words: list[tuple[str, str]]) -> str:
    """The keys of words(folded key, replacement) in the texts between tags, longest first; what was put in is not read again."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key, to in words:
        automaton.add_word(key, (len(key), to))
    automaton.make_automaton()

    def piece(text: str) -> str:
        low, inner = _folded(text), text.strip()
        first = text.find(inner)
        hits = sorted(((n, end - n + 1, to) for end, (n, to) in automaton.iter(low)), key=lambda h: (-h[0], h[1]))
        taken, chosen = bytearray(len(text)), []
        for n, start, to in hits:
            if n < FLUSH_CHARS and (start != first or n != len(inner)) or any(taken[start : start + n]):
                continue
            taken[start : start + n] = b"\1" * n
            chosen.append((start, n, to))
        for start, n, to in sorted(chosen, reverse=True):
            text = text[:start] + to + text[start + n :]
        return text

    return "".join(x if x.startswith("<") else piece(x) for x in re.split(r"(<[^>]*>)", raw) if x)


def replace_in_query(href: str, words: list[tuple[str, str]]) -> str:
    """The texts of a message link's query, decoded, translated and encoded again."""
    from urllib.parse import quote, unquote_plus

    def put(m: re.Match) -> str:
        text = unquote_plus(m[2])
        low, done, pos = _folded(text), [], 0
        keys = sorted(words, key=lambda w: (-len(w[0]), w[0]))
        while pos < len(text):
            hit = next(((k, to) for k, to in keys if low.startswith(k, pos)), None)
            done.append(hit[1] if hit else text[pos])
            pos += len(hit[0]) if hit else 1
        return m[1] + quote("".join(done), safe="") if "".join(done) != text else m[0]

    return re.sub(r"([?&][^=&#]+=)([^&#]*)", put, href)


def piecewise(asked: DataFrame, words: DataFrame) -> DataFrame:
    """Elements and links of asked(page_id, start, stop, kind, raw) with every key that they hold replaced, as edits."""
    keyed = _by_text(words)
    shown = F.when(F.col("kind") == "link", F.try_url_decode(F.col("raw"))).otherwise(F.col("raw"))
    named = asked.withColumn("text", F.lower(T.normalize_once(F.coalesce(shown, F.col("raw"))))).where("text != ''")
    # a key that is all of a text is no candidate of contained_keys: a mark behind each text makes it longer
    pairs = M.contained_keys(named.select(F.concat("text", F.lit("\x01")).alias("text")), keyed.select("key")).join(keyed, "key")
    own = pairs.groupBy("text").agg(F.collect_list(F.struct("key", "found")).alias("words"))
    joined = named.withColumn("text", F.concat("text", F.lit("\x01"))).join(own, "text").select("page_id", "start", "stop", "kind", "raw", "words")
    schema = pa.schema([("page_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("to", pa.string()), ("rank", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words = [(_folded(w["key"]), w["found"]) for w in r["words"]]
                if r["kind"] == "link":
                    to = replace_in_query(r["raw"], words)
                    out += [(r["page_id"], r["start"], r["stop"], f'"{escape(to)}"', 3)] if to != r["raw"] else []
                else:
                    to = replace_between_tags(r["raw"], [(k, t if "<" in t else escape(t, quote=False)) for k, t in words])
                    out += [(r["page_id"], r["start"], r["stop"], to, 3)] if to != r["raw"] else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return joined.mapInArrow(run, "page_id long, start int, stop int, to string, rank int")


def _by_text(words: DataFrame) -> DataFrame:
    """(key, found): the best translation of each lower-cased normalized text without markup."""
    keyed = words.where(~T.has_html(F.col("original_text"))).select(F.lower(T.normalize_once(F.col("original_text"))).alias("key"), "translated_text", "status", "updated_at", "id")
    return best_per_key(keyed.where(F.char_length("key") >= 2), ["key"], [F.col("status"), F.col("updated_at"), -F.col("id")]).select("key", F.col("translated_text").alias("found"))


def head_edits(heads: DataFrame, tm: DataFrame) -> DataFrame:
    """Title and meta tags by their page's context if its original is still shown, else anywhere (J20), else by prefix."""
    asked = heads.select("page_id", "start", "stop", "kind", F.col("name").alias("seo"), F.col("raw").alias("original"))
    kinds = asked.select("page_id", F.col("seo").alias("kind"), "original").distinct()
    found = R.seo_text(kinds, tm).select("page_id", F.col("kind").alias("seo"), "original", "translated_text", "found_by")
    rows = asked.join(found, ["page_id", "seo", "original"])
    full = rows.where("found_by != 'none'").withColumn("shown", F.col("translated_text"))

    parts = [F.struct(F.lit(k).alias("no"), F.lit(s).alias("sep"), F.split("original", f"\\Q{s}\\E").alias("xs")) for k, s in enumerate(SEPARATORS)]
    titles = rows.where("found_by = 'none' and seo in ('seo_title', 'og_title')").withColumn("p", F.explode(F.array(*parts))).where("size(p.xs) > 1")
    cuts = titles.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p.xs") - 1))).withColumn("prefix", F.expr("array_join(slice(p.xs, 1, k), p.sep)"))
    known = tm.where("translated_text != original_text").select(F.lower(T.trim(F.col("original_text"))).alias("key"), "translated_text", "status", "updated_at", "id")
    known = best_per_key(known, ["key"], [F.col("status"), F.col("updated_at"), -F.col("id")]).select("key", F.col("translated_text").alias("front"))
    met = cuts.join(known, F.lower(T.trim(F.col("prefix"))) == F.col("key"))
    tail = F.substring(F.col("original"), F.char_length("prefix") + 1, F.char_length("original"))
    best = met.groupBy("page_id", "start", "stop", "kind").agg(F.max_by(F.concat("front", tail), F.struct(-F.col("p.no"), F.col("k"))).alias("shown"))
    both = full.select("page_id", "start", "stop", "kind", "shown").unionByName(best)
    return _edit(both, F.when(F.col("kind") == "title", as_text(F.col("shown"))).otherwise(as_attribute(F.col("shown"))), 0)


def image_edits(images: DataFrame, tm: DataFrame, home: str = "") -> DataFrame:
    """Addresses, source sets, alt and title of images whose hash the memory has."""
    rows = images.withColumn("h", F.md5(U.media_key(F.col("raw"), home))).join(H.media_translations(tm), "h")
    one = lambda name: F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))
    put = lambda name, value: F.when(value.isNotNull() & one(name).isNotNull(), F.struct(one(name)["start"].alias("start"), one(name)["stop"].alias("stop"), as_attribute(value).alias("to")))
    edits = [put(a, F.col("t_src")) for a in ADDRESSES] + [put("srcset", U.rewrite_srcset(one("srcset")["value"], F.col("raw"), F.col("t_src")))]
    for a in ("alt", "title"):
        value = F.col(f"t_{a}")
        new = F.when(value.isNotNull() & one(a).isNull(), F.struct(F.col("start"), F.col("stop"), F.concat(F.lit(f" {a}="), as_attribute(value)).alias("to")))
        edits.append(F.coalesce(put(a, value), new))
    return _edit(rows.select("page_id", F.explode(F.array_compact(F.array(*edits))).alias("e")).select("page_id", "e.*"), F.col("to"), 0)


def edits_of(found: DataFrame, tm: DataFrame, script: str | None = None, home: str = "") -> DataFrame:
    """All edits of slots; found should be a stored table, as several steps read it."""
    memory = stored(usable_memory(tm), "memory")  # rules and keys are Columns of it: computed once each
    technical = lambda c: P.any_of(P.technical_render(F.col(c)))
    words = stored(memory.where(~F.col("context").startswith("media.src") & ~technical("original_text") & ~technical("translated_text")), "words")
    body = found.where("kind in ('text', 'element', 'attribute')")
    asked = body.withColumn("k", F.md5(T.normalize_lookup(F.col("raw")))).join(_by_key(words, T.normalize_lookup(F.col("original_text"))), "k", "left")
    shown = F.when(F.col("kind") == "attribute", as_attribute(F.col("found"))).otherwise(T.carry_blanks(F.col("raw"), as_text(F.col("found"))))
    exact = _edit(asked.where("found is not null"), shown, 1)
    left = asked.where("found is null").drop("k", "found")

    kinds = {r[0] for r in found.select("kind").distinct().collect()}  # seven at most
    made = [exact]
    pieces = found.where("kind = 'link'").select("page_id", "start", "stop", "kind", "raw")
    if "element" in kinds:
        plain = M.plaintext_keys(words).select(F.col("plain_hash").alias("k"), F.col("translated_text").alias("found")).where("k != md5('')")
        plain = best_per_key(plain, ["k"], [F.col("found")])
        elements = left.where("kind = 'element'").withColumn("k", F.md5(T.strip_for_matching(F.col("raw")))).join(plain, "k")
        marked = T.has_html(F.col("found"))
        made.append(_edit(elements.where(marked), T.carry_blanks(F.col("raw"), F.col("found")), 2))
        pieces = pieces.unionByName(elements.where(~marked).select("page_id", "start", "stop", "kind", "raw"))
    if kinds & {"element", "link"}:
        made.append(piecewise(pieces, words))
    if "text" in kinds:
        texts = left.where("kind = 'text' and whole").withColumn("text", F.col("raw"))
        inside = texts.join(contained(texts, words, script), "text")
        made.append(_edit(inside, T.carry_blanks(F.col("raw"), F.col("to")), 4))
    if kinds & {"title", "meta"}:
        made.append(head_edits(found.where("kind in ('title', 'meta')"), memory.where(~F.col("context").startswith("media.src"))))
    if "image" in kinds:
        made.append(image_edits(found.where("kind = 'image'"), memory, home))
    return reduce(DataFrame.unionByName, made)


def merge(html: str | None, edits: list[tuple[int, int, str, int]]) -> tuple[str | None, int]:
    """(page, edits that were made): in order of place; the outer and then the lower rank wins over what it overlaps."""
    if html is None:
        return None, 0
    out, pos, last, made = [], 0, -1, 0
    for start, stop, to, _ in sorted(edits, key=lambda e: (e[0], -e[1], e[3], e[2])):
        if start < pos or start < stop and (start, stop) == last:
            continue
        out += [html[pos:start], to]
        pos, last, made = stop, (start, stop), made + 1
    return "".join([*out, html[pos:]]), made


def apply_edits(pages: DataFrame, edits: DataFrame, counts: DataFrame) -> DataFrame:
    """(page_id, html, n_strings, n_translated) of pages(page_id, html), edits and counts(page_id, n_strings)."""
    own = edits.groupBy("page_id").agg(F.collect_list(F.struct("start", "stop", "to", "rank")).alias("edits"))
    joined = pages.select("page_id", "html").join(own, "page_id", "left").join(counts, "page_id", "left")
    schema = pa.schema([("page_id", pa.int64()), ("html", pa.string()), ("n_strings", pa.int64()), ("n_translated", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in H._slices(batch):
                lists = part.column("edits")
                flat = list(zip(*(c.to_pylist() for c in lists.flatten().flatten())))
                ends = list(accumulate(n or 0 for n in pc.list_value_length(lists).to_pylist()))
                pages_of = zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), [0, *ends], ends, part.column("n_strings").to_pylist())
                out = [(i, *merge(h, flat[a:b]), n or 0) for i, h, a, b, n in pages_of]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(((x[k] for x in out) for k in (0, 1, 3, 2)), schema)], schema=schema)

    return joined.mapInArrow(run, "page_id long, html string, n_strings long, n_translated long")


def localize(pages: DataFrame, tm: DataFrame, no_translate: tuple[str, ...] = (), script: str | None = None, home: str = "") -> DataFrame:
    """(page_id, html, n_strings, n_translated): pages(page_id, html) with the translations of tm put in.

    tm needs original_text and translated_text only; context, status, updated_at and id make the choice finer. Page ids
    should be different: rows of one id get each other's edits otherwise. A null page stays null; an empty one stays empty.
    """
    found = stored(slots(pages, no_translate), "slots")
    counts = found.where("kind in ('text', 'attribute', 'title', 'meta')").groupBy("page_id").agg(F.count("*").alias("n_strings"))
    return apply_edits(pages, edits_of(found, tm, script, home), counts)
