"""Lookups with several sources: which one wins, and what stays without one.

Candidates from all sources are one union with a priority; the best per key is an aggregate, so a text that very many
rows share combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import predicates as P
from glossaloom.functions import text as T
from glossaloom.operators.memory import best_per_key, most_trusted, reviewed, usable

# Keys of structured data whose texts are translated, and whose URLs get a language.
GRAPH_TEXTS = ("name", "description", "headline", "articleBody", "caption", "text", "alternateName", "slogan")
GRAPH_URLS = ("url", "urlTemplate", "@id")


def by_priority(candidates: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """The first candidate table that has a key gives its row; within a table the greatest order does."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.withColumn("prio", F.lit(k)) for k, c in enumerate(candidates)])
    return best_per_key(union, keys, [-F.col("prio"), *order])


def page_translation(tm: DataFrame, meta: DataFrame, legacy: DataFrame) -> DataFrame:
    """Per post and language the memory's page rows, else post meta, else the legacy table; empty texts don't count.

    meta and legacy have (post_id, language_code, translated_text).
    """
    own = tm.withColumn("post_id", T.context_post_id(F.col("context"))).where("post_id is not null").select("post_id", "language_code", "translated_text", "id")
    filled = [c.where(F.coalesce("translated_text", F.lit("")) != "") for c in (own, meta.withColumn("id", F.lit(0).cast("long")), legacy.withColumn("id", F.lit(0).cast("long")))]
    return by_priority(filled, ["post_id", "language_code"], [-F.col("id"), F.col("translated_text")]).select("post_id", "language_code", "translated_text", "prio")


def string_translation(texts: DataFrame, tm: DataFrame, page_strings: DataFrame | None = None) -> DataFrame:
    """Technical texts have none; else the latest reviewed row, else any usable one, else a page's own string; the result is checked as well.

    texts(text); page_strings(original_text, translated_text).
    """
    asked = texts.select("text").distinct().where(~P.any_of(P.technical_memory(F.col("text"))))
    rows = tm.select(F.trim("original_text").alias("k"), "translated_text", "updated_at", "id", "status").where(F.coalesce("translated_text", F.lit("")) != "")
    sources = [rows.where(reviewed()), rows.where("status >= 1")]
    if page_strings is not None:
        sources.append(page_strings.select(F.trim("original_text").alias("k"), "translated_text", F.lit(None).cast("timestamp").alias("updated_at"), F.lit(0).cast("long").alias("id"), F.lit(1).alias("status")))
    best = by_priority(sources, ["k"], [F.col("updated_at"), -F.col("id")]).where(~P.any_of(P.technical_memory(F.col("translated_text"))))
    return asked.join(best.select("k", "translated_text", "prio"), F.trim("text") == F.col("k"), "left").drop("k")


def attach(items: DataFrame, tm: DataFrame) -> DataFrame:
    """items(item_id, field_group, context, original, plural_form, language_code) with their translations.

    Media and SEO items match by context, plural items by text and form, all others by text.
    """
    by_context = F.col("field_group").isin("media", "seo_fields")
    plural = ~by_context & F.col("plural_form").isNotNull()
    kind = F.when(by_context, "c").when(plural, "p").otherwise("t")
    key = F.when(by_context, F.col("context")).when(plural, F.concat_ws("|", "plural_form", "original")).otherwise(F.col("original"))
    rows = tm.where(F.coalesce("translated_text", F.lit("")) != "")
    ways = [("c", F.col("context")), ("p", F.when(F.col("plural_form").isNotNull(), F.concat_ws("|", "plural_form", "original_text"))), ("t", F.when(F.col("plural_form").isNull(), F.col("original_text")))]
    keyed = reduce(lambda a, b: a.unionByName(b), [rows.select(F.lit(k).alias("kind"), c.alias("key"), "language_code", "translated_text", "status", "id") for k, c in ways]).where("key is not null")
    best = best_per_key(keyed, ["kind", "key", "language_code"], [F.col("status"), -F.col("id")]).select("kind", "key", "language_code", "translated_text", "status")
    found = items.withColumn("kind", kind).withColumn("key", key).join(best, ["kind", "key", "language_code"], "left")
    state = F.when(F.col("translated_text").isNull(), "pending").otherwise("translated")
    return found.withColumn("state", state).drop("kind", "key", "status")


def attach_forms(items: DataFrame, forms: DataFrame) -> DataFrame:
    """Items with the map of all plural forms; forms(original_text, language_code, forms) as stats.plural_maps gives it."""
    return items.join(forms.select(F.col("original_text").alias("original"), "language_code", "forms"), ["original", "language_code"], "left").withColumn("n_forms", F.coalesce(F.size("forms"), F.lit(0)))


def seo_text(pages: DataFrame, tm: DataFrame) -> DataFrame:
    """A page's SEO text by its own context if the stored original still is what the page shows, else by text anywhere.

    pages(page_id, kind, original): kind is seo_title, meta_description, og_title or og_description.
    """
    own = tm.select(F.col("context").alias("ctx"), T.normalize_seo(F.col("original_text")).alias("shown"), F.col("translated_text").alias("t1"), "id")
    own = best_per_key(own.where("t1 is not null"), ["ctx", "shown"], [-F.col("id")]).select("ctx", "shown", "t1")
    anywhere = most_trusted(tm.where(usable(contexts=False))).select(T.normalize_seo(F.col("original_text")).alias("any"), F.col("translated_text").alias("t2"), "id")
    anywhere = best_per_key(anywhere, ["any"], [-F.col("id")]).select("any", "t2")
    asked = pages.withColumn("ctx", F.concat(F.lit("post_"), "page_id", F.lit("_"), "kind")).withColumn("shown", T.normalize_seo(F.col("original")))
    found = asked.join(own, ["ctx", "shown"], "left").join(anywhere, F.col("shown") == F.col("any"), "left")
    return found.select(*pages.columns, F.coalesce("t1", "t2", "original").alias("translated_text"), F.when(F.col("t1").isNotNull(), "page").when(F.col("t2").isNotNull(), "global").otherwise("none").alias("found_by"))


def merge_page_and_global(tm: DataFrame) -> DataFrame:
    """The dictionary of each page: its own rows before global ones; (post_id, original_text, translated_text)."""
    own = tm.withColumn("post_id", T.context_post_id(F.col("context")))
    pages = own.where("post_id is not null").select("post_id", "original_text", "translated_text", "id")
    shared = own.where(F.col("context").startswith("global_")).select("original_text", "translated_text", "id")
    # one global row a text, or a text of many pages would meet all of its global rows
    spread = pages.select("post_id", "original_text").distinct().join(best_per_key(shared, ["original_text"], [-F.col("id")]), "original_text")
    return by_priority([pages, spread], ["post_id", "original_text"], [-F.col("id")]).select("post_id", "original_text", "translated_text")


def graph_rewriter(words: dict[str, str], prefix: str = ""):
    """J21, X19 as a pandas UDF: translated texts and language-prefixed paths in JSON-LD; what isn't JSON stays. words is one page's or a bounded set."""

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json
        import re

        def walk(x, key=None):
            if isinstance(x, dict):
                return {k: walk(v, k) for k, v in x.items()}
            if isinstance(x, list):
                return [walk(v, key) for v in x]
            if isinstance(x, str) and key in GRAPH_TEXTS:
                return words.get(x, x)
            if isinstance(x, str) and key in GRAPH_URLS and prefix:
                return re.sub(r"^(https?://[^/]+)?/(?!" + re.escape(prefix.strip("/")) + "(?:/|$))", lambda m: f"{m[1] or ''}/{prefix.strip('/')}/", x)
            return x

        def one(text: str) -> str:
            try:
                return json.dumps(walk(json.loads(text)), ensure_ascii=False)
            except ValueError:
                return text

        for part in parts:
            yield part.map(one, na_action="ignore")

    return rewrite


def meta_translations(meta: DataFrame, prefix: str = "_translation_") -> DataFrame:
    """Post meta (post_id, meta_key, meta_value) with a key prefix, as a map per post; of equal keys the greatest value."""
    own = meta.where(F.col("meta_key").startswith(prefix)).withColumn("field", F.substring("meta_key", len(prefix) + 1, 255))
    one = own.groupBy("post_id", "field").agg(F.max("meta_value").alias("value"))
    return one.groupBy("post_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def posts_with_translations(legacy: DataFrame, posts: DataFrame, language: str, most: int | None = None) -> DataFrame:
    """Different posts with a translation, in order of id."""
    own = legacy.where(F.col("language_code") == language).select("post_id").distinct().join(posts, "post_id").orderBy("post_id")
    return own if most is None else own.limit(most)


def already_translated(texts: DataFrame, tm: DataFrame, language: str) -> DataFrame:
    """texts that have a translation in a language, or are one."""
    rows = tm.where((F.col("language_code") == language) & (F.col("status") >= 1) & (F.coalesce("translated_text", F.lit("")) != ""))
    known = rows.select(F.col("original_text").alias("text")).union(rows.select("translated_text"))
    return texts.join(known.distinct(), "text", "left_semi")


def equals_ignoring(c: Column, value: Column, case: bool = True, blanks: bool = True) -> Column:
    """F11, F12."""
    fold = lambda x: F.trim(x) if blanks else x
    return F.lower(fold(c)) == F.lower(fold(value)) if case else fold(c) == fold(value)


def kinds_left(kinds: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """F18."""
    return kinds.where(~F.col("kind").isin(*excluded))


def rescanned(tm: DataFrame, found: DataFrame) -> DataFrame:
    """Gettext rows give way to what a scan found."""
    return tm.where(F.coalesce("source", F.lit("")) != "gettext").unionByName(found, allowMissingColumns=True)


def valid_languages(chosen: DataFrame, registry: DataFrame, default: str) -> DataFrame:
    """chosen(code) that the registry knows, and the default."""
    known = chosen.select("code").join(registry.select("code"), "code", "left_semi")
    return known.union(registry.where(F.col("code") == default).select("code")).distinct()
