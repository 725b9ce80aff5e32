"""Cross-language search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions.text import context_post_id


def parse_terms(query: str, least: int = 2) -> list[str]:
    """N11 for a query string on the driver."""
    query = re.sub(r"\s+", " ", query.strip())
    terms = re.findall('"([^"]+)"', query) + re.sub('"[^"]+"', "", query).split(" ")
    return [t for t in terms if len(t) >= least]


def all_terms(c: Column, terms: list[str], ci: bool = False) -> Column:
    """a literal substring for every term; ci compares in lower case."""
    own = F.lower(c) if ci else c
    return reduce(lambda a, b: a & b, (F.contains(own, F.lit(t.lower() if ci else t)) for t in terms), F.lit(True))


def search(tm: DataFrame, docs: DataFrame, query: str, language: str, ci: bool = False) -> DataFrame:
    """Ids of documents whose translation in a language or whose own text has all terms."""
    terms = parse_terms(query)
    if not terms:
        return docs.select("doc_id").limit(0)
    translated = tm.where((F.col("language_code") == language) & all_terms(F.col("translated_text"), terms, ci)).select(context_post_id(F.col("context")).alias("doc_id")).where("doc_id is not null")
    published = translated.distinct().join(docs.select("doc_id"), "doc_id", "left_semi")
    own = docs.where(all_terms(F.col("text"), terms, ci)).select("doc_id")
    return published.union(own).distinct()


def within(ids: DataFrame, hits: DataFrame) -> DataFrame:
    """U2."""
    return ids.intersect(hits)
