"""Counts over the translation memory. All are groupings with partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(tm: DataFrame) -> DataFrame:
    """A2, A3: rows and different strings by language and status."""
    return tm.groupBy("language_code", "status").agg(F.count("*").alias("n"), F.countDistinct("original_text_hash").alias("n_strings"))


def coverage_sets(tm: DataFrame) -> DataFrame:
    """A1 to A3 as grouping sets: total, by language, by status."""
    return tm.groupingSets([["language_code"], ["status"], []], "language_code", "status").agg(F.count("*").alias("n"))


def by_kind(tm: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows by the source of their document."""
    from glossaloom.functions.text import context_post_id

    own = tm.withColumn("doc_id", context_post_id(F.col("context"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    return own.join(docs.select("doc_id", F.col("source").alias("kind")), "doc_id").groupBy("kind").agg(F.sum("n").alias("n"))


def domains(tm: DataFrame) -> DataFrame:
    """A5."""
    rows = tm.where("source = 'gettext' and gettext_domain is not null")
    return rows.groupBy("gettext_domain").agg(F.countDistinct("original_text_hash").alias("n_strings"), F.sum(F.when(F.coalesce("translated_text", F.lit("")) != "", 1).otherwise(0)).alias("n_translated"))


def duplicate_groups(tm: DataFrame, least: int = 2) -> DataFrame:
    """Keys with several rows and their ids in order."""
    many = tm.groupBy("original_text_hash", "language_code").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return many.where(F.col("n") >= least)


def plural_completeness(tm: DataFrame) -> DataFrame:
    """A10."""
    rows = tm.where("plural_form is not null")
    return rows.groupBy("original_text_hash", "language_code").agg(F.count("*").alias("forms"), F.sum((F.coalesce("translated_text", F.lit("")) != "").cast("long")).alias("translated"))


def plural_maps(tm: DataFrame) -> DataFrame:
    """Form -> text per string and language, and the last form's text."""
    rows = tm.where("plural_form is not null")
    return rows.groupBy("original_text", "language_code").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("plural_form", "translated_text")))).alias("forms"), F.max_by("translated_text", "plural_form").alias("last_form"))


def completeness_of(maps: DataFrame) -> DataFrame:
    """A10 from the maps of plural_maps: the number of forms, and of those with a text."""
    filled = F.filter(F.map_values("forms"), lambda t: F.coalesce(t, F.lit("")) != "")
    return maps.withColumn("translated", F.size(filled).cast("long")).withColumn("forms", F.size("forms").cast("long"))


def items_by_group(items: DataFrame) -> DataFrame:
    """A11, A12, H22."""
    return items.groupBy("page_id", "field_group", "type").agg(F.count("*").alias("n"))


def unified_structure(tm: DataFrame) -> DataFrame:
    """Per post a map group -> text -> translation; the row with the greatest id wins."""
    from glossaloom.functions.text import parse_context

    rows = tm.select(parse_context(F.col("context")).alias("c"), "language_code", "original_text", F.coalesce("translated_text", "original_text").alias("shown"), "id").where("c.scope = 'post'")
    # a post is the unit of all three groupings, so its texts move once
    rows = rows.select(F.col("c.id").alias("post_id"), F.col("c.grp").alias("grp"), "language_code", "original_text", "shown", "id").repartition("post_id", "language_code")
    last = rows.groupBy("post_id", "grp", "language_code", "original_text").agg(F.max_by("shown", "id").alias("translated"))
    groups = last.groupBy("post_id", "language_code", "grp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("original_text", "translated")))).alias("m"))
    return groups.groupBy("post_id", "language_code").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", F.to_json("m"))))).alias("groups"))
