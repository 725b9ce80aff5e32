"""Schemas of the translation memory and of extracted items."""

from __future__ import annotations

from pyspark.sql import types as T

TM = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("original_text", T.StringType(), False),
        T.StructField("original_text_hash", T.StringType(), False),
        T.StructField("translated_text", T.StringType()),
        T.StructField("language_code", T.StringType(), False),
        T.StructField("context", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("gettext_domain", T.StringType()),
        T.StructField("plural_form", T.IntegerType()),
        T.StructField("original_plural", T.StringType()),
        T.StructField("block_type", T.IntegerType()),
        T.StructField("original_id", T.LongType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
ORIGINALS = "id long, original string, created_at timestamp"
ITEM = "page_id long, pass_no int, pos int, type string, field_group string, context string, attribute string, original string, src_hash string"
