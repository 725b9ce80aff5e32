"""Pages and localized pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.functions import predicates as P


def read_pages(spark: SparkSession, path: str, valid_only: bool = False, most_chars: int = 100_000_000) -> DataFrame:
    """Pages; valid_only drops fragments and pages beyond the parser's size."""
    pages = spark.read.parquet(path)
    return pages.where(P.valid_page(F.col("html")) & (F.char_length("html") <= most_chars)) if valid_only else pages


def write_localized(pages: DataFrame, path: str) -> None:
    """Partitioned by language."""
    pages.write.mode("overwrite").partitionBy("language_code").parquet(path)
