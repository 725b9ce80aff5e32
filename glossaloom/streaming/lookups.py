"""Streams of strings and pages against the translation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.functions import text as T
from glossaloom.operators import rewrite as RW
from glossaloom.operators.memory import best_per_key
from glossaloom.session import shared_dir


def lookup_stream(strings: DataFrame, tm: DataFrame, text_col: str = "text") -> DataFrame:
    """A stream joined with the best translation per normalized text. The memory is a static side; no state is kept."""
    keyed = tm.select(F.md5(T.normalize_dynamic(F.col("original_text"))).alias("h"), "translated_text", "status", "updated_at", "id")
    best = best_per_key(keyed, ["h"], [F.col("status"), F.col("updated_at"), -F.col("id")]).select("h", "translated_text")
    return strings.withColumn("h", F.md5(T.normalize_dynamic(F.col(text_col)))).join(best, "h", "left").drop("h")


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString()) if single else reader.parquet(path)


def start(stream: DataFrame, folder: str, partition_by: tuple[str, ...] = ()):
    """A run over everything that has arrived, kept in a folder of its own: its rows, and the checkpoint that says which files they cover.

    Started again with the same folder, after an end, a stop or a loss, it goes on where it was: a batch whose rows were
    written but not committed is made again from the same files and takes their place. The caller awaits the query.
    """
    return stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").partitionBy(*partition_by).trigger(availableNow=True).start()


def resume(stream: DataFrame, folder: str) -> DataFrame:
    """Runs `start` to its end; all rows that the folder then holds, those of former runs included."""
    start(stream, folder).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_available(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Everything that has arrived, once, in a fresh folder; to go on with a run, use `resume`."""
    return resume(stream, shared_dir(spark, label))


def progress(query, total: int) -> list[tuple[int, int, int]]:
    """(batch, rows so far, percent of total) of a query's batches, as long as it remembers them."""
    done, out = 0, []
    for p in query.recentProgress:
        done += p["numInputRows"]
        out.append((p["batchId"], done, round(100 * done / total) if total else 100))
    return out


def asked_once(strings: DataFrame, ttl: str, keys: tuple[str, ...] = ("page_id", "text"), time_col: str = "seen_at") -> DataFrame:
    """The strings of a stream that weren't asked for within the time to live: only these need a lookup.

    State is one entry per string, kept until the watermark is past its time and the TTL, so it is bounded by what arrives
    within a TTL (a cache of 1, 12 or 24 hours).
    """
    return strings.withWatermark(time_col, ttl).dropDuplicatesWithinWatermark(list(keys))


def localize_stream(pages: DataFrame, tm: DataFrame, path: str, checkpoint: str, files_per_trigger: int | None = None):
    """Batches of page fragments, translated and appended; the caller awaits the query."""

    def one(batch: DataFrame, batch_id: int) -> None:
        RW.localize(batch, tm).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
