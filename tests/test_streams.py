"""Runs that stop and go on, state with a time to live, and saved strings on a partitioned memory."""

from __future__ import annotations

import os
import shutil
import time

from pyspark.sql import functions as F

from glossaloom.operators import memory as M
from glossaloom.streaming import lookups as SL

DDL = "page_id long, text string"


def source(spark, folder, files):
    for k in range(files):
        spark.createDataFrame([(k, f"t{k}"), (k, f"u{k}")], DDL).coalesce(1).write.mode("append").parquet(str(folder))


def test_a_stopped_run_goes_on(spark, tmp_path):
    source(spark, tmp_path / "in", 5)
    stream = SL.table_stream(spark, str(tmp_path / "in"), DDL, files_per_trigger=1)
    query = SL.start(stream, str(tmp_path / "run"))
    while query.isActive and not os.path.exists(tmp_path / "run/checkpoint/commits/0"):
        time.sleep(0.005)
    query.stop()  # after one batch, or in the middle of a later one
    before = len([f for f in os.listdir(tmp_path / "run/checkpoint/commits") if f.isdigit()])
    assert before >= 1
    rows = SL.resume(stream, str(tmp_path / "run")).collect()
    assert sorted(r.text for r in rows) == sorted(x + str(k) for k in range(5) for x in "tu")
    assert SL.resume(stream, str(tmp_path / "run")).count() == 10  # nothing new, nothing twice
    source(spark, tmp_path / "in", 1)
    assert SL.resume(stream, str(tmp_path / "run")).count() == 12


def test_a_batch_that_was_not_committed_is_made_again(spark, tmp_path):
    source(spark, tmp_path / "in", 3)
    stream = SL.table_stream(spark, str(tmp_path / "in"), DDL, files_per_trigger=1)
    SL.resume(stream, str(tmp_path / "run"))
    commits = tmp_path / "run/checkpoint/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (str(last), f".{last}.crc"):
        if os.path.exists(commits / f):
            os.remove(commits / f)
    source(spark, tmp_path / "in", 1)
    assert sorted(r.text for r in SL.resume(stream, str(tmp_path / "run")).collect()) == ["t0", "t0", "t1", "t2", "u0", "u0", "u1", "u2"]


def test_progress(spark, tmp_path):
    source(spark, tmp_path / "in", 4)
    query = SL.start(SL.table_stream(spark, str(tmp_path / "in"), DDL, files_per_trigger=1), str(tmp_path / "run"))
    query.awaitTermination()
    assert [p[1:] for p in SL.progress(query, 8) if p[1]] == [(2, 25), (4, 50), (6, 75), (8, 100)]
    assert SL.progress(query, 0)[-1][2] == 100


def test_strings_are_asked_once_within_their_time(spark, tmp_path):
    seen = lambda *rows: spark.createDataFrame(rows, "page_id long, text string, at long").select("page_id", "text", F.timestamp_seconds("at").alias("seen_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    (tmp_path / "in").mkdir()
    stream = SL.table_stream(spark, str(tmp_path / "in"), "page_id long, text string, seen_at timestamp")
    asked = SL.asked_once(stream, "1 hour")
    h, t = 3600, 1_700_000_000
    seen((1, "a", t), (1, "a", t + 5), (2, "a", t))
    assert SL.resume(asked, str(tmp_path / "run")).count() == 2
    seen((1, "a", t + h // 2), (1, "b", t + h // 2))
    assert SL.resume(asked, str(tmp_path / "run")).count() == 3  # answered half an hour ago
    seen((3, "later", t + 5 * h))
    SL.resume(asked, str(tmp_path / "run"))
    seen((1, "a", t + 6 * h))
    assert sorted((r.page_id, r.text) for r in SL.resume(asked, str(tmp_path / "run")).collect()) == [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "later")]


TM = "id long, original_text string, original_text_hash string, translated_text string, language_code string, context string, source string, gettext_domain string, plural_form int, original_plural string, block_type int, original_id long, status int, updated_at timestamp"
EDITS = "id long, original_text string, translated_text string, language_code string, context string, source string, gettext_domain string, updated_at timestamp"


def memory(spark, rows):
    """rows(id, text, translation, language, context, source)."""
    frame = spark.createDataFrame([(i, o, t, lang, c, s, "d", None, None, 0, None, 3, None) for i, o, t, lang, c, s in rows], TM.replace("original_text_hash string, ", "").replace("updated_at timestamp", "at string"))
    return frame.withColumn("original_text_hash", F.md5("original_text")).withColumn("updated_at", F.lit("2020-01-01").cast("timestamp")).select(*[c.split()[0] for c in TM.split(", ")])


ROWS = [(1, "Hi", "a", "de", "p", "custom"), (2, "Hi", "b", "de", "g1", "gettext"), (3, "Hi", "c", "de", "g2", "gettext"), (4, "Hi", "d", "fr", "g1", "gettext"), (5, "Ho", "e", "de", "g1", "gettext"), (6, "Hi", "f", "es", "q", "custom"), (7, "Hi", "h", "de", None, "custom")]


def edits(spark, rows):
    made = spark.createDataFrame([(100 + k, *r) for k, r in enumerate(rows)], EDITS.replace("updated_at timestamp", "at long"))
    return made.select(*[c.split()[0] for c in EDITS.split(", ")[:-1]], F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("updated_at"))


def brief(frame):
    return sorted((r.id, r.translated_text, r.language_code, r.context, r.status) for r in frame.collect())


def test_saved_strings_reach_gettext_rows(spark):
    tm = memory(spark, ROWS)
    got = brief(M.save_strings(tm, edits(spark, [("Hi", "old", "de", "p", "custom", None, 1), (" <b>Hi</b> ", "n<i>e</i>w ", "de", "p", "custom", None, 2), ("Hi", "own", "de", "g2", "gettext", "d", 3), ("New", "neu", "de", "x", "custom", None, 1), ("Hi", "none", "de", None, "custom", None, 1)])))
    assert got == sorted([(1, "new", "de", "p", 2), (2, "new", "de", "g1", 1), (3, "own", "de", "g2", 2), (4, "d", "fr", "g1", 3), (5, "e", "de", "g1", 3), (6, "f", "es", "q", 3), (7, "none", "de", None, 2), (103, "neu", "de", "x", 2)])
    only_gettext = brief(M.save_strings(tm, edits(spark, [("Hi", "own", "de", "g2", "gettext", "d", 3)])))
    assert [r for r in only_gettext if r[4] != 3] == [(3, "own", "de", "g2", 2)]
    assert brief(M.save_strings(tm, edits(spark, []))) == brief(tm) and M.save_strings(tm.limit(0), edits(spark, [])).count() == 0


def test_only_edited_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "tm")
    memory(spark, ROWS).write.partitionBy("language_code").parquet(path)
    files = lambda lang: sorted((f, os.stat(f"{path}/language_code={lang}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/language_code={lang}"))
    before = {x: files(x) for x in ("de", "fr", "es")}
    assert M.save_to(path, edits(spark, [("Hi", "neu", "de", "p", "custom", None, 1)])) == ["de"]
    assert files("fr") == before["fr"] and files("es") == before["es"] and files("de") != before["de"]
    got = brief(spark.read.parquet(path))
    assert (1, "neu", "de", "p", 2) in got and (2, "neu", "de", "g1", 1) in got and len(got) == 7
    shutil.rmtree(path)
