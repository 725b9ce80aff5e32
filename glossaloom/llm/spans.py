"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences after . ! ? followed by white space, and at line ends. Every run of at least
`least_sentences` consecutive sentences that just reaches `least_words` words, counted from its first sentence or back
from its last, is hashed (96 bits, over lower-cased words). Runs are joined globally: one that occurs in several
documents stays in the first of them, one that occurs again within a document stays where it comes first, and sentences
covered by any other occurrence are removed. So of a repeated passage all whole sentences go, if they make up such a run.

A document is a row, named by its id and a 64-bit hash of its text: documents come in the order of their ids (null last)
and, within an id, of that hash. A run counts in the grouping by its hash with partial aggregates, and its occurrences
meet the repeated hashes in a join that Spark can split, so a very common passage is no bottleneck.

Cases: null and empty texts have no runs; rows of one id with different texts are documents of their own, as are rows
with null ids; rows equal in id and text are one document, so each of them keeps what that document keeps; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.llm.common import slices, stored, table

#: A set of characters first, which lets the search skip what lies between.
END = re.compile(r"[.!?\n](?:(?<=\n)|[.!?]*\s)\s*")
OUT = "doc_id long, text string, n_sentences long, n_removed long, chars_removed long, first_doc_ids array<long>"


def sentence_bounds(text: str) -> list[int]:
    """0, the end of each sentence with the white space after it, in code points."""
    bounds = [0, *(m.end() for m in END.finditer(text))]
    if bounds[-1] < len(text):
        bounds.append(len(text))
    return bounds


def runs(text: str, least_words: int, least_sentences: int) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes]]:
    """Sentence bounds, then first sentence, end (exclusive) and 96-bit hash of each run, by first sentence."""
    from xxhash import xxh3_128_digest

    bounds = sentence_bounds(text)
    low = text.lower()
    same = len(low) == len(text)  # some capitals have longer small forms: then each sentence is lowered by itself
    parts = [low[a:b].split() if same else text[a:b].lower().split() for a, b in zip(bounds, bounds[1:])]
    n = len(parts)
    words = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, n), out=words[1:])
    if words[-1] < least_words:
        return bounds, np.empty(0, np.int64), np.empty(0, np.int64), []
    k = np.arange(n)
    # the first end that leaves enough words and sentences, and the last first sentence that does
    ends = np.maximum(np.searchsorted(words, words[:-1] + least_words), k + least_sentences)
    firsts = np.minimum(np.searchsorted(words, words[1:] - least_words, "right") - 1, k + 1 - least_sentences)
    key = np.unique(np.r_[(k * (n + 1) + ends)[ends <= n], (firsts * (n + 1) + k + 1)[firsts >= 0]])
    first, end = key // (n + 1), key % (n + 1)
    sentences = "\n".join(map(" ".join, parts)).encode().split(b"\n")
    joined = b"\n".join(sentences)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, sentences), np.int64, n) + 1, out=at[1:])
    hashes = [xxh3_128_digest(joined[a:b])[:12] for a, b in zip(at[first].tolist(), (at[end] - 1).tolist())]
    return bounds, first, end, hashes


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k, text): id and k, a hash of the text, name the row."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text"))


def hashed_runs(rows: DataFrame, least_words: int, least_sentences: int) -> DataFrame:
    """(h, g, doc_id, k, first, end): every different run of every row, where it comes first."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("k", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, row_of, firsts, ends = [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    if not text:
                        continue
                    _, first, end, own = runs(text, least_words, least_sentences)
                    kept = list(dict(zip(reversed(own), reversed(range(len(own))))).values())
                    hashes += [own[k] for k in kept]
                    row_of.append(np.full(len(kept), row))
                    firsts.append(first[kept])
                    ends.append(end[kept])
                if hashes:
                    raw, at = np.frombuffer(b"".join(hashes), np.dtype([("h", "<i8"), ("g", "<i4")])), pa.array(np.concatenate(row_of))
                    yield pa.RecordBatch.from_arrays([pa.array(raw["h"].copy()), pa.array(raw["g"].copy()), part.column("doc_id").take(at), part.column("k").take(at), pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32))], schema=schema)

    return rows.mapInArrow(found, "h long, g int, doc_id long, k long, first int, end int")


def _hits(rows: DataFrame, least_words: int, least_sentences: int) -> DataFrame:
    """(doc_id, k, spans, first_docs): the runs of each row that an earlier one has."""
    found = hashed_runs(rows, least_words, least_sentences)
    repeated = found.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1").select("h", "g", "first_doc")
    shared = stored(found.join(repeated, ["h", "g"]), "shared_runs")
    # where several rows have the least id (or none has an id), the first is that of the least text hash
    tied = shared.where("doc_id <=> first_doc").groupBy("h", "g").agg(F.min("k").alias("first_k"), F.max("k").alias("last_k")).where("first_k < last_k").drop("last_k")
    tied = stored(tied, "tied_runs")
    hits = shared.join(tied, ["h", "g"], "left").where("not (doc_id <=> first_doc) or k != first_k")
    return hits.groupBy("doc_id", "k").agg(F.collect_set(F.struct("first", "end")).alias("spans"), F.collect_set("first_doc").alias("first_docs"))


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 20, least_sentences: int = 2, changed_only: bool = True) -> DataFrame:
    """The documents (by default those that lose a sentence) with what is left of their texts."""
    texts = _rows(docs, id_col, text_col)
    hits = _hits(texts, least_words, least_sentences).select(F.col("doc_id").alias("hit_id"), F.col("k").alias("hit_k"), "spans", "first_docs")
    joined = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("k") == F.col("hit_k")), "left").select("doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.end").alias("end"), F.array_sort("first_docs").alias("first_docs"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("chars_removed", pa.int64()), ("first_doc_ids", pa.list_(pa.int64()))])

    def rest(text: str | None, spans: list[tuple[int, int]]) -> tuple:
        if not text:
            return text, 0, 0, 0
        bounds, first, end, own = runs(text, least_words, least_sentences)
        n = len(bounds) - 1
        gone = np.zeros(n + 1, np.int64)
        seen: set[bytes] = set()
        again = [(a, b) for a, b, h in zip(first.tolist(), end.tolist(), own) if h in seen or seen.add(h)]
        for a, b in [*spans, *again]:
            gone[a] += 1
            gone[b] -= 1
        covered = np.cumsum(gone[:n]) > 0
        if not covered.any():
            return text, n, 0, 0
        kept = "".join(text[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(~covered).tolist())
        return kept, n, int(covered.sum()), len(text) - len(kept)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for r in part.to_pylist():
                    kept, n, removed, chars = rest(r["text"], list(zip(r["first"] or [], r["end"] or [])))
                    if removed or not changed_only:
                        out.append((r["doc_id"], kept, n, removed, chars, r["first_docs"] or []))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return joined.mapInArrow(rows, OUT)


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sentence_spans": op8_sentence_spans}
ORACLES: dict[str, str] = {}
