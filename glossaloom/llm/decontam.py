"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Every passage of every document is a query. Passages are windows of 2 * L words that start every L words, where L is the
least power of two (64 at least) that holds an item, one run of windows for each class of item lengths; so an item that a
document contains lies whole in some window. An item is retrieved if its BM25 score reaches `ratio` of the score that it
gets from its own words. It counts as leaked if at least `overlap` of the five-word shingles of its question and of its
answer occur in the passage and the half windows around it. The question ends with the last question mark that text
follows, else with the first half of the words.

Items are dealt to blocks of about `block_chars` characters by a hash; BM25 statistics are counted over all items. A task
builds the index of each block and writes it to the shared folder; workers load one block at a time, and each block is a
pass of its own. The driver sees only the blocks' file names. Words are compared in lower case, without punctuation.

Cases: null or empty texts and items match nothing; an item of fewer than five words counts as one shingle per part;
an item text that is repeated is reported for each of its ids; rows of one doc_id are searched apart and give a row
each; a null id stays null; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.llm.common import fresh_dir, open_fs, slices, stored, table

K1, B = 1.2, 0.75
WORD = re.compile(r"\w+")
SHINGLE, LEAST_CLASS, BLOCK_ITEMS = 5, 64, 8
#: Words of a text that are held at once.
_WORDS_AT_ONCE = 200_000
OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, at_word long"


def shingles(words: list, n: int = SHINGLE) -> set[tuple]:
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    words = WORD.findall(text.lower())
    head, mark, tail = text.rpartition("?")
    if not tail.strip():
        head, mark, tail = head.rpartition("?")
    answer = WORD.findall(tail.lower()) if mark else []
    if not answer or len(answer) == len(words):
        return words[: len(words) // 2], words[len(words) // 2 :]
    return words[: len(words) - len(answer)], answer


class Index:
    """Inverted index of the items of one length class.

    A term's postings are grouped by blocks of items: per block the greatest impact, then the items with their impacts.
    """

    def __init__(self, length: int):
        self.length = length
        self.items: list[tuple[int, list[tuple], list[tuple]]] = []
        self.postings: list[tuple[int, int, float]] = []  # term, item, impact
        self.need: list[float] = []

    def seal(self, n_terms: int) -> None:
        term, item, impact = (np.array(c) for c in zip(*self.postings))
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], impact[order]
        block = self.item // BLOCK_ITEMS
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
        self.block, self.block_top = block[first], np.maximum.reduceat(self.impact, first)
        self.block_begin, self.block_size = first, np.diff(np.r_[first, len(term)])
        self.begin = np.searchsorted(term[first], np.arange(n_terms + 1))  # of a term, in the blocks
        self.size = np.diff(np.r_[self.begin, len(first)])
        self.needs = np.array(self.need)
        self.block_need = np.minimum.reduceat(self.needs, np.arange(0, len(self.needs), BLOCK_ITEMS))
        self.least = float(self.needs.min())
        self.bound = np.zeros(n_terms + 1)  # the last for words that no item has
        np.maximum.at(self.bound, term, self.impact)
        del self.postings

    def search(self, passage: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, score) of every item whose score reaches what it needs, for different (passage, term) in rows.

        Block-max WAND, for all passages at once: blocks whose summed greatest impacts can't reach the least that one of
        their items needs are passed over, and only the items of the other blocks are scored.
        """
        n_blocks = len(self.block_need)
        e, row = _ranges(self.begin[term], self.size[term])
        pair = passage[row] * n_blocks + self.block[e]
        pairs, which = np.unique(pair, return_inverse=True)
        reach = np.bincount(which, self.block_top[e]) >= self.block_need[pairs % n_blocks]
        if not reach.any():
            return []
        live = reach[which]
        e, which = e[live], which[live]
        p, row = _ranges(self.block_begin[e], self.block_size[e])
        keys, at = np.unique(which[row] * BLOCK_ITEMS + self.item[p] % BLOCK_ITEMS, return_inverse=True)
        scores = np.bincount(at, self.impact[p])
        found = pairs[keys // BLOCK_ITEMS]
        item = found % n_blocks * BLOCK_ITEMS + keys % BLOCK_ITEMS
        hit = scores >= self.needs[item]
        return list(zip((found[hit] // n_blocks).tolist(), item[hit].tolist(), scores[hit].tolist()))


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges that begin there and are so long, and the range of each."""
    row = np.repeat(np.arange(len(size)), size)
    return np.arange(len(row)) + np.repeat(begin - (np.cumsum(size) - size), size), row


def build_index(items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float, ratio: float) -> tuple[dict[str, int], list[Index]]:
    vocabulary: dict[str, int] = {}
    classes: dict[int, Index] = {}
    # items with the same commonest word, which tells the language, share blocks
    for item_id, text in sorted(items, key=lambda x: (Counter(WORD.findall(x[1].lower())).most_common(1), x)):
        words = WORD.findall(text.lower())
        if not words:
            continue
        length = LEAST_CLASS
        while length < len(words):
            length *= 2
        index = classes.setdefault(length, Index(length))
        own = 0.0
        for word, tf in Counter(words).items():
            t = vocabulary.setdefault(word, len(vocabulary))
            idf = math.log(1 + (n_items - df[word] + 0.5) / (df[word] + 0.5))
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            index.postings.append((t, len(index.items), w))
            own += w
        index.need.append(ratio * own * (1 - 1e-9))
        index.items.append((item_id, *([tuple(vocabulary[x] for x in s) for s in shingles(part)] for part in question_answer(text))))
    for index in classes.values():
        index.seal(len(vocabulary))
    return vocabulary, list(classes.values())


def _blocks(text: str, overlap: int) -> Iterator[tuple[int, list[str]]]:
    """The words of a text in runs that overlap by so many words, with the number of words before each."""
    if len(text) < 4 * _WORDS_AT_ONCE:
        yield 0, WORD.findall(text.lower())
        return
    words, at = [], 0
    for m in WORD.finditer(text.lower()):
        words.append(m[0])
        if len(words) >= _WORDS_AT_ONCE + overlap:
            yield at, words
            at += len(words) - overlap
            words = words[-overlap:]
    yield at, words


def search_text(text: str, vocabulary: dict[str, int], classes: list[Index], overlap: float) -> dict[int, tuple]:
    """Best (score, question overlap, answer overlap, first word of the passage) by id of the leaked items."""
    best: dict[int, tuple] = {}
    widest = 4 * max(c.length for c in classes)
    for before, words in _blocks(text, widest):
        ids = np.array([vocabulary.get(w, -1) for w in words], np.int64)
        if not len(ids) or ids.max() < 0:
            continue
        for index in classes:
            half = index.length
            bound = index.bound
            starts = np.arange(0, len(ids), half)
            sums = np.add.reduceat(bound[ids], starts)
            live = np.flatnonzero(sums + np.r_[sums[1:], 0] >= index.least)
            if not len(live):
                continue
            size = np.minimum(2 * half, len(ids) - live * half)
            place, row = _ranges(live * half, size)
            term = ids[place]
            key = np.unique(live[row[term >= 0]] * len(vocabulary) + term[term >= 0])
            for k, item, score in index.search(key // len(vocabulary), key % len(vocabulary)):
                item_id, question, answer = index.items[item]
                there = shingle_lookup(ids[max(0, (k - 1) * half) : (k + 3) * half].tolist(), question, answer)
                q, a = (sum(s in there for s in part) / len(part) if part else 1.0 for part in (question, answer))
                if q >= overlap and a >= overlap and (item_id not in best or score > best[item_id][0]):
                    best[item_id] = (score, q, a, before + k * half)
    return best


def shingle_lookup(ids: list[int], *parts: list[tuple]) -> set[tuple]:
    """The runs of ids of the lengths that the parts' shingles have."""
    found: set[tuple] = set()
    for n in {len(s) for part in parts for s in part}:
        found |= {tuple(ids[k : k + n]) for k in range(len(ids) - n + 1)}
    return found


def _indexes(items: DataFrame, id_col: str, text_col: str, ratio: float, block_chars: int) -> list[str]:
    """Writes an index per block of items; the files' URIs."""
    spark = items.sparkSession
    items = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n_blocks = max(1, -(-(items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // block_chars))
    items = stored(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))), "items")
    out = pa.schema([("block", pa.int64()), ("word", pa.string()), ("total", pa.int64())])

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for block, text in zip(part.column("block").to_pylist(), part.column("text").to_pylist()):
                    words = WORD.findall(text.lower())
                    different = list(set(words))
                    if words:  # the total stands at one of the words
                        yield pa.RecordBatch.from_arrays([pa.array([block] * len(different), pa.int64()), pa.array(different), pa.array([len(words)] + [0] * (len(different) - 1), pa.int64())], schema=out)

    words = stored(items.select("block", "text").mapInArrow(words_of, "block long, word string, total long"), "item_words")
    total = words.agg(F.sum("total")).first()[0] or 0
    n_items = items.count()
    mean_words = total / n_items if total else 1.0
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    of_block = words.select("block", "word").distinct().join(df, "word")
    folder = fresh_dir(spark, "bm25")

    def build(rows: pa.Table, known: pa.Table) -> pa.Table:
        counts = dict(zip(known.column("word").to_pylist(), known.column("df").to_pylist()))
        index = build_index(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())), counts, n_items, mean_words, ratio)
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        name = f"block-{uuid.uuid4().hex}.index"
        with fs.open_output_stream(f"{path}/{name}") as f:
            f.write(pickle.dumps(index))
        return pa.table({"name": [name]}) if rows.num_rows else pa.table({"name": pa.array([], pa.string())})

    built = items.groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(build, "name string")
    return [f"{folder}/{r['name']}" for r in stored(built, "bm25_files").orderBy("name").collect()]  # a row per block


_LOADED: dict[str, tuple] = {}


def _load(uri: str) -> tuple[dict[str, int], list[Index]]:
    """The index in a file; a worker keeps the last one."""
    if uri not in _LOADED:
        _LOADED.clear()
        fs, path = open_fs(uri)
        with fs.open_input_stream(path) as f:
            _LOADED[uri] = pickle.loads(f.read())
    return _LOADED[uri]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", ratio: float = 0.7, overlap: float = 0.8, block_chars: int = 20_000_000) -> DataFrame:
    """One row per document row and leaked item, with its best passage."""
    queries = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("at_word", pa.int64())])

    def leaks_of(index: str) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, classes = _load(index)
            for batch in batches if classes else ():
                for part in slices(batch, "t"):
                    found = []
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("t").to_pylist()):
                        if text:
                            found += [(doc_id, item, *v) for item, v in search_text(text, vocabulary, classes, overlap).items()]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        return queries.mapInArrow(rows, OUT)

    parts = [leaks_of(index) for index in _indexes(items, item_id_col, item_text_col, ratio, block_chars)]
    leaks = docs.sparkSession.createDataFrame([], OUT)
    for k, part in enumerate(parts):
        leaks = leaks.unionByName(part) if k else part
    return leaks


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", ratio: float = 0.7, overlap: float = 0.8, block_chars: int = 20_000_000) -> DataFrame:
    """The rows of docs, all columns, that leak no item. No join is needed, so rows may share ids."""

    def clean(docs: DataFrame, index: str) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, classes = _load(index)
            for batch in batches:
                for part in slices(batch, text_col):
                    kept = [not (text and classes and search_text(text, vocabulary, classes, overlap)) for text in part.column(text_col).to_pylist()]
                    yield part.filter(pa.array(kept, pa.bool_()))

        return docs.mapInArrow(rows, docs.schema)

    for index in _indexes(items, item_id_col, item_text_col, ratio, block_chars):
        docs = clean(docs, index)
    return docs


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
ORACLES: dict[str, str] = {}
