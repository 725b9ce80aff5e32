"""Language of whole texts: known words first, character n-grams of falling length for unseen words.

Learned per language from labelled rows: relative frequencies of words and of n-grams (with a space on either side of a
word). A word known in any language scores -log10 of its frequency there, or a penalty where it is absent. An unseen
word is scored by its known n-grams of the greatest length that has any, averaged. The mean over a text's words decides;
`score` is the softmax of the means, weighted by the words up to a limit. The model comes from a sample of whole
labelled texts, chosen by a hash of the id: about `rows_per_lang` rows of each label, and fewer where their texts would
exceed about `chars_per_lang` characters. Every label, and every word and n-gram of the sample, is kept. The model is
sparse: a token's 64-bit hash with the labels that have it and their scores, at most 24 bytes for each (token, label), so
it grows with the number of labels, not with its square. (Two tokens of one length share a hash once in about 10^7 models
of a million tokens.)

Words are letters with the combining marks that follow them.

Cases: null texts and texts without a letter are `und` with score 0, and so is all if nothing could be learned; rows
with null id, text or lang teach nothing; each row of a repeated id has its prediction; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.llm.common import slices, stored, table

WORD = re.compile(r"[^\W\d_]+")
#: Python's \\w leaves out combining marks, which many scripts need.
MARKED_WORD, MARK = regex.compile(r"[^\W\d_][^\W\d_\p{M}]*(?:\p{M}+[^\W\d_\p{M}]*)*"), regex.compile(r"\p{M}")
LONGEST, PENALTY, WEIGHT_WORDS = 5, 7.0, 25
#: Bytes of the score table in a Python worker, and words kept in it.
_TABLE_BYTES, _KEPT_WORDS = 32 << 20, 400_000

#: Of a string's UTF-8, as Spark's xxhash64.
_HASH = xxhash.xxh64_intdigest

_SCORERS: dict[str, "Scorer"] = {}


def _grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[k : k + n] for k in range(len(w) - n + 1)]


def words_of(text: str) -> list[str]:
    low = text.lower()
    return WORD.findall(low) if low.isascii() or not MARK.search(low) else MARKED_WORD.findall(low)


def _counted(rows: DataFrame, keys: list[str], count) -> DataFrame:
    """Sums n by the keys of what count(batch), a Counter over tuples of the keys, finds in Arrow batches."""
    kinds = {"lang": pa.string(), "length": pa.int32(), "token": pa.string()}
    schema = pa.schema([*((k, kinds[k]) for k in keys), ("n", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[0]):
                counter = count(part)
                if counter:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, kinds[k]) for k, c in zip(keys, zip(*counter))), pa.array(counter.values(), pa.int64())], schema=schema)

    out = ", ".join(f"{k} {'int' if k == 'length' else 'string'}" for k in keys) + ", n long"
    return rows.mapInArrow(found, out).groupBy(*keys).agg(F.sum("n").alias("n"))


def _words(part: pa.RecordBatch) -> Counter:
    by_lang: dict[str, Counter] = {}
    for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
        by_lang.setdefault(lang, Counter()).update(words_of(text))
    return Counter({(lang, word): n for lang, own in by_lang.items() for word, n in own.items()})


def _pieces(part: pa.RecordBatch) -> Counter:
    """Each word as the token of length 0, and its n-grams."""
    found: Counter = Counter()
    for word, lang, k in zip(*(part.column(c).to_pylist() for c in ("token", "lang", "n"))):
        found[lang, 0, word] += k
        for n in range(1, LONGEST + 1):
            for gram in _grams(word, n):
                found[lang, n, gram] += k
    return found


def train(labelled: DataFrame, rows_per_lang: int = 2000, chars_per_lang: int = 8_000_000) -> dict:
    """Model of labelled(id, text, lang), of all its labels."""
    sums = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    counts = stored(sums, "labels")  # a table, so that Spark knows its size when it plans the join
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    taken = F.least(F.lit(float(rows_per_lang)) / F.col("rows"), F.lit(float(chars_per_lang)) / F.greatest("chars", F.lit(1)))
    sample = labelled.join(counts, "lang").where(chance < taken).select("text", "lang")
    words = stored(_counted(sample, ["lang", "token"], _words).select("token", "lang", "n"), "words")  # n-grams come from different words, once each
    tokens = _counted(words, ["lang", "length", "token"], _pieces)
    rows = tokens.select("lang", "length", F.xxhash64("token").alias("hash"), "n").toArrow()
    langs = sorted(r["lang"] for r in counts.select("lang").collect())
    label = pc.index_in(rows.column("lang"), pa.array(langs, pa.string())).to_numpy().astype(np.int32)
    return _model(langs, label, *(rows.column(c).to_numpy() for c in ("length", "hash", "n")))


def _model(langs: list[str], label: np.ndarray, length: np.ndarray, code: np.ndarray, n: np.ndarray) -> dict:
    """The sparse model of (label, length, hash, count) entries: hashes of each length (words at 0) with the places of their entries."""
    order = np.lexsort((label, code, length))
    label, length, code, n = label[order], length[order], code[order], n[order].astype(np.float64)
    group = length.astype(np.int64) * max(1, len(langs)) + label
    totals = np.bincount(group, weights=n, minlength=1)
    scores = -np.log10(n / totals[group]) if len(n) else n
    hashes, starts = [], []
    for k in range(LONGEST + 1):
        a, b = np.searchsorted(length, (k, k + 1))
        own, first = np.unique(code[a:b], return_index=True)
        hashes.append(own)
        starts.append(np.append(first + a, b))
    key = xxhash.xxh64_hexdigest(repr(langs).encode() + label.tobytes() + code.tobytes() + scores.tobytes())
    return {"langs": langs, "hashes": hashes, "starts": starts, "labels": label, "scores": scores.astype(np.float32), "key": key}


def model_bytes(model: dict) -> int:
    return sum(x.nbytes for x in (*model["hashes"], *model["starts"], model["labels"], model["scores"]))


class _Rows(dict):
    """Row of the score table by word. Words that the table lacks are added to `over`, at row 0."""

    def __init__(self, scorer: "Scorer", room: int):
        self.scorer, self.room = scorer, room

    def __missing__(self, word: str) -> int:
        self.scorer.over += self.scorer.scores([word])[0]
        return 0


class Scorer:
    def __init__(self, model: dict):
        self.model, n = model, max(1, len(model["langs"]))
        room = max(1000, min(_KEPT_WORDS, _TABLE_BYTES // (4 * n)))
        self.table, self.over, self.rows = np.zeros((room, n), np.float32), np.zeros(n), _Rows(self, room)

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, labels): of the word, else the mean of its known n-grams of the greatest length that has any, else the penalty."""
        n_labels = len(self.model["langs"])
        out, left = np.full((len(words), n_labels), PENALTY), np.arange(len(words))
        for n in (0, *range(LONGEST, 0, -1)):
            known, starts = self.model["hashes"][n], self.model["starts"][n]
            if not len(left) or not len(known):
                continue
            tokens = [[words[k]] if n == 0 else _grams(words[k], n) for k in left]
            owner = np.repeat(np.arange(len(left)), [len(t) for t in tokens])
            codes = np.fromiter((_HASH(g, 42) for t in tokens for g in t), np.uint64).view(np.int64)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            hit = known[at] == codes
            at, owner = at[hit], owner[hit]
            size = starts[at + 1] - starts[at]
            entry = np.arange(size.sum()) + np.repeat(starts[at] - (np.cumsum(size) - size), size)
            place = np.repeat(owner, size) * n_labels + self.model["labels"][entry]
            less = np.bincount(place, weights=self.model["scores"][entry] - PENALTY, minlength=len(left) * n_labels).reshape(-1, n_labels)
            k = np.bincount(owner, minlength=len(left))
            out[left[k > 0]] += less[k > 0] / k[k > 0, None]
            left = left[k == 0]
        return out

    def learn(self, words: set[str]) -> None:
        """Puts new words into the score table, many at once; if they have no room, the table begins anew."""
        new = [w for w in words if w not in self.rows and len(w) <= 40]
        if len(self.rows) + len(new) >= self.rows.room:
            self.rows.clear()
            new = [w for w in words if len(w) <= 40][: self.rows.room - 1]
        step = max(16, (1 << 20) // self.table.shape[1] // 8)
        for k in range(0, len(new), step):
            part, first = new[k : k + step], len(self.rows) + 1
            self.table[first : first + len(part)] = self.scores(part)
            self.rows.update(zip(part, range(first, first + len(part))))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [words_of(t) if t else [] for t in texts]
        if self.model["langs"]:
            self.learn(set().union(*words))
        return list(map(self._best, words))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self._best(words_of(text) if text else [])

    def _best(self, words: list[str]) -> tuple[str, float]:
        if not self.model["langs"] or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        self.over[:] = 0
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int32, len(words))
        mean = (self.table[rows].sum(axis=0, dtype=np.float64) + self.over) / len(words)
        best = int(mean.argmin())
        odds = np.exp((mean[best] - mean) * np.log(10) * min(len(words), WEIGHT_WORDS))
        return self.model["langs"][best], float(1 / odds.sum())


def scorer(model: dict) -> Scorer:
    if model["key"] not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model["key"]] = Scorer(model)
    return _SCORERS[model["key"]]


def learnable(id_col: Column) -> Column:
    """Of which documents the language may be learned; the others are held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) != 1, F.lit(False))


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> dict:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return train(rows.where(learnable(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull()), **bounds)


def predict_languages(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of columns of these names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared.value)
        for batch in batches:
            for part in slices(batch, text_col):
                found = own.predict_all(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(rows, schema)


def op3_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_languages(docs.select("doc_id", "text"), train_on(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_word_backoff_langid": op3_word_backoff_langid}
ORACLES: dict[str, str] = {}
