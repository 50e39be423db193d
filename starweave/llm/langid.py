"""Language identification, word first: known words score by their per-language log frequency, unseen
words by the longest character n-grams that are known, falling back to shorter ones.

Training counts words per language on Spark over a bounded sample of labelled documents (about
``SAMPLE_PER_LANGUAGE`` of each language, picked by a hash of the id, whole texts) and keeps the
most frequent ``WORDS_PER_LANGUAGE`` words of each; n-gram counts come from those words. Both bounds
are parameters of the classifier. The model is a few megabytes and is broadcast.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows without id or
label are not learned from; if nothing can be learned every text is ``und``; ties go to the first
language by name; repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starweave.llm.common import documents, fold

SAMPLE_PER_LANGUAGE = 5_000
WORDS_PER_LANGUAGE = 30_000
NGRAMS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
_SMOOTH = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; empty if the text has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(w.isalpha() for w in found) else []


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between boundary marks."""
    marked = f"\x02{word}\x03"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies per language of words and of n-grams by length."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        """``counts``: language to word to count."""
        self.languages = sorted(counts)
        self.words = self._table(counts)
        self.grams: dict[int, dict[str, np.ndarray]] = {}
        for n in NGRAMS:
            by: dict[str, dict[str, int]] = {}
            for lang, ws in counts.items():
                c: Counter = Counter()
                for w, k in ws.items():
                    for g in grams(w, n):
                        c[g] += k
                by[lang] = c
            self.grams[n] = self._table(by)

    @classmethod
    def of(cls, state: tuple) -> Model:
        """The model of a ``state``: plain data, as broadcast."""
        model = cls.__new__(cls)
        model.languages, model.words, model.grams = state
        return model

    @property
    def state(self) -> tuple:
        return self.languages, self.words, self.grams

    def _table(self, counts: dict[str, dict[str, int]]) -> dict[str, np.ndarray]:
        keys = sorted(set().union(*counts.values())) if counts else []
        x = np.array([[counts[lang].get(k, 0) for lang in self.languages] for k in keys], dtype=np.float64)
        if not len(keys):
            return {}
        x = np.log((x + _SMOOTH) / (x.sum(axis=0) + _SMOOTH * len(keys)))
        return dict(zip(keys, x - x.max(axis=1, keepdims=True)))

    def score(self, word: str) -> np.ndarray:
        """Log likelihood of the word per language, relative to the best."""
        known = self.words.get(word)
        if known is not None:
            return known
        for n in NGRAMS:
            found = [v for v in map(self.grams[n].get, grams(word, n)) if v is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages))


class _Scores(dict):
    """Word to its row in ``rows``; emptied between texts when it holds too many words."""

    LIMIT = 300_000

    def __init__(self, model: Model) -> None:
        super().__init__()
        self._model = model
        self._size = 0
        self.rows = np.zeros((1024, max(1, len(model.languages))))

    def __missing__(self, word: str) -> int:
        if self._size == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self._size] = self._model.score(word)
        self[word] = self._size
        self._size += 1
        return self._size - 1

    def shrink(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()
            self._size = 0


def predict(model: Model, text: str | None, cache: _Scores) -> tuple[str, float]:
    found = words(text)
    if not found or not model.languages:
        return UNKNOWN, 0.0
    cache.shrink()
    at = np.fromiter(map(cache.__getitem__, found), dtype=np.int64, count=len(found))
    total = cache.rows[at].sum(axis=0)
    best = int(total.argmax())
    return model.languages[best], float(1 / np.exp(total - total[best]).sum())


def _predictions(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value)
        cache = _Scores(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [predict(model, t, cache) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"),
                                       pa.array([g for g, _ in got], pa.string()),
                                       pa.array([s for _, s in got], pa.float64())],
                                      names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words per language, added up within the task."""
    by: dict[str, Counter] = defaultdict(Counter)

    def rows() -> pa.RecordBatch:
        out = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
        by.clear()
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))],
                               names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by[lang].update(words(text))
            if sum(map(len, by.values())) > 400_000:
                yield rows()
    if any(by.values()):
        yield rows()


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, keep: int = WORDS_PER_LANGUAGE) -> Model:
    """Learn from ``labelled(doc_id, text, lang)``."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    # A row is in the sample if its hash, as a fraction, is below its language's share.
    share = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30))
    sample = labelled.join(F.broadcast(sizes), "lang").filter(share * F.col("rows") < per_language)
    counts = sample.select("lang", "text").mapInArrow(_counts, "lang string, word string, n long")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= keep)
    by: dict[str, dict[str, int]] = defaultdict(dict)
    for r in top.select("lang", "word", "n").toLocalIterator():
        by[r.lang][r.word] = r.n
    return Model(dict(by))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", modulus: int = 5, held: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Held-out documents, whose crc32 of
    the id modulo ``modulus`` is ``held``, are not learned from."""
    base = documents(docs, id_col, text_col, lang_col)
    base = base.select("doc_id", "text", F.col(lang_col).cast("string").alias("lang"),
                       fold(base, modulus, held).alias("held_out"))
    model = train(base.filter("not held_out and doc_id is not null and lang is not null and text is not null"))
    shared = docs.sparkSession.sparkContext.broadcast(model.state)
    return base.select("doc_id", "text", "held_out").mapInArrow(
        _predictions(shared), "doc_id long, held_out boolean, lang_pred string, score double")
