"""Document log-likelihood under a gated recurrent language model and a smoothed unigram model.

1. Word counts over all training documents, by a 64-bit hash of the word: tasks add up their own
   words first, then one aggregate gives every word's count, the number of tokens and of types.
2. Every text is written once as model words: the ``WORDS`` most frequent words, one of which stands
   for all others. Training and scoring read these.
3. A recurrent model with a class-factored softmax over the model words is trained by truncated
   backpropagation. The rounds' texts are disjoint shares, picked by a hash of the id, that make up
   all training documents; a round's texts are dealt by hash into shards of about ``SHARD_TOKENS``
   tokens, in order of id within. Every shard starts from the round's model, and the mean of the
   shards' models, weighted by tokens and taken block by block in two steps, starts the next round.
   Shards do not depend on how the input is partitioned, so neither do scores, up to rounding.
4. Every text is scored whole; the state is carried from window to window. A word outside the
   model's words has the probability of "other" times its smoothed share of all other words.

Counts of the ``HEAD`` most frequent words are broadcast (a bound in bytes); the remaining words of
each text go through a join with the count table, so every count is exact at any vocabulary size.

Defined results: a null text is empty and is scored as the end token alone; rows without an id are
scored, not learned from; with nothing to learn from, counts are zero; repeated rows are scored one
by one; an empty table gives an empty result. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starweave.llm.common import documents, fold, stored
from starweave.llm.gru import Gru

CLASSES, WIDTH, HIDDEN = 32, 32, 16
WORDS = CLASSES * WIDTH
HEAD = 200_000  # words, about, whose counts are broadcast: 3.2 MB
ROUNDS = (1, 9, 90)  # percent of the training documents in each round: all of them
SHARD_TOKENS = 2_000_000
STREAMS = 256
_END = -1  # the end token's key; word keys are hashes of words
_BLOCK = 4096  # parameters averaged by one task
_DISTINCT = 500_000  # words whose counts a task keeps, about


class WordIds:
    """Words as numbers, for a few texts at a time: ``keys[number]`` is the word's key, 0 the end token.

    Each call numbers its own distinct words, so a word of two calls has two numbers. No table of words
    is kept: hashing a distinct word of a call costs less than looking it up.
    """

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.keys = np.array([_END], dtype=np.int64)

    def numbers(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The words of each text, A-Z lower-cased, and the end token."""
        # Large strings: a batch of long texts may exceed 2 GB. The kernels look at bytes only.
        # A new array, not a slice: the cast of a slice mixes up its bytes.
        plain = pa.array([t or b"" for t in texts], pa.large_binary())
        plain = pc.ascii_lower(plain.cast(pa.large_string(), safe=False))
        split = pc.ascii_split_whitespace(plain)
        words = split.flatten()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
        real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # none before or after outer spaces
        text = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
        size = np.bincount(text[real], minlength=len(split))
        numbers = np.insert(coded.indices.to_numpy()[real].astype(np.int64) + len(self.keys), np.cumsum(size), 0)
        self.keys = np.concatenate([self.keys, keys.view(np.int64)])
        return np.split(numbers, np.cumsum(size + 1)[:-1])


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    key, n = key[n > 0], n[n > 0]
    by = np.argsort(key)
    key = key[by]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else by
    return key[at], np.add.reduceat(n[by], at) if len(at) else n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = WordIds()
    keys, counts, size = [], [], 0

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys[0]), pa.array(counts[0])], names=["key", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            ids.reset()
            got = ids.numbers(batch.column("text").slice(at, 512).to_pylist())
            keys.append(ids.keys)
            counts.append(np.bincount(np.concatenate(got), minlength=len(ids.keys)))
            size += len(ids.keys)
            if size > 2 * _DISTINCT:
                keys, counts = ([x] for x in _added(keys, counts))
                size = len(keys[0])
                if size > _DISTINCT:
                    yield rows()
                    keys, counts, size = [], [], 0
    if keys:
        keys, counts = ([x] for x in _added(keys, counts))
        yield rows()


class Lexicon:
    """The most frequent keys with their counts, and the number of tokens and types in training."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens: int, types: int) -> None:
        """``keys`` most frequent first."""
        by = np.argsort(keys)
        self.keys, self.counts = keys[by], counts[by]
        self.tokens, self.types = tokens, types
        # Model words: 0 .. WORDS-1 by count, one of them "other".
        top = min(WORDS - 1, len(keys))
        inside = counts[:top]
        self.other_tokens, self.other_types = tokens - int(inside.sum()), types - top
        n = np.zeros(WORDS, dtype=np.int64)
        n[:top], n[top] = inside, self.other_tokens
        order = np.argsort(-n, kind="stable")
        place = np.empty(WORDS, dtype=np.int64)
        place[order] = np.arange(WORDS)
        self.model_counts, self.other = n[order], int(place[top])
        word = np.full(len(keys), self.other, dtype=np.int64)
        word[:top] = place[:top]
        self.word = word[by]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the lexicon, is it there) of each key."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), dtype=bool)

    def words(self, keys: np.ndarray) -> np.ndarray:
        """Model words of the keys."""
        at, there = self.find(keys)
        return np.where(there, self.word[at], self.other) if len(self.keys) else np.full(len(keys), self.other)

    @property
    def end(self) -> int:
        return int(self.words(np.array([_END]))[0])

    def state(self) -> tuple:
        return tuple(self.__dict__.items())

    @classmethod
    def of(cls, state: tuple) -> Lexicon:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out


def lexicon(training: DataFrame) -> tuple[DataFrame, Lexicon]:
    """The table of all counts ``(key, n)``, and its head."""
    counts = training.select("text").mapInArrow(_counts, "key long, n long")
    counts = stored(counts.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    # The head is what lies above one count, so that tasks send their share of it and nothing else.
    above = 0
    if size.types > HEAD:
        above = counts.agg(F.percentile_approx("n", 1 - HEAD / size.types, 1_000_000).alias("n")).first().n
    head = counts.filter(F.col("n") > above).toPandas().sort_values(["n", "key"], ascending=[False, True])
    return counts, Lexicon(head["key"].to_numpy(np.int64), head["n"].to_numpy(np.int64), size.tokens, size.types)


_WORDS = ("doc_id long, held_out boolean, words binary, n_tokens long, head_known long, base_log double, "
          "other_log double, n_other long, tail array<long>")


def _encoded(lex_state):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon.of(lex_state.value)
        ids, log = WordIds(), np.log10(lex.counts + 0.5)
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                ids.reset()
                texts, rows = ids.numbers(part.column("text").to_pylist()), []
                at, there = lex.find(ids.keys)
                place = np.where(there, at, -1)  # of each number in the lexicon, -1 for what it lacks
                for numbers in texts:
                    at = place[numbers]
                    there = at >= 0
                    words = np.full(len(at), lex.other)
                    words[there] = lex.word[at[there]]
                    other = words == lex.other
                    rows.append((words.astype("<u2").tobytes(), len(at), int(there.sum()), float(log[at[there]].sum()),
                                 float(log[at[there & other]].sum()), int(other.sum()), ids.keys[numbers[~there]]))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("held_out"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                    names=["doc_id", "held_out", "words", "n_tokens", "head_known", "base_log", "other_log", "n_other", "tail"])

    return run


def _training(end: int, params):
    def model_of(shard: int, model: Gru, seen: int) -> pa.RecordBatch:
        flat = model.to_array()
        cut = range(0, len(flat), _BLOCK)
        return pa.record_batch([
            pa.array([shard] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()),
            pa.array([float(seen)] * len(cut), pa.float64()), pa.array([flat[a:a + _BLOCK].tobytes() for a in cut], pa.binary()),
        ], names=["shard", "block", "weight", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model, seen, buffer, size = None, None, 0, [], 0

        def learn() -> None:
            nonlocal seen, buffer, size
            if buffer:
                model.train(np.concatenate(buffer).astype(np.int64), end, STREAMS)
            seen, buffer, size = seen + size, [], 0

        for batch in batches:
            for shard, words in zip(batch.column("shard").to_pylist(), batch.column("words").to_pylist()):
                if shard != now:
                    learn()
                    if seen:
                        yield model_of(now, model, seen)
                    now, model, seen = shard, Gru(CLASSES, WIDTH, HIDDEN).load(params.value), 0
                buffer.append(np.frombuffer(words, "<u2"))
                size += len(buffer[-1])
                if size > 200_000:
                    learn()
        learn()
        if seen:
            yield model_of(now, model, seen)

    return run


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("shard")
    weight = rows["weight"].to_numpy()
    data = np.stack([np.frombuffer(b, dtype=np.float32) for b in rows["data"]])
    mean = (data * (weight / weight.sum())[:, None]).sum(axis=0).astype(np.float32)
    return pd.DataFrame({"shard": rows["group"].iloc[:1].to_numpy(), "block": rows["block"].iloc[:1].to_numpy(),
                         "weight": [weight.sum()], "data": [mean.tobytes()]})


def train(training: DataFrame, lex: Lexicon) -> np.ndarray:
    """Parameters of the model after all rounds over ``training(doc_id, words)``."""
    sc = training.sparkSession.sparkContext
    params = Gru(CLASSES, WIDTH, HIDDEN, lex.model_counts).to_array()
    place, lo = F.pmod(F.xxhash64("doc_id"), F.lit(100)), 0
    kinds = "shard long, block int, weight double, data binary"
    for share in ROUNDS:
        shards = max(1, -(-lex.tokens * share // (100 * SHARD_TOKENS)))
        part = training.filter((place >= lo) & (place < lo + share)).select(
            "doc_id", "words", F.pmod(F.xxhash64(F.lit(share), "doc_id", "words"), F.lit(shards)).alias("shard"))
        lo += share
        part = part.repartition(min(shards, 10_000), "shard").sortWithinPartitions("shard", "doc_id", "words")
        models = part.select("shard", "words").mapInArrow(_training(lex.end, sc.broadcast(params)), kinds)
        models = models.withColumn("group", F.pmod("shard", F.lit(math.isqrt(shards) + 1)))
        models = models.groupBy("block", "group").applyInPandas(_mean, kinds).withColumn("group", F.lit(0).cast("long"))
        mean = models.groupBy("block").applyInPandas(_mean, kinds).select("block", "data").collect()  # one model
        if mean:
            params = np.concatenate([np.frombuffer(r.data, np.float32) for r in sorted(mean, key=lambda r: r.block)])
    return params


def _scores(params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Gru(CLASSES, WIDTH, HIDDEN).load(params.value)
        for batch in batches:
            for part in (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048)):
                texts = [np.frombuffer(w, "<u2") for w in part.column("words").to_pylist()]
                score = pa.array(model.score(texts) / np.log(10), pa.float64())
                yield part.drop_columns(["words"]).append_column("model_log", score)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5,
                    held: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    base = documents(docs, id_col, text_col)
    base = base.select("doc_id", F.col("text").cast("binary").alias("text"), fold(base, modulus, held).alias("held_out"))
    training = base.filter("not held_out and doc_id is not null")
    counts, lex = lexicon(training)
    sc = docs.sparkSession.sparkContext
    texts = stored(base.mapInArrow(_encoded(sc.broadcast(lex.state())), _WORDS)
                   .withColumn("rid", F.monotonically_increasing_id()), "model-words")
    params = train(texts.filter("not held_out and doc_id is not null").select("doc_id", "words"), lex)
    rows = texts.select("rid", "doc_id", "held_out", "n_tokens", "head_known", "base_log", "other_log", "n_other",
                        F.size("tail").alias("n_tail"), "words")
    kinds = T.StructType([*(f for f in rows.schema if f.name != "words"), T.StructField("model_log", T.DoubleType())])
    rows = stored(rows.mapInArrow(_scores(sc.broadcast(params)), kinds), "scores")
    # Words beyond the head: each text's occurrences meet the exact counts. None of them is frequent.
    tail = texts.select("rid", F.explode("tail").alias("key")).groupBy("key", "rid").agg(F.count("*").alias("k"))
    found = tail.join(counts, "key").groupBy("rid").agg(
        F.sum("k").alias("known"), F.sum(F.col("k") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))).alias("gain"))
    zero = F.lit(0)
    total, other = lex.tokens + 0.5 * (lex.types + 1), lex.other_tokens + 0.5 * (lex.other_types + 1)
    unseen = F.col("n_tail") * F.log10(F.lit(0.5))  # every tail word as if unseen; ``gain`` corrects the seen
    gain = F.coalesce("gain", F.lit(0.0)) + unseen
    return rows.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", zero)).cast("long").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") + gain - F.col("n_tokens") * F.log10(F.lit(total))).alias("base_score"),
        (F.col("model_log") + F.col("other_log") + gain - F.col("n_other") * F.log10(F.lit(other))).alias("score"))
