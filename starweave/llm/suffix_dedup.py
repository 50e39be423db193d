"""Exact removal of repeated 100-byte strings by hashed names at sampled anchors.

This stands in for prefix doubling: a string is known by a name, a 64-bit rolling hash of its bytes
made within its text. Strings of 56 bytes are named at anchors and counted by Spark once; those whose
name is unique in the corpus leave; the others get a longer name once, that of their context or of
100 bytes. There are no rank pairs, and no rounds over growing lengths. Exact up to hash collisions.

Three things keep this far below one row per byte and round, without losing a match:

* Anchors. Every 100-byte string holds 45 strings of 56 bytes; the one with the smallest hash
  (leftmost on ties) is its anchor. Equal strings have equal anchors at equal places, so only
  anchors are named first, about one byte in 23. A string whose anchor is unique
  occurs once.
* Contexts. An anchor's context is all bytes of the 100-byte strings that can hold it. If two
  anchors have equal contexts, all strings around the later one start earlier too. If all anchors
  of one name have one context, nothing else need be looked at.
* Only strings around the anchors left over are named at 100 bytes and compared one by one.

Names are grouped by partial counts and minimums, never in lists, so a passage that a third of all
documents share costs one row per map task and group. A bitmap of bounded size drops most unique
anchors before the join that returns the counts.

Defined results: a null text is empty; a text under 100 bytes loses nothing; equal rows (same id
and text) are one document and get the same result; texts that share an id, or have none, are
ordered by id (nulls last), then md5; an empty table gives an empty result. Texts of any length are
worked through in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starweave.llm.common import col, documents, fresh, quoted, stored
from starweave.llm.keyfilter import KeyFilter
from starweave.llm.shingles import mix

LENGTH = 100  # bytes of a string that may not repeat
GRAM = 56  # bytes of an anchor (32 to 64): long enough that few repeat by chance
_SPAN = LENGTH - GRAM  # an anchor starts 0 to this many bytes after its string
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_POS = 24  # bits of a position inside a buffer
_PACK = 1 << 16  # short texts are worked on together, about this many bytes at a time
_BLOCK = 1 << 22  # long texts are worked on in blocks of this many string starts


class Buffer:
    """Some texts, or a block of one, as one byte array, with the names of 32, 64 and 100 bytes.

    ``parts`` lists (text number, first byte of the text here, position of that byte in the text,
    length of the whole text, first and one past the last string start that this buffer covers).
    """

    def __init__(self, data: bytes, parts: list[tuple[int, int, int, int, int, int]]) -> None:
        self.parts = parts
        h = np.frombuffer(data, dtype=np.uint8).astype(_U)
        h += _U(1)
        power, names, width = _P, {}, 1
        with np.errstate(over="ignore"):
            while width < 64:  # names double
                h = h[:-width] * power + h[width:]
                power, width = power * power, width * 2
                if width in (4, 32, 64):
                    names[width] = h
        self.h4, self.h32, self.h64 = names[4], names[32], names[64]
        with np.errstate(over="ignore"):
            self.grams = mix(self.h32[:len(self.h32) - GRAM + 32] * _P + self.h32[GRAM - 32:])
        key = (self.grams >> _U(_POS)) << _U(_POS)
        key |= np.arange(len(key), dtype=_U)
        width = 1
        while width * 2 <= _SPAN + 1:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        rest = _SPAN + 1 - width
        if rest:
            key = np.minimum(key[:-rest], key[rest:])
        self.anchor = (key & _U((1 << _POS) - 1)).astype(np.int64)  # per string start

    def runs(self):
        """Per part: (text number, shift, text length, first starts of runs, ends of runs, anchors).

        ``shift`` turns a buffer position into a text position; a run is the consecutive string
        starts that share an anchor, in buffer positions.
        """
        for number, at, pos, size, lo, hi in self.parts:
            shift = pos - at
            a = self.anchor[lo - shift:hi - shift]
            cut = np.flatnonzero(a[1:] != a[:-1]) + 1
            first = np.concatenate([[0], cut])
            last = np.concatenate([cut, [len(a)]])
            yield number, shift, size, first + lo - shift, last + lo - shift, a[first]

    def gram(self, anchors: np.ndarray) -> np.ndarray:
        return self.grams[anchors].view(np.int64)

    def context(self, anchors: np.ndarray, shift: int, size: int) -> np.ndarray:
        """Name of the bytes of all strings that can hold the anchor, within the text."""
        c0 = np.maximum(anchors - _SPAN, -shift)
        c1 = np.minimum(anchors + LENGTH, size - shift)
        mid = np.minimum(c0 + 64, c1 - 64)
        with np.errstate(over="ignore"):
            x = mix(self.h64[c0] + ((c1 - c0) << 8).astype(_U))
            x = mix(x * _P + self.h64[mid])
            x = mix(x * _P + self.h64[c1 - 64] + (anchors - c0).astype(_U))
        return x.view(np.int64)

    def string(self, starts: np.ndarray) -> np.ndarray:
        """Name of the 100 bytes at each start."""
        with np.errstate(over="ignore"):
            x = mix(self.h64[starts] + _U(LENGTH))
            x = mix(x * _P + self.h32[starts + 64])
            return mix(x * _P + self.h4[starts + 96]).view(np.int64)


def buffers(texts: list[bytes | None]) -> Iterator[Buffer]:
    """The texts of 100 bytes or more: short ones packed together, long ones in overlapping blocks."""
    data, parts, size = [], [], 0
    for number, t in enumerate(texts):
        n = len(t) if t else 0
        if n < LENGTH:
            continue
        if n - LENGTH >= _BLOCK:
            for lo in range(0, n - LENGTH + 1, _BLOCK):
                hi = min(lo + _BLOCK, n - LENGTH + 1)
                a, b = max(0, lo - 2 * LENGTH), min(n, hi + 3 * LENGTH)
                yield Buffer(t[a:b] + bytes(128), [(number, 0, a, n, lo, hi)])
            continue
        data.append(t)
        parts.append((number, size, 0, n, 0, n - LENGTH + 1))
        size += n
        if size >= _PACK:
            yield Buffer(b"".join([*data, bytes(128)]), parts)
            data, parts, size = [], [], 0
    if data:
        yield Buffer(b"".join([*data, bytes(128)]), parts)


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name of every anchor."""
    for b in _chunks(batches):
        out = [buf.gram(anchors) for buf in buffers(b.column("text").to_pylist())
               for _, _, _, _, _, anchors in buf.runs()]
        if out:
            yield pa.record_batch([pa.array(np.concatenate(out))], names=["gram"])


def _anchors(repeated: KeyFilter):
    """Anchors whose names may repeat; ``again`` marks a context that the same text holds before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            order = b.column("ord").to_numpy()
            found: dict[int, list[tuple[np.ndarray, ...]]] = {}
            for buf in buffers(b.column("text").to_pylist()):
                for number, shift, size, _, _, anchors in buf.runs():
                    gram = buf.gram(anchors)
                    keep = repeated.keep(gram)
                    if keep.any():
                        at = anchors[keep]
                        found.setdefault(number, []).append((gram[keep], buf.context(at, shift, size), at + shift))
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for number, parts in found.items():
                gram, ctx, pos = (np.concatenate(x) for x in zip(*parts))
                pos, once = np.unique(pos, return_index=True)  # blocks of a long text share their edges
                gram, ctx = gram[once], ctx[once]
                again = np.ones(len(ctx), dtype=bool)
                again[np.unique(ctx, return_index=True)[1]] = False
                for c, x in zip(cols, (gram, ctx, np.full(len(pos), order[number]), pos, again)):
                    c.append(x)
            if cols[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in cols],
                                      names=["gram", "ctx", "ord", "pos", "again"])

    return run


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts ``a`` and names of the strings around the open anchors. A string that the text holds
    before is not named again: such strings come out as spans a to b (``name`` null)."""
    for b in _chunks(batches):
        texts = b.column("text").to_pylist()
        order = b.column("ord").to_pylist()
        todo = [np.array(p, dtype=np.int64) for p in b.column("open").to_pylist()]
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for buf in buffers(texts):
            for number, shift, _, first, last, anchors in buf.runs():
                pick = np.isin(anchors + shift, todo[number])
                if pick.any():
                    size = (last - first)[pick]
                    starts = np.repeat(first[pick] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    found.setdefault(number, []).append((starts + shift, buf.string(starts)))
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for number, parts in found.items():
            starts, name = (np.concatenate(x) for x in zip(*parts))
            head = np.zeros(len(name), dtype=bool)
            head[np.unique(name, return_index=True)[1]] = True
            rows = [(starts[head], starts[head] + LENGTH, name[head], False)]
            if not head.all():
                x, y = _merged(starts[~head], starts[~head] + LENGTH)
                rows.append((x, y, np.zeros(len(x), dtype=np.int64), True))
            for x, y, n, known in rows:
                for c, v in zip(cols, (np.full(len(x), order[number]), x, y, n, np.full(len(x), known))):
                    c.append(v)
        if cols[0]:
            full = [np.concatenate(c) for c in cols]
            yield pa.record_batch([pa.array(full[0]), pa.array(full[1].astype(np.int32)),
                                   pa.array(full[2].astype(np.int32), mask=~full[4]), pa.array(full[3], mask=full[4])], names=["ord", "a", "b", "name"])


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as disjoint maximal runs."""
    by = np.argsort(starts, kind="stable")
    a, b = starts[by], np.maximum.accumulate(ends[by])  # ends so far
    head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return a[head], b[np.concatenate([head[1:] - 1, [len(a) - 1]])]


def _cut(text: bytes, spans: list, whole_characters: bool) -> tuple[bytes, int, int]:
    if not spans:
        return text, 0, 0
    x = np.array([(s["a"], s["b"]) for s in spans], dtype=np.int64)
    a, b = _merged(x[:, 0], np.minimum(x[:, 1], len(text)))
    out, at, removed, runs = [], 0, 0, 0
    for s, e in zip(a.tolist(), b.tolist()):
        if whole_characters:  # a character that is only partly covered stays
            while s < e and text[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                e -= 1
            if e <= s:
                continue
        out.append(text[at:s])
        removed, at, runs = removed + e - s, e, runs + 1
    out.append(text[at:])
    return b"".join(out), removed, runs


def _results(whole_characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            kept = [_cut(t, s, whole_characters) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield pa.record_batch([
                b.column("ord"), pa.array([r for _, r, _ in kept], pa.int64()),
                pa.array([n for _, _, n in kept], pa.int64()),
                pa.array([t if whole_characters else hashlib.sha256(t).hexdigest().encode() for t, _, _ in kept], pa.binary()),
            ], names=["ord", "n_removed", "n_spans", "kept"])

    return run


def _ordered(df: DataFrame, id_col: str, digest: str, out: str) -> DataFrame:
    """Add ``out``, the text's place in the order of documents: the id itself if it can serve."""
    ids = df.select(F.col(id_col).alias("i"), F.col(digest).alias("g")).distinct()
    shape = ids.agg(F.count("*").alias("n"), F.count_distinct("i").alias("ids")).first()
    if shape.n == shape.ids:
        return df.withColumn(out, F.col(id_col))
    ranked = ids.orderBy(F.col("i").asc_nulls_last(), "g").rdd.zipWithIndex()
    ranked = stored(ranked.map(lambda x: (x[0][0], x[0][1], x[1])).toDF("i long, g binary, ord long"), "order")
    i, g = fresh(df.columns, "i"), fresh(df.columns, "g")
    ranked = ranked.select(F.col("i").alias(i), F.col("g").alias(g), F.col("ord").alias(out))
    return df.join(ranked, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(digest) == F.col(g))).drop(i, g)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``(ord, spans)`` of ``texts(ord, text)``: for each text with any, spans whose union is every
    byte of a 100-byte string that also starts earlier."""
    grams = texts.select("text").mapInArrow(_grams, "gram long")
    repeats = stored(grams.groupBy("gram").agg(F.count("*").alias("n_gram")).filter("n_gram > 1"), "grams")
    rows = texts.select("ord", "text").mapInArrow(_anchors(KeyFilter(repeats.select("gram"))),
                                                  "gram long, ctx long, ord long, pos long, again boolean")
    rows = stored(rows, "anchors")
    contexts = rows.groupBy("gram", "ctx").agg(F.count("*").alias("n_ctx"), F.min("ord").alias("first_ord"))
    contexts = stored(contexts.join(repeats, "gram").select("ctx", "n_ctx", "first_ord", "n_gram"), "contexts")
    rows = rows.join(contexts, "ctx").select(
        "ord", "pos", (F.col("again") | (F.col("first_ord") < F.col("ord"))).alias("later"),
        (F.col("n_ctx") < F.col("n_gram")).alias("open"))
    rows = stored(rows.filter("later or open"), "ranked")
    known = rows.filter("later").select("ord", F.greatest(F.col("pos") - _SPAN, F.lit(0)).cast("int").alias("a"),
                                        (F.col("pos") + LENGTH).cast("int").alias("b"))
    todo = stored(rows.filter("not later").groupBy("ord").agg(F.collect_list("pos").alias("open")), "open-anchors")
    some = KeyFilter(todo.select("ord")).rows(texts.select("ord", "text"), "ord")
    strings = stored(some.join(todo, "ord").select("ord", "text", "open")
                     .mapInArrow(_strings, "ord long, a int, b int, name long"), "strings")
    named = strings.filter("name is not null")
    names = named.groupBy("name").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    names = stored(names.filter("first_ord < last_ord").select("name", "first_ord"), "names")
    later = KeyFilter(names.select("name")).rows(named, "name").join(names, "name").filter("ord > first_ord")
    spans = known.unionAll(strings.filter("name is null").select("ord", "a", "b")).unionAll(
        later.select("ord", "a", (F.col("a") + LENGTH).alias("b")))
    return stored(spans.groupBy("ord").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = documents(docs, id_col, text_col)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return _ordered(base.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("digest")),
                    "doc_id", "digest", "ord")


def _cut_texts(texts: DataFrame, spans: DataFrame, whole_characters: bool) -> DataFrame:
    """What is left of each text that has spans; other texts are mostly dropped before the shuffle."""
    hit = KeyFilter(spans.select("ord")).rows(texts, "ord").join(spans, "ord").select("ord", "text", "spans")
    schema = "ord long, n_removed long, n_spans long, kept binary"
    return stored(hit.mapInArrow(_results(whole_characters), schema).dropDuplicates(["ord"]), "cut")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents, their texts without the repeated bytes, with all their columns.

    A character that is only partly covered stays whole, so the texts remain valid; a text may
    become empty.
    """
    i, g, o, x, k = (fresh(docs.columns, n) for n in ("id", "digest", "ord", "bytes", "kept"))
    mine = [F.col(quoted(c)) for c in docs.columns]
    text = F.coalesce(col(docs, text_col).cast("string"), F.lit("")).cast("binary")
    df = docs.select(*mine, col(docs, id_col).cast("long").alias(i), F.unhex(F.md5(text)).alias(g))
    df = _ordered(df, i, g, o)
    texts = df.select(F.col(o).alias("ord"),
                      F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary").alias("text"))
    cut = _cut_texts(texts, repeated_spans(texts), True).select(F.col("ord").alias(o), F.col("kept").cast("string").alias(k))
    new = F.coalesce(F.col(k), F.col(quoted(text_col)).cast("string")).alias(text_col)
    return df.join(cut, o, "left").select(*(new if c == text_col else F.col(quoted(c)) for c in docs.columns))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    base = _base(docs, id_col, text_col)
    texts = base.select("ord", "text")
    cut = _cut_texts(texts, repeated_spans(texts), False)
    whole = base.select("doc_id", "ord", F.octet_length("text").cast("long").alias("n_bytes"),
                        F.sha2("text", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return whole.join(cut, "ord", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce(F.col("kept").cast("string"), "whole").alias("kept_sha256"))
