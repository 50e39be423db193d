"""Packing documents into token sequences by cutting-stock column generation.

A document's ids and one end id are cut into whole sequences and a rest. The histogram of piece
lengths, in units of ``UNIT`` ids, is a cutting-stock problem of fixed size: patterns say which
lengths share a sequence. Column generation solves its linear program on the driver (knapsack
dynamic programming prices new patterns), patterns are rounded down, and what is left is packed
first-fit by length. Only that histogram leaves the executors, never rows.

Patterns then become sequences: the pieces of one length are ranked across the cluster, and rank r
of a length goes to the r-th slot that the patterns have for it. Ranks come from counts per
(length, bucket), so a length that a third of all pieces have is spread over many tasks.

Defined results: a null or empty text is the end id alone; repeated rows and ids are packed each;
null ids pass through; an empty table gives an empty result. Texts of any length are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starweave.llm.common import documents, stored
from starweave.llm.tokens import ByteBpe

LENGTH = 2048  # ids of a sequence
END_ID = 1
UNIT = 8  # ids; piece lengths are rounded up to it when patterns are made
_BUCKET_ROWS = 2_000  # pieces ranked by one task at a time


# ---- the linear program, over a histogram of fixed size -------------------------------------

def knapsack(value: np.ndarray, width: np.ndarray, room: int) -> np.ndarray:
    """Counts of each item that fit into ``room`` and are worth most (items may repeat)."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    order = np.argsort(width, kind="stable")
    w, v = width[order], value[order]
    fit = np.searchsorted(w, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c], pick[c] = best[c - 1], -1
        if fit[c]:
            worth = best[c - w[:fit[c]]] + v[:fit[c]]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], pick[c] = worth[i], i
    counts = np.zeros(len(width), dtype=np.int64)
    c = room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= w[pick[c]]
    return counts


def patterns(need: np.ndarray, room: int, rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each width 1 to ``room``) with how often to use them; they cover ``need`` exactly."""
    width = np.flatnonzero(need)
    if not len(width):
        return []
    b = need[width].astype(float)
    width = width + 1
    columns = np.diag(room // width).astype(float)  # one width per pattern
    inverse = np.diag(1 / columns.diagonal())
    x = inverse @ b
    for _ in range(rounds):
        price = inverse.sum(axis=0)  # every pattern costs one sequence
        new = knapsack(price, width, room).astype(float)
        if price @ new <= 1 + 1e-9:
            break
        step = inverse @ new
        up = step > 1e-12
        ratio = np.full(len(x), np.inf)
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        x -= ratio[out] * step
        x[out] = ratio[out]
        columns[:, out] = new
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    used = np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)
    cols = columns.astype(np.int64)
    left = need[width - 1] - cols @ used
    while (left < 0).any():  # rounding error of the solver: give the excess back
        j = int(np.flatnonzero((cols[left.argmin()] > 0) & (used > 0))[0])
        used[j] -= 1
        left += cols[:, j]
    found: dict[tuple, int] = {}
    for j in np.flatnonzero(used):
        found[tuple(cols[:, j])] = found.get(tuple(cols[:, j]), 0) + int(used[j])
    while left.any():  # first fit, longest first, as often as it can be repeated
        space, counts = room, np.zeros(len(width), dtype=np.int64)
        for i in range(len(width) - 1, -1, -1):
            counts[i] = min(left[i], space // width[i])
            space -= counts[i] * width[i]
        times = int((left[counts > 0] // counts[counts > 0]).min())
        left -= counts * times
        found[tuple(counts)] = found.get(tuple(counts), 0) + times
    out = []
    for counts, times in found.items():
        full = np.zeros(room, dtype=np.int64)
        full[width - 1] = counts
        out.append((full, times))
    return out


def slots(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(width, first rank, one past the last rank, pieces per sequence, first sequence) of each use."""
    out, sequence, ranks = [], 0, {}
    for counts, times in plan:
        for w in np.flatnonzero(counts):
            a, n = ranks.get(w, 0), int(counts[w])
            out.append((int(w) + 1, a, a + n * times, n, sequence))
            ranks[w] = a + n * times
        sequence += times
    return out


# ---- pieces and their places ----------------------------------------------------------------

def _pieces(vocabulary, length: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(vocabulary.value)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = bpe.encode(text) + end
                    n = len(ids) // 4
                    for a in range(0, n, length):
                        piece = ids[4 * a:4 * (a + length)]
                        rows.append((doc, a, len(piece) // 4, zlib.crc32(piece), n, *([piece] if keep_ids else [])))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
                kinds = [pa.int64()] * 5 + [pa.binary()] * keep_ids
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         end_id: int = END_ID, unit: int = UNIT, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``vocabulary`` is the path of a byte-level BPE ``tokenizer.json`` that the driver can read; its
    content is sent to the executors. ``keep_ids`` adds each piece's ids, little-endian 32-bit.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    base = documents(docs, id_col, text_col)
    pieces = stored(base.mapInArrow(_pieces(content, length, end_id, keep_ids), schema), "pieces")
    room = length // unit
    width = F.least(F.ceil(F.col("length") / unit), F.lit(room)).cast("int")
    by_width = pieces.groupBy(width.alias("w")).agg(F.count("*").alias("n")).collect()  # at most ``room`` rows
    need = np.zeros(room, dtype=np.int64)
    for r in by_width:
        need[r.w - 1] = r.n
    rows = slots(patterns(need, room))
    table = spark.createDataFrame(rows, "w int, lo long, hi long, per long, first long")

    buckets = max(1, int(need.sum()) // _BUCKET_ROWS)
    pieces = pieces.withColumn("w", width).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = pieces.groupBy("w", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("w").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("w", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    here = Window.partitionBy("w", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("k", F.row_number().over(here)).join(sizes, ["w", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("k") - 1)
    # ``slots`` has at most about ``room`` squared rows, whatever the number of documents.
    placed = ranked.join(F.broadcast(table), "w").filter("rank >= lo and rank < hi")
    placed = placed.select(*columns, (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")))
                           .cast("long").alias("sequence_id"))
    placed = stored(placed, "placed")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
