"""Fill-in-middle transformation of whole texts, cut at code points but moved as bytes.

A buffer of UTF-8 texts has a sparse exception index: for each multibyte character its code-point
position and the excess bytes up to there. Everything between exceptions is ASCII, where a code-point
position is a byte position minus a constant. So a cut in code points becomes a byte cut, and back, by
one ``searchsorted`` over the exceptions and one addition; the texts themselves are only sliced. One
index serves all texts of a buffer, whose cuts are converted together.

Which form a text gets and where it is cut depends on its id alone (SHA-256 of seed and id, by Spark's
own functions), so a recomputed task gives the same rows. Nothing is shuffled, collected or broadcast.

Defined results: a null text is an empty one and stays plain, as does a text that holds a sentinel; a
null id counts as the empty text in the hash; repeated rows are transformed alike; texts of any length
are cut whole; an empty table gives an empty result; other columns of ``docs`` are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starweave.llm.common import documents

#: Marks of the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
_BYTES = 4 << 20  # of text that are cut with one index


class ExceptionIndex:
    """Multibyte characters of a UTF-8 buffer: where each is, and the excess bytes before it."""

    def __init__(self, raw: np.ndarray) -> None:
        self.byte = np.flatnonzero(raw >= 0xC0)
        first = raw[self.byte]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(excess)))
        self.char = self.byte - self.before[:-1]

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """Byte positions of code-point positions."""
        return chars + self.before[np.searchsorted(self.char, chars, side="left")]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Code-point positions of byte positions at character starts."""
        return at - self.before[np.searchsorted(self.byte, at, side="left")]


def buffers(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of rows of a binary column: first row, one past the last, their bytes, the rows' offsets in them."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = memoryview(data) if data is not None else memoryview(b"")
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + _BYTES, side="right")) - 1)
        yield a, b, bytes(raw[at[a]:at[b]]), at[a:b + 1] - at[a]
        a = b


def _cut(sentinels: tuple[bytes, bytes, bytes]):
    p, s, m = sentinels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, at in buffers(batch.column("text")):
                part = batch.slice(a, b - a)
                index = ExceptionIndex(np.frombuffer(raw, dtype=np.uint8))
                start = index.to_chars(at)
                n = np.diff(start)
                h1, h2 = (np.asarray(part.column(c)) % (n + 1) for c in ("h1", "h2"))
                lo, hi = np.minimum(h1, h2), np.maximum(h1, h2)
                cut_lo, cut_hi = index.to_bytes(start[:-1] + lo), index.to_bytes(start[:-1] + hi)
                form = part.column("form").to_pylist()
                out = []
                for f, x, y, z, e in zip(form, at[:-1].tolist(), cut_lo.tolist(), cut_hi.tolist(), at[1:].tolist()):
                    if f == "psm":
                        out.append(b"".join((p, raw[x:y], s, raw[z:e], m, raw[y:z])))
                    elif f == "spm":
                        out.append(b"".join((s, raw[z:e], p, raw[x:y], m, raw[y:z])))
                    else:
                        out.append(raw[x:e])
                plain = np.array([f == "plain" for f in form], dtype=bool)
                yield pa.record_batch([
                    part.column("doc_id"), pa.array(n, pa.int64()), part.column("form"),
                    pa.array(lo, pa.int64(), mask=plain), pa.array(hi - lo, pa.int64(), mask=plain),
                    pa.array(out, pa.binary()),
                ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1",
              plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: doc_id, n (code points), form, prefix_chars, middle_chars, output (text).

    ``plain_percent`` of the ids stay plain; ``spm_percent`` of the others start with the suffix.
    """
    base = documents(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    held = F.lit(False)
    for mark in sentinels:
        held = held | F.contains(text, F.lit(mark))
    form = (F.when((text == "") | held | (h[2] % 100 >= 100 - plain_percent), "plain")
            .when(h[3] % 100 < spm_percent, "spm").otherwise("psm"))
    base = base.select("doc_id", text.cast("binary").alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    out = base.mapInArrow(_cut(tuple(x.encode() for x in sentinels)),
                          "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def _join(sentinels: tuple[bytes, bytes, bytes]):
    p, s, m = sentinels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != "output"]
            for a, b, raw, at in buffers(batch.column("output")):
                part = batch.slice(a, b - a)
                texts, cuts = [], np.zeros((b - a, 2), dtype=np.int64)
                plain = np.zeros(b - a, dtype=bool)
                for i, (form, x, e) in enumerate(zip(part.column("form").to_pylist(), at[:-1].tolist(), at[1:].tolist())):
                    if form == "plain":
                        plain[i] = True
                        texts.append(raw[x:e])
                        continue
                    # A sentinel cannot overlap itself and no text that was cut holds one: the first one found is the mark.
                    second = raw.index(s if form == "psm" else p, x, e)
                    third = raw.index(m, second, e)
                    one, two, middle = raw[x + len(p):second], raw[second + len(s):third], raw[third + len(m):e]
                    prefix, suffix = (one, two) if form == "psm" else (two, one)
                    texts.append(prefix + middle + suffix)
                    cuts[i] = len(prefix), len(prefix) + len(middle)
                whole = np.frombuffer(b"".join(texts), dtype=np.uint8)
                start = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) for t in texts])))[:-1]
                index = ExceptionIndex(whole)
                zero = index.to_chars(start)
                lo, hi = (index.to_chars(start + cuts[:, k]) - zero for k in (0, 1))
                yield pa.record_batch([
                    *(part.column(c) for c in names), pa.array(texts, pa.binary()),
                    pa.array(lo, pa.int64(), mask=plain), pa.array(hi - lo, pa.int64(), mask=plain),
                ], names=[*names, "text", "prefix_chars", "middle_chars"])

    return run


def restore(transformed: DataFrame, *keep: str, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, the columns named in ``keep``, and the text rebuilt from ``output`` and ``form`` with its cuts in code points."""
    own = transformed.select("doc_id", *keep, "form", F.col("output").cast("binary").alias("output"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "output"]
    out = own.mapInArrow(_join(tuple(x.encode() for x in sentinels)),
                         ", ".join([*fields, "text binary", "prefix_chars long", "middle_chars long"]))
    return out.withColumn("text", F.col("text").cast("string"))


def fim_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the form, its cuts, and digests of the output and of the text rebuilt from the output alone."""
    done = transform(docs, id_col, text_col).withColumnsRenamed({"prefix_chars": "prefix", "middle_chars": "middle"})
    done = done.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    back = restore(done, "n", "prefix", "middle", "output_sha256")
    return back.select("doc_id", "n", "form", F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars"),
                       "output_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))
