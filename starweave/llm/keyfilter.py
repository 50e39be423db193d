"""A bitmap of keys with a fixed size bound, to drop most rows that cannot join before a shuffle.

It never drops a row that joins; rows that slip through are removed by the join that follows. The
bitmap has sixteen bits a key up to ``MAX_BITS``; past that it lets more rows through, which costs
time and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starweave.llm.shingles import mix

MAX_BITS = 1 << 28  # 32 MB, broadcast
_BLOCK = 1 << 15


def _marks(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                           & np.uint64(bits - 1)).astype(np.int64)
            yield pa.record_batch([pa.array((at // _BLOCK).astype(np.int32)), pa.array((at % _BLOCK).astype(np.int32))],
                                  names=["block", "bit"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for bits in b.column("bits").to_pylist():
            flags = np.zeros(_BLOCK, dtype=np.uint8)
            flags[bits] = 1
            out.append(np.packbits(flags, bitorder="little").tobytes())
        yield pa.record_batch([b.column("block"), pa.array(out, pa.binary())], names=["block", "data"])


class KeyFilter:
    """``keep(values)``: a mask that is true for every key of the table it was made from."""

    def __init__(self, keys: DataFrame) -> None:
        """``keys`` has one long column without nulls; it is read twice, so store it first."""
        bits = _BLOCK
        wanted = 16 * keys.count()
        while bits < min(wanted, MAX_BITS):
            bits *= 2
        marks = keys.mapInArrow(_marks(bits), "block int, bit int")
        blocks = marks.groupBy("block").agg(F.collect_set("bit").alias("bits"))
        data = np.zeros(bits // 8, dtype=np.uint8)
        for row in blocks.mapInArrow(_blocks, "block int, data binary").toLocalIterator():
            at = row.block * (_BLOCK // 8)
            data[at:at + _BLOCK // 8] = np.frombuffer(row.data, dtype=np.uint8)
        self._mask = np.uint64(bits - 1)
        self._data = keys.sparkSession.sparkContext.broadcast(data)

    def keep(self, values: np.ndarray) -> np.ndarray:
        at = mix(values.astype(np.int64).view(np.uint64)) & self._mask
        return (self._data.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def rows(self, df: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be in the table; only the key column goes to Python."""
        @F.pandas_udf("boolean")
        def may(v: pd.Series) -> pd.Series:
            return pd.Series(keep(v.to_numpy()))

        keep = self.keep
        return df.filter(may(F.col(key)))
