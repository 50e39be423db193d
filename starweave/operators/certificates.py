"""Key certificates: that a column of a source holds no (typed, non-null) key twice (K2, J6).

A certificate is kept for a loaded source, so that all outputs built from it cause one check job: by the
DataFrame object, and, for a deterministic plan over files, by what it reads: its plan and the path,
length and modification time of each file. A source loaded again from the same unchanged files has the
certificate still; a file that was added, removed or rewritten makes it another source. Only proofs of
uniqueness are kept. They live as long as the session, or the DataFrame if that is all they hang on.
"""

from __future__ import annotations

import hashlib
import weakref
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import SpecError


class DuplicateKeyError(SpecError):
    """A join target holds a key more than once."""


_BY_FRAME: "weakref.WeakKeyDictionary[DataFrame, set]" = weakref.WeakKeyDictionary()
_BY_SNAPSHOT: "weakref.WeakKeyDictionary[SparkSession, set]" = weakref.WeakKeyDictionary()


def snapshot(df: DataFrame) -> str | None:
    """Digest of a deterministic plan and of the files it reads as they are now; None without such files."""
    plan = df._jdf.queryExecution().analyzed()
    files = {unquote(f) for f in df.inputFiles()}
    if not files or not plan.deterministic() or df.isStreaming:
        return None
    spark = df.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    now = []
    for folder in sorted({f.rpartition("/")[0] for f in files}):  # one listing per folder, not one call per file
        path = hadoop.Path(folder)
        for status in path.getFileSystem(conf).listStatus(path):
            name = f"{folder}/{status.getPath().getName()}"
            if name in files:
                now.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    if len(now) < len(files):
        return None
    what = [str(df.semanticHash()), plan.canonicalized().toString(), *sorted(now)]
    return hashlib.sha256("\n".join(what).encode()).hexdigest()


def first_repeated(tagged: list[DataFrame]) -> Row | None:
    """A repeated key of any of the tagged key tables, counted in one job."""
    every, *more = tagged
    for df in more:
        every = every.unionByName(df)
    return every.groupBy("what", "ki", "ks").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).first()


def check_targets(sources: Mapping[str, DataFrame], targets: Mapping[tuple[str, str, str], Column]) -> None:
    """Raise on a repeated key of any target ``(source, column, key type)``, given as its typed key.

    All targets without a certificate share one job: keys tagged by target are counted in one aggregate,
    with partial aggregation, so even a key repeated in a third of the rows is reduced before the
    shuffle, and one row comes back at most.
    """
    snapshots: dict[str, str | None] = {}
    open_targets: dict[tuple[str, str, str], DataFrame] = {}
    for what, key in targets.items():
        name, column, kind = what
        src = sources[name]
        if (column, kind) in _BY_FRAME.get(src, ()):
            continue
        if name not in snapshots:
            snapshots[name] = snapshot(src)
        if (snapshots[name], column, kind) in _BY_SNAPSHOT.get(src.sparkSession, ()):
            _BY_FRAME.setdefault(src, set()).add((column, kind))
            continue
        keys = src.select(key.alias("k"))
        integral = isinstance(keys.schema["k"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        open_targets[what] = keys.filter("k is not null").select(
            F.lit(f"{name}.{column}").alias("what"),
            (F.col("k").cast("bigint") if integral else F.lit(None).cast("bigint")).alias("ki"),
            (F.lit(None).cast("string") if integral else F.col("k")).alias("ks"))
    if not open_targets:
        return
    row = first_repeated(list(open_targets.values()))
    if row is not None:
        raise DuplicateKeyError(f"duplicate key in {row.what}: {row.ki if row.ks is None else row.ks}")
    for name, column, kind in open_targets:
        src = sources[name]
        _BY_FRAME.setdefault(src, set()).add((column, kind))
        # The files as listed before the check: a change during it leaves a snapshot that no later load has.
        if snapshots[name] is not None:
            _BY_SNAPSHOT.setdefault(src.sparkSession, set()).add((snapshots[name], column, kind))
