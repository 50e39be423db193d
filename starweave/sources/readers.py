"""Dataset sources: catalog tables, CSV, Parquet and folders of files.

Every reader returns a lazy DataFrame. Column pruning and predicate pushdown reach the scan
because callers only ``select``/``filter`` afterwards; nothing here reads rows on the driver.
CSV is the exception the format forces: ``inferSchema`` runs one scan job. Pass ``schema``
to skip it on large inputs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.spec import ImportSpec, SpecError
from .folders import is_partitioned, read_folder

# Source kinds a dataset may name.
FORMATS = ("table", "csv", "parquet")


def read_dataset(spark: SparkSession, ref: str, fmt: str = "parquet", recursive: bool = False,
                 schema: T.StructType | str | None = None) -> DataFrame:
    """Load one dataset.

    ``fmt``: ``"table"`` (catalog name, possibly qualified, or a Delta table's storage path),
    ``"csv"`` (header row, types inferred unless ``schema`` is given) or ``"parquet"``. With
    ``recursive=True`` a folder is read as one table: every file with the format's extension
    below it, at any depth; names starting with ``_`` or ``.`` are skipped by Spark's file index. Files
    of a folder may differ in columns and types (``sources.folders``) unless ``schema`` is given.
    """
    if fmt == "table":
        if recursive:
            raise ValueError("recursive applies to file formats only")
        if "/" in ref:
            # A table's storage path rather than a catalog name: read it as a Delta table
            # (the Delta jar must be on the classpath, as it is wherever such tables live).
            return spark.read.format("delta").load(ref)
        return spark.read.table(ref)
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; expected one of {FORMATS}")
    if recursive and schema is None:
        return read_folder(spark, ref, fmt)
    reader = spark.read
    if recursive:
        # The extension in any case. A folder of partition folders (key=value) keeps its partition
        # columns; any other folder is read at all depths.
        reader = reader.option("pathGlobFilter", "*." + "".join(f"[{c}{c.upper()}]" for c in fmt))
        if not is_partitioned(spark, ref):
            reader = reader.option("recursiveFileLookup", "true")
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
        else:
            reader = reader.schema(schema)
        return reader.csv(ref)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(ref)


def load_sources(spark: SparkSession, spec: ImportSpec,
                 sources: Mapping[str, DataFrame | str] | None = None,
                 fmt: str | None = None, recursive: bool | None = None,
                 schemas: Mapping[str, T.StructType | str] | None = None) -> dict[str, DataFrame]:
    """One DataFrame per dataset of the spec.

    ``sources`` maps a dataset name to a DataFrame or to a path/table name; missing names fall
    back to the dataset's ``Path``. Every dataset must resolve. ``fmt`` defaults to the format
    the config document names (``dataSourceFileType``), else Parquet; files of a config-named
    CSV or Parquet source are read as folders (``recursive``) unless told otherwise. ``schemas``
    gives a dataset's schema, which spares CSV files the scan that infers one.
    """
    if fmt is None:
        fmt = spec.source_format or "parquet"
        if recursive is None:
            recursive = spec.source_format in ("csv", "parquet")
    recursive = bool(recursive) and fmt != "table"
    sources = dict(sources or {})
    out: dict[str, DataFrame] = {}
    for d in spec.datasets:
        given = sources.get(d.name, d.path)
        if isinstance(given, DataFrame):
            out[d.name] = given
        elif given:
            out[d.name] = read_dataset(spark, given, fmt, recursive=recursive, schema=(schemas or {}).get(d.name))
        else:
            raise SpecError(f"dataset {d.name!r} has no source and no path")
    return out


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    """Name and type family of every column, from the schema (no data read)."""
    from ..functions.types import type_family

    return [(f.name, type_family(f.dataType)) for f in df.schema.fields]
