"""A folder of files as one table, also when its files differ in columns or types (S4), and CSV lines that
do not parse (S2).

Files of one schema are one scan. When a folder holds several schemas, the files are grouped by schema,
each group is scanned with its own, columns are united by name, and a column that has several types gets
the narrowest one that holds them all. A column that a file lacks is null in its rows. Nothing is read
with another file's schema.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import quote
from ..session import scratch_path

_READERS = 16  # files whose schema is read at a time


def is_partitioned(spark: SparkSession, ref: str) -> bool:
    """Whether the visible folders directly below ``ref`` are all partition folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ref)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return False
    names = [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()]
    names = [n for n in names if n[0] not in "_."]
    return bool(names) and all("=" in n for n in names)


def folder_files(spark: SparkSession, ref: str, fmt: str) -> list[str]:
    """Every visible file below ``ref`` with the format's extension, in any case; names that start with ``_`` or ``.`` are hidden."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ref)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(path).toString().rstrip("/")
    found, listing = [], fs.listFiles(path, True)
    while listing.hasNext():
        name = listing.next().getPath().toString()
        below = name[len(root):].strip("/").split("/")
        if below[-1].lower().endswith("." + fmt) and not any(p[0] in "_." for p in below):
            found.append(name)
    return sorted(found)


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both; text if there is no other."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
    if isinstance(a, whole) and isinstance(b, whole):
        return max(a, b, key=lambda t: digits[type(t)])
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        exact = [t if isinstance(t, T.DecimalType) else T.DecimalType(digits[type(t)], 0) for t in (a, b) if not isinstance(t, (T.FloatType, T.DoubleType))]
        if len(exact) == 2:
            scale = max(t.scale for t in exact)
            size = max(t.precision - t.scale for t in exact) + scale
            return T.DecimalType(size, scale) if size <= 38 else T.DoubleType()
        return T.DoubleType()
    dates = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, dates) and isinstance(b, dates):
        return T.TimestampType() if T.TimestampType() in (a, b) else T.TimestampNTZType()
    return T.StringType()


def united_schema(schemas: Sequence[T.StructType]) -> T.StructType:
    """All columns by name (without case), in the order in which they first come, each as wide as needed."""
    fields: dict[str, T.StructField] = {}
    for f in (f for s in schemas for f in s.fields):
        old = fields.get(f.name.casefold())
        kind = f.dataType if old is None else wider(old.dataType, f.dataType)
        fields[f.name.casefold()] = T.StructField(f.name if old is None else old.name, kind, True)
    return T.StructType(list(fields.values()))


def _conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    own = {f.name.casefold(): f for f in df.schema.fields}

    def column(f: T.StructField):
        mine = own.get(f.name.casefold())
        if mine is None:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(quote(mine.name))
        if mine.dataType != f.dataType:
            nested = isinstance(mine.dataType, (T.ArrayType, T.MapType, T.StructType))
            c = F.to_json(c) if nested and isinstance(f.dataType, T.StringType) else c.cast(f.dataType)
        return c.alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


def read_folder(spark: SparkSession, ref: str, fmt: str) -> DataFrame:
    """Every file of the format below ``ref`` as one table; partition folders (``key=value``) give their columns.

    Parquet footers are merged by a Spark job; only if types conflict are the files' schemas read one by
    one, ``_READERS`` at a time, as CSV headers always are when there are several files.
    """
    partitioned = is_partitioned(spark, ref)

    def reader() -> DataFrameReader:
        out = spark.read.option("pathGlobFilter", "*." + "".join(f"[{c}{c.upper()}]" for c in fmt))
        return out if partitioned else out.option("recursiveFileLookup", "true")

    if fmt == "parquet":
        try:
            return reader().option("mergeSchema", "true").parquet(ref)
        except (PySparkException, Py4JJavaError) as error:  # Spark raises either, by where footers are merged
            if "CANNOT_MERGE" not in str(error):
                raise
    files = folder_files(spark, ref, fmt)

    def scan(paths: Sequence[str], infer: bool) -> DataFrame:
        out = spark.read.option("basePath", ref) if partitioned else spark.read
        if fmt == "parquet":
            return out.parquet(*paths)
        return out.option("header", "true").option("inferSchema", str(infer).lower()).csv(list(paths))

    if fmt == "csv" and len(files) < 2:
        return reader().option("header", "true").option("inferSchema", "true").csv(ref)
    with ThreadPoolExecutor(_READERS) as pool:
        found = list(pool.map(lambda f: scan([f], False).schema.json(), files))
    groups: dict[str, list[str]] = {}
    for path, schema in zip(files, found):
        groups.setdefault(schema, []).append(path)
    if fmt == "csv" and len(groups) == 1:  # one header: types are inferred over all files at once
        return reader().option("header", "true").option("inferSchema", "true").csv(ref)
    scans = [scan(paths, True) for paths in groups.values()]
    schema = united_schema([s.schema for s in scans])
    every, *more = (_conformed(s, schema) for s in scans)
    for df in more:
        every = every.unionByName(df)
    return every


def read_csv_checked(spark: SparkSession, ref: str, schema: T.StructType | str | None = None,
                     recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: the rows of CSV files that parse, and the lines that do not.

    A line is rejected if a value does not parse as its column's type or if it has too few or too many
    values. ``rejected`` has the line and its file. The lines are parsed once, when this is called, and
    both tables are written to the shared scratch folder. Accepted and rejected rows together are the
    data lines of the files. Without ``schema`` types are inferred first, and then only the number of values
    can be wrong.
    """
    reader = spark.read.option("header", "true")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]")
    if schema is None:
        schema = reader.option("inferSchema", "true").csv(ref).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    line = "__line"
    whole = T.StructType([*schema.fields, T.StructField(line, T.StringType(), True)])
    parsed = reader.option("inferSchema", "false").schema(whole).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", line).csv(ref)
    path = scratch_path(spark, "checked")
    parsed.select(*[F.col(quote(f.name)) for f in schema.fields], F.col(line), F.col("_metadata.file_path").alias("__file"),
                  F.col(line).isNotNull().alias("__bad")).write.partitionBy("__bad").parquet(path)
    stored = spark.read.schema(T.StructType([*whole.fields, T.StructField("__file", T.StringType()),
                                             T.StructField("__bad", T.BooleanType())])).parquet(path)
    good = stored.filter("not __bad").select(*[F.col(quote(f.name)) for f in schema.fields])
    return good, stored.filter("__bad").select(F.col(line).alias("line"), F.col("__file").alias("file"))
