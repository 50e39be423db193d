"""Type families, attribute types and typed join keys.

All conversions are Catalyst expressions (``cast`` / ``try_cast`` / ``to_json`` / ``hex``),
so they stay inside whole-stage codegen. Only schema metadata is inspected on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The type-name vocabulary of the import contract.
# Family of a type name (lower-cased, trimmed), then the attribute type of a family.
# ---------------------------------------------------------------------------
INT_NAMES = ("int", "integer", "bigint", "long", "short", "smallint", "tinyint", "byte")
FLOAT_NAMES = ("float", "double", "decimal", "numeric", "real", "number")
STRING_NAMES = ("string", "varchar", "char", "nvarchar", "text", "nchar")
BOOLEAN_NAMES = ("boolean", "bool", "bit")
TIMESTAMP_NAMES = (
    "timestamp", "timestamp_ntz", "timestamp_ltz", "date", "datetime", "datetime2", "datetimeoffset", "time",
)
OTHER_AS_STRING_NAMES = ("binary", "varbinary", "array", "map", "struct", "void", "null")
FAMILY_TO_ATTRIBUTE_TYPE = {
    "int": "Integer",
    "double": "Float",
    "string": "String",
    "timestamp": "Date",
    "boolean": "Boolean",
}
ATTRIBUTE_TYPES = ("String", "Integer", "Float", "Date", "Boolean")
JOIN_KEY_TYPES = ("Integer", "String")
# ---------------------------------------------------------------------------

# Spark target type per attribute type (DEC-4: Date is timestamp without zone).
ATTRIBUTE_SPARK_TYPE: dict[str, T.DataType] = {
    "String": T.StringType(),
    "Integer": T.LongType(),
    "Float": T.DoubleType(),
    "Date": T.TimestampNTZType(),
    "Boolean": T.BooleanType(),
}

# Money is added exactly: eighteen digits before the point, ten after it. NaN, infinities and values
# of 1e18 or more do not convert and are left out of totals, as nulls are.
MONEY = "decimal(28,10)"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


# Family of each listed name, from the fixed values above.
_FAMILY = {name: family for family, names in (
    ("int", INT_NAMES), ("double", FLOAT_NAMES), ("string", STRING_NAMES + OTHER_AS_STRING_NAMES),
    ("boolean", BOOLEAN_NAMES), ("timestamp", TIMESTAMP_NAMES)) for name in names}


def type_family(type_name: str | T.DataType) -> str:
    """Family of a Spark type, or of a type name (its parameters and element types do not matter)."""
    if isinstance(type_name, T.DataType):
        for kinds, family in ((_INTEGRAL, "int"), (_FRACTIONAL, "double"), (T.BooleanType, "boolean"),
                              (_DATES, "timestamp")):
            if isinstance(type_name, kinds):
                return family
        type_name = type_name.simpleString()
    name = type_name.strip().lower()
    return _FAMILY.get(name) or _FAMILY.get(name.partition("(")[0].strip(), name)


def attribute_type_of_family(family: str) -> str:
    return FAMILY_TO_ATTRIBUTE_TYPE.get(family, "String")


def default_attribute_type(dtype: T.DataType) -> str:
    """Attribute type a column gets by default from its Spark type."""
    return attribute_type_of_family(type_family(dtype))


def _as_number(column: Column, source: T.DataType, attribute_type: str) -> Column:
    """Seconds since 1970 of a date or timestamp, whole for Integer."""
    if isinstance(source, T.TimestampType):
        micros = F.unix_micros(column)
    else:
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        micros = F.timestamp_diff("MICROSECOND", epoch, column.cast("timestamp_ntz"))
    return F.floor(micros / 1_000_000).cast("bigint") if attribute_type == "Integer" else micros / F.lit(1e6)


def to_attribute_type(column: Column, source: T.DataType, attribute_type: str) -> Column:
    """Convert one column to the Spark type of ``attribute_type``; never fails a job.

    Values that do not convert become null. By source: text and numbers are tried (double to
    Integer truncates toward zero; a number is no Date); dates and timestamps become seconds since
    1970 as numbers and are no Boolean; a Boolean is 1 or 0 as a number and no Date; nested values
    are JSON text and binary is hex, as String only (DEC-5); other types are text, as String only.
    """
    if attribute_type not in ATTRIBUTE_SPARK_TYPE:
        raise ValueError(f"unknown attribute type {attribute_type!r}; expected one of {ATTRIBUTE_TYPES}")
    target = ATTRIBUTE_SPARK_TYPE[attribute_type]
    nothing = F.lit(None).cast(target)
    if source == target:
        return column
    if isinstance(source, T.StringType):
        return column.try_cast(target)
    if isinstance(source, T.NumericType):
        return nothing if attribute_type == "Date" else column.try_cast(target)
    if isinstance(source, _DATES):
        if attribute_type in ("Integer", "Float"):
            return _as_number(column, source, attribute_type)
        return nothing if attribute_type == "Boolean" else column.try_cast(target)
    if isinstance(source, T.BooleanType):
        return nothing if attribute_type == "Date" else column.try_cast(target)
    if attribute_type != "String" or isinstance(source, T.NullType):
        return nothing
    if isinstance(source, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return F.hex(column) if isinstance(source, T.BinaryType) else column.cast(target)


def normalize_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast every (or each named) column to the target type of its family's attribute type."""
    wanted = set(columns) if columns is not None else None
    out = []
    for field in df.schema.fields:
        col = F.col(_quote(field.name))
        if wanted is None or field.name in wanted:
            col = to_attribute_type(col, field.dataType, default_attribute_type(field.dataType))
        out.append(col.alias(field.name))
    return df.select(*out)


def cast_attributes(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named columns to the chosen attribute types (``try_cast``: bad values become null)."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    missing = [name for name in types if name not in schema]
    if missing:
        raise ValueError(f"cast_attributes: unknown columns {missing}")
    out = []
    for name, dtype in schema.items():
        col = F.col(_quote(name))
        if name in types:
            col = to_attribute_type(col, dtype, types[name])
        out.append(col.alias(name))
    return df.select(*out)


def cast_losses(df: DataFrame, types: dict[str, str], observation: Observation) -> DataFrame:
    """``cast_attributes``, while ``observation`` counts the values that each named column loses.

    A value is lost if it is not null and becomes null. The counts are metrics of the rows that pass, so
    they cost no scan; ``observation.get`` has them, by column name, after the first action on the result.
    """
    schema = {f.name: f.dataType for f in df.schema.fields}
    missing = [name for name in types if name not in schema]
    if missing:
        raise ValueError(f"cast_losses: unknown columns {missing}")
    typed = {n: f"__typed{i}" for i, n in enumerate(types)}
    both = df.select("*", *[to_attribute_type(F.col(_quote(n)), schema[n], types[n]).alias(t) for n, t in typed.items()])
    return observed_losses(both, typed, observation).select(
        *[F.col(_quote(typed.get(n, n))).alias(n) for n in schema])


def observed_losses(df: DataFrame, typed: dict[str, str], observation: Observation) -> DataFrame:
    """``df`` with a metric per raw column: rows where it has a value and its typed column has none."""
    return df.observe(observation, *[
        F.count_if(F.col(_quote(n)).isNotNull() & F.col(_quote(t)).isNull()).alias(n) for n, t in typed.items()])


def default_literal(value: str, attribute_type: str) -> Column:
    """The default value of an attribute as a typed literal (DEC-7)."""
    target = ATTRIBUTE_SPARK_TYPE[attribute_type]
    return F.lit(value).try_cast(target)


def fill_defaults(df: DataFrame, defaults: dict[str, tuple[str, str]]) -> DataFrame:
    """``coalesce`` each named column with its default: ``{name: (default_text, attribute_type)}``.

    An empty default text leaves the column as it is.
    """
    out = []
    for field in df.schema.fields:
        col = F.col(_quote(field.name))
        spec = defaults.get(field.name)
        if spec is not None and spec[0] != "":
            text, attribute_type = spec
            col = F.coalesce(col, default_literal(text, attribute_type).cast(field.dataType))
        out.append(col.alias(field.name))
    return df.select(*out)


def typed_key(column: Column, source: T.DataType, key_type: str, where: str = "") -> Column:
    """A join key converted to the edge's ``JoinKeyType``; no cast when it already fits.

    Integer keys accept integral and string columns; strings that are not integers become null
    and so never match (K1 reports them). Floating and decimal keys raise (DEC-13): truncation
    would invent matches.
    """
    if key_type not in JOIN_KEY_TYPES:
        raise ValueError(f"JoinKeyType must be one of {JOIN_KEY_TYPES}, got {key_type!r}")
    if key_type == "Integer":
        if isinstance(source, _INTEGRAL):
            return column
        if isinstance(source, T.StringType):
            return F.trim(column).try_cast(T.LongType())
        raise TypeError(
            f"{where or 'join key'}: a {source.simpleString()} column cannot be an Integer join key"
        )
    if isinstance(source, T.StringType):
        return column
    if isinstance(source, _FRACTIONAL):
        raise TypeError(
            f"{where or 'join key'}: a {source.simpleString()} column cannot be a String join key"
        )
    return column.cast(T.StringType())


def key_spark_type(key_type: str) -> T.DataType:
    return T.LongType() if key_type == "Integer" else T.StringType()


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


quote = _quote
