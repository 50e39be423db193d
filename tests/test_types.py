
import pytest
from pyspark.sql import types as T

from starweave.functions.types import (
    cast_attributes, default_attribute_type, normalize_types, type_family, typed_key,
)

FAMILY_ROWS = [
    (("int", "integer", "bigint", "long", "short", "smallint", "tinyint", "byte"), "int", "Integer"),
    (("float", "double", "decimal", "numeric", "real", "number", "decimal(10,2)"), "double", "Float"),
    (("string", "varchar", "char", "nvarchar", "text", "nchar", "varchar(20)", "char(3)", "nvarchar(8)"),
     "string", "String"),
    (("boolean", "bool", "bit"), "boolean", "Boolean"),
    (("timestamp", "timestamp_ntz", "timestamp_ltz", "date", "datetime", "datetime2", "datetimeoffset", "time"),
     "timestamp", "Date"),
    (("binary", "varbinary", "array", "map", "struct", "void", "null"), "string", "String"),
]


@pytest.mark.parametrize("names,family,attribute", FAMILY_ROWS)
def test_family_table(names, family, attribute):
    from starweave.functions.types import attribute_type_of_family

    for n in names:
        assert type_family(n) == family
        assert type_family(f"  {n.upper()} ") == family
        assert attribute_type_of_family(type_family(n)) == attribute


def test_nested_names_fall_through_to_string():
    # Spark prints nested types with their element types; they are not in the table and
    # fall through unchanged, which the attribute mapping turns into String.
    for dt in (T.ArrayType(T.IntegerType()), T.MapType(T.StringType(), T.IntegerType()),
               T.StructType([T.StructField("x", T.IntegerType())])):
        assert type_family(dt.simpleString()) == dt.simpleString()
        assert default_attribute_type(dt) == "String"
    assert default_attribute_type(T.DecimalType(10, 2)) == "Float"
    assert default_attribute_type(T.DayTimeIntervalType()) == "String"


def test_normalize_types_on_embeddings(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    out = normalize_types(emb)
    assert dict(out.dtypes) == {"vec_id": "bigint", "embedding": "string", "label": "bigint"}
    first = out.orderBy("vec_id").first()
    assert first["embedding"].startswith("[")  # DEC-5: nested values as JSON text


def test_normalize_types_decimal_binary_date(spark):
    df = spark.sql("select cast(1.25 as decimal(10,2)) d, cast('ab' as binary) b, date'2024-01-02' dt, "
                   "cast(3 as tinyint) t, true f")
    out = normalize_types(df)
    assert dict(out.dtypes) == {"d": "double", "b": "string", "dt": "timestamp_ntz", "t": "bigint", "f": "boolean"}
    r = out.first()
    assert r["d"] == 1.25 and r["b"] == "6162" and str(r["dt"]) == "2024-01-02 00:00:00"


def test_cast_attributes_bad_values_become_null(spark):
    df = spark.sql("select 'x1' a, '12' b, 7.9 c, 'yes' d")
    out = cast_attributes(df, {"a": "Integer", "b": "Integer", "c": "Integer", "d": "Boolean"}).first()
    assert out["a"] is None and out["b"] == 12 and out["c"] == 7 and out["d"] is True


def test_typed_key_rules(spark):
    from pyspark.sql import functions as F

    with pytest.raises(TypeError):
        typed_key(F.col("x"), T.DoubleType(), "Integer")
    with pytest.raises(TypeError):
        typed_key(F.col("x"), T.DecimalType(10, 0), "Integer")
    with pytest.raises(TypeError):
        typed_key(F.col("x"), T.DoubleType(), "String")
    with pytest.raises(ValueError):
        typed_key(F.col("x"), T.LongType(), "Guid")
    df = spark.sql("select ' 42 ' s, 42 i")
    r = df.select(typed_key(F.col("s"), T.StringType(), "Integer").alias("k1"),
                  typed_key(F.col("i"), T.IntegerType(), "String").alias("k2")).first()
    assert r["k1"] == 42 and r["k2"] == "42"
