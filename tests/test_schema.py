from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.schema import (
    check_primary_keys,
    conform,
    field_list,
    parse_type,
    to_struct,
    unwrap_record,
    validate_fields,
)


def test_field_list_to_struct():
    s = to_struct([{"name": "field1", "type": "string"}, {"name": "n", "type": "long"}])
    assert s == T.StructType([T.StructField("field1", T.StringType()),
                              T.StructField("n", T.LongType())])


def test_record_form_unwraps():
    rec = {"fields": [{"name": "first_name", "type": "string"},
                      {"name": "last_name", "type": "string"}]}
    assert unwrap_record(rec) == rec["fields"]
    assert to_struct(rec).fieldNames() == ["first_name", "last_name"]


@pytest.mark.parametrize("name,expected", [
    ("bytes", T.BinaryType()), ("boolean", T.BooleanType()), ("int", T.IntegerType()),
    ("float", T.FloatType()), ("double", T.DoubleType()), ("long", T.LongType()),
    ("timestamp_ntz", T.TimestampNTZType()), ("decimal(10,2)", T.DecimalType(10, 2)),
    ("array<string>", T.ArrayType(T.StringType())),
])
def test_type_names(spark, name, expected):
    assert parse_type(name) == expected


def test_null_type_refused():
    with pytest.raises(ValueError, match="null"):
        parse_type("null")


def test_unknown_type_refused(spark):
    with pytest.raises(ValueError, match="unknown type"):
        parse_type("no_such_type")


@pytest.mark.parametrize("bad", [
    [{"type": "string"}],
    [{"name": "a"}],
    [{"name": 1, "type": "string"}],
    [{"name": "a", "type": 3}],
    [{"name": "a", "type": "string"}, {"name": "a", "type": "long"}],
    ["a"],
    {"nofields": []},
])
def test_validation_errors(bad):
    with pytest.raises(ValueError):
        validate_fields(bad)


def test_primary_keys_subset():
    fields = [{"name": "field1", "type": "string"}]
    assert check_primary_keys(["field1"], fields) == ["field1"]
    with pytest.raises(ValueError, match="not output fields"):
        check_primary_keys(["other"], fields)
    with pytest.raises(ValueError, match="at least one"):
        check_primary_keys([], fields)


def test_field_list_roundtrip(spark):
    s = to_struct([{"name": "a", "type": "string"}, {"name": "b", "type": "long"}])
    assert to_struct(field_list(s)) == s


def test_conform_casts_orders_and_drops(spark):
    df = spark.createDataFrame([(1, "x", 2.5)], "b int, a string, extra double")
    out = conform(df, [{"name": "a", "type": "string"}, {"name": "b", "type": "long"}])
    assert out.columns == ["a", "b"]
    assert out.schema["b"].dataType == T.LongType()
    assert out.first().asDict() == {"a": "x", "b": 1}


def test_conform_missing_field(spark):
    df = spark.range(1).select(F.col("id").alias("a"))
    with pytest.raises(ValueError, match="missing declared fields"):
        conform(df, [{"name": "a", "type": "long"}, {"name": "b", "type": "long"}])


def test_conform_refuses_to_cut_off_a_fraction(spark):
    schema = [{"name": "x", "type": "int"}]
    whole = spark.createDataFrame([(2.0,), (None,), (-3.0,)], "x double")
    assert [r.x for r in conform(whole, schema).collect()] == [2, None, -3]
    with pytest.raises(Exception, match="no whole number: 1.9"):
        conform(spark.createDataFrame([(1.9,)], "x double"), schema).collect()
