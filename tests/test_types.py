from __future__ import annotations

import datetime
import pathlib
from typing import Optional

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import types
from quillon.functions import encoding


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("str", T.StringType()),
        ("INT", T.LongType()),
        ("float", T.DoubleType()),
        ("timestamp", T.TimestampNTZType()),
        ("vector[float32:3]", T.ArrayType(T.FloatType())),
        ("vector[float:300]", T.ArrayType(T.DoubleType())),
        ("filedict", T.MapType(T.StringType(), T.StringType())),
        ("pickle", T.StringType()),
    ],
)
def test_parse(text, kind):
    assert types.parse(text).spark == kind


def test_nested_and_arrays():
    nested = types.parse("a=str|b=vector[float:64]|c=x=int")
    assert [n for n, _ in nested.nested] == ["a", "b", "c"] and nested.spark["b"].dataType == T.ArrayType(T.DoubleType())
    assert nested.spark["b"].metadata == {"type": "vector[float:64]", "shape": [64]}
    grid = types.parse("array[float:2x3]")
    assert grid.shape == (2, 3) and grid.spark.fieldNames() == ["shape", "data"]
    for bad in ("nothing", "vector[what:3]", "vector[float]", "array[float:]"):
        with pytest.raises(ValueError):
            types.parse(bad)
    types.register("money", T.DecimalType(18, 2))
    assert types.parse("Money").spark == T.DecimalType(18, 2)


def test_annotations():
    class Part:
        is_component = True

    hints = {str: "str", int: "int", Optional[float]: "float", dict: "json", list[int]: "json", dict[str, Part]: "componentdict", list[Part]: "componentlist", Part: "componenttype", pathlib.Path: "file", object: "dill", datetime.date: "date", int | str: "json"}
    assert {h: types.annotation(h) for h in hints} == hints

    class Row:
        x: int
        y: Optional[str]

    assert types.fields_of(Row) == {"x": "int", "y": "str"}
    assert types.output_type(lambda x: x) == "str"
    assert types.merged({"a": "str", "b": "int"}, {"b": "float"}) == {"a": "str", "b": "float"}
    assert types.is_trivial({"a": "str"}) and not types.is_trivial({"a": "vector[float:2]"})


def test_vector_length_is_checked(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    kind = types.parse("vector[float:2]")
    assert [r[0] for r in rows.select(encoding.vector_encode(F.col("v"), kind)).collect()] == [[1.0, 2.0], None]
    with pytest.raises(Exception, match="expected 3 components, got 2"):
        rows.select(encoding.vector_encode(F.col("v"), types.parse("vector[float:3]"))).collect()


def test_array_round_trip(spark):
    kind = types.parse("array[float:2x2x2]")
    grid = [[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]]]
    rows = spark.createDataFrame([(grid,)], "g array<array<array<double>>>")
    flat = rows.select(encoding.array_encode(F.col("g"), kind).alias("a"))
    assert flat.first()["a"]["data"] == [float(i) for i in range(1, 9)]
    assert flat.select(encoding.array_decode(F.col("a"), kind)).first()[0] == grid
