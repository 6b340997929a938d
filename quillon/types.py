"""Type strings of table fields, and their Spark types.

A field's type is written as a string: a scalar name, `vector[float:64]`, `array[float:2x3]`, or
a nested schema `a=str|b=vector[float:3]`. Types that Spark has no value for (pickled objects,
files, component references) are stored as opaque bytes or reference strings and are never
evaluated inside a query. Names are case-insensitive.
"""

from __future__ import annotations

import datetime
import inspect
import pathlib
import re
import types as pytypes
import typing
from dataclasses import dataclass

from pyspark.sql import types as T

#: Scalar type names and their Spark types.
SCALARS: dict[str, T.DataType] = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "bytes": T.BinaryType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "id": T.StringType(),
    "json": T.StringType(),
    "pickle": T.StringType(),
    "dill": T.StringType(),
    "pickleencoder": T.BinaryType(),
    "dillencoder": T.BinaryType(),
    "file": T.StringType(),
    "filedict": T.MapType(T.StringType(), T.StringType()),
    "basetype": T.StringType(),
    "componenttype": T.StringType(),
    "componentlist": T.ArrayType(T.StringType()),
    "componentdict": T.MapType(T.StringType(), T.StringType()),
    "image": T.BinaryType(),
}

#: Element types of vectors and arrays.
ELEMENTS: dict[str, T.DataType] = {
    "float": T.DoubleType(),
    "float64": T.DoubleType(),
    "float32": T.FloatType(),
    "int": T.LongType(),
    "int64": T.LongType(),
    "int32": T.IntegerType(),
    "int8": T.ByteType(),
    "bool": T.BooleanType(),
}

VECTOR = re.compile(r"vector\[(\w+):(\d+)\]", re.I)
ARRAY = re.compile(r"array\[(\w+):(\d+(?:x\d+)*)\]", re.I)
_REGISTERED: dict[str, T.DataType] = {}


@dataclass(frozen=True)
class FieldType:
    """What a type string says: Spark's type, and what Spark's type doesn't tell."""

    text: str
    spark: T.DataType
    shape: tuple[int, ...] | None = None
    element: str | None = None
    nested: tuple[tuple[str, FieldType], ...] = ()

    @property
    def metadata(self) -> dict:
        return {"type": self.text} | ({"shape": list(self.shape)} if self.shape else {})


def register(name: str, kind: T.DataType) -> None:
    """Add a type name of one's own."""
    _REGISTERED[name.lower()] = kind


def _split(text: str) -> list[str]:
    """At the bars that stand outside of brackets."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "[(") - (c in "])")
        if c == "|" and not depth:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def parse(text: str) -> FieldType:
    """The field type of a type string; ValueError if it names none."""
    text = text.strip()
    low = text.lower()
    if "=" in text:
        nested = tuple((name.strip(), parse(kind)) for name, _, kind in (part.partition("=") for part in _split(text)))
        return FieldType(text, T.StructType([T.StructField(n, f.spark, True, f.metadata) for n, f in nested]), nested=nested)
    if m := VECTOR.fullmatch(low):
        if m[1] not in ELEMENTS:
            raise ValueError(f"unknown element type {m[1]!r}")
        return FieldType(text, T.ArrayType(ELEMENTS[m[1]]), (int(m[2]),), m[1])
    if m := ARRAY.fullmatch(low):
        if m[1] not in ELEMENTS:
            raise ValueError(f"unknown element type {m[1]!r}")
        shape = tuple(int(n) for n in m[2].split("x"))
        return FieldType(text, T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(ELEMENTS[m[1]]))]), shape, m[1])
    for known in (SCALARS, _REGISTERED):
        if low in known:
            return FieldType(text, known[low])
    raise ValueError(f"unknown type {text!r}")


def struct_type(fields: dict[str, str]) -> T.StructType:
    """The Spark schema of a table's fields; the type strings are kept as metadata."""
    parsed = {name: parse(kind) for name, kind in fields.items()}
    return T.StructType([T.StructField(name, f.spark, True, f.metadata) for name, f in parsed.items()])


def merged(left: dict[str, str], right: dict[str, str]) -> dict[str, str]:
    """Fields of both; the right ones win."""
    return {**left, **right}


def is_trivial(fields: dict[str, str]) -> bool:
    """True if every field is a plain scalar, so values need no encoding."""
    return all(kind.lower() in ("str", "int", "float", "bool", "bytes", "date", "timestamp", "id") for kind in fields.values())


def type_string(kind: T.DataType) -> str:
    """A type string for a column of an existing DataFrame."""
    if isinstance(kind, T.StructType):
        return "|".join(f"{f.name}={type_string(f.dataType)}" for f in kind.fields)
    if isinstance(kind, (T.ArrayType, T.MapType, T.VariantType)):
        return "json"
    names = {T.StringType: "str", T.BooleanType: "bool", T.BinaryType: "bytes", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp"}
    if type(kind) in names:
        return names[type(kind)]
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.FractionalType):
        return "float"
    return "str"


_JSON = (str, int, float, bool, type(None))


def _is_json(hint) -> bool:
    origin = typing.get_origin(hint)
    if origin in (typing.Union, pytypes.UnionType, list, dict, tuple):
        return all(_is_json(a) for a in typing.get_args(hint) if a is not Ellipsis)
    return hint in _JSON or hint in (list, dict, tuple)


def annotation(hint) -> str:
    """Type string of a Python annotation; what nothing else fits is an opaque object."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, pytypes.UnionType) and type(None) in args:
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            return annotation(rest[0])
    if hint is inspect.Parameter.empty:
        return "str"
    if isinstance(hint, str):
        return hint if _known(hint) else "dill"
    plain = {str: "str", int: "int", float: "float", bool: "bool", bytes: "bytes", datetime.datetime: "timestamp", datetime.date: "date", pathlib.Path: "file"}
    if hint in plain:
        return plain[hint]
    if _is_component(hint):
        return "componenttype"
    if origin in (dict, list) and args and _is_component(args[-1]):
        return "componentdict" if origin is dict else "componentlist"
    if _is_json(hint):
        return "json"
    return "dill"


def _is_component(hint) -> bool:
    return inspect.isclass(hint) and getattr(hint, "is_component", False)


def _known(text: str) -> bool:
    try:
        parse(text)
    except ValueError:
        return False
    return True


def fields_of(cls: type) -> dict[str, str]:
    """Fields of a class by its annotations."""
    return {name: annotation(hint) for name, hint in typing.get_type_hints(cls).items() if typing.get_origin(hint) is not typing.ClassVar and not name.startswith("__")}


def output_type(function) -> str:
    """Type string of a function's result: its return annotation, or `str`."""
    return annotation(inspect.signature(function).return_annotation)
