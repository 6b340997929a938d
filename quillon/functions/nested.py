"""Nested documents: functions on Python values, and on struct columns of DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Path = tuple[Any, ...]


def walk(value: Any, path: Path = ()) -> Iterator[tuple[Path, Any]]:
    """(path, leaf) of everything inside dicts, lists, tuples and sets."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, (*path, k))
    elif isinstance(value, (list, tuple, set)):
        for i, v in enumerate(value):
            yield from walk(v, (*path, i))
    else:
        yield path, value


def deep_items(value: dict) -> dict[str, Any]:
    """Dotted path and value of each leaf; only mappings are entered."""
    out: dict[str, Any] = {}
    for k, v in value.items():
        out |= {f"{k}.{p}": x for p, x in deep_items(v).items()} if isinstance(v, dict) and v else {str(k): v}
    return out


def deep_keys(value: dict) -> list[str]:
    return list(deep_items(value))


def deep_get(value: dict, path: str) -> Any:
    """A value by its dotted path; KeyError if there is none."""
    for part in path.split("."):
        value = value[part]
    return value


def deep_update(left: dict, right: dict) -> dict:
    """A new dict: right's values over left's, mappings merged key by key."""
    out = dict(left)
    for k, v in right.items():
        out[k] = deep_update(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def map_leaves(value: Any, function: Callable[[Any], Any], when: Callable[[Any], bool] = lambda _: True) -> Any:
    """The same nesting with function applied to the leaves that `when` picks."""
    if isinstance(value, dict):
        return {k: map_leaves(v, function, when) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return type(value)(map_leaves(v, function, when) for v in value)
    return function(value) if when(value) else value


def find_leaves(value: Any, when: Callable[[Any], bool]) -> list[Any]:
    return [leaf for _, leaf in walk(value) if when(leaf)]


def dict_diff(left: dict, right: dict) -> dict[str, tuple[Any, Any]]:
    """Dotted path to (left, right) wherever the two differ; a missing side is None."""
    out: dict[str, tuple[Any, Any]] = {}
    for k in {**left, **right}:
        a, b = left.get(k), right.get(k)
        if isinstance(a, dict) and isinstance(b, dict):
            out |= {f"{k}.{p}": pair for p, pair in dict_diff(a, b).items()}
        elif (k in left) != (k in right) or a != b:
            out[str(k)] = (a, b)
    return out


def document_diff(old: dict, new: dict) -> dict[str, Any]:
    """New values of the fields that differ."""
    return {k: new[k] for k in old if k in new and (type(old[k]) is not type(new[k]) or old[k] != new[k])}


REFERENCE = re.compile(r"\?\(([\w.-]+)\)")


def fill_references(value: Any, known: dict[str, Any]) -> Any:
    """`?(name)` and `?(name.attribute)` replaced by what they name. A text that is one
    reference becomes the value itself; unknown names stay."""

    def look(name: str) -> Any:
        if name in known:
            return known[name]
        head, _, rest = name.partition(".")
        found = known[head]
        for part in rest.split(".") if rest else ():
            found = found[part] if isinstance(found, dict) else getattr(found, part)
        return found

    def fill(text: str) -> Any:
        if m := REFERENCE.fullmatch(text):
            try:
                return look(m[1])
            except (KeyError, AttributeError):
                return text

        def put(m: re.Match) -> str:
            try:
                return str(look(m[1]))
            except (KeyError, AttributeError):
                return m[0]

        return REFERENCE.sub(put, text)

    return map_leaves(value, fill, lambda x: isinstance(x, str))


VARIABLE = re.compile(r"<var:([^<>]*?)>")


def set_variables(value: Any, /, **variables: Any) -> Any:
    """`<var:name>` replaced anywhere in a nested value, keys included. A text that is one
    variable keeps the value's type; unknown variables stay."""
    if isinstance(value, dict):
        return {set_variables(k, **variables): set_variables(v, **variables) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(set_variables(v, **variables) for v in value)
    if not isinstance(value, str):
        return value
    if m := VARIABLE.fullmatch(value):
        return variables.get(m[1].strip(), value)
    return VARIABLE.sub(lambda m: str(variables.get(m[1].strip(), m[0])), value)


def variables_in(value: Any) -> set[str]:
    texts = [x for p, x in walk(value) if isinstance(x, str)] + [k for p, _ in walk(value) for k in p if isinstance(k, str)]
    return {m.strip() for text in texts for m in VARIABLE.findall(text)}


def leaf_columns(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of all columns inside structs."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += leaf_columns(f.dataType, name + ".") if isinstance(f.dataType, T.StructType) else [name]
    return out


def changed_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, and the names of the fields in which the rows of two tables differ (null-safe)."""
    names = [c for c in old.columns if c != key and c in new.columns]
    left, right = old.alias("o"), new.alias("n")
    differ = [F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in names]
    joined = left.join(right, F.col(f"o.{key}") == F.col(f"n.{key}"))
    return joined.select(F.col(f"o.{key}").alias(key), F.array_compact(F.array(*differ)).alias("changed")).filter(F.size("changed") > 0)


def transform_leaves(column: Column, kind: T.DataType, function: Callable[[Column], Column], when: type[T.DataType]) -> Column:
    """A column with function applied to all leaves of one type, inside structs, arrays and map values."""
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[transform_leaves(column[f.name], f.dataType, function, when).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: transform_leaves(x, kind.elementType, function, when))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: transform_leaves(v, kind.valueType, function, when))
    return function(column) if isinstance(kind, when) else column
