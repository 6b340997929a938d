"""Column functions for encoded values: JSON, base64, arrays, vectors, ids."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.types import FieldType


def json_encode(column: Column) -> Column:
    """JSON text of a struct, array or map."""
    return F.to_json(column)


def json_decode(column: Column, schema: str | T.DataType | None = None) -> Column:
    """The value of JSON text: a variant, or a value of the given schema. Bad JSON is null."""
    return F.try_parse_json(column) if schema is None else F.from_json(column, schema)


def json_get(column: Column, path: str) -> Column:
    """One value inside JSON text, by a dotted path."""
    return F.get_json_object(column, "$." + path)


def base64_encode(column: Column) -> Column:
    return F.base64(column)


def base64_decode(column: Column) -> Column:
    return F.unbase64(column)


def vector_encode(column: Column, kind: FieldType) -> Column:
    """Cast to the vector's element type; a vector of another length is an error."""
    if kind.shape is None or len(kind.shape) != 1:
        raise ValueError(f"{kind.text} is no vector type")
    wrong = F.raise_error(F.concat(F.lit(f"expected {kind.shape[0]} components, got "), F.size(column).cast("string")))
    return F.when(column.isNull(), F.lit(None)).when(F.size(column) == kind.shape[0], column.cast(kind.spark)).otherwise(wrong.cast(kind.spark))


def array_encode(column: Column, kind: FieldType) -> Column:
    """Nested arrays as (shape, values in row order)."""
    if kind.shape is None:
        raise ValueError(f"{kind.text} is no array type")
    flat = column
    for _ in kind.shape[1:]:
        flat = F.flatten(flat)
    shape = F.array(*[F.lit(n) for n in kind.shape])
    return F.when(column.isNotNull(), F.struct(shape.alias("shape"), flat.cast(T.ArrayType(kind.spark["data"].dataType.elementType)).alias("data")))


def array_decode(column: Column, kind: FieldType) -> Column:
    """Nested arrays of the type's shape."""
    out = column["data"]
    for n in reversed(kind.shape[1:]):
        out = _rows(out, n)
    return out


def _rows(values: Column, n: int) -> Column:
    """An array cut into arrays of n values. The array is a lambda's variable, so it is made once."""

    def cut(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / n).cast("int") - 1), lambda i: F.slice(own, i * n + 1, n))

    return F.transform(F.array(values), cut)[0]


def create_id(column: Column, digits: int = 16) -> Column:
    """Id of a value: the first hexadecimal digits of its SHA-256."""
    return F.substring(F.sha2(column.cast("string"), 256), 1, digits)


def random_id() -> Column:
    return F.uuid()


#: How credentials in a URL are masked.
MASK, LEFT, RIGHT = "******", 2, 2


def anonymize_url(url: str | None) -> str | None:
    """A connection URL with the inner characters of user and password masked."""
    if not url:
        return url
    m = re.fullmatch(r"([^:]*(?=://).*?)://([^:@]*):([^:@]*)@(.*)", url, re.S)
    if not m:
        return url
    hide = lambda s: s[:LEFT] + MASK + s[-RIGHT:] if s else ""
    return f"{m[1]}://{hide(m[2])}:{hide(m[3])}@{m[4]}"


def anonymize_url_column(column: Column) -> Column:
    """The same on a column."""
    part = rf"([^:@]{{0,{LEFT}}})[^:@]*?([^:@]{{0,{RIGHT}}})"
    return F.when(column.rlike(r"://[^:@]+:[^:@]+@"), F.regexp_replace(column, rf"://{part}:{part}@", f"://$1{MASK}$2:$3{MASK}$4@")).otherwise(column)


def for_json(rows: DataFrame) -> DataFrame:
    """What clients get as JSON: no NaN or infinite numbers, dates and times as ISO text."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return rows.select(*out)


#: Tags that keep equal texts of different types apart.
TAGS = ((type(None), "<NoneType>"), (float, "<float>"), (int, "<int>"))


def hash_value(value) -> str:
    """Canonical SHA-256 of a nested value: mappings by sorted keys, sequences in order."""
    sha = lambda text: hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
    if isinstance(value, (bytes, bytearray)):
        return sha(bytes(value))
    if isinstance(value, (list, tuple)):
        return sha("".join(map(hash_value, value)))
    if isinstance(value, dict):
        return sha(str([(hash_value(k), hash_value(value[k])) for k in sorted(value)]))
    tag = next((tag for kind, tag in TAGS if isinstance(value, kind)), "")
    return sha(tag + str(value))


def row_hash(*columns: str) -> Column:
    """SHA-256 of some columns of a row, told apart from those of other columns or nulls."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
