"""Joins of a table with the outputs that models made of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "_outputs__"
SOURCE = "_source"
#: Characters of a predict id, and of the hash at its end.
LENGTH, DIGITS = 50, 18


def predict_id(identifier: str, digest: str) -> str:
    """Name of a model's outputs: as much of the identifier as there is room for, and the hash."""
    return f"{identifier[: LENGTH - len(digest) - 2]}__{digest}"


def table_name(name: str) -> str:
    return name if name.startswith(PREFIX) else PREFIX + name


def complete(name: str, tables: dict[str, int]) -> str:
    """Full name of an output table by a name or its beginning; of several versions the one with
    the greatest number wins. KeyError if none fits."""
    wanted = table_name(name)
    if wanted in tables:
        return wanted
    fits = [t for t in tables if t.startswith(wanted + "__")] or [t for t in tables if t.startswith(wanted)]
    if not fits:
        raise KeyError(f"no outputs {name!r}")
    return max(fits, key=lambda t: (tables[t], t))


def resolve(name: str, columns: list[str]) -> str:
    """A column by its name, or an output column by its name's beginning."""
    if name in columns or not name.startswith(PREFIX):
        return name
    return next((c for c in columns if c.startswith(name)), name)


def joined(base: DataFrame, key: str, outputs: list[tuple[str, DataFrame]], how: str = "inner") -> DataFrame:
    """base with each output's value column, every one joined to the base's own key. Several
    outputs of a row multiply with each other."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    out = base
    for number, (column, rows) in enumerate(outputs):
        source = f"{SOURCE}_{number}"
        out = out.join(rows.select(F.col(SOURCE).alias(source), column), F.col(key).cast("string") == F.col(source).cast("string"), how).drop(source)
    return out


def missing(base: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """base rows without any output row."""
    return base.join(rows.select(F.col(SOURCE).cast("string").alias(SOURCE)), F.col(key).cast("string") == F.col(SOURCE), "left_anti")
