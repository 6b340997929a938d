"""Predicates of the form column OP literal."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literals up to this many are one IN list, more are joined.
IN_LIST = 10_000

OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "isin")


@dataclass(frozen=True)
class Predicate:
    field: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")

    def column(self, name: str | None = None, keep_missing: bool = False) -> Column:
        """As a column; `name` replaces the field's. SQL's logic of three values holds: a null
        matches nothing, not even `!=`, unless keep_missing is set."""
        c, v = F.col(quoted(name or self.field)), self.value
        match self.op:
            case "==":
                return c == F.lit(v)
            case "!=":
                return ~c.eqNullSafe(F.lit(v)) if keep_missing else c != F.lit(v)
            case "<":
                return c < F.lit(v)
            case "<=":
                return c <= F.lit(v)
            case ">":
                return c > F.lit(v)
            case ">=":
                return c >= F.lit(v)
        values = [x for x in v if x is not None]  # a null in the list would make misses unknown
        return c.isin(values) if values else F.lit(False)


class Field:
    """A column of a query; comparing it gives a predicate."""

    def __init__(self, name: str):
        self.name = name

    def _make(self, op: str, value: Any) -> Predicate:
        if isinstance(value, (Field, Column)):
            raise TypeError("a predicate compares a column with a literal")
        return Predicate(self.name, op, value)

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        return self._make("==", value)

    def __ne__(self, value: Any) -> Predicate:  # type: ignore[override]
        return self._make("!=", value)

    def __lt__(self, value: Any) -> Predicate:
        return self._make("<", value)

    def __le__(self, value: Any) -> Predicate:
        return self._make("<=", value)

    def __gt__(self, value: Any) -> Predicate:
        return self._make(">", value)

    def __ge__(self, value: Any) -> Predicate:
        return self._make(">=", value)

    def isin(self, values: Any) -> Predicate:
        """One of some literals, or of the values in the first column of a query or a DataFrame: then
        a semi-join, and nothing comes to the client."""
        return self._make("isin", values if is_rows(values) else tuple(values))

    __hash__ = None  # type: ignore[assignment]

    def __repr__(self) -> str:
        return f"Field({self.name!r})"


def is_rows(values: Any) -> bool:
    return isinstance(values, DataFrame) or hasattr(values, "df")


def quoted(name: str) -> str:
    """A column's name for F.col: dots reach into structs, all else is literal."""
    return ".".join(f"`{p}`" for p in name.split(".")) if not name.startswith("`") else name


def apply(rows: DataFrame, predicates: list[tuple[Predicate, str]], keep_missing: bool = False) -> DataFrame:
    """Rows on which all predicates hold, each on its resolved column. Long lists of literals are
    semi-joins, so that the plan stays small."""
    short = [p.column(name, keep_missing) for p, name in predicates if p.op != "isin" or not is_rows(p.value) and len(p.value) <= IN_LIST]
    if short:
        rows = rows.filter(reduce(lambda a, b: a & b, short))
    for p, name in predicates:
        if p.op == "isin" and is_rows(p.value):
            wanted = p.value if isinstance(p.value, DataFrame) else p.value.df()
            wanted = wanted.select(F.col(quoted(wanted.columns[0])).alias("_wanted"))
            rows = rows.join(wanted, F.col(quoted(name)) == F.col("_wanted"), "left_semi")
        elif p.op == "isin" and len(p.value) > IN_LIST:
            kind = rows.select(F.col(quoted(name))).schema.fields[0].dataType.simpleString()
            wanted = rows.sparkSession.createDataFrame([(v,) for v in set(p.value) if v is not None], f"_wanted {kind}")
            rows = rows.join(wanted, F.col(quoted(name)) == F.col("_wanted"), "left_semi")
    return rows


def condition(equal: dict[str, Any]) -> Column:
    """All fields equal their value; null equals null. Never unknown."""
    return reduce(lambda a, b: a & b, [F.col(quoted(k)).eqNullSafe(F.lit(v)) for k, v in equal.items()], F.lit(True))
