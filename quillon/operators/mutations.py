"""Updates, replacements and deletions as rewrites of a table's rows (copy on write)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.predicates import condition


def updated(rows: DataFrame, equal: dict[str, Any], values: dict[str, Any]) -> DataFrame:
    """Rows that meet the condition get the values."""
    meets = condition(equal)
    out = [F.when(meets, F.lit(values[c]).cast(rows.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in rows.columns]
    if unknown := set(values) - set(rows.columns):
        raise ValueError(f"no column {sorted(unknown)}")
    return rows.select(*out)


def deleted(rows: DataFrame, equal: dict[str, Any]) -> DataFrame:
    """Rows that don't meet the condition; one that is unknown isn't met."""
    return rows.filter(~F.coalesce(condition(equal), F.lit(False)))


def merged(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with those of the same key replaced by the changes, and the others of the changes
    added (upsert)."""
    kept = rows.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.select(*rows.columns))
