"""Nested values of many rows as arrays, and back."""

from __future__ import annotations

from typing import Any

import numpy as np


def stacked(rows: list[Any]) -> Any:
    """Rows of equal nesting as one value whose leaves are arrays with a leading dimension."""
    first = rows[0]
    if isinstance(first, dict):
        return {k: stacked([r[k] for r in rows]) for k in first}
    if isinstance(first, tuple):
        return tuple(stacked([r[i] for r in rows]) for i in range(len(first)))
    return np.stack([np.asarray(r) for r in rows])


def unstacked(batch: Any) -> list[Any]:
    """The rows of a stacked value."""
    if isinstance(batch, dict):
        parts = {k: unstacked(v) for k, v in batch.items()}
        return [{k: v[i] for k, v in parts.items()} for i in range(len(next(iter(parts.values()))))] if parts else []
    if isinstance(batch, tuple):
        return [tuple(x) for x in zip(*(unstacked(v) for v in batch))]
    return list(batch)
