"""Fitting models on folds of a table, with Spark's own estimators or any Python trainer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.models import Metric, Model

FOLD = "_fold"


def fold_column(key: str, valid: float = 0.1, seed: int = 42) -> Column:
    """`train` or `valid` by a hash of the key: the same row is always in the same fold."""
    share = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return F.when(share < valid, "valid").otherwise("train")


def in_fold(rows: DataFrame, fold: str | None) -> DataFrame:
    return rows if fold is None else rows.filter(F.col(FOLD) == fold)


@dataclass
class History:
    """Metrics of a training run, and when to keep or to stop."""

    watch: str = "loss"
    larger: bool = False
    patience: int = 3
    values: dict[str, list[float]] = field(default_factory=dict)

    def append(self, values: dict[str, float]) -> None:
        for k, v in values.items():
            self.values.setdefault(k, []).append(v)

    def _watched(self) -> list[float]:
        sign = 1 if self.larger else -1
        return [sign * v for v in self.values.get(self.watch, [])]

    def is_best(self) -> bool:
        """The last value is as good as any before: the moment to keep a checkpoint."""
        v = self._watched()
        return bool(v) and v[-1] >= max(v)

    def should_stop(self) -> bool:
        """The best value is `patience` steps back or more."""
        v = self._watched()
        return bool(v) and len(v) - 1 - max(i for i, x in enumerate(v) if x == max(v)) >= self.patience


def best_so_far(rows: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Metric rows with the running maximum of each run, and whether the row reaches it."""
    from pyspark.sql import Window

    before = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("best", F.max(value).over(before)).withColumn("is_best", F.col(value) == F.col("best"))


@dataclass
class MlTrainer:
    """A pyspark.ml estimator or pipeline: fitted on the executors, whatever the rows' number."""

    estimator: Any

    def fit(self, rows: DataFrame) -> Any:
        return self.estimator.fit(rows)


@dataclass
class LocalTrainer:
    """fit(features, targets) of a Python library on at most `limit` rows, which one process
    holds. The rows are those with the least hash of their key; the limit is part of the model."""

    fit_function: Callable[[list, list], Any]
    limit: int = 100_000

    def fit(self, rows: DataFrame, x: str, y: str, key: str) -> Any:
        own = rows.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(key).alias("key"))
        chosen = own.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(self.limit).collect()
        return self.fit_function([r["x"] for r in chosen], [r["y"] for r in chosen])


class Estimator(Model):
    """An object of a Python library with fit(x, y) and predict(x) on lists, as a model. Each Arrow
    batch is one call of the object's predict."""

    def __init__(
        self, identifier: str, estimator: Any, preprocess: Callable | None = None, postprocess: Callable | None = None, y_preprocess: Callable | None = None,
        datatype: str = "float", limit: int = 100_000, fit_options: dict[str, Any] | None = None, predict_options: dict[str, Any] | None = None,
    ):
        super().__init__(identifier, datatype=datatype)
        self.estimator, self.preprocess, self.postprocess, self.y_preprocess = estimator, preprocess, postprocess, y_preprocess
        self.limit, self.fit_options, self.predict_options = limit, fit_options or {}, predict_options or {}

    def predict(self, x: Any) -> Any:
        return self.predict_batch([([x], {})])[0]

    def predict_batch(self, calls: list[tuple[list, dict]]) -> list[Any]:
        if not calls:
            return []
        given = [self.preprocess(*args, **kwargs) if self.preprocess else (args or list(kwargs.values()))[0] for args, kwargs in calls]
        found = list(self.estimator.predict(given, **self.predict_options))
        return [self.postprocess(y) for y in found] if self.postprocess else found

    def fit(self, rows: DataFrame, x: str, key: str, y: str | None = None) -> Estimator:
        """Fit on the rows of the training fold, if rows have folds, `limit` of them at most; without
        y by x alone. The version goes up."""

        def train(xs: list, ys: list) -> None:
            xs = [self.preprocess(v) for v in xs] if self.preprocess else xs
            ys = [self.y_preprocess(v) for v in ys] if self.y_preprocess else ys
            self.estimator.fit(*([xs] if y is None else [xs, ys]), **self.fit_options)

        LocalTrainer(train, self.limit).fit(in_fold(rows, "train" if FOLD in rows.columns else None), x, y or x, key)
        self.version += 1
        return self


def fit_and_validate(model: Estimator, rows: DataFrame, x: str, y: str, key: str, metrics: Sequence[Metric], valid: float = 0.1) -> dict[str, float]:
    """Fit on the training fold, then append the validation fold's metrics to the model; rows
    without folds get them by their key."""
    rows = rows if FOLD in rows.columns else rows.withColumn(FOLD, fold_column(key, valid))
    model.fit(rows, x, key, y)
    found = model.validate(in_fold(rows, "valid"), x, y, metrics)
    model.append_metrics(found)
    return found


def steps(train: Callable[[int], dict[str, float]], history: History, most: int, save: Callable[[int], None] | None = None) -> History:
    """A training loop: train(step) returns metrics; the best state is saved, and training ends
    early where it doesn't get better."""
    for k in range(most):
        history.append(train(k))
        if save and history.is_best():
            save(k)
        if history.should_stop():
            break
    return history


def summary(metrics: dict[str, Sequence[float]]) -> dict[str, float]:
    return {k: v[-1] for k, v in metrics.items() if v}
