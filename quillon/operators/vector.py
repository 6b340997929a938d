"""Exact vector search as plain DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MEASURES = ("cosine", "dot", "l2")
#: Components from which on products of whole batches are the faster way.
LONG = 128


def _check(measure: str) -> None:
    if measure not in MEASURES:
        raise ValueError(f"no measure {measure!r}; known: {', '.join(MEASURES)}")


def score(vector: Column, query: list[float], measure: str = "cosine") -> Column:
    """Similarity of a vector column and a constant vector, in double precision; larger is nearer.
    `l2` is the negative distance. A vector of length zero has no cosine (null). All in the JVM."""
    _check(measure)
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vector.cast("array<double>")
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    if measure == "l2":
        return F.lit(0.0) - F.sqrt(total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    if measure == "dot":
        return dot
    length = F.sqrt(total(F.transform(v, lambda a: a * a)))
    own = float(np.sqrt(np.sum(np.asarray(query, float) ** 2)))
    return F.try_divide(dot, length * F.lit(own))


def score_batches(vector: Column, query: list[float], measure: str = "cosine") -> Column:
    """The same scores by matrix products over Arrow batches: faster for long vectors. A null vector,
    or one of another length than the query's, has a null score."""
    _check(measure)
    q = np.asarray(query, np.float64)

    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = np.sqrt(q @ q)
        for batch in batches:
            good = np.array([v is not None and len(v) == len(q) for v in batch], bool)
            out = np.full(len(batch), np.nan)
            if good.any():
                x = np.stack(batch[good].to_numpy()).astype(np.float64)
                if measure == "l2":
                    out[good] = 0.0 - np.sqrt(((x - q) ** 2).sum(axis=1))
                else:
                    value = x @ q
                    if measure == "cosine":
                        length = np.sqrt((x * x).sum(axis=1)) * own
                        value = np.divide(value, length, out=np.full(len(value), np.nan), where=length > 0)
                    out[good] = value
            yield pd.Series(out)

    return F.nanvl(run(vector), F.lit(None).cast("double"))


def scored(vector: str, query: list[float], n: int, measure: str) -> Column:
    """The score of a vector column, the faster way for its length."""
    return (score_batches if len(query) >= LONG else score)(F.col(vector), query, measure)


def nearest(rows: DataFrame, key: str, vector: str, query: list[float], n: int = 100, measure: str = "cosine", batches: bool | None = None) -> DataFrame:
    """(key, score) of the n nearest rows, best first; ties by key. Each task keeps n rows only.
    batches: by products of whole batches; by default where vectors are long."""
    own = scored(vector, query, n, measure) if batches is None else (score_batches if batches else score)(F.col(vector), query, measure)
    found = rows.select(key, own.alias("score")).filter("score is not null")
    return found.orderBy(F.desc("score"), key).limit(n)


def nearest_to_id(rows: DataFrame, key: str, vector: str, value, n: int = 100, measure: str = "cosine") -> DataFrame:
    """Nearest rows of a stored vector, itself among them. KeyError if there is none."""
    found = rows.filter(F.col(key) == F.lit(value)).select(vector).first()
    if found is None or found[0] is None:
        raise KeyError(value)
    return nearest(rows, key, vector, list(found[0]), n, measure)


def best_per_key(scored: DataFrame, key: str) -> DataFrame:
    """The best score of each key, where a key has several vectors."""
    return scored.groupBy(key).agg(F.max("score").alias("score"))


def like_first(base: DataFrame, key: str, index: DataFrame, index_key: str, vector: str, query: list[float], n: int, measure: str) -> DataFrame:
    """base rows among the n nearest of the whole index, with their score; others follow later."""
    top = best_per_key(nearest(index, index_key, vector, query, n, measure), index_key)
    # n rows at most on this side.
    return base.join(F.broadcast(top.withColumnRenamed(index_key, "_key")), F.col(key) == F.col("_key")).drop("_key")


def like_last(base: DataFrame, key: str, index: DataFrame, index_key: str, vector: str, query: list[float], n: int, measure: str) -> DataFrame:
    """The n rows of base whose vectors are nearest; rows without a vector are left out."""
    vectors = index.select(F.col(index_key).alias("_key"), F.col(vector).alias("_vector"))
    found = base.join(vectors, F.col(key) == F.col("_key")).withColumn("score", scored("_vector", query, n, measure)).drop("_key", "_vector")
    return found.filter("score is not null").orderBy(F.desc("score"), key).limit(n)


def upsert(index: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """Vectors of both tables, the last by `order` for each key."""
    both = index.unionByName(items)
    last = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), order).alias("_row"))
    return last.select(key, "_row.*").select(*index.columns)


def delete(index: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return index.join(ids.select(key).distinct(), key, "left_anti")


def missing(outputs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Vectors that the index lacks: what a restarted index has to add."""
    return outputs.join(index.select(key), key, "left_anti")


def describe(index: DataFrame, vector: str, measure: str) -> DataFrame:
    """size, dimensions and measure in one row."""
    return index.agg(F.count(vector).alias("size"), F.max(F.size(vector)).alias("dimensions")).withColumn("measure", F.lit(measure))


def foreign_score(distance: Column, measure: str, store: str) -> Column:
    """Scores from other vector stores' distances, larger always nearer. Fixed conventions:
    `one_minus` stores give 1 - d for cosine and l2 and -d for dot; `negative` ones give -d."""
    if store == "one_minus":
        return -distance if measure == "dot" else F.lit(1.0) - distance
    if store == "negative":
        return -distance
    raise ValueError(f"no convention {store!r}")
