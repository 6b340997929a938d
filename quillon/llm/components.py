"""Connected components of a distributed list of links.

Every round each node hooks onto its least neighbour, hooks are followed to their ends by
doubling, and the links are drawn anew between those ends. At least half of the nodes that
still have links go each round, so rounds follow the logarithm of the longest component.
Links, labels and counts stay distributed; each step starts from a table written to the shared
folder. The joins have one row a node on one side, so a node with very many links splits.

What is left of the links once they are ONE or fewer, 16 MB, is solved by one task instead of
more rounds; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written


#: Links that one task may solve.
ONE = 1 << 20


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link a node that connect what the links (a, b) connect, to each least value."""
    if len(a) == 0:
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[left], label[right]
        differ = la != lb
        if not differ.any():
            break
        left, right, la, lb = left[differ], right[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    changed = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[changed], nodes[label[changed]]


def spanning_links(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the links of a minimum spanning forest (Boruvka): among the links given, fewer
    than there are nodes, and every cut is crossed by one of its lightest."""
    chosen: list[np.ndarray] = []
    if not len(a):
        return np.zeros(0, np.int64)
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    key = weight.astype(np.int64) * len(a) + np.arange(len(a))
    at, label = np.arange(len(a)), np.arange(len(nodes))
    while True:
        la, lb = label[left[at]], label[right[at]]
        at, la, lb = at[la != lb], la[la != lb], lb[la != lb]
        if not len(at):
            return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        best = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(best, la, key[at])
        np.minimum.at(best, lb, key[at])
        picked = np.unique(best[best < np.iinfo(np.int64).max]) % len(a)
        chosen.append(picked)
        x, y = local_forest(label[left[picked]], label[right[picked]])
        to = np.arange(len(nodes))
        to[x] = y
        label = to[label]


def solved(edges: DataFrame) -> DataFrame:
    """(id, component) of few links, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
        if got:
            ids, tops = local_forest(*(np.concatenate(x) for x in zip(*got)))
            roots = np.unique(tops)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, roots)), pa.array(np.append(tops, roots))], ["id", "component"])

    return written(edges.select("a", "b").coalesce(1).mapInArrow(run, "id long, component long"))


def components(links: DataFrame, one: int = ONE) -> DataFrame:
    """(id, component) of every node in links (a, b): the least id that it reaches.

    Links with a null end, and those from a node to itself, connect nothing.
    """
    spark = links.sparkSession
    edges = written(links.filter("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")))
    labels = None
    while left := edges.count():
        if left <= one:
            own = solved(edges)
            if labels is None:
                return own
            later = own.select(F.col("id").alias("component"), F.col("component").alias("up"))
            return written(labels.join(later, "component", "left").select("id", F.coalesce("up", "component").alias("component")))
        edges = written(edges.distinct()) if labels is None else edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("up")))
        while True:
            upper = hooks.select(F.col("id").alias("up"), F.col("up").alias("top"))
            jumped = written(hooks.join(upper, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            hooks = jumped.select("id", "up")
            if jumped.filter("moved").isEmpty():
                break
        left, right = (hooks.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b"))
        drawn = edges.join(left, "a").join(right, "b").filter("a_up <> b_up")
        edges = written(drawn.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
        if labels is None:
            labels = hooks.select("id", F.col("up").alias("component"))
        else:
            later = hooks.select(F.col("id").alias("component"), "up")
            labels = written(labels.join(later, "component", "left").select("id", F.coalesce("up", "component").alias("component")))
    return labels if labels is not None else spark.createDataFrame([], "id long, component long")
