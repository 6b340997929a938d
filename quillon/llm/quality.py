"""Quality classifier: a sparse ensemble of rules.

Statistics of each whole text; boosted trees are grown on a bounded sample of labelled rows,
every path in them is a conjunctive rule, a lasso logistic regression keeps few of the rules,
and those are compiled into one Spark column expression over the statistics.

Defined results: null and empty texts have statistics 0 and get the score that the rules give
for those; without labels of both classes every score is the labels' smoothed mean (0.5 if there
are none); a null doc_id is scored and never held out; repeated rows are scored alike and learned
once; an empty table gives no rows; other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE_BYTES, Words, blocks, column_name, labelled_rows, must_be_new, text_buffers
from quillon.llm.linear import lasso_logistic

#: Labelled rows to learn from, at most.
SAMPLE = 20_000

STATISTICS = ("words", "word_length", "distinct", "adjacent", "symbols", "marks", "digits", "upper", "stops", "commas", "line_words", "lines_again", "high")

NO_SPACE = np.ones(256, bool)
NO_SPACE[list(SPACE_BYTES)] = False
NO_BREAK = np.ones(256, bool)
NO_BREAK[list(b"\r\n")] = False
SAME = np.arange(256, dtype=np.uint8)


def _group(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


GROUPS = {
    "symbols": _group(b"#$%&*+/<=>@[\\]^_`{|}~"),
    "marks": _group(b"!?"),
    "digits": _group(b"0123456789"),
    "upper": _group(bytes(range(0x41, 0x5B))),
    "stops": _group(b"."),
    "commas": _group(b",;:"),
    "high": _group(bytes(range(0x80, 0x100))),
}


def _distinct(words: Words) -> np.ndarray:
    """Different words of each text."""
    doc = np.repeat(np.arange(len(words.count)), words.count)
    mixed = (words.hash ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    first = np.unique(mixed, return_index=True)[1]
    return np.bincount(doc[first], minlength=len(words.count))


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(offsets) - 1
    words = Words(raw, offsets, NO_SPACE, SAME)
    count = np.maximum(words.count, 1)
    doc = np.repeat(np.arange(n), words.count)
    length = np.bincount(doc, weights=words.ends - words.starts, minlength=n)
    adjacent = np.zeros(len(doc), bool)
    adjacent[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    lines = Words(raw, offsets, NO_BREAK, SAME)
    out = {
        "words": np.log1p(words.count),
        "word_length": length / count,
        "distinct": np.where(words.count > 0, _distinct(words) / count, 0),
        "adjacent": np.bincount(doc[adjacent], minlength=n) / count,
        "line_words": np.log1p(words.count / np.maximum(lines.count, 1)),
        "lines_again": (lines.count - _distinct(lines)) / np.maximum(lines.count, 1),
    }
    for name, group in GROUPS.items():
        sums = np.concatenate([[0], np.cumsum(group[raw])])
        out[name] = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(length, 1)
    return np.column_stack([out[s] for s in STATISTICS])


def with_statistics(docs: DataFrame, column: str) -> DataFrame:
    """docs with a struct column of the statistics."""
    kind = f"struct<{', '.join(f'{s}: double' for s in STATISTICS)}>"
    schema = docs.select("*", F.lit(None).cast(kind).alias(column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(batch.schema.names.index("text")))
            for i, j in blocks(offsets):
                rows = statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(STATISTICS))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, own], [*part.schema.names, column])

    return docs.mapInArrow(run, schema)


Rule = tuple[tuple[int, str, float], ...]  # (statistic, "<=" or ">", threshold), all of which hold


def tree_rules(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, bins: list[np.ndarray], binned: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """The paths of one tree, and its prediction for each row."""
    rules: list[Rule] = []
    value = np.zeros(len(x))

    def grow(rows: np.ndarray, path: Rule, left: int) -> None:
        g, h = gradient[rows], hessian[rows]
        if path:
            rules.append(path)
        best = (1e-6, None)
        total_g, total_h = g.sum(), h.sum()
        base = total_g**2 / (total_h + 1)
        for f, edges in enumerate(bins if left else []):
            if not len(edges):
                continue
            b = binned[rows, f]
            cg, ch = np.cumsum(np.bincount(b, g, len(edges) + 1))[:-1], np.cumsum(np.bincount(b, h, len(edges) + 1))[:-1]
            gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - base
            gain[(ch < 1e-3) | (total_h - ch < 1e-3)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
        if best[1] is None:
            value[rows] = -total_g / (total_h + 1)
            return
        f, k = best[1]
        low, edge = binned[rows, f] <= k, float(bins[f][k])
        grow(rows[low], (*path, (f, "<=", edge)), left - 1)
        grow(rows[~low], (*path, (f, ">", edge)), left - 1)

    grow(np.arange(len(x)), (), depth)
    return rules, value


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, edge in rule:
        out &= (x[:, f] <= edge) if op == "<=" else (x[:, f] > edge)
    return out


@dataclass
class RuleModel:
    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self, statistics_column: str) -> Column:
        """Score of 0 to 1."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            all_hold = F.lit(True)
            for f, op, edge in rule:
                value = F.col(f"`{statistics_column}`.{STATISTICS[f]}")
                all_hold = all_hold & ((value <= edge) if op == "<=" else (value > edge))
            z = z + F.when(all_hold, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, l1: float = 1e-3) -> RuleModel:
    if len(np.unique(y)) < 2:
        mean = (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], float(np.log(mean / (1 - mean))))
    bins = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(bins, x.T)])
    score, rules = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        found, value = tree_rules(x, p - y, p * (1 - p) + 1e-9, bins, binned, depth)
        rules += found
        score += 0.5 * value
    rules = sorted(set(rules), key=lambda r: (len(r), r))
    matrix = np.column_stack([holds(r, x) for r in rules]).astype(np.float32)
    weights, intercept = lasso_logistic(matrix, y.astype(np.float32), l1)
    return RuleModel([(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4], intercept)


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, sample: int = SAMPLE) -> RuleModel:
    rows = with_statistics(labelled_rows(docs, labels, "quality", mod, held_out, sample), "_statistics")
    got = rows.select("doc_id", "label", "_statistics.*").orderBy("doc_id", "label").toPandas()
    return fit_rules(got[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), got["label"].to_numpy(float))


def scored(docs: DataFrame, model: RuleModel, column: str = "score") -> DataFrame:
    """docs with the score as a further column, whose name must be new."""
    must_be_new([column], docs.columns)
    own = column_name("_statistics", docs.columns)
    return with_statistics(docs, own).withColumn(column, model.column(own)).drop(own)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    column = column_name("_quality", docs.columns)
    return scored(docs, fit(docs, labels), column).filter(F.col(f"`{column}`") >= threshold).drop(column)
