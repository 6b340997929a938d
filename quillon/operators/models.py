"""Models: Python functions applied to columns, and what is built of them.

A model runs in Arrow batches on the executors. Its `key` says which columns are its arguments:
a name, several names, a mapping of argument names, or both; None is the whole row.
"""

from __future__ import annotations

import inspect
import json
import os
import re
import string
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import types
from quillon.functions.text import format_prompt
from quillon.plans.predicates import quoted

Key = str | Sequence[str] | dict[str, str] | tuple | None


def signature(function: Callable) -> str:
    """How a function takes its input: singleton, *args, **kwargs or *args,**kwargs. Parameters
    without a default are positional."""
    parameters = [p for p in inspect.signature(function).parameters.values() if p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD)]
    plain = [p for p in parameters if p.default is p.empty]
    if len(plain) == 1 and len(parameters) == 1:
        return "singleton"
    if plain and len(plain) < len(parameters):
        return "*args,**kwargs"
    return "*args" if plain else "**kwargs"


def key_shape(key: Key) -> str:
    if key is None or isinstance(key, str):
        return "singleton"
    if isinstance(key, dict):
        return "**kwargs"
    if len(key) == 2 and isinstance(key[0], (list, tuple)) and isinstance(key[1], dict):
        return "*args,**kwargs"
    return "*args"


def packed(key: Key, columns: list[str]) -> Column:
    """The model's arguments as one struct column: a0, a1, ... and k_name."""
    names = columns if key is None else []
    args, kwargs = arguments(key)
    fields = [F.col(quoted(c)).alias(f"a{i}") for i, c in enumerate(args)] + [F.col(quoted(c)).alias(f"k_{k}") for k, c in kwargs.items()]
    if key is None:
        fields = [F.struct(*[F.col(quoted(c)) for c in names]).alias("a0")]
    return F.struct(*fields)


def arguments(key: Key) -> tuple[list[str], dict[str, str]]:
    """Columns of the positional and of the named arguments."""
    match key_shape(key):
        case "singleton":
            return ([] if key is None else [key]), {}
        case "**kwargs":
            return [], dict(key)
        case "*args":
            return list(key), {}
    return list(key[0]), dict(key[1])


def _value(x: Any) -> Any:
    """Python's own types for what Arrow hands over."""
    if isinstance(x, dict):
        return {k: _value(v) for k, v in x.items()}
    if hasattr(x, "tolist"):
        x = x.tolist()
    return [_value(v) for v in x] if isinstance(x, list) else x


def _calls(row: dict[str, Any]) -> tuple[list, dict]:
    args = [row[c] for c in sorted((c for c in row if c[0] == "a" and c[1:].isdigit()), key=lambda c: int(c[1:]))]
    return args, {c[2:]: v for c, v in row.items() if c.startswith("k_")}


@dataclass
class Model:
    """A named model. Either a subclass has predict(), or `function` is what predicts."""

    identifier: str
    function: Callable | None = None
    datatype: str | None = None
    method: str | None = None
    threads: int = 0
    version: int = 0
    metrics: dict[str, list[float]] = field(default_factory=dict)

    breaking = ("identifier", "datatype", "method")

    def predict(self, *args: Any, **kwargs: Any) -> Any:
        if self.function is None:
            raise NotImplementedError
        target = getattr(self.function, self.method) if self.method else self.function
        return target(*args, **kwargs)

    def _target(self) -> Callable:
        if self.function is not None and type(self).predict is Model.predict:
            return getattr(self.function, self.method) if self.method else self.function
        return self.predict

    @property
    def signature(self) -> str:
        return signature(self._target())

    @property
    def output(self) -> str:
        """Type string of the output."""
        return self.datatype or types.output_type(self._target())

    def check(self, key: Key) -> None:
        """A key that doesn't fit the function's parameters is an error before anything runs."""
        args, kwargs = arguments(key)
        try:
            inspect.signature(self._target()).bind(*([None] * (len(args) or (key is None))), **dict.fromkeys(kwargs))
        except TypeError as e:
            raise ValueError(f"the key {key!r} doesn't fit {self.identifier}: {e}") from None

    def predict_batch(self, calls: list[tuple[list, dict]]) -> list[Any]:
        """Outputs of many calls. Subclasses that work on whole batches replace this."""
        if self.threads > 1:
            with ThreadPoolExecutor(self.threads) as pool:
                return list(pool.map(lambda c: self.predict(*c[0], **c[1]), calls))
        return [self.predict(*args, **kwargs) for args, kwargs in calls]

    def column(self, key: Key, columns: list[str], flatten: bool = False) -> Column:
        """The output as a column; with flatten an array of what the model returned."""
        self.check(key)
        kind = T.ArrayType(types.parse(self.output).spark) if flatten else types.parse(self.output).spark
        model, text = self, self.output.lower() == "json"

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for batch in batches:
                calls = [_calls({c: _value(v) for c, v in row.items()}) for row in batch.to_dict("records")]
                results = model.predict_batch(calls)
                if text:
                    results = [[json.dumps(y) for y in r] if flatten else json.dumps(r) for r in results]
                yield pd.Series([_value(r) for r in results], index=batch.index, dtype=object if isinstance(kind, (T.ArrayType, T.StructType, T.StringType)) else None)

        return run(packed(key, columns))

    def predict_in(self, rows: DataFrame, key: Key, name: str = "prediction") -> DataFrame:
        return rows.withColumn(name, self.column(key, rows.columns))

    def predict_flat(self, rows: DataFrame, key: Key, name: str = "prediction", position: str = "position") -> DataFrame:
        """One row for each element that the model returns, with its position."""
        own = rows.withColumn("_all", self.column(key, rows.columns, flatten=True))
        return own.select(*[f"`{c}`" for c in rows.columns], F.posexplode("_all").alias(position, name))

    def validate(self, rows: DataFrame, key: Key, target: str, metrics: Sequence[Metric]) -> dict[str, float]:
        """Metrics of predictions against a target column: one pass for all expressions, and one
        for each Python function."""
        scored = self.predict_in(rows, key, "_prediction")
        passes = [[m for m in metrics if m.function is None], *([m] for m in metrics if m.function is not None)]
        out: dict[str, float] = {}
        for own in filter(None, passes):
            out |= scored.agg(*[m.column(F.col("_prediction"), F.col(quoted(target))).alias(m.identifier) for m in own]).first().asDict()
        return {m.identifier: out[m.identifier] for m in metrics}

    def append_metrics(self, values: dict[str, float]) -> None:
        for k, v in values.items():
            self.metrics.setdefault(k, []).append(v)


class Sequential(Model):
    """Models one after the other, each on the output of the one before."""

    def __init__(self, identifier: str, models: Sequence[Model]):
        super().__init__(identifier, datatype=models[-1].output)
        self.models = list(models)

    @property
    def signature(self) -> str:
        return self.models[0].signature

    def _target(self) -> Callable:
        return self.models[0]._target()

    def predict(self, *args: Any, **kwargs: Any) -> Any:
        out = self.models[0].predict(*args, **kwargs)
        for m in self.models[1:]:
            out = m.predict(out)
        return out

    def predict_batch(self, calls: list[tuple[list, dict]]) -> list[Any]:
        out = self.models[0].predict_batch(calls)
        for m in self.models[1:]:
            out = m.predict_batch([([x], {}) for x in out])
        return out


class QueryModel(Model):
    """A query with variables as a function: its rows, passed through postprocess."""

    def __init__(self, identifier: str, query: Any, preprocess: Callable | None = None, postprocess: Callable | None = None):
        super().__init__(identifier)
        self.query, self.preprocess, self.postprocess = query, preprocess, postprocess

    def predict(self, **variables: Any) -> Any:
        if missing := self.query.variables - set(variables):
            raise ValueError(f"no value for {sorted(missing)}")
        if self.preprocess:
            variables = {k: self.preprocess(v) for k, v in variables.items()}
        rows = self.query.set_variables(**variables).records()
        return self.postprocess(rows) if self.postprocess else rows


class ApiModel(Model):
    """Calls to a service, several at once. The URL is a template of environment variables and of
    the call's arguments; `post` sends and returns parsed JSON."""

    def __init__(self, identifier: str, url: str, post: Callable[[str, dict], Any], threads: int = 8, postprocess: Callable | None = None, datatype: str = "str", tries: int = 3):
        super().__init__(identifier, datatype=datatype, threads=threads)
        self.url, self.post, self.postprocess, self.tries = url, post, postprocess, tries

    def build_url(self, values: dict[str, Any]) -> str:
        names = {n for _, n, _, _ in string.Formatter().parse(self.url) if n}
        found = {n: values[n] if n in values else os.environ[n] for n in names if n in values or n in os.environ}
        if missing := names - set(found):
            raise KeyError(f"no value for {sorted(missing)}")
        return self.url.format(**found)

    def predict(self, **values: Any) -> Any:
        from quillon.operators.retries import retried

        out = retried(lambda: self.post(self.build_url(values), values), tries=self.tries)
        return self.postprocess(out) if self.postprocess else out


class LanguageModel(Model):
    """Text from text or from a list of messages; other input is an error, and a null gives a null.
    The prompt template is put around the input, and a function generates: one text, or with
    several=True a list of them, of which a single one stands for itself. With errors="empty" a
    failing call gives an empty text instead of ending the job."""

    def __init__(self, identifier: str, generate: Callable[[str], Any], prompt: str = "{input}", threads: int = 0, errors: str = "raise", several: bool = False):
        super().__init__(identifier, datatype="json" if several else "str", threads=threads)
        self.generate, self.prompt, self.errors, self.several = generate, prompt, errors, several

    def predict(self, text: Any, context: list[str] | None = None) -> Any:
        if text is None:
            return None
        if isinstance(text, list) and all(isinstance(t, dict) for t in text):
            prompt = self.messages(text)
        elif isinstance(text, str):
            prompt = format_prompt(text, self.prompt, context)
        else:
            raise ValueError(f"{self.identifier} takes a text or a list of messages, not {type(text).__name__}")
        try:
            out = self.generate(prompt)
        except Exception:
            if self.errors == "empty":
                return ""
            raise
        return out[0] if self.several and isinstance(out, list) and len(out) == 1 else out

    @staticmethod
    def messages(turns: list) -> str:
        """A conversation as text, one `role: content` a line."""
        return "\n".join(f"{t['role']}: {t.get('content', t.get('text', ''))}" for t in turns)


class EmbeddingModel(Model):
    """Vectors from texts in batches: embed(texts) returns one vector for each, in any order if it
    returns (number, vector) pairs. Each batch is tried `tries` times. Without dimensions one text
    is embedded to see how many there are."""

    def __init__(self, identifier: str, embed: Callable[[list[str]], list], dimensions: int | None = None, batch: int = 100, tries: int = 3, postprocess: Callable[[list[float]], list[float]] | None = None):
        super().__init__(identifier)
        self.embed, self.batch, self.tries, self.postprocess = embed, batch, tries, postprocess
        self.dimensions = len(self.predict("dimensions")) if dimensions is None else dimensions
        self.datatype = f"vector[float:{self.dimensions}]"

    def predict(self, text: str) -> list[float]:
        return self.predict_batch([([text], {})])[0]

    def predict_batch(self, calls: list[tuple[list, dict]]) -> list[Any]:
        from quillon.operators.retries import retried

        texts = [(args or list(kwargs.values()))[0] for args, kwargs in calls]
        out: list[Any] = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            got = retried(lambda part=part: self.embed(part), tries=self.tries)
            if len(got) != len(part):
                raise ValueError(f"{self.identifier} gave {len(got)} vectors for {len(part)} texts")
            if got and isinstance(got[0], tuple):
                got = [v for _, v in sorted(got, key=lambda x: x[0])]
            vectors = [[float(x) for x in v] for v in got]
            out += [[float(x) for x in self.postprocess(v)] for v in vectors] if self.postprocess else vectors
        return out


def hashed_embedding(dimensions: int, words: str = r"\w+") -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding service: hashed words, unit length. Where the signs
    of all words cancel, the words count without signs: only texts without words get zeros."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimensions
            hashes = [zlib.crc32(w.lower().encode()) for w in re.findall(words, text or "")]
            for h in hashes:
                v[h % dimensions] += 1.0 if h >> 16 & 1 else -1.0
            if not any(v):
                for h in hashes:
                    v[h % dimensions] += 1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out

    return embed


def retrieval_model(identifier: str, search: Callable[[str], list[str]], llm: Model, template: str) -> Model:
    """Retrieve texts, fill them into a template as {context} and {query}, and generate."""

    def predict(query: str) -> str:
        return llm.predict(template.format(context="\n\n".join(search(query)), query=query))

    return Model(identifier, predict, "str")


@dataclass
class Metric:
    """A number from predictions and targets: an aggregate expression, the mean of a Python function
    of each pair, or a Python function of both whole columns (which one task then holds: for
    validation sets only)."""

    identifier: str
    expression: Callable[[Column, Column], Column] | None = None
    function: Callable[[Sequence, Sequence], float] | None = None
    each: Callable[[Any, Any], float] | None = None

    def column(self, prediction: Column, target: Column) -> Column:
        if self.expression is not None:
            return self.expression(prediction, target)
        if self.each is not None:
            one = self.each

            @F.pandas_udf("double")
            def pairs(x: pd.Series, y: pd.Series) -> pd.Series:
                return pd.Series([float(one(a, b)) for a, b in zip(x.tolist(), y.tolist())])

            return F.avg(pairs(prediction, target))
        function = self.function

        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> float:
            return float(function(x.tolist(), y.tolist()))

        return run(prediction, target)


ACCURACY = Metric("accuracy", lambda p, y: F.avg(p.eqNullSafe(y).cast("double")))
MEAN_SQUARED_ERROR = Metric("mse", lambda p, y: F.avg((p - y) * (p - y)))
