"""Datasets: what a query returned, fixed or live, as a whole or row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillon.operators.models import Key, arguments, key_shape
from quillon.operators.training import in_fold
from quillon.plans.predicates import quoted
from quillon.plans.query import Query
from quillon.sources.readers import sampled

if TYPE_CHECKING:
    from quillon.database import Database


@dataclass
class Dataset:
    """A query's rows, or a sample that depends on the seed and the rows' ids alone. A pinned
    dataset keeps the rows that it had when it was first used."""

    identifier: str
    select: Query
    sample_size: int | None = None
    seed: int = 42
    pin: bool = False

    @property
    def table(self) -> str:
        return f"_dataset__{self.identifier}"

    def _live(self, db: Database) -> DataFrame:
        key = db.primary_id(self.select.table)
        return sampled(self.select.df(), key, self.sample_size, self.seed)

    def frame(self, db: Database) -> DataFrame:
        if not self.pin:
            return self._live(db)
        path = f"{db.store.root}/datasets/{self.identifier}"
        if not db.store.files.exists(f"datasets/{self.identifier}/_SUCCESS"):
            self._live(db).write.mode("overwrite").parquet(path)
        return db.spark.read.parquet(path)


@dataclass
class Data:
    """Literal rows that a component brings along."""

    fields: dict[str, str]
    rows: list[dict[str, Any]] = field(default_factory=list)

    def frame(self, db: Database) -> DataFrame:
        return db.frame(self.rows, self.fields)

    def add_to(self, db: Database, table: str) -> list[str]:
        """Insert the rows into a table, which is made if there is none."""
        db.create_table(table, self.fields)
        return db.insert(table, self.rows)


@dataclass
class QueryDataset:
    """A query's rows for training: those of a fold, shaped for a model's arguments. Rows are
    read in blocks; only one block is on the client at a time."""

    db: Database
    select: Query
    key: Key = None
    fold: str | None = "train"
    ids: Iterable[Any] | None = None
    transform: Callable[..., Any] | None = None

    def frame(self) -> DataFrame:
        rows = in_fold(self.select.df(), self.fold)
        if self.ids is not None:
            rows = rows.filter(F.col(quoted(self.db.primary_id(self.select.table))).isin(list(self.ids)))
        return rows

    def __len__(self) -> int:
        return self.frame().count()

    def shaped(self, row: Row) -> Any:
        """The row as the key says: one value, a tuple, a dict, or both; then transformed."""
        values = row.asDict(recursive=True)
        args, kwargs = arguments(self.key)
        positional, named = [values[a] for a in args], {k: values[c] for k, c in kwargs.items()}
        shape = key_shape(self.key)
        if shape == "singleton":
            one = values if self.key is None else positional[0]
            return self.transform(one) if self.transform else one
        if self.transform:
            return self.transform(*positional, **named)
        return {"*args": tuple(positional), "**kwargs": named}.get(shape, (tuple(positional), named))

    def get(self, primary_id: Any) -> Any:
        row = self.select.get(**{self.db.primary_id(self.select.table): primary_id})
        if row is None:
            raise KeyError(primary_id)
        return self.shaped(row)

    def __iter__(self) -> Iterator[Any]:
        return (self.shaped(row) for row in self.frame().toLocalIterator(prefetchPartitions=True))
