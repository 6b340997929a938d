"""One entry point: tables, queries, models, listeners, vector indexes, components and SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import types
from quillon.operators import mutations, vector
from quillon.operators import outputs as out
from quillon.operators.models import Model
from quillon.plans.components import Catalog
from quillon.plans.predicates import Predicate, apply, is_rows
from quillon.plans.query import Like, Query
from quillon.session import ship
from quillon.sources.files import Artifacts
from quillon.sources.store import TableStore
from quillon.streaming import listener as listening
from quillon.streaming.listener import Listener


@dataclass
class VectorIndex:
    """Vectors to search: a column of a table, or a listener's outputs. A query document is
    embedded by the model whose key it holds, or holds the vector itself."""

    identifier: str
    table: str
    vector: str
    measure: str = "cosine"
    models: tuple[tuple[str, Model], ...] = ()  # (document key, model)

    def query_vector(self, document: dict[str, Any]) -> list[float]:
        for key, model in self.models:
            if key in document:
                return [float(x) for x in model.predict(document[key])]
        if self.vector in document:
            return [float(x) for x in document[self.vector]]
        raise KeyError(f"the document has none of {[k for k, _ in self.models] + [self.vector]}")


class Database:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = ship(spark)
        self.store = TableStore(spark, root)
        self.artifacts = Artifacts(self.store.files)
        self.indexes: dict[str, VectorIndex] = {}
        self.listeners: list[Listener] = []
        self._catalog: Catalog | None = None

    @property
    def catalog(self) -> Catalog:
        if self._catalog is None:
            self._catalog = Catalog(self)
        return self._catalog

    # --- tables

    def __getitem__(self, name: str) -> Query:
        return Query(name, self)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def primary_id(self, name: str) -> str:
        return self.store.primary_id(name)

    def attach(self, name: str, rows: DataFrame | str, primary_id: str = "id") -> Query:
        """Query a DataFrame, or Parquet files, under a name."""
        self.store.attach(name, self.spark.read.parquet(rows) if isinstance(rows, str) else rows, primary_id)
        return self[name]

    def create_table(self, name: str, fields: dict[str, str], primary_id: str = "id") -> Query:
        self.store.create(name, fields, primary_id)
        return self[name]

    def drop_table(self, name: str) -> None:
        self.store.drop(name)

    def drop(self, force: bool = False) -> None:
        """Drop all tables, outputs and components, and forget listeners and indexes. Attached
        sources and artifacts stay where they are. It needs force=True, as nothing brings them back."""
        if not force:
            raise ValueError("drop() deletes all tables; say force=True if that is wanted")
        for name in self.store.names():
            self.store.drop(name)
        self.listeners, self.indexes, self._catalog = [], {}, None

    def list_tables(self) -> list[str]:
        return [n for n in self.store.names() if not n.startswith(("_components", "_parents", "_artifacts", "_jobs", "_deployments", "_done__"))]

    def output_tables(self) -> dict[str, int]:
        """Output tables and the order in which they were made known."""
        known = {x.outputs: i for i, x in enumerate(self.listeners)}
        return {n: known.get(n, -1) for n in self.store.names() if n.startswith(out.PREFIX)}

    def frame(self, rows: Iterable[dict[str, Any]], fields: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], types.struct_type(fields))

    def stable(self, rows: DataFrame) -> DataFrame:
        """rows written to the shared folder and reread: used several times, computed once, and
        not computed again with another result if an executor is lost."""
        sc = self.spark.sparkContext
        if self.spark.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(f"{self.store.root}/checkpoints")
        return rows.checkpoint()

    def kept(self, rows: DataFrame, *folders: str) -> DataFrame:
        """rows written as Parquet under the database's root, with a folder for each value of some
        columns, and reread."""
        path = f"{self.store.root}/work/{uuid.uuid4().hex}"
        rows.write.partitionBy(*folders).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # --- rows

    def insert(self, table: str, rows: DataFrame | Iterable[dict[str, Any]]) -> list[str]:
        """Add rows and run the table's listeners; returns the ids of rows given as dicts. A
        DataFrame's ids stay distributed: the list is empty then."""
        local = not isinstance(rows, DataFrame)
        if local:
            rows = list(rows)
            if not rows:
                return []
            fields = self.store.fields(table)
            if unknown := {k for r in rows for k in r} - set(fields):
                raise ValueError(f"table {table!r} has no column {sorted(unknown)}")
            key = self.primary_id(table)
            if fields[key].lower() in ("str", "id"):
                rows = [{**r, key: r[key] if r.get(key) is not None else str(uuid.uuid4())} for r in rows]
            given = [str(r.get(key)) for r in rows]
            rows = self.frame(rows, {f: t for f, t in fields.items() if any(f in r for r in rows)})
        added = self.store.append(table, rows)
        key = self.primary_id(table)
        if self.listeners and not table.startswith("_"):
            listening.on_change(self, table, added.select(key))
        return given if local else []

    def insert_objects(self, objects: Iterable[Any]) -> list[str]:
        """Rows from instances of annotated classes; a class without a table gets one."""
        ids: list[str] = []
        by_class: dict[type, list[Any]] = {}
        for o in objects:
            by_class.setdefault(type(o), []).append(o)
        for cls, own in by_class.items():
            self.store.create(cls.__name__, types.fields_of(cls))
            ids += self.insert(cls.__name__, [{f: getattr(o, f) for f in types.fields_of(cls)} for o in own])
        return ids

    def _changed(self, table: str, condition: dict[str, Any]) -> DataFrame | None:
        if not self.listeners or not listening.affected(table, self.listeners):
            return None
        from quillon.plans.predicates import condition as column

        return self.stable(self.table(table).filter(column(condition)).select(self.primary_id(table)))

    def update(self, table: str, condition: dict[str, Any], values: dict[str, Any]) -> None:
        ids = self._changed(table, condition)
        self.store.rewrite(table, lambda rows: mutations.updated(rows, condition, values))
        if ids is not None:
            listening.on_change(self, table, ids)

    def replace(self, table: str, condition: dict[str, Any], row: dict[str, Any], upsert: bool = False) -> None:
        """Overwrite the given fields of the rows that meet the condition; the primary id stays.
        With upsert the row is added if none does."""
        key = self.primary_id(table)
        ids = self._changed(table, condition)
        values = {k: v for k, v in row.items() if k != key}
        if upsert and self.table(table).filter(mutations.condition(condition)).isEmpty():
            self.insert(table, [{**condition, **row}])
            return
        self.store.rewrite(table, lambda rows: mutations.updated(rows, condition, values))
        if ids is not None:
            listening.on_change(self, table, ids)

    def delete(self, table: str, condition: dict[str, Any]) -> None:
        ids = self._changed(table, condition)
        self.store.rewrite(table, lambda rows: mutations.deleted(rows, condition))
        if ids is not None:
            listening.on_change(self, table, ids, deleted=True)

    # --- listeners and search

    def listen(self, listener: Listener, backfill: bool = True) -> Listener:
        """Register a listener, make its tables and predict for the rows that there are."""
        if listener.select.db is not self:
            raise ValueError("the listener's query belongs to another database")
        self.listeners = [x for x in self.listeners if x.predict_id != listener.predict_id] + [listener]
        listener.create(self)
        if backfill:
            listener.run(self)
        return listener

    def add_index(self, index: VectorIndex) -> VectorIndex:
        if index.measure not in vector.MEASURES:
            raise ValueError(f"no measure {index.measure!r}")
        self.indexes[index.identifier] = index
        return index

    def index_rows(self, index: VectorIndex) -> tuple[DataFrame, str, str]:
        """(rows, id column, vector column) of an index."""
        if index.table.startswith(out.PREFIX):
            name = out.complete(index.table, self.output_tables())
            return self.table(name).filter(F.col(name).isNotNull()), out.SOURCE, name
        return self.table(index.table).filter(F.col(index.vector).isNotNull()), self.primary_id(index.table), index.vector

    def search(self, like: Like) -> tuple[DataFrame, str, str, list[float], int, str]:
        if like.index not in self.indexes:
            raise KeyError(f"no vector index {like.index!r}")
        index = self.indexes[like.index]
        return (*self.index_rows(index), index.query_vector(like.document), like.n, index.measure)

    def select_nearest(self, document: dict[str, Any], vector_index: str, ids: Iterable[Any] | None = None, n: int = 100) -> DataFrame:
        """(id, score) of the n nearest vectors, among some ids if given."""
        rows, key, column, query, n, measure = self.search(Like(document, vector_index, n))
        if ids is not None:
            rows = apply(rows, [(Predicate(key, "isin", ids if is_rows(ids) else tuple(ids)), key)])
        return vector.nearest(rows, key, column, query, n, measure).withColumnRenamed(key, "id")

    # --- code and configuration

    def add_plugin(self, path: str) -> None:
        """Make a Python file, or a zip of a package, importable on the driver and the executors."""
        self.spark.sparkContext.addPyFile(path)

    def apply(self, what: Any, **variables: Any) -> Any:
        """Register a listener, a vector index, a dataset's table or a component. Applying the
        same thing again changes nothing."""
        if isinstance(what, Listener):
            known = any(x.predict_id == what.predict_id for x in self.listeners)
            return what if known else self.listen(what)
        if isinstance(what, VectorIndex):
            return self.add_index(what)
        return self.catalog.apply(what.with_variables(**variables) if variables else what)

    # --- native

    def sql(self, text: str, **arguments: Any) -> DataFrame:
        """Any Spark SQL over the database's tables, with named parameters."""
        for name in self.store.names():
            if name in text:
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=arguments or None)

    def execute(self, what: Query | str | Callable[[Database], DataFrame]) -> DataFrame:
        if isinstance(what, str):
            return self.sql(what)
        return what.df() if isinstance(what, Query) else what(self)


def connect(spark: SparkSession, root: str) -> Database:
    """The database whose tables lie under a folder of any store that Spark reads."""
    return Database(spark, root)
