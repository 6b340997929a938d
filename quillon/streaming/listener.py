"""Listeners: models whose outputs follow a table.

A listener is a query, a key and a model. Its outputs lie in a table of their own, named by the
listener and a hash of what defines it, with the source row's id. Backfill predicts for rows that
lack outputs; a batch of changed ids is predicted anew. Outputs are keyed by (source, position)
and replaced by source, and a batch is committed with its number, so a batch that runs twice
leaves the same table. Sources that gave no output are remembered, so they aren't tried again.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions.encoding import hash_value
from quillon.operators import outputs as out
from quillon.operators.models import Key, Model, arguments
from quillon.plans.query import Query

if TYPE_CHECKING:
    from quillon.database import Database


@dataclass
class Listener:
    identifier: str
    select: Query
    key: Key
    model: Model
    flatten: bool = False
    digest: str = field(init=False)

    def __post_init__(self) -> None:
        self.model.check(self.key)
        parts = [type(self).__name__, self.identifier, self.model.identifier, self.model.version, self.model.output, _key_text(self.key), self.select.to_json(), self.flatten]
        self.digest = hash_value([str(p) for p in parts])[: out.DIGITS]

    @property
    def predict_id(self) -> str:
        return out.predict_id(self.identifier, self.digest)

    @property
    def outputs(self) -> str:
        return out.table_name(self.predict_id)

    @property
    def upstream(self) -> str:
        """The table that it follows."""
        return self.select.table

    def fields(self) -> dict[str, str]:
        return {"id": "str", out.SOURCE: "str", "position": "int", self.outputs: self.model.output}

    def create(self, db: Database) -> None:
        db.store.create(self.outputs, self.fields(), "id", {"listener": self.identifier})
        db.store.create(self.done, {out.SOURCE: "str"}, out.SOURCE)

    @property
    def done(self) -> str:
        """Table of the sources that were predicted for, whether they gave output or not."""
        return f"_done__{self.predict_id}"

    def predicted(self, rows: DataFrame, key: str) -> DataFrame:
        """Output rows: id, source, position, value. Ids depend on source and position alone."""
        source = F.col(key).cast("string").alias(out.SOURCE)
        if self.flatten:
            made = self.model.predict_flat(rows, self.key, "_value", "_position").select(source, F.col("_position").cast("long").alias("position"), F.col("_value").alias(self.outputs))
        else:
            made = self.model.predict_in(rows, self.key, "_value").select(source, F.lit(0).cast("long").alias("position"), F.col("_value").alias(self.outputs))
        name = F.substring(F.sha2(F.concat_ws(":", out.SOURCE, F.col("position").cast("string")), 256), 1, 32)
        return made.select(name.alias("id"), out.SOURCE, "position", self.outputs)

    def run(self, db: Database, ids: DataFrame | Iterable[str] | None = None, token: tuple[str, int] | None = None) -> DataFrame:
        """Predict for these source ids, or for all that lack outputs; returns the sources."""
        key = db.primary_id(self.upstream)
        rows = self.select.df()
        text = F.col(key).cast("string")
        if ids is None:
            return self._backfill(db, rows, text, key)
        else:
            if not isinstance(ids, DataFrame):
                ids = db.spark.createDataFrame([(str(i),) for i in ids], "id string")
            wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("_s")).distinct()
            todo = rows.join(wanted, text == F.col("_s"), "left_semi")
        todo = db.stable(todo)
        sources = todo.select(text.alias(out.SOURCE)).distinct()
        # Ids that left the query lose their outputs as well.
        gone = db.stable(wanted.withColumnRenamed("_s", out.SOURCE))
        db.store.rewrite(self.outputs, lambda old: old.join(gone, out.SOURCE, "left_anti").unionByName(self.predicted(todo, key)), token)
        db.store.rewrite(self.done, lambda old: old.join(gone, out.SOURCE, "left_anti").unionByName(sources), token)
        return sources

    def _backfill(self, db: Database, rows: DataFrame, text: Column, key: str) -> DataFrame:
        """Predict for what neither table knows. Outputs are committed before the sources are marked
        as done, so a run that failed in between has only the marks left to make."""
        known = lambda table: db.store.read(table).select(F.col(out.SOURCE).alias("_s"))
        left = db.stable(rows.join(known(self.done), text == F.col("_s"), "left_anti"))
        todo = left.join(known(self.outputs), text == F.col("_s"), "left_anti")
        db.store.append(self.outputs, self.predicted(todo, key))
        sources = left.select(text.alias(out.SOURCE)).distinct()
        db.store.append(self.done, sources)
        return sources

    def forget(self, db: Database, ids: DataFrame, token: tuple[str, int] | None = None) -> None:
        """Drop the outputs of deleted rows."""
        gone = db.stable(ids.select(F.col(ids.columns[0]).cast("string").alias(out.SOURCE)).distinct())
        for name in (self.outputs, self.done):
            db.store.rewrite(name, lambda old: old.join(gone, out.SOURCE, "left_anti"), token)


def _key_text(key: Key) -> str:
    args, kwargs = arguments(key)
    return f"{args} {sorted(kwargs.items())} {key is None}"


def order(listeners: Iterable[Listener]) -> list[Listener]:
    """Listeners so that each follows those whose outputs it reads."""
    return [n for n in topological({x.predict_id: x for x in listeners}, lambda x: dependencies(x, listeners))]


def dependencies(listener: Listener, listeners: Iterable[Listener]) -> list[str]:
    read = {listener.upstream, *(out.table_name(p) for p in listener.select.outputs_of)}
    return [x.predict_id for x in listeners if x is not listener and any(t == x.outputs or x.outputs.startswith(t) for t in read if t.startswith(out.PREFIX))]


def topological(nodes: dict[str, Any], before: Callable[[Any], Iterable[str]]) -> list[Any]:
    """Nodes in an order in which each follows those it names; ValueError on a cycle."""
    state: dict[str, int] = {}
    out_: list[Any] = []
    for root in nodes:
        todo = [(root, False)]
        while todo:
            name, ready = todo.pop()
            if ready:
                state[name] = 2
                out_.append(nodes[name])
            elif state.get(name) == 1:
                raise ValueError(f"{name} depends on itself")
            elif name not in state:
                state[name] = 1
                todo.append((name, True))
                for b in before(nodes[name]):
                    if b in nodes and state.get(b) != 2:
                        if state.get(b) == 1:
                            raise ValueError(f"{b} depends on itself")
                        todo.append((b, False))
    return out_


def affected(table: str, listeners: list[Listener]) -> list[Listener]:
    """What a change of a table reaches, in the order in which to run it."""
    reached, tables = [], {table}
    for x in order(listeners):
        reads = {x.upstream, *(out.table_name(p) for p in x.select.outputs_of)}
        if any(t == r or t.startswith(r + "__") for t in tables for r in reads):
            reached.append(x)
            tables.add(x.outputs)
    return reached


def tree(table: str, listeners: list[Listener]) -> str:
    """The consumers of a table as indented lines."""
    lines = [table]

    def grow(name: str, depth: int) -> None:
        for x in listeners:
            if x.upstream == name or any(out.table_name(p) == name for p in x.select.outputs_of):
                lines.append("  " * depth + f"{x.identifier} -> {x.outputs}")
                grow(x.outputs, depth + 1)

    grow(table, 1)
    return "\n".join(lines)


def on_change(db: Database, table: str, ids: DataFrame, deleted: bool = False, token: int | tuple[str, int] | None = None) -> list[str]:
    """Bring all listeners up to date with changed rows of a table; returns the ones that ran. The
    token of a batch is its number, with the name of its stream where there are several."""
    stream, number = token if isinstance(token, tuple) else ("", token)
    chain = affected(table, db.listeners)
    changed: dict[str, DataFrame] = {table: db.stable(ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct())}
    ran = []
    for x in chain:
        own = (f"change:{x.predict_id}:{stream}", number) if number is not None else None
        sources = changed.get(x.upstream)
        if sources is None or x.select.outputs_of:
            # Outputs joined to the base table are named by the base table's ids.
            sources = changed.get(table) if x.upstream == table else sources
        if sources is None:
            continue
        before = db.store.read(x.outputs).join(sources.withColumnRenamed("id", out.SOURCE), out.SOURCE, "left_semi").select("id")
        before = db.stable(before)
        if deleted:
            x.forget(db, sources, own)
        else:
            x.run(db, sources, own)
        after = db.store.read(x.outputs).join(sources.withColumnRenamed("id", out.SOURCE), out.SOURCE, "left_semi").select("id")
        changed[x.outputs] = db.stable(before.unionByName(after).distinct())
        ran.append(x.predict_id)
    return ran


def follow(db: Database, stream: DataFrame, table: str, checkpoint: str, key: str | None = None, **trigger: Any) -> StreamingQuery:
    """Insert a stream's rows into a table and run its listeners, one batch after the other. The
    number of a batch is its token: a batch that runs again after a failure changes nothing twice."""
    name = f"follow:{table}:{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}"
    key = key or db.primary_id(table)

    def batch(rows: DataFrame, number: int) -> None:
        rows = db.stable(rows)
        db.store.append(table, rows, (name, number))
        on_change(db, table, rows.select(key), token=(name, number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def by_consumer(listeners: Iterable[Listener]) -> dict[str, list[str]]:
    """Identifiers of the listeners on each table."""
    out_: dict[str, list[str]] = defaultdict(list)
    for x in listeners:
        out_[x.upstream].append(x.identifier)
    return dict(out_)
