"""The immutable query builder and its translation to a DataFrame.

A query is a table and what is asked of it; verbs return a new query. Whatever the order in which
verbs were called, the plan is: nearest vectors of the whole index (if `like` came first), filters
on the table, joins with outputs, filters on outputs, projection, nearest vectors among what is
left (if `like` came later), offset and limit. Catalyst moves filters and columns to the scan.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillon.functions.nested import set_variables, variables_in
from quillon.operators import outputs as out
from quillon.operators import vector
from quillon.plans.predicates import Field, Predicate, apply, quoted

if TYPE_CHECKING:
    from quillon.database import Database


class GrammarError(AttributeError):
    """A verb that can't follow the ones before it."""


@dataclass(frozen=True)
class Like:
    document: dict[str, Any]
    index: str
    n: int = 10
    first: bool = False


@dataclass(frozen=True)
class Query:
    table: str
    db: Database | None = None
    filters: tuple[Predicate, ...] = ()
    outputs_of: tuple[str, ...] = ()
    how: str = "inner"
    columns: tuple[str, ...] | None = None
    likeness: Like | None = None
    count: int | None = None
    skip: int = 0
    begun: bool = False  # some verb was called

    def _next(self, **changes: Any) -> Query:
        if self.count is not None:
            raise GrammarError("limit ends a query")
        return replace(self, begun=True, **changes)

    # --- verbs that return queries

    def filter(self, *predicates: Predicate) -> Query:
        """All predicates hold, together with those of earlier filters."""
        if not all(isinstance(p, Predicate) for p in predicates):
            raise TypeError("filter takes predicates, like t['x'] == 1")
        return self._next(filters=self.filters + predicates)

    def select(self, *columns: str | Field) -> Query:
        """These columns, together with those of earlier selects; none means all."""
        names = tuple(c.name if isinstance(c, Field) else c for c in columns)
        if not names:
            return self._next()
        before = self.columns or ()
        return self._next(columns=before + tuple(n for n in dict.fromkeys(names) if n not in before))

    def outputs(self, *predict_ids: str, how: str = "inner") -> Query:
        if self.outputs_of:
            raise GrammarError("outputs may be called once")
        return self._next(outputs_of=tuple(predict_ids), how=how)

    def like(self, document: dict[str, Any], vector_index: str, n: int = 10) -> Query:
        """Nearest rows to a document. As the first verb it searches the whole index, and filters
        thin out its n rows; as a later one it searches what the query has left."""
        if self.likeness:
            raise GrammarError("like may be called once")
        return self._next(likeness=Like(document, vector_index, n, first=not self.begun))

    def limit(self, n: int, offset: int = 0) -> Query:
        return self._next(count=n, skip=offset)

    def set_variables(self, **variables: Any) -> Query:
        """`<var:name>` in predicates and documents replaced."""
        return Query.from_dict(set_variables(self.to_dict(), **variables), self.db)

    @property
    def variables(self) -> set[str]:
        return variables_in(self.to_dict())

    # --- columns

    def __getitem__(self, name: str) -> Field:
        return Field(name)

    @property
    def primary_id(self) -> Field:
        return Field(self._db.primary_id(self.table))

    @property
    def _db(self) -> Database:
        if self.db is None:
            raise ValueError("the query has no database")
        return self.db

    # --- plan

    def df(self) -> DataFrame:
        """The query as a DataFrame; nothing runs yet."""
        db = self._db
        key = db.primary_id(self.table)
        rows = db.table(self.table)
        score: list[str] = []
        search = None
        own_vectors = False
        if self.likeness:
            search = db.search(self.likeness)
            score = ["score"]
            own_vectors = not self.likeness.first and db.indexes[self.likeness.index].table == self.table
            if self.likeness.first:
                rows = vector.like_first(rows, key, *search)
        base = list(rows.columns)
        early = [p for p in self.filters if not p.field.startswith(out.PREFIX) or p.field in base]
        late = [p for p in self.filters if p not in early]
        rows = apply(rows, [(p, p.field) for p in early])
        added: list[str] = []
        if self.outputs_of:
            known = db.output_tables()
            names = [out.complete(p, known) for p in self.outputs_of]
            rows = out.joined(rows, key, [(n, db.table(n)) for n in names], self.how)
            added = names
        rows = apply(rows, [(p, out.resolve(p.field, rows.columns)) for p in late])
        if own_vectors:  # the vector is in the row
            rows = rows.withColumn("score", vector.scored(search[2], *search[3:]))
        wanted = None
        if self.columns is not None:
            wanted = [out.resolve(c, rows.columns) for c in self.columns]
            wanted += [c for c in added if c not in wanted]
            hidden = [key] if key not in wanted else []
            visible = [c for c in score if c in rows.columns]
            rows = rows.select(*[F.col(quoted(c)).alias(c) for c in wanted + hidden], *visible)
        if own_vectors:
            rows = rows.filter("score is not null").orderBy(F.desc("score"), quoted(key)).limit(self.likeness.n)
        elif self.likeness and not self.likeness.first:
            rows = vector.like_last(rows, key, *search)
        if self.likeness:
            rows = rows.orderBy(F.desc("score"), quoted(key)) if self.likeness.first else rows
        elif self.count is not None:
            rows = rows.orderBy(quoted(key))
        if self.skip:
            rows = rows.offset(self.skip)
        if self.count is not None:
            rows = rows.limit(self.count)
        return rows if wanted is None else rows.select(*[f"`{c}`" for c in [*wanted, *score]])

    # --- ends of a query

    def execute(self) -> DataFrame:
        return self.df()

    def records(self) -> list[dict[str, Any]]:
        """Rows as dicts on the client, primary id and source as text."""
        ids = {self._db.primary_id(self.table), out.SOURCE}
        return [{k: str(v) if k in ids and v is not None else v for k, v in row.asDict(recursive=True).items()} for row in self.df().collect()]

    def ids(self) -> DataFrame:
        """Primary ids as text, in one column."""
        key = self._db.primary_id(self.table)
        wanted = replace(self, columns=(key,)) if self.columns is not None else self
        return wanted.df().select(F.col(quoted(key)).cast("string").alias(key))

    def distinct(self, column: str) -> DataFrame:
        return self.df().select(quoted(column)).distinct()

    def get(self, **equal: Any) -> Row | None:
        """The first row by primary id that fits, or None."""
        found = self.filter(*[Predicate(k, "==", v) for k, v in equal.items()]) if equal else self
        rows = found.df()
        if not self.likeness and self.count is None:
            key = self._db.primary_id(self.table)
            rows = rows.orderBy(key) if key in rows.columns else rows
        return rows.first()

    def subset(self, ids: Iterable[Any]) -> DataFrame:
        return self.filter(Predicate(self._db.primary_id(self.table), "isin", tuple(ids))).df()

    def missing_outputs(self, predict_id: str) -> DataFrame:
        """Primary ids of the rows that the model has no output for."""
        db = self._db
        key = db.primary_id(self.table)
        try:
            rows = db.table(out.complete(predict_id, db.output_tables()))
        except KeyError:
            return self.ids()
        keep = replace(self, columns=None)
        return out.missing(keep.df(), key, rows).select(F.col(quoted(key)).cast("string").alias(key))

    def _numbered(self) -> tuple[DataFrame, list[tuple[int, int, int]]]:
        """The rows with _part and _row, their place in a range of primary ids, written with a folder
        for each range; and (range, rows before it, its rows). One shuffle, no window: a row's place
        in its sorted partition is the lower part of its monotonic id."""
        key = self._db.primary_id(self.table)
        rows = self.df()
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = F.monotonically_increasing_id()
        dealt = rows.repartitionByRange(parts, quoted(key)).sortWithinPartitions(quoted(key)).withColumn("_row", own)
        dealt = dealt.withColumn("_part", F.shiftright("_row", 33).cast("int")).withColumn("_row", F.col("_row").bitwiseAND((1 << 33) - 1))
        dealt = self._db.kept(dealt, "_part")
        # As many rows as there are shuffle partitions.
        counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
        places, before = [], 0
        for part in sorted(counts):
            places.append((part, before, counts[part]))
            before += counts[part]
        return dealt, places

    def numbered_chunks(self, n: int) -> DataFrame:
        """The rows with the number of their chunk of n rows, in order of the primary id."""
        dealt, places = self._numbered()
        before = dealt.sparkSession.createDataFrame([p[:2] for p in places], "_part int, _before long")
        number = F.floor((F.col("_before") + F.col("_row")) / n).cast("long").alias("chunk")
        return dealt.join(F.broadcast(before), "_part").select(*[f"`{c}`" for c in dealt.columns if c not in ("_part", "_row")], number)

    def chunks(self, n: int) -> Iterator[DataFrame]:
        """The rows in blocks of n by primary id. Each reads the folders that hold it alone."""
        dealt, places = self._numbered()
        total = places[-1][1] + places[-1][2] if places else 0
        for low in range(0, total, n):
            held = [(part, before) for part, before, rows in places if before < low + n and before + rows > low]
            row = sum((F.when(F.col("_part") == part, F.lit(before)).otherwise(0) for part, before in held), F.lit(0)) + F.col("_row")
            yield dealt.filter(F.col("_part").isin([p for p, _ in held]) & (row >= low) & (row < low + n)).drop("_part", "_row")

    # --- mutations

    def insert(self, rows: DataFrame | Iterable[dict[str, Any]]) -> list[str]:
        """Add rows; returns their primary ids."""
        return self._db.insert(self.table, rows)

    def update(self, condition: dict[str, Any], key: str, value: Any) -> None:
        self._db.update(self.table, condition, {key: value})

    def replace(self, condition: dict[str, Any], row: dict[str, Any], upsert: bool = False) -> None:
        self._db.replace(self.table, condition, row, upsert)

    def delete(self, condition: dict[str, Any]) -> None:
        self._db.delete(self.table, condition)

    # --- text

    def to_dict(self) -> dict[str, Any]:
        return {
            "table": self.table,
            "filters": [[p.field, p.op, _literal(p)] for p in self.filters],
            "outputs": list(self.outputs_of),
            "how": self.how,
            "columns": None if self.columns is None else list(self.columns),
            "like": self.likeness and {"document": self.likeness.document, "index": self.likeness.index, "n": self.likeness.n, "first": self.likeness.first},
            "limit": self.count,
            "offset": self.skip,
            "begun": self.begun,
        }

    @staticmethod
    def from_dict(d: dict[str, Any], db: Database | None = None) -> Query:
        filters = tuple(Predicate(f, op, (Query.from_dict(v, db) if isinstance(v, dict) else tuple(v)) if op == "isin" else v) for f, op, v in d["filters"])
        likeness = Like(**d["like"]) if d["like"] else None
        return Query(d["table"], db, filters, tuple(d["outputs"]), d["how"], None if d["columns"] is None else tuple(d["columns"]), likeness, d["limit"], d["offset"], d["begun"])

    def to_json(self) -> str:
        """Text from which the query can be made again; nothing in it is ever evaluated."""
        return json.dumps(self.to_dict(), default=_plain, sort_keys=True)

    @staticmethod
    def from_json(text: str, db: Database | None = None) -> Query:
        return Query.from_dict(json.loads(text, object_hook=_object), db)


def _literal(p: Predicate) -> Any:
    if p.op != "isin":
        return p.value
    if isinstance(p.value, Query):
        return p.value.to_dict()
    if isinstance(p.value, DataFrame):
        raise TypeError("a DataFrame has no text form; use a query")
    return list(p.value)


def _plain(value: Any) -> Any:
    if isinstance(value, (datetime.datetime, datetime.date)):
        return {"__time__": value.isoformat(), "date": not isinstance(value, datetime.datetime)}
    if hasattr(value, "tolist"):
        return value.tolist()
    raise TypeError(f"{type(value).__name__} has no text form")


def _object(value: dict) -> Any:
    if "__time__" in value:
        return (datetime.date if value["date"] else datetime.datetime).fromisoformat(value["__time__"])
    return value
