"""Tables as Parquet folders with a commit log.

Each table's log is a row of numbered small files. An entry says which data folders make up the
table from then on; writing a data folder has no effect until an entry names it. Entries are
made only if their number is free, so a writer that lost a race reads the log again and tries
anew, and readers keep the snapshot that they began with. An entry may carry a token, and a
token is committed once: that makes streaming writers idempotent.

An entry that only adds a folder names that folder alone; every WHOLE-th entry names them all, so a
log grows with its commits, not with their square. vacuum() deletes what no entry needs any more.

Entries are taken by creating a file that must not exist, and shown by a rename. Both are atomic on
HDFS and local disks. On stores whose rename isn't (S3), a table may have one writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import types
from quillon.sources.files import Files


#: Entries from one that names all folders to the next.
WHOLE = 32


class NotFound(KeyError):
    """A table, component or artifact that doesn't exist."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self.views: dict[str, tuple[DataFrame | Callable[[], DataFrame], str]] = {}  # tables that are someone else's

    def attach(self, name: str, frame: DataFrame | Callable[[], DataFrame], primary_id: str) -> None:
        """Read a DataFrame, or what a function returns at first use, under a table's name; it
        can't be written to."""
        self.views[name] = (frame, primary_id)

    def _view(self, name: str) -> DataFrame:
        frame, key = self.views[name]
        if not isinstance(frame, DataFrame):
            frame = frame()
            self.views[name] = (frame, key)
        return frame

    def _log(self, name: str) -> list[str]:
        return [n for n in self.files.names(f"tables/{name}/log") if n.endswith(".json")]

    def _entry(self, name: str, number: str) -> dict:
        return json.loads(self.files.read(f"tables/{name}/log/{number}"))

    def snapshot(self, name: str) -> dict:
        """The last entry: fields, primary_id, folders, tokens."""
        log = self._log(name)
        if not log:
            raise NotFound(f"no table {name!r}")
        return self._state(name, log)

    def _state(self, name: str, log: list[str]) -> dict:
        """What the log's last entry means: the last whole entry and what was added since."""
        added: list[dict] = []
        for number in reversed(log):
            entry = self._entry(name, number)
            if "folders" in entry:
                for x in reversed(added):
                    entry = entry | {"folders": [*entry["folders"], x["add"]], "tokens": entry["tokens"] | x["tokens"]}
                return entry
            added.append(entry)
        raise NotFound(f"the log of {name!r} has lost its beginning")

    def exists(self, name: str) -> bool:
        return name in self.views or bool(self._log(name))

    def names(self) -> list[str]:
        return sorted({*self.views, *(n for n in self.files.names("tables") if self._log(n))})

    def create(self, name: str, fields: dict[str, str], primary_id: str = "id", extra: dict | None = None) -> bool:
        """False if the table exists already. The primary id is a string field that is added."""
        if self.exists(name):
            return False
        fields = dict(fields) if primary_id in fields else {primary_id: "str", **fields}
        types.struct_type(fields)  # an unknown type is an error now, not on first use
        return self._commit(name, 0, {"fields": fields, "primary_id": primary_id, "folders": [], "tokens": {}, "extra": extra or {}})

    def create_all(self, tables: dict[str, dict[str, str]]) -> list[str]:
        return [name for name, fields in tables.items() if self.create(name, fields)]

    def drop(self, name: str) -> None:
        self.views.pop(name, None)
        self.files.delete(f"tables/{name}")

    def fields(self, name: str) -> dict[str, str]:
        if name in self.views:
            return {f.name: types.type_string(f.dataType) for f in self._view(name).schema.fields}
        return self.snapshot(name)["fields"]

    def primary_id(self, name: str) -> str:
        return self.views[name][1] if name in self.views else self.snapshot(name)["primary_id"]

    def read(self, name: str) -> DataFrame:
        if name in self.views:
            return self._view(name)
        entry = self.snapshot(name)
        schema = types.struct_type(entry["fields"])
        paths = [f"{self.root}/tables/{name}/{folder}" for folder in entry["folders"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def conformed(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with exactly the table's columns: casts, nulls for missing ones, ids for rows
        without one. Columns that the table lacks are an error."""
        entry = self.snapshot(name)
        schema, own = types.struct_type(entry["fields"]), set(rows.columns)
        if unknown := own - {f.name for f in schema.fields}:
            raise ValueError(f"table {name!r} has no column {sorted(unknown)}")
        out = []
        for f in schema.fields:
            column = F.col(f"`{f.name}`").cast(f.dataType) if f.name in own else F.lit(None).cast(f.dataType)
            if f.name == entry["primary_id"]:
                column = F.coalesce(column, F.uuid()) if isinstance(f.dataType, T.StringType) else column
            out.append(column.alias(f.name, metadata=f.metadata))
        return rows.select(*out)

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/tables/{name}/{folder}")
        return folder

    def _commit(self, name: str, number: int, entry: dict) -> bool:
        return self.files.write(f"tables/{name}/log/{number:012d}.json", json.dumps(entry).encode(), overwrite=False)

    def _change(self, name: str, make: Callable[[dict], dict | None]) -> dict:
        """Commit make(last entry), again if someone else was faster; None: nothing to do."""
        if name in self.views:
            raise ValueError(f"{name!r} is read only")
        for _ in range(50):
            log = self._log(name)
            if not log:
                raise NotFound(f"no table {name!r}")
            before = self._state(name, log)
            entry = make(before)
            if entry is None:
                return before
            number = int(log[-1].split(".")[0]) + 1
            if self._commit(name, number, entry if number % WHOLE == 0 else self._short(before, entry)):
                return entry
        raise RuntimeError(f"too many writers on {name!r}")

    @staticmethod
    def _short(before: dict, entry: dict) -> dict:
        """The entry as what it adds, if it does nothing but add a folder."""
        same = all(before[k] == entry[k] for k in before if k not in ("folders", "tokens"))
        if not same or entry["folders"][:-1] != before["folders"] or not entry["folders"]:
            return entry
        return {"add": entry["folders"][-1], "tokens": {k: v for k, v in entry["tokens"].items() if before["tokens"].get(k) != v}}

    def vacuum(self, name: str, older_than: float = 7 * 86400) -> list[str]:
        """Delete data folders that the table no longer has, and entries before the last whole one, if
        they are older than so many seconds: readers and writers that began before must have ended."""
        log = self._log(name)
        if not log:
            raise NotFound(f"no table {name!r}")
        used = set(self._state(name, log)["folders"])
        whole = max(i for i, number in enumerate(log) if "folders" in self._entry(name, number))
        until = time.time() - older_than
        ages = {f"tables/{name}/{n}": t for n, t in self.files.ages(f"tables/{name}").items() if n.startswith("data-") and n not in used}
        ages |= {f"tables/{name}/log/{n}": t for n, t in self.files.ages(f"tables/{name}/log").items() if n in log[:whole]}
        gone = sorted(path for path, made in ages.items() if made <= until)
        for path in gone:
            self.files.delete(path)
        return gone

    def append(self, name: str, rows: DataFrame, token: tuple[str, int] | None = None) -> DataFrame | None:
        """Add rows; returns them as stored. With a token (writer, batch number) a batch that the
        writer committed before is left out, and None returned."""
        if name in self.views:
            raise ValueError(f"{name!r} is read only")
        if self._seen(self.snapshot(name), token):
            return None
        folder = self._write(name, self.conformed(name, rows))

        def add(entry: dict) -> dict | None:
            if self._seen(entry, token):
                return None
            return entry | {"folders": [*entry["folders"], folder], "tokens": self._marked(entry, token)}

        if folder not in self._change(name, add)["folders"]:
            return None
        return self.spark.read.schema(types.struct_type(self.fields(name))).parquet(f"{self.root}/tables/{name}/{folder}")

    def rewrite(self, name: str, change: Callable[[DataFrame], DataFrame], token: tuple[str, int] | None = None) -> None:
        """Replace all rows by change(rows): copy on write. Done anew if the table changed
        meanwhile, as rows of another writer would be lost otherwise."""

        def replace(entry: dict) -> dict | None:
            if self._seen(entry, token):
                return None
            folder = self._write(name, self.conformed(name, change(self.read(name))))
            return entry | {"folders": [folder], "tokens": self._marked(entry, token)}

        self._change(name, replace)

    def compact(self, name: str, files: int) -> None:
        """Rewrite many small folders as one of so many files."""
        self.rewrite(name, lambda rows: rows.repartition(files))

    @staticmethod
    def _seen(entry: dict, token: tuple[str, int] | None) -> bool:
        return token is not None and entry["tokens"].get(token[0], -1) >= token[1]

    @staticmethod
    def _marked(entry: dict, token: tuple[str, int] | None) -> dict:
        return entry["tokens"] if token is None else entry["tokens"] | {token[0]: token[1]}
