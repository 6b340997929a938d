"""The catalog of components: versioned objects, compared by hash when applied anew.

A component's uuid is a hash of its breaking fields, its hash one of all fields. Applying it is
`same` where the hash is known, `update` where only the uuid is, `breaking` (a new version) where
neither is but the name is, and `new` otherwise. The catalog is four tables of the store, so all
lookups are ordinary queries over them.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from enum import StrEnum
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.encoding import hash_value
from quillon.sources.store import NotFound
from quillon.streaming.listener import topological

if TYPE_CHECKING:
    from quillon.database import Database


class Status(StrEnum):
    SUBMITTED = "submitted"
    PENDING = "pending"
    RUNNING = "running"
    DELETION = "deletion"
    FAILED = "failed"
    SUCCESS = "success"


@dataclass
class Component:
    """A named thing with fields. Fields may hold other components."""

    identifier: str
    kind: str = "component"
    fields: dict[str, Any] = field(default_factory=dict)
    breaking: tuple[str, ...] = ()
    is_component = True

    def children(self) -> list[Component]:
        return [x for v in self.fields.values() for x in _components(v)]

    def merkle(self) -> dict[str, str]:
        """Hash of each field; a child counts by its uuid."""
        return {k: hash_value(_plain(v, lambda c: c.uuid)) for k, v in sorted(self.fields.items())}

    @property
    def hash(self) -> str:
        return hash_value([self.kind, self.identifier, self.merkle()])

    @property
    def uuid(self) -> str:
        hashes = self.merkle()
        return hash_value([self.kind, self.identifier, {k: hashes[k] for k in self.breaking if k in hashes}])[:18]

    def to_json(self) -> str:
        return json.dumps(_plain(self.fields, lambda c: c.reference), sort_keys=True, default=str)

    @property
    def reference(self) -> str:
        return f"&:component:{self.kind}:{self.identifier}:{self.uuid}"

    def with_variables(self, **variables: Any) -> Component:
        from quillon.functions.nested import set_variables

        return Component(self.identifier, self.kind, set_variables(self.fields, **variables), self.breaking)


def _components(value: Any) -> Iterator[Component]:
    if isinstance(value, Component):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _components(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from _components(v)


def _plain(value: Any, name: Callable[[Component], str]) -> Any:
    if isinstance(value, Component):
        return name(value)
    if isinstance(value, dict):
        return {k: _plain(v, name) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v, name) for v in value]
    return value


def diff(old: Component, new: Component) -> list[str]:
    """Fields whose hashes differ."""
    a, b = old.merkle(), new.merkle()
    return sorted(k for k in {*a, *b} if a.get(k) != b.get(k))


@dataclass(frozen=True)
class Step:
    """What applying a component does to one component."""

    status: str  # new, same, update or breaking
    component: Component
    version: int


@dataclass
class Trigger:
    """A function to run when a component is applied, or a table changes."""

    name: str
    function: Callable[..., Any]
    events: tuple[str, ...] = ("apply",)
    depends: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()


def jobs_of(triggers: Iterable[Trigger], event: str, changed: set[str] | None = None) -> list[Trigger]:
    """Triggers of an event in the order in which they depend on each other. After an update only
    those that require a changed field, or nothing in particular, are among them."""
    own = {t.name: t for t in triggers if event in t.events and (changed is None or not t.requires or changed & set(t.requires))}
    return topological(own, lambda t: t.depends)


#: The catalog's tables.
TABLES = {
    "_components": {"uuid": "str", "kind": "str", "identifier": "str", "version": "int", "hash": "str", "status": "str", "details": "str", "fields": "str", "breaking": "json"},
    "_parents": {"id": "str", "parent": "str", "child": "str"},
    "_artifacts": {"id": "str", "component": "str", "artifact": "str"},
    "_jobs": {"job_id": "str", "component": "str", "method": "str", "status": "str", "depends": "json", "error": "str"},
    "_deployments": {"id": "str", "index": "str", "source": "str"},
}
KEYS = {"_components": "uuid", "_jobs": "job_id"}


class Catalog:
    def __init__(self, db: Database):
        self.db, self.store = db, db.store
        self._lock = threading.RLock()
        for name, fields in TABLES.items():
            self.store.create(name, fields, KEYS.get(name, "id"))

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _put(self, name: str, rows: list[dict[str, Any]]) -> None:
        """Rows by their key: new ones are added, known ones replaced."""
        if not rows:
            return
        key = self.store.primary_id(name)
        fields = self.store.fields(name)
        new = self.db.frame([{f: r.get(f) for f in fields} for r in rows], fields)
        gone = [r[key] for r in rows]
        self.store.rewrite(name, lambda old: old.filter(~F.col(key).isin(gone)).unionByName(new))

    # --- lookup

    def latest(self) -> DataFrame:
        """Each component's last version."""
        rows = self.table("_components")
        last = rows.groupBy("kind", "identifier").agg(F.max_by(F.struct(*rows.columns), "version").alias("_r"))
        return last.select("_r.*")

    def show(self, kind: str | None = None, identifier: str | None = None) -> DataFrame:
        rows = self.table("_components")
        if kind:
            rows = rows.filter(F.col("kind") == kind)
        if identifier:
            rows = rows.filter(F.col("identifier") == identifier)
        return rows.select("kind", "identifier", "version", "status", "uuid").orderBy("kind", "identifier", "version")

    def _row(self, kind: str, identifier: str | None = None, version: int | None = None, uuid: str | None = None):
        rows = self.table("_components").filter(F.col("kind") == kind)
        if uuid is not None:
            rows = rows.filter(F.col("uuid") == uuid)
        else:
            rows = rows.filter(F.col("identifier") == identifier)
            if version is not None:
                rows = rows.filter(F.col("version") == version)
        return rows.orderBy(F.desc("version")).first()

    def load(self, kind: str, identifier: str | None = None, version: int | None = None, uuid: str | None = None) -> Component:
        """A component with its children, by name (the last version) or by uuid."""
        row = self._row(kind, identifier, version, uuid)
        if row is None:
            raise NotFound(f"no {kind} {identifier or uuid}")
        return self._made(row)

    def load_all(self, kind: str) -> list[Component]:
        return [self._made(r) for r in self.latest().filter(F.col("kind") == kind).orderBy("identifier").collect()]

    def _made(self, row) -> Component:
        def back(value: Any) -> Any:
            if isinstance(value, str) and value.startswith("&:component:"):
                kind, _, uuid = value.removeprefix("&:component:").split(":")
                return self.load(kind, uuid=uuid)
            if isinstance(value, dict):
                return {k: back(v) for k, v in value.items()}
            return [back(v) for v in value] if isinstance(value, list) else value

        return Component(row["identifier"], row["kind"], back(json.loads(row["fields"])), tuple(json.loads(row["breaking"])))

    def parents(self, uuid: str) -> DataFrame:
        edges = self.table("_parents").filter(F.col("child") == uuid)
        return edges.join(self.table("_components"), F.col("parent") == F.col("uuid")).select("kind", "identifier", "version", "uuid")

    def children(self, uuid: str) -> DataFrame:
        edges = self.table("_parents").filter(F.col("parent") == uuid)
        return edges.join(self.table("_components"), F.col("child") == F.col("uuid")).select("kind", "identifier", "version", "uuid")

    # --- lifecycle

    def plan(self, component: Component) -> list[Step]:
        """What apply() would do, children first."""
        steps: dict[str, Step] = {}

        def visit(c: Component) -> None:
            for child in c.children():
                visit(child)
            if c.uuid in steps:
                return
            last = self._row(c.kind, c.identifier)
            known = self._row(c.kind, uuid=c.uuid)
            if known is not None and known["hash"] == c.hash:
                steps[c.uuid] = Step("same", c, known["version"])
            elif known is not None:
                steps[c.uuid] = Step("update", c, known["version"])
            elif last is not None:
                steps[c.uuid] = Step("breaking", c, last["version"] + 1)
            else:
                steps[c.uuid] = Step("new", c, 0)

        visit(component)
        return list(steps.values())

    def apply(self, component: Component, triggers: Iterable[Trigger] = ()) -> list[Step]:
        """Store what changed and run the triggers; returns the steps taken."""
        with self._lock:
            steps = self.plan(component)
            changed = [s for s in steps if s.status != "same"]
            old = {s.component.uuid: self.load(s.component.kind, uuid=s.component.uuid) for s in changed if s.status == "update"}
            self._put("_components", [{"uuid": s.component.uuid, "kind": s.component.kind, "identifier": s.component.identifier, "version": s.version, "hash": s.component.hash, "status": str(Status.SUCCESS), "details": "", "fields": s.component.to_json(), "breaking": json.dumps(list(s.component.breaking))} for s in changed])
            edges = [(s.component.uuid, c.uuid) for s in changed for c in s.component.children()]
            self._put("_parents", [{"id": f"{p}:{c}", "parent": p, "child": c} for p, c in dict.fromkeys(edges)])
            refs = [(s.component.uuid, r) for s in changed for r in _references(s.component.fields)]
            self._put("_artifacts", [{"id": f"{u}:{r}", "component": u, "artifact": r} for u, r in refs])
        top = steps[-1]
        if top.status != "same":
            fields = set(diff(old[top.component.uuid], top.component)) if top.status == "update" else None
            self.run_jobs(top.component.uuid, jobs_of(triggers, "update" if top.status == "update" else "apply", fields), top.component)
        return steps

    def teardown(self, kind: str, identifier: str, recursive: bool = False, force: bool = False) -> list[str]:
        """Remove all versions of a component; ValueError while another one uses it, unless
        forced. With recursive its children go too, where nothing else uses them."""
        rows = self.table("_components").filter((F.col("kind") == kind) & (F.col("identifier") == identifier)).collect()
        if not rows:
            raise NotFound(f"no {kind} {identifier}")
        gone: list[str] = []
        for row in rows:
            used = [p["uuid"] for p in self.parents(row["uuid"]).collect() if p["uuid"] not in gone]
            if used and not force:
                raise ValueError(f"{kind} {identifier} is used by {used}")
        below = [c for row in rows for c in self.children(row["uuid"]).collect()]
        gone += [r["uuid"] for r in rows]
        self._drop(gone)
        for c in below if recursive else ():
            if not self.parents(c["uuid"]).isEmpty() or c["uuid"] in gone:
                continue
            if self._row(c["kind"], uuid=c["uuid"]) is not None:
                gone += self.teardown(c["kind"], c["identifier"], recursive=True)
        return gone

    def _drop(self, uuids: list[str]) -> None:
        self.store.rewrite("_components", lambda t: t.filter(~F.col("uuid").isin(uuids)))
        self.store.rewrite("_parents", lambda t: t.filter(~F.col("parent").isin(uuids)))
        self.store.rewrite("_artifacts", lambda t: t.filter(~F.col("component").isin(uuids)))

    def collect_garbage(self) -> list[str]:
        """Delete artifacts that no component refers to any more."""
        return self.db.artifacts.collect_garbage({r["artifact"] for r in self.table("_artifacts").select("artifact").distinct().collect()})

    # --- jobs and status

    def run_jobs(self, component: str, triggers: list[Trigger], *args: Any) -> dict[str, str]:
        """Run triggers in order. What depends on a failed one fails as well, without running."""
        states: dict[str, str] = {}
        rows = []
        for t in triggers:
            error = ""
            if any(states.get(d) == Status.FAILED for d in t.depends):
                states[t.name], error = str(Status.FAILED), "a job that it depends on failed"
            else:
                try:
                    t.function(*args)
                    states[t.name] = str(Status.SUCCESS)
                except Exception as e:
                    states[t.name], error = str(Status.FAILED), f"{type(e).__name__}: {e}"
            rows.append({"job_id": f"{component}:{t.name}", "component": component, "method": t.name, "status": states[t.name], "depends": json.dumps(list(t.depends)), "error": error})
        self._put("_jobs", rows)
        if Status.FAILED in states.values():
            self.set_failed(component, "; ".join(r["error"] for r in rows if r["error"]))
        return states

    def fix(self, component: str, triggers: list[Trigger], *args: Any) -> dict[str, str]:
        """Run the failed jobs of a component again; it is well again if all succeed."""
        failed = {r["method"] for r in self.table("_jobs").filter((F.col("component") == component) & (F.col("status") == str(Status.FAILED))).collect()}
        states = self.run_jobs(component, [Trigger(t.name, t.function, t.events, tuple(d for d in t.depends if d in failed), t.requires) for t in triggers if t.name in failed], *args)
        if Status.FAILED not in states.values():
            self.set_fixed(component)
        return states

    def ancestors(self, uuid: str) -> list[str]:
        edges = [(r["parent"], r["child"]) for r in self.table("_parents").select("parent", "child").collect()]
        out, todo = [], [uuid]
        while todo:
            at = todo.pop()
            new = [p for p, c in edges if c == at and p not in out]
            out += new
            todo += new
        return out

    def _mark(self, uuid: str, status: str, change: Callable[[list[str]], list[str]], details: str | None = None) -> None:
        row = self.table("_components").filter(F.col("uuid") == uuid).first()
        if row is None:
            return
        now = json.loads(row["details"] or "{}")
        now["failed_children"] = change(now.get("failed_children", []))
        if details is not None:
            now["reason"] = details
        well = status == Status.SUCCESS and not now["failed_children"]
        self._put("_components", [row.asDict() | {"status": status if well or status == Status.FAILED else str(Status.FAILED), "details": json.dumps({} if well else now)}])

    def set_failed(self, uuid: str, reason: str = "") -> None:
        """A failed component marks all that use it."""
        self._mark(uuid, str(Status.FAILED), lambda x: x, reason)
        for a in self.ancestors(uuid):
            self._mark(a, str(Status.FAILED), lambda x: sorted({*x, uuid}))

    def set_fixed(self, uuid: str) -> None:
        """When the last failed child of a component is well, so is the component."""
        self._mark(uuid, str(Status.SUCCESS), lambda x: x)
        for a in self.ancestors(uuid):
            self._mark(a, str(Status.SUCCESS), lambda x: [c for c in x if c != uuid])

    def status(self) -> DataFrame:
        """The last version's status of each component."""
        return self.latest().select("kind", "identifier", "version", "status", "details")

    def wait(self, kind: str, identifier: str, timeout: float = 60, every: float = 0.5) -> str:
        """Until a component is well or has failed."""
        end = time.monotonic() + timeout
        while True:
            row = self._row(kind, identifier)
            if row is not None and row["status"] in (Status.SUCCESS, Status.FAILED):
                return row["status"]
            if time.monotonic() > end:
                raise TimeoutError(f"{kind} {identifier} isn't ready")
            time.sleep(every)

    # --- files

    def export(self, component: Component) -> dict[str, Any]:
        """The component and all below it, as JSON text can hold it."""
        below = {c.reference: self.export(c) for c in component.children()}
        return {"kind": component.kind, "identifier": component.identifier, "breaking": list(component.breaking), "fields": json.loads(component.to_json()), "children": below}

    @staticmethod
    def read(data: dict[str, Any]) -> Component:
        """What export() wrote. Data from JSON: nothing in it is evaluated."""
        below = {ref: Catalog.read(d) for ref, d in data["children"].items()}

        def back(value: Any) -> Any:
            if isinstance(value, str) and value in below:
                return below[value]
            if isinstance(value, dict):
                return {k: back(v) for k, v in value.items()}
            return [back(v) for v in value] if isinstance(value, list) else value

        return Component(data["identifier"], data["kind"], back(data["fields"]), tuple(data["breaking"]))


def _references(value: Any) -> list[str]:
    from quillon.functions.nested import find_leaves

    return find_leaves(_plain(value, lambda c: ""), lambda x: isinstance(x, str) and x.startswith(("&:blob:", "&:file:")))


def max_versions(rows: DataFrame, name: str, version: str, *columns: str) -> DataFrame:
    """Each name's greatest version, and columns of that row."""
    return rows.groupBy(name).agg(F.max(version).alias(version), *[F.max_by(c, version).alias(c) for c in columns])


def running_versions(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Rows with the number of their version among those of their name, from 0."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1)
