from __future__ import annotations

import json

import pytest

from quillon import connect
from quillon.plans.components import Catalog, Component, Status, Trigger, diff, jobs_of
from quillon.sources.store import NotFound


@pytest.fixture
def catalog(spark, tmp_path):
    return connect(spark, f"file://{tmp_path}/c").catalog


def model(size=1, note="a"):
    return Component("m", "model", {"size": size, "note": note}, ("size",))


def app(**kw):
    return Component("app", "application", {"model": model(**kw), "name": "x"}, ("model",))


def test_status_of_a_plan(catalog):
    assert [(s.status, s.version) for s in catalog.apply(model())] == [("new", 0)]
    assert [s.status for s in catalog.apply(model())] == ["same"]
    assert [(s.status, s.version) for s in catalog.apply(model(note="b"))] == [("update", 0)]
    assert catalog.load("model", "m").fields["note"] == "b"
    assert [(s.status, s.version) for s in catalog.plan(model(size=2))] == [("breaking", 1)]
    catalog.apply(model(size=2))
    assert catalog.load("model", "m").fields["size"] == 2 and catalog.load("model", "m", version=0).fields["size"] == 1
    assert catalog.show("model").count() == 2 and catalog.latest().count() == 1
    with pytest.raises(NotFound):
        catalog.load("model", "none")


def test_children(catalog):
    steps = catalog.apply(app())
    assert [s.component.kind for s in steps] == ["model", "application"]
    loaded = catalog.load("application", "app")
    assert loaded == app() and catalog.children(loaded.uuid).count() == 1
    assert [r["identifier"] for r in catalog.parents(model().uuid).collect()] == ["app"]
    assert [s.status for s in catalog.plan(app(size=5))] == ["breaking", "breaking"]
    assert diff(app(), app(size=5)) == ["model"]
    assert [c.identifier for c in catalog.load_all("model")] == ["m"]


def test_teardown(catalog):
    catalog.apply(app())
    with pytest.raises(ValueError, match="is used by"):
        catalog.teardown("model", "m")
    assert len(catalog.teardown("application", "app", recursive=True)) == 2
    assert catalog.show().count() == 0
    catalog.apply(app())
    catalog.teardown("model", "m", force=True)
    assert [r["identifier"] for r in catalog.show().collect()] == ["app"]


def test_jobs(catalog):
    ran = []
    triggers = [Trigger("b", lambda c: ran.append("b"), depends=("a",)), Trigger("a", lambda c: ran.append("a")), Trigger("size", lambda c: ran.append("size"), events=("apply", "update"), requires=("size",)), Trigger("note", lambda c: ran.append("note"), events=("update",), requires=("note",))]
    catalog.apply(model(), triggers)
    assert ran == ["a", "b", "size"]
    ran.clear()
    catalog.apply(model(note="z"), triggers)
    assert ran == ["note"]
    assert [t.name for t in jobs_of(triggers, "apply")] == ["a", "b", "size"]


def test_failure_spreads_and_is_fixed(catalog):
    broken = {"now": True}

    def work(c):
        if broken["now"]:
            raise RuntimeError("no memory")

    triggers = [Trigger("work", work), Trigger("after", lambda c: None, depends=("work",))]
    catalog.apply(app())
    uuid = model().uuid
    states = catalog.run_jobs(uuid, triggers, None)
    assert states == {"work": "failed", "after": "failed"}
    status = {r["identifier"]: r for r in catalog.status().collect()}
    assert status["m"]["status"] == status["app"]["status"] == Status.FAILED
    assert json.loads(status["app"]["details"])["failed_children"] == [uuid]
    assert catalog.wait("application", "app", timeout=1) == Status.FAILED
    broken["now"] = False
    assert set(catalog.fix(uuid, triggers, None).values()) == {"success"}
    assert {r["status"] for r in catalog.status().collect()} == {"success"}


def test_export_and_artifacts(catalog, tmp_path):
    data = json.loads(json.dumps(catalog.export(app())))
    assert Catalog.read(data) == app()
    ref = catalog.db.artifacts.put_bytes(b"weights")
    lost = catalog.db.artifacts.put_bytes(b"old")
    catalog.apply(Component("w", "model", {"blob": ref}))
    assert catalog.collect_garbage() == [lost.rsplit(":", 1)[-1]]
    assert catalog.db.artifacts.get(ref) == b"weights"


def test_variables():
    made = Component("m", "model", {"x": "<var:n>"}).with_variables(n=3)
    assert made.fields == {"x": 3}
