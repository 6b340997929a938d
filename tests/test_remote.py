from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quillon import Listener, Model, connect
from quillon.database import VectorIndex
from quillon.operators import remote
from quillon.streaming import events
from quillon.streaming.poll import Poller


@pytest.fixture
def db(spark, tmp_path):
    db = connect(spark, f"file://{tmp_path}/db")
    db.create_table("places", {"v": "vector[float:2]"})
    db["places"].insert([{"id": "a", "v": [1.0, 0.0]}, {"id": "b", "v": [0.0, 1.0]}, {"id": "c", "v": [1.0, 1.0]}])
    db.add_index(VectorIndex("near", "places", "v", "dot"))
    return db


def test_search_over_http(db):
    server = remote.serve(remote.SearchService(db))
    try:
        client = remote.SearchClient(remote.http_post(f"http://127.0.0.1:{server.server_port}"), "near")
        assert client.list() == ["near"]
        assert client.describe() == {"size": 3, "dimensions": 2, "measure": "dot"}
        assert client.nearest_from_array([2, 1], n=2) == (["c", "a"], [3.0, 2.0])
        assert client.nearest_from_id("b", n=5) == (["b", "c", "a"], [1.0, 1.0, 0.0])
        assert client.add({"a": [5, 0], "d": [9, 9]}) == 2
        assert client.nearest_from_array([1, 0], n=3) == (["d", "a", "c"], [9.0, 5.0, 1.0])
        assert client.delete(["d", "nobody"]) == 2 and client.describe()["size"] == 3
        for call in (lambda: client.nearest_from_id("d"), lambda: client.post("drop", {}), lambda: remote.SearchClient(client.post, "far").describe()):
            with pytest.raises(KeyError):
                call()
        with pytest.raises(ValueError):
            client.post("describe", {"nonsense": 1})
    finally:
        server.shutdown()
        server.server_close()


def test_drop_everything(db):
    with pytest.raises(ValueError, match="force"):
        db.drop()
    assert db.list_tables() == ["places"]
    db.drop(force=True)
    assert db.list_tables() == [] and db.indexes == {}


def test_poller(db, spark):
    source = [(str(i), f"t{i}") for i in range(3)]
    db.create_table("texts", {"s": "str"})
    x = db.listen(Listener("size", db["texts"].select("id", "s"), "s", Model("len", len, "int")))
    poller = Poller(db, "texts", lambda: spark.createDataFrame(source, "id string, s string"))
    assert poller.poll() == 3 and poller.poll() == 0
    source.append(("9", "nine"))
    run, x.run = x.run, None  # the listener fails once the row is in
    with pytest.raises(TypeError):
        poller.poll()
    x.run = run
    assert poller.poll() == 0
    assert {r["_source"]: r[x.outputs] for r in db.table(x.outputs).collect()} == {"0": 2, "1": 2, "2": 2, "9": 4}


def test_poller_runs_until_stopped(db, spark):
    failed = []

    def broken():
        raise OSError("away")

    poller = Poller(db, "places", broken, period=0.01, on_error=failed.append).start()
    with pytest.raises(RuntimeError):
        poller.start()
    end = time.time() + 20
    while len(failed) < 2 and time.time() < end:
        time.sleep(0.02)
    poller.stop(20)
    assert not poller.thread.is_alive() and len(failed) >= 2
    seen = len(failed)
    time.sleep(0.1)
    assert len(failed) == seen


def test_foreign_changes(spark):
    records = spark.createDataFrame([("insert", ("1",)), ("replace", ("2",)), ("delete", ("3",)), ("drop", None), ("insert", (None,)), (None, ("4",))], "operationType string, documentKey struct<_id: string>")
    assert [tuple(r) for r in events.from_change_records(records).orderBy("id").collect()] == [("1", "insert"), ("2", "update"), ("3", "delete")]
    versions = spark.createDataFrame([(1, "INSERT", False), (2, "INSERT", True), (2, "DELETE", True), (3, "DELETE", False), (None, "INSERT", False), (4, "INSERT", None)], "k long, `METADATA$ACTION` string, `METADATA$ISUPDATE` boolean")
    found = lambda **o: sorted(tuple(r) for r in events.from_row_versions(versions, "k", **o).collect())
    assert found() == [("1", "insert"), ("2", "update"), ("3", "delete"), ("4", "insert")]
    assert found(appends=True) == [("1", "insert"), ("2", "insert"), ("4", "insert")]
    assert events.from_row_versions(versions.filter(F.lit(False)), "k").count() == 0
