from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quillon import Listener, Model, VectorIndex, connect
from quillon.operators import outputs
from quillon.streaming import events, listener, windows
from quillon.streaming.cron import Crontab, Schedule


@pytest.fixture
def db(spark, tmp_path):
    db = connect(spark, f"file://{tmp_path}/db")
    db.create_table("t", {"x": "int"})
    return db


def plus(n):
    return Model(f"plus{n}", lambda x: x + n, "int")


def values(db, x):
    return sorted(r[x.outputs] for r in db.table(x.outputs).collect())


def add(db, numbers):
    return db["t"].insert([{"id": f"{n:04d}", "x": n} for n in numbers])


def test_naming(db):
    x = Listener("a" * 60, db["t"], "x", plus(1))
    assert len(x.predict_id) == 50 and x.predict_id.startswith("a" * 30 + "__") and x.outputs == "_outputs__" + x.predict_id
    assert Listener("a", db["t"], "x", plus(1)).predict_id != Listener("a", db["t"], "x", plus(2)).predict_id
    assert outputs.complete("a", {"_outputs__a__01": 0, "_outputs__a__02": 1, "_outputs__ab__9": 2}) == "_outputs__a__02"


def test_backfill_then_follow(db):
    add(db, range(5))
    first = db.listen(Listener("l1", db["t"], "x", plus(1)))
    second = db.listen(Listener("l2", db[first.outputs], first.outputs, plus(10)))
    assert values(db, first) == [1, 2, 3, 4, 5] and values(db, second) == [11, 12, 13, 14, 15]
    assert db["t"].missing_outputs("l1").count() == 0
    add(db, range(5, 10))
    assert values(db, first) == list(range(1, 11)) and values(db, second) == list(range(11, 21))
    first.run(db)
    assert len(values(db, first)) == 10
    db["t"].update({"x": 3}, "x", 100)
    assert 101 in values(db, first) and 4 not in values(db, first) and 111 in values(db, second) and len(values(db, second)) == 10
    db["t"].delete({"x": 100})
    assert len(values(db, first)) == 9 and len(values(db, second)) == 9
    assert db["t"].outputs("l1").execute().count() == 9


def test_flatten(db):
    add(db, [0, 2, 3])
    x = db.listen(Listener("f", db["t"], "x", Model("rep", lambda n: list(range(n)), "int"), flatten=True))
    rows = db.table(x.outputs).collect()
    assert sorted((r["_source"], r["position"], r[x.outputs]) for r in rows) == [("0002", 0, 0), ("0002", 1, 1), ("0003", 0, 0), ("0003", 1, 1), ("0003", 2, 2)]
    assert x.run(db).count() == 0  # the source without output isn't tried again


def test_filtered_listener_and_graph(db):
    add(db, range(4))
    t = db["t"]
    a = db.listen(Listener("a", t.filter(t["x"] > 1), "x", plus(1)))
    b = db.listen(Listener("b", t, "x", plus(2)))
    both = db.listen(Listener("both", t.outputs("a", "b"), (a.outputs, b.outputs), Model("sum", lambda p, q: p + q, "int")))
    assert values(db, a) == [3, 4] and values(db, both) == [7, 9]
    add(db, [10])
    assert values(db, both) == [7, 9, 23]
    assert [x.identifier for x in listener.affected("t", db.listeners)][-1] == "both"
    assert "both" in listener.tree("t", db.listeners) and set(listener.by_consumer(db.listeners)["t"]) == {"a", "b", "both"}


def test_vectors_of_a_listener(db):
    add(db, range(6))
    embed = Model("e", lambda x: [float(x), 1.0], "vector[float:2]")
    x = db.listen(Listener("e", db["t"], "x", embed))
    db.add_index(VectorIndex("i", x.outputs, x.outputs, "l2", (("x", embed), ("y", Model("neg", lambda y: [-float(y), 1.0], "vector[float:2]")))))
    t = db["t"]
    assert [r["x"] for r in t.like({"x": 3}, "i", n=1).records()] == [3]
    assert [r["x"] for r in t.like({"y": -5}, "i", n=1).records()] == [5]
    add(db, [50])
    assert [r["x"] for r in t.like({"y": -50}, "i", n=1).records()] == [50]


def test_stream_is_idempotent(db, spark, tmp_path):
    x = db.listen(Listener("l", db["t"], "x", plus(1)))
    source = tmp_path / "in"
    spark.createDataFrame([("1", 1), ("2", 2)], "id string, x long").write.parquet(str(source))
    stream = lambda: spark.readStream.schema("id string, x long").parquet(str(source))
    checkpoint = str(tmp_path / "cp")
    listener.follow(db, stream(), "t", checkpoint).awaitTermination()
    assert values(db, x) == [2, 3]
    spark.createDataFrame([("3", 3)], "id string, x long").write.mode("append").parquet(str(source))
    listener.follow(db, stream(), "t", checkpoint).awaitTermination()
    assert values(db, x) == [2, 3, 4]
    # The same batch number once more, as after a failure before the commit was noted.
    import hashlib

    name = f"follow:t:{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}"
    again = spark.createDataFrame([("3", 3)], "id string, x long")
    assert db.store.append("t", again, (name, 1)) is None
    listener.on_change(db, "t", again.select("id"), token=1)
    assert values(db, x) == [2, 3, 4] and db.table("t").count() == 3


def test_two_streams_and_two_tables_lose_nothing(db, spark, tmp_path):
    t = db["t"]
    x = db.listen(Listener("l", t, "x", plus(1)))
    db.create_table("u", {"x": "int"})
    y = db.listen(Listener("m", db["u"], "x", plus(100)))
    for k in range(2):
        rows = spark.createDataFrame([(f"{k}-{i}", 10 * k + i) for i in range(3)], "id string, x long")
        rows.write.parquet(str(tmp_path / f"in{k}"))
        for table in ("t", "u"):
            listener.follow(db, spark.readStream.schema(rows.schema).parquet(str(tmp_path / f"in{k}")), table, str(tmp_path / f"cp-{table}-{k}")).awaitTermination()
    assert values(db, x) == [1, 2, 3, 11, 12, 13] and values(db, y) == [100, 101, 102, 110, 111, 112]


@pytest.mark.parametrize("fails", [0, 1])
def test_a_backfill_that_failed_can_be_repeated(db, monkeypatch, fails):
    add(db, range(4))
    x = db.listen(Listener("l", db["t"], "x", plus(1)), backfill=False)
    real, calls = db.store._commit, []

    def failing(name, number, entry):
        calls.append(name)
        if len(calls) == fails + 1:
            raise OSError("lost")
        return real(name, number, entry)

    monkeypatch.setattr(db.store, "_commit", failing)
    with pytest.raises(OSError):
        x.run(db)
    monkeypatch.setattr(db.store, "_commit", real)
    x.run(db)
    assert values(db, x) == [1, 2, 3, 4] and x.run(db).count() == 0
    add(db, [9])
    assert values(db, x) == [1, 2, 3, 4, 10]


def test_events(spark):
    rows = spark.createDataFrame([("t", "insert", "b"), ("t", "insert", "a"), ("t", "delete", "c"), ("u", "insert", "a")], "table string, type string, id string")
    got = {(r["table"], r["type"]): r["ids"] for r in events.grouped(rows).collect()}
    assert got == {("t", "insert"): ["a", "b"], ("t", "delete"): ["c"], ("u", "insert"): ["a"]}
    assert events.by_kind(rows)["delete"].count() == 1
    many = spark.range(5000).selectExpr("'t' as table", "cast(null as string) as type", "id % 2500 as id")
    parts = events.grouped(many, batch=100).collect()
    assert sum(r["n_ids"] for r in parts) == 2500 and max(r["n_ids"] for r in parts) < 200


def test_cycles():
    with pytest.raises(ValueError):
        listener.topological({"a": "b", "b": "a"}, lambda x: [x])
    assert listener.topological({"a": ("b", "c"), "b": ("c",), "c": ()}, lambda x: x) == [(), ("c",), ("b", "c")]


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.datetime(2020, 1, 1, h, m), "a") for h, m in ((0, 1), (0, 59), (1, 0), (3, 30))], "ts timestamp, k string")
    rows.write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "w"))
    out = windows.windowed(stream, "ts", "1 hour", ["k"], [F.count("*").alias("n")])
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 1, 2]


def test_cron():
    every = Schedule("*/15 3-5 * * 1")
    assert every.due(datetime.datetime(2026, 1, 5, 3, 30)) and not every.due(datetime.datetime(2026, 1, 6, 3, 30))
    assert every.after(datetime.datetime(2026, 1, 5, 5, 45)) == datetime.datetime(2026, 1, 12, 3, 0)
    assert Schedule("0 0 1 * 7").due(datetime.datetime(2026, 2, 8)) and Schedule("0 0 1 * 7").due(datetime.datetime(2026, 4, 1))
    for bad in ("* * * *", "61 * * * *", "a * * * *"):
        with pytest.raises(ValueError):
            Schedule(bad)
    tab, ran = Crontab(), []
    tab.add("job", "5 * * * *", lambda: ran.append(1))
    assert tab.run_due(datetime.datetime(2026, 1, 1, 0, 5)) == ["job"] and tab.run_due(datetime.datetime(2026, 1, 1, 0, 6)) == [] and ran == [1]
