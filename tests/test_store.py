from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon import connect
from quillon.sources import readers
from quillon.sources.store import TableStore


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/s")


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("x"))


def test_append_is_idempotent_by_token(spark, store):
    assert store.create("t", {"x": "int"}) and not store.create("t", {"y": "int"})
    store.append("t", rows(spark, 3), ("writer", 0))
    assert store.append("t", rows(spark, 3), ("writer", 0)) is None
    store.append("t", rows(spark, 2, 3), ("writer", 1))
    store.append("t", rows(spark, 1, 9), ("other", 0))
    assert store.read("t").count() == 6
    store.rewrite("t", lambda r: r.filter("x < 4"), ("writer", 2))
    store.rewrite("t", lambda r: r.limit(0), ("writer", 2))
    assert store.read("t").count() == 4


def test_readers_keep_their_snapshot(spark, store):
    store.create("t", {"x": "int"})
    store.append("t", rows(spark, 5))
    before = store.read("t")
    store.rewrite("t", lambda r: r.filter("x = 1"))
    store.compact("t", 1)
    assert before.count() == 5 and store.read("t").count() == 1


def test_writers_that_race(spark, store):
    store.create("t", {"x": "int"})
    real, calls = store._commit, []

    def slow(name, number, entry):
        if not calls:  # another writer commits first
            calls.append(1)
            other = TableStore(spark, store.root)
            other.append("t", rows(spark, 2, 100))
        return real(name, number, entry)

    store._commit = slow
    store.append("t", rows(spark, 3))
    assert store.read("t").count() == 5


def test_log_grows_with_its_commits(spark, store, monkeypatch):
    from quillon.sources import store as module

    monkeypatch.setattr(module, "WHOLE", 4)
    store.create("t", {"x": "int"})
    for k in range(10):
        store.append("t", rows(spark, 1, k), ("writer", k))
    assert store.append("t", rows(spark, 1), ("writer", 3)) is None
    entries = [store._entry("t", n) for n in store._log("t")]
    assert [("folders" in e) for e in entries] == [k % 4 == 0 for k in range(11)]
    assert sorted(r["x"] for r in store.read("t").collect()) == list(range(10))
    store.rewrite("t", lambda r: r.filter("x > 7"))
    before = store.read("t")
    assert store.vacuum("t") == [] and len(store.vacuum("t", older_than=-60)) == 10 + 11
    assert before.count() == store.read("t").count() == 2
    store.append("t", rows(spark, 1, 50))
    assert store.read("t").count() == 3


def test_conformed(spark, store):
    store.create("t", {"x": "int", "v": "vector[float:2]"})
    store.append("t", spark.createDataFrame([("5", [1.0, 2.0])], "x string, v array<double>"))
    row = store.read("t").first()
    assert row["x"] == 5 and row["v"] == [1.0, 2.0] and len(row["id"]) == 36
    assert store.fields("t") == {"id": "str", "x": "int", "v": "vector[float:2]"}


def test_artifacts(spark, tmp_path):
    db = connect(spark, f"file://{tmp_path}/a")
    ref = db.artifacts.put_bytes(b"data")
    assert db.artifacts.put_bytes(b"data") == ref and db.artifacts.get(ref) == b"data"
    path = tmp_path / "f.bin"
    path.write_bytes(b"\x00\xff" * 1000)
    file = db.artifacts.put_file(str(path))
    assert db.artifacts.get(file) == path.read_bytes()
    assert len(db.artifacts.collect_garbage({file})) == 1 and len(db.artifacts.names()) == 1


@pytest.mark.parametrize(
    ("uri", "url"),
    [
        ("postgres://u:p@h:5432/d", "jdbc:postgresql://h:5432/d"),
        ("mysql://h/d?useSSL=true", "jdbc:mysql://h/d?useSSL=true"),
        ("duckdb:///tmp/x.db", "jdbc:duckdb:/tmp/x.db"),
        ("sqlite:///tmp/x.db", "jdbc:sqlite:/tmp/x.db"),
        ("snowflake://u:p@account/d", "jdbc:snowflake://account/d"),
    ],
)
def test_jdbc_options(uri, url):
    got = readers.jdbc_options(uri, "t", "id", 8, (0, 100))
    assert got["url"] == url and got["numPartitions"] == "8" and ("user" in got) == ("@" in uri)
    with pytest.raises(ValueError):
        readers.jdbc_options("ftp://x", "t")


def test_other_sources(spark, tmp_path):
    assert readers.inmemory(spark, [{"a": 1}], {"a": "int", "b": "str"}).first().asDict() == {"a": 1, "b": None}
    calls = []
    remote = readers.RemoteData(lambda: calls.append(1) or [{"a": 1}], {"a": "int"})
    assert remote.frame(spark).count() == remote.frame(spark).count() == 1 and len(calls) == 1
    frame = spark.createDataFrame([("t:a:1",), ("t:b:1",), ("u:a:1",), ("t_x",)], "k string")
    assert sorted(r[0] for r in readers.keyed(frame, "k", "t:*:1", "t_x").collect()) == ["t:a:1", "t:b:1", "t_x"]
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert readers.read_uri(spark, f"parquet://{tmp_path}/p").count() == 3
    (tmp_path / "j.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.json_file(spark, str(tmp_path / "j.json"), {"a": "int"}).count() == 2
    one = readers.sampled(spark.range(100), "id", 10, seed=1).collect()
    assert one == readers.sampled(spark.range(100).repartition(7), "id", 10, seed=1).collect()
    assert readers.sampled(spark.range(5), "id", None).count() == 5


def test_rows_of_a_database(spark, tmp_path):
    """Against Derby, the database that Spark ships: types, nulls, ranges, and a filter that the
    database itself answers."""
    url = "jdbc:derby:memory:quillon"
    spark._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    rows = [(i, f"n{i}" if i % 7 else None, i / 4) for i in range(100)]
    spark.createDataFrame(rows, "id long, name string, price double").write.jdbc(f"{url};create=true", "items")
    whole = readers.read_uri(spark, url, "items")
    assert sorted(tuple(r) for r in whole.collect()) == rows
    ranges = readers.read_uri(spark, url, "items", column="id", partitions=4, bounds=(0, 100))
    assert ranges.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in ranges.collect()) == rows
    few = whole.filter("price > 20").select("id")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "price" in plan.split("PushedFilters")[1] and "name" not in plan.split("ReadSchema")[1]
    assert sorted(r["id"] for r in few.collect()) == [i for i, _, p in rows if p > 20]


STORE = """
import json, fnmatch
class Redis:
    def __init__(self, path):
        self.rows = json.load(open(path))
    @classmethod
    def from_url(cls, url):
        return cls(url.removeprefix("redis://"))
    def scan_iter(self, match, count):
        return (k.encode() for k in [*self.rows, *list(self.rows)[:9]] if fnmatch.fnmatch(k, match))
    def mget(self, keys):
        assert len(keys) <= 1000
        return [v and v.encode() for v in (self.rows[k.decode()] for k in keys)]
"""


def test_rows_of_a_key_value_store(spark, tmp_path):
    """Against a stand-in for the client package: several requests, keys that vanish or come twice, other
    tables."""
    import json

    (tmp_path / "redis.py").write_text(STORE)
    rows = {f"t:m:{i}": json.dumps({"x": i}) for i in range(2500)} | {"t:m:gone": None, "u:m:1": "{}"}
    (tmp_path / "rows.json").write_text(json.dumps(rows))
    spark.sparkContext.addPyFile(str(tmp_path / "redis.py"))
    got = readers.read_uri(spark, f"redis://{tmp_path}/rows.json", "t").collect()
    assert sorted(tuple(r) for r in got) == sorted((k, v) for k, v in rows.items() if k.startswith("t:") and v)
