from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import Listener, Model, connect
from quillon.operators import training
from quillon.operators.batches import stacked, unstacked
from quillon.sources.datasets import Data, Dataset, QueryDataset
from quillon.streaming.queue import Queue


@pytest.fixture
def db(spark, tmp_path):
    db = connect(spark, f"file://{tmp_path}/db")
    db.create_table("documents", {"x": "int", "y": "int"})
    db["documents"].insert([{"id": f"{i:02d}", "x": i, "y": -i} for i in range(10)])
    return db


def test_pinned_and_live(db):
    live = Dataset("live", db["documents"].select("x"))
    pinned = Dataset("pinned", db["documents"].select("x"), pin=True)
    assert live.frame(db).count() == pinned.frame(db).count() == 10
    db["documents"].insert([{"x": i} for i in range(10, 20)])
    assert live.frame(db).count() == 20 and pinned.frame(db).count() == 10


def test_sample(db):
    a = Dataset("a", db["documents"], sample_size=4, seed=1).frame(db).collect()
    assert len(a) == 4 and a == Dataset("b", db["documents"], sample_size=4, seed=1).frame(db).collect()
    assert Dataset("c", db["documents"], sample_size=4, seed=2).frame(db).collect() != a


def test_query_dataset(db):
    rows = db.table("documents").withColumn(training.FOLD, F.when(F.col("x") < 7, "train").otherwise("valid"))
    db.store.attach("folded", rows, "id")
    t = db["folded"]
    assert len(QueryDataset(db, t, "x")) == 7 and len(QueryDataset(db, t, "x", fold=None)) == 10
    assert sorted(QueryDataset(db, t, "x", fold="valid")) == [7, 8, 9]
    assert QueryDataset(db, t, ("x", "y")).get("03") == (3, -3)
    assert QueryDataset(db, t, {"a": "x"}, transform=lambda a: a * 2).get("03") == 6
    assert QueryDataset(db, t, (("x",), {"b": "y"})).get("03") == ((3,), {"b": -3})
    assert QueryDataset(db, t, "x", ids=["01", "02", "09"], fold=None, transform=lambda x: x + 1).ids and sorted(QueryDataset(db, t, "x", ids=["01", "09"], fold=None)) == [1, 9]
    with pytest.raises(KeyError):
        QueryDataset(db, t, "x").get("nope")


def test_inline_data_and_apply(db):
    assert Data({"a": "int"}, [{"id": "1", "a": 1}]).add_to(db, "inline") == ["1"]
    x = Listener("l", db["inline"], "a", Model("m", lambda a: a + 1, "int"))
    assert db.apply(x) is x and db.apply(Listener("l", db["inline"], "a", Model("m", lambda a: a + 1, "int"))).predict_id == x.predict_id
    assert len(db.listeners) == 1


def test_batches():
    rows = [{"a": np.ones(2) * i, "b": (i, [i, i])} for i in range(3)]
    batch = stacked(rows)
    assert batch["a"].shape == (3, 2) and batch["b"][1].shape == (3, 2)
    back = unstacked(batch)
    assert len(back) == 3 and back[2]["b"][0] == 2 and back[1]["a"].tolist() == [1.0, 1.0]


def test_queue():
    q, got = Queue(), []
    q.publish("t", 1, 2)
    q.publish("u", 3)
    assert len(q) == 3 and q.drain(lambda t, e: got.append((t, e))) == 3 and got == [("t", [1, 2]), ("u", [3])] and len(q) == 0
    q.publish("t", 4)
    with pytest.raises(ZeroDivisionError):
        q.drain(lambda t, e: 1 / 0)
    assert len(q) == 1
