from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import decontam

FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            for p in range(len(own) - len(part) + 1):
                if own[p : p + len(part)] == part:
                    hit.update(range(p, p + len(part)))
                    found.add("" if name is None else str(name))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, hit int")


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [decontam.TEST_BYTES, 40])
def test_report(spark, monkeypatch, block):
    rng = random.Random(3)
    vocabulary = ["a", "Bé", "c1", "dd", "É"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, item(25)), (2, item(12)), (3, "rare two"), (4, ""), (5, None), (2, item(11)), (None, "no id here"), (10, item(10))]
    texts = [item(rng.randrange(40)) for _ in range(40)] + [items[0][1].replace(" ", "\n - "), "x rare, TWO y rare two", None, "", "...", items[0][1] * 3, "no id here", items[7][1] + " " + items[1][1]]
    texts += texts[-3:]
    monkeypatch.setattr(decontam, "TEST_BYTES", block)
    monkeypatch.setattr(decontam.test_blocks, "__defaults__", (block,))
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.report(frame(spark, texts), items_frame(spark, items)).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(texts)}
    kept = decontam.decontaminate(frame(spark, texts), items_frame(spark, items))
    assert kept.columns == ["doc_id", "text", "n_words", "hit"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in got if not got[i][4]]


def test_empty_tables(spark):
    assert decontam.report(frame(spark, []), items_frame(spark, [(1, "a b")])).collect() == []
    row = decontam.report(frame(spark, ["a b"]), items_frame(spark, [])).first()
    assert tuple(row) == (0, *brute("a b", []))


def test_matches_are_longest(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "intro " + " ".join(f"W{i}" for i in range(5, 25)) + " outro"
    got = [tuple(r) for r in decontam.matches(frame(spark, [text]), items_frame(spark, [(7, item)])).collect()]
    assert got == [(0, 1, "7", 5, 20)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array_order(values):
    import numpy as np

    order = decontam.suffix_array(np.array(values), 16)
    assert sorted(order.tolist()) == list(range(len(values)))
    keys = [values[i : i + 16] for i in order]
    assert keys == sorted(keys)


def test_rows_without_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "rare two", "n", 1), (1, "rare two", "n", 1), (1, "rare two", "n", 1), (2, None, "n", 1)], "doc_id long, text string, n_words string, hit int")
    got = sorted(((r["doc_id"], r["n_hit"]) for r in decontam.report(docs, items_frame(spark, [(3, "rare two")])).collect()), key=str)
    assert got == [(1, 2), (1, 2), (2, 0), (None, 2)]


def test_one_block_at_a_time(monkeypatch):
    class Sent:
        loads = 0
        _path = "p"
        value = property(lambda self: (_ for _ in ()).throw(AssertionError("a block of several isn't kept")))

        def load_from_path(self, path):
            Sent.loads += 1
            return decontam.TestItems([(Sent.loads, "a b c")], 3)

    raw, offsets = decontam.text_buffers(decontam.pa.array(["x a b c y", "a b"]))
    words, hit, items = decontam.judge(raw, offsets, [Sent(), Sent(), Sent()])
    assert Sent.loads == 3 and hit.tolist() == [3, 0] and [k for k, _ in items] == [3, 0]
