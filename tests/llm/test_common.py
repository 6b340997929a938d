from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import common


def test_written_survives_and_is_cleaned(spark):
    rows = common.written(spark.range(10))
    path = spark.sparkContext._quillon_paths[-1]
    assert rows.count() == 10 and os.path.isdir(path)
    assert common.clean(spark) >= 1 and not os.path.exists(path) and common.clean(spark) == 0


def test_text_buffers():
    column = pa.array(["x", None, "é", "", "abc"])
    for part in (column, column.slice(1, 3), column.cast(pa.large_string()), pa.chunked_array([column.slice(0, 2), column.slice(2)])):
        raw, offsets = common.text_buffers(part)
        texts = [raw[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
        assert texts == [t or "" for t in part.to_pylist()]
    assert common.text_buffers(pa.array([], pa.string()))[1].tolist() == [0]


def test_blocks_cover_all_rows():
    offsets = np.array([0, 3, 3, 50, 51, 90])
    assert list(common.blocks(offsets, 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(common.blocks(np.zeros(1, np.int64))) == []


def test_names():
    assert common.column_name("a", ["A", "a_"]) == "a__"
    with pytest.raises(ValueError):
        common.must_be_new(["Score"], ["score"])


def test_words():
    raw, offsets = common.text_buffers(pa.array(["Ab c1-É", "", "ab averyverylongwordofmanybytes x"]))
    words = common.Words(raw, offsets)
    assert words.count.tolist() == [3, 0, 3]
    assert [w.decode() for w in words.phrase(0, 6)] == ["ab", "c1", "É", "ab", "averyverylongwordofmanybytes", "x"]
    assert words.hash[0] == words.hash[3] and len(set(words.hash.tolist())) == 5
