from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import embeddings


def brute(rows, threshold):
    good = {}
    width = 8
    for i, v in rows:
        if i is None or not v or len(v) != width or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        if np.isfinite(x).all() and (x * x).sum() > 0:
            good.setdefault(i, x)
    links = {i: set() for i, _ in rows if i is not None}
    for a, b in itertools.combinations(good, 2):
        x, y = good[a], good[b]
        if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            links[a].add(b)
            links[b].add(a)
    label, out = {i: i for i in links}, {}
    for _ in links:
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
    for i in links:
        out[i] = (len(links[i]), label[i], label[i] == i)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1.0) for i, v in rows], "vec_id long, embedding array<float>, n_links string, unit double")


@pytest.mark.parametrize("tile", [embeddings.TILE, 16])
def test_near_duplicates(spark, tile):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    values = np.concatenate([base, base[:20] + rng.normal(size=(20, 8)) * 0.15, base[:10] + rng.normal(size=(10, 8)) * 0.4, base[:3]]).astype(np.float32)
    rows = [(i * 2, [float(x) for x in v]) for i, v in enumerate(values)]
    rows += [(901, None), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8), (905, [float("inf")] + [1.0] * 7), (906, []), (907, [1.0]), (908, [1e-30] * 8), (909, [1e30] * 8)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(frame(spark, rows), 0.95, tile=tile).collect()}
    assert got == brute(rows, 0.95)


def test_hot_vector_and_nulls(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(400 + i, [1.0, 2.0, 3.0 + i / 1000]) for i in range(50)] + [(None, [1.0, 2.0, 3.0])]
    got = embeddings.near_duplicates(frame(spark, rows), 0.95, tile=32).collect()
    assert {r["n_links"] for r in got if r["vec_id"] is not None} == {349}
    assert {r["component_id"] for r in got if r["vec_id"] is not None} == {0}
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, False)]
    assert embeddings.near_duplicates(frame(spark, []), 0.95).collect() == []


def test_dense_tiles_hold_no_more_than_a_part_of_their_links():
    rng = np.random.default_rng(2)
    x = 1 + rng.normal(size=(2 * embeddings.PART + 5, 16)) / 1000
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    sizes = [len(i) for i, _ in embeddings.part_links(x, x[::-1].copy(), 0.95, False)]
    assert sum(sizes) == len(x) ** 2 and max(sizes) <= embeddings.PART**2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 40), st.floats(0.1, 0.999))
def test_tile_links_lose_nothing(seed, width, threshold):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, width))
    x[10:20] = x[:10] + rng.normal(size=(10, width)) * rng.choice([1e-6, 0.05, 0.5])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    i, j = embeddings.tile_links(x, x, threshold, True)
    sims = np.einsum("id,jd->ij", x, x)
    clear = {(a, b) for a in range(30) for b in range(a + 1, 30) if sims[a, b] >= threshold + 1e-12}
    maybe = {(a, b) for a in range(30) for b in range(a + 1, 30) if sims[a, b] >= threshold - 1e-12}
    found = set(zip(i.tolist(), j.tolist()))
    assert clear <= found <= maybe
