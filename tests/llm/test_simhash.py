from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillon.llm import simhash
from quillon.llm.components import components, local_forest, spanning_links

FOLD = {i: i + 32 for i in range(65, 91)}


def brute_print(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, fp int, rep string")


def texts(seed=1, n=60):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 2, 3, 40, 200]))] for _ in range(n)]
    out = [" ".join(w) for w in base]
    for w in base:
        copy = list(w)
        copy[rng.randrange(len(copy))] = "new"
        out.append("\t".join(copy))
    return out + ["", None, " \n", "A b", "a  B"] + out[:5]


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_near_duplicates(spark, crowd):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())] + [(None, "no id"), (None, None)]
    got = simhash.near_duplicates(frame(spark, rows), shingle=3, max_bits=2, crowd=crowd).select("doc_id", simhash.as_hex("fp").alias("h"), "component_id").collect()
    prints = {i: brute_print(t, 3) for i, t in rows if i is not None}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    label = brute_components(prints, linked)
    assert {(r["doc_id"], r["h"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, f"{p:016x}", label[i]) for i, p in prints.items()}
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None) and len(got) == len(rows)


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("crowd", [5000, 3])
def test_every_link_is_found(spark, max_bits, crowd):
    rng = np.random.default_rng(max_bits)
    prints = rng.integers(0, 2**63, 40, dtype=np.int64)
    near = [int(p) ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for p in prints for k in range(1, 7)]
    values = sorted({*map(int, prints), *near})
    distinct = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "f0 long, rep long")
    links = simhash.links_of(distinct, simhash.segments(max_bits), 1, max_bits, crowd).collect()
    got = brute_components(range(len(values)), [(r["a"], r["b"]) for r in links])
    want = brute_components(range(len(values)), [(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= max_bits])
    assert got == want
    assert all((values[r["a"]] ^ values[r["b"]]).bit_count() <= max_bits for r in links)


def jaccard(a, b, n=5):
    sets = []
    for t in (a, b):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_similar_groups(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(3000)}" for _ in range(300)] for _ in range(30)]
    rows = []
    for w in base:
        rows.append(" ".join(w))
        for edits in (1, 2, 4, 20):
            copy = list(w)
            for _ in range(edits):
                copy[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += ["short text", "short text", "", None]
    ids = {i + 1: t for i, t in enumerate(rows)}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, ids.items())).collect()}
    want = brute_components(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if jaccard(ids[a], ids[b]) >= 0.8])
    assert sum(got[i] == want[i] for i in ids) >= 0.98 * len(ids)
    assert all(want[i] == want[got[i]] for i in ids)  # no link that isn't there
    kept = simhash.keep_one(frame(spark, [*ids.items(), (1, rows[0]), (None, "stays")]))
    assert kept.columns == ["doc_id", "text", "fp", "rep"]
    found = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in found if i) == sorted({got[i] for i in ids}) and found.count(None) == 1


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_groups_of_copies_around_the_limit(spark, crowd):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    ids = {}
    for i in range(60):
        copy = list(base)
        for _ in range(rng.choice([2, 3])):
            copy[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        ids[i] = " ".join(copy)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, ids.items()), crowd=crowd).collect()}
    want = brute_components(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if jaccard(ids[a], ids[b]) >= 0.8])
    assert len(set(got.values())) <= len(set(want.values())) + 1
    assert all(want[i] == want[got[i]] for i in ids)


def test_repeated_lines_make_no_links(spark):
    rng = random.Random(4)
    line = " the same line of seven words here"
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) + line * 100 for _ in range(2)]
    prints = {simhash.fingerprints(*simhash.text_buffers(pa.array([t])), 5, 2).tobytes() for t in texts}
    assert len(prints) == 1 and jaccard(*texts) < 0.1
    assert [r["component_id"] for r in simhash.similar_groups(frame(spark, enumerate(texts))).orderBy("doc_id").collect()] == [0, 1]


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_links_of_short_texts_and_repeats(spark, crowd):
    rng = random.Random(6)
    ids = {}
    for k in range(60):
        n = rng.choice([8, 8, 12, 36])
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        ids[2 * k], ids[2 * k + 1] = " ".join(words), " ".join([*words, *(f"n{i}" for i in range((n - 4) // 4))])
    for k, times in enumerate((10, 20, 40)):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(300))
        ids[200 + 2 * k], ids[201 + 2 * k] = text, text + " the same line of seven words here" * times
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, ids.items()), crowd=crowd).collect()}
    want = brute_components(ids, [(a, b) for a, b in itertools.combinations(ids, 2) if jaccard(ids[a], ids[b]) >= 0.8])
    assert len(set(want.values())) == 63 and got == want


def test_one_layout_at_every_size():
    assert simhash.likely_segments(0.8) == ([(k // 4, 16 * (k % 4), 16) for k in range(12)], 3, 41)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rows = spark.createDataFrame([*edges, *edges[:9], (None, 5), (7, None), (9, 9)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(rows).collect()}
    for one in (0, 20):  # rounds of joins to the end, or until few links are left
        assert {r["id"]: r["component"] for r in components(rows, one).collect()} == got
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    assert got == {i: c for i, c in brute_components(nodes, [e for e in edges if e[0] != e[1]]).items()}
    assert components(rows.limit(0)).collect() == []


def test_forests():
    rng = np.random.default_rng(0)
    a, b, w = rng.integers(0, 50, 400), rng.integers(0, 50, 400), rng.integers(0, 9, 400)
    use = spanning_links(a, b, w)
    everything = brute_components(range(50), list(zip(a.tolist(), b.tolist())))
    assert brute_components(range(50), list(zip(a[use].tolist(), b[use].tolist()))) == everything
    for k in range(9):  # the links up to any weight connect what all links up to it connect
        low, own = w <= k, w[use] <= k
        assert brute_components(range(50), list(zip(a[low].tolist(), b[low].tolist()))) == brute_components(range(50), list(zip(a[use][own].tolist(), b[use][own].tolist())))
    x, y = local_forest(a, b)
    assert brute_components(range(50), list(zip(x.tolist(), y.tolist()))) == everything


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.keep_one(frame(spark, [])).collect() == []


def test_ids_that_name_several_texts(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(50)) for _ in range(3)]
    rows = [(1, texts[0]), (2, texts[0]), (3, texts[1]), (3, texts[1]), (4, texts[1]), (5, texts[2]), (5, texts[0]), (5, texts[2]), (6, texts[2])]
    kept = sorted((r["doc_id"], texts.index(r["text"])) for r in simhash.keep_one(frame(spark, rows)).collect())
    assert kept == [(1, 0), (3, 1), (5, 0), (5, 2), (6, 2)]  # 5 names no document


def test_id_filter(spark, monkeypatch):
    ids = spark.range(0, 4000, 2)
    some, others = np.arange(0, 4000, 2), np.arange(1, 40001, 2)
    for most, passing in ((1 << 28, 0.01), (1 << 13, 0.25), (1 << 10, 1.0)):
        monkeypatch.setattr(simhash.IdFilter, "MOST", most)
        made = simhash.IdFilter.of(ids)
        assert made.may_hold(some).all() and made.may_hold(others).mean() <= passing
