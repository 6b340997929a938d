from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing, wavelet
from quillon.llm.common import text_buffers
from quillon.llm.tokens import Encoder

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ENCODERS = {path: Encoder(path) for path in (BYTES, WORDS)}

ODD = ["", " ", "\n", "  a  b \n\n c\n", "it's 12'3 don't", "日本 x", "a×b÷c", "x ", "é É ÀÞß12 34!!  ??\t\tq", "<|endoftext|> a", "é", "\x00a", "a\n b", "12 3a4 !a! a!", "abcdefghijklmnopqrstuvwxyz" * 5, "\r\n x\ry"]


def ids_of(path, texts):
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    ids, cuts = ENCODERS[path].encode(raw, offsets)
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def library(path, text):
    return ENCODERS[path].tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_odd_texts(path):
    assert ENCODERS[path].kind != "whole"
    assert ids_of(path, [*ODD, None]) == [library(path, t) for t in [*ODD, None]]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens(path):
    fresh = Tokenizer.from_file(path)
    texts = ["one two", "one<|endoftext|>two", "<|", "endoftext|>", "<|startoftext|>a <|EndOfText|>", "", "<|endoftext|>", *ODD]
    assert ids_of(path, texts) == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert {BYTES: 50256, WORDS: 49407}[path] in ids_of(path, texts)[1]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé ÉßñT1 9!'?\n\t.-日 "), max_size=30), max_size=6))
def test_any_text(path, texts):
    assert ids_of(path, texts) == [library(path, t) for t in texts]


FRESH = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "a", " ", "b1", "é", "\n"]), max_size=8).map("".join), max_size=5))
def test_texts_with_added_tokens(path, texts):
    assert ids_of(path, texts) == [FRESH[path].encode(t, add_special_tokens=False).ids for t in texts]


def test_occurrences_of_a_frequent_token():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.2, wavelet.SHARD_TOKENS), 50_000).astype(np.uint32)
    shard = wavelet.Shard(wavelet.to_bytes(ids, [1], [len(ids)]))
    for token in (1, 2, 50_000, 49_999):
        assert np.array_equal(shard.places(token), np.flatnonzero(ids == token))
    at = rng.integers(0, len(ids), 2000)
    assert np.array_equal(shard.access(at), ids[at])
    assert sum(d.nbytes for d in shard.directories) < 0.07 * sum(map(len, shard.planes))


def test_packing_keeps_null_ids(spark):
    rows = packing.pack(documents(spark, [(None, "a b", "x", 0), (None, None, "x", 0), (4, "c", "x", 0)]), WORDS, end_id=1, size=64).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in rows) == [(False, 2), (True, 1), (True, 3)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=700))
def test_wavelet_round_trip(values):
    ids = np.array(values, np.uint32)
    shard = wavelet.Shard(wavelet.to_bytes(ids, [7], [len(ids)]))
    assert shard.ids().tolist() == values
    for i in range(0, len(values), 97):
        assert shard.access(i) == values[i]
    for token in {*values[:3], 5}:
        places = [i for i, v in enumerate(values) if v == token]
        assert shard.count(token) == len(places)
        assert shard.occurrences(token) == places
        assert shard.rank(token, len(values) // 2) == sum(p < len(values) // 2 for p in places)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string, tokens int")


def test_token_output(spark, tmp_path):
    rows = [(i, t, "x", i) for i, t in enumerate([*ODD, None, "word " * 3000])] + [(3, ODD[3], "x", 1), (None, "no id", None, None)]
    shards = wavelet.write_shards(documents(spark, rows), str(tmp_path / "shards"), BYTES, 2, shard_tokens=100)
    got = sorted((tuple(r) for r in wavelet.read_documents(shards).collect()), key=lambda r: r[1])
    expected, start = [], 0
    for name, text, *_ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])):
        ids = [*library(BYTES, text), 2]
        expected.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    ends = sorted(r["place"] for r in wavelet.find_token(shards, 2).collect())
    assert set(r[1] + r[2] - 1 for r in expected) <= set(ends)
    empty = wavelet.token_output(documents(spark, []), BYTES, 2)
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def check_packing(rows, texts, size, end_id):
    ids = {i: [*library(WORDS, t), end_id] for i, t in texts.items()}
    seen = {i: [] for i in ids}
    for r in rows:
        own = ids[r["doc_id"]]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    assert all(sorted(seen[i]) == list(range(len(ids[i]))) for i in ids)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(sequences) == list(range(len(sequences)))
    assert max(sequences.values(), default=0) <= size
    return sequences


def test_packing(spark):
    texts = {i: "word " * (i * 7 % 300) + ODD[i % len(ODD)] for i in range(200)} | {500: None, 501: "long text " * 500}
    rows = packing.pack(documents(spark, [(i, t, "x", 0) for i, t in texts.items()]), WORDS, end_id=1, size=256).collect()
    sequences = check_packing(rows, texts, 256, 1)
    assert sum(256 - n for n in sequences.values()) < 0.05 * sum(sequences.values())
    again = packing.pack(documents(spark, [(1, "a b c", "x", 0)] * 3), WORDS, end_id=1, size=256).collect()
    assert sorted(r["offset"] for r in again) == [0, 4, 8]
    assert packing.pack(documents(spark, []), WORDS).collect() == []


def brute_pack(lengths, size):
    """Shortest pack first, one piece at a time."""
    packs = []
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + n <= size]
        if fits:
            min(fits, key=sum).append(n)
        else:
            packs.append([n])
    return len(packs)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_places_every_length_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    counts = {}
    for lengths, packs in patterns:
        assert sum(lengths) <= 64
        for n in lengths:
            counts[n] = counts.get(n, 0) + packs
    assert counts == histogram
    every = [n for n, c in histogram.items() for _ in range(c)]
    assert sum(p for _, p in patterns) <= brute_pack(every, 64) + len(histogram)
