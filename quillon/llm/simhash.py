"""SimHash near-dedup with deletion-variant signatures.

A fingerprint has 64 bits, or more words of 64 bits. It is cut into few segments, and each
segment is indexed once for each of its bits with that bit left out, so two fingerprints with a
segment that differs by at most one bit meet in an equality on (segment, bit, rest). What meets
is verified on all bits.

Two uses. `near_duplicates` links fingerprints of 64 bits at `max_bits` or fewer differing bits
and finds every such link: it cuts into so few segments that one of them must differ by one bit
at most. `similar_groups` links texts whose sets of shingles have a Jaccard similarity of 0.8 or
more: such texts differ in a seventh of the bits, so it takes more, shorter segments, of which
one differs by at most one bit with high probability, and verifies the similarity itself on the
shingles of each link. Its fingerprints count each distinct shingle once, as the similarity does.
Texts of few shingles meet under the least of their shingles instead, and no link of theirs is
missed.

Equal fingerprints, or in `similar_groups` equal sets of shingles, are one node from the start,
so exact copies make no pairs. Under one index
key, sorted rows are compared as they stream by, and only a spanning forest of the links is
emitted, the closest pairs first. A key with more than `crowd` fingerprints is cut into blocks;
each pair of blocks is one row, so no task holds more than two of them. Where links of a forest
turn out not to be similar, `similar_groups` compares the sets of shingles of that group's texts
themselves, in blocks as well, and so finds what the failed links displaced.

Defined results: a null or empty text has no words and the fingerprint zero, which links like
any other; a row with null doc_id gets its fingerprint, joins no component and has a null
component_id; repeated rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE_BYTES, blocks, column_name, text_buffers, written
from quillon.llm.components import components, local_forest, spanning_links

SEED = 42
#: Fingerprints under one key that are compared as one block.
CROWD = 4096
#: Shingles whose bits are counted at once.
CHUNK = 1 << 17
#: Recall that similar_groups aims at for a pair of just the least similarity.
RECALL = 0.97

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A-Z in lower case and one space between words: (text, word starts, word ends, where each
    document's words begin among them)."""
    text = raw.copy()
    text[(raw >= 0x41) & (raw <= 0x5A)] += 32
    size = len(text)
    space = IS_SPACE[text]
    begins = np.zeros(size + 1, bool)
    begins[offsets] = True
    starts_word = ~space
    starts_word[1:] &= space[:-1] | begins[1:-1]
    at = np.flatnonzero(starts_word)
    first = np.searchsorted(at, offsets)
    # The space before each word that isn't its document's first stays.
    keep = ~space
    inner = np.ones(len(at), bool)
    inner[first[:-1][first[:-1] < first[1:]]] = False
    keep[at[inner] - 1] = True
    text[space] = 0x20
    place = np.cumsum(keep) - 1
    out = text[keep]
    starts = place[at]
    ends_word = ~space
    ends_word[:-1] &= space[1:] | begins[1:-1]
    return out.tobytes(), starts, place[np.flatnonzero(ends_word)] + 1, first


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each shingle, its XXH64), part by part in order; fewer words than a shingle has
    are one shingle."""
    text, starts, ends, first = words_of(raw, offsets)
    words = np.diff(first)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(offsets) - 1), count)
    a = first[:-1][doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    b = np.minimum(a + shingle, first[1:][doc]) - 1
    h = xxhash.xxh64_intdigest
    for i in range(0, len(doc), CHUNK):
        part = slice(i, i + CHUNK)
        yield doc[part], np.array([h(text[s:e], SEED) for s, e in zip(starts[a[part]].tolist(), ends[b[part]].tolist())], np.uint64)


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hash itself for word 0, others that depend on it alone for further words."""
    if not word:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(offsets) - 1)]
    for doc, h in shingle_hashes(raw, offsets, shingle):
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        for d, part in zip(doc[cut].tolist(), np.split(h, cut[1:])):
            found[d].append(part)
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in found]


def fingerprints(raw: np.ndarray, offsets: np.ndarray, shingle: int, words: int = 1) -> np.ndarray:
    """uint64 fingerprint of each text, one column a word: bits set in over half of the hashes."""
    return fingerprints_of(shingle_hashes(raw, offsets, shingle), len(offsets) - 1, words)


def set_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """fingerprints() with each distinct hash counted once."""
    doc, h = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([np.zeros(0, np.uint64), *sets])
    return fingerprints_of(((doc[i : i + CHUNK], h[i : i + CHUNK]) for i in range(0, len(doc), CHUNK)), len(sets), words)


def fingerprints_of(hashes: Iterator[tuple[np.ndarray, np.ndarray]], n: int, words: int) -> np.ndarray:
    ones, count = np.zeros((n, words, 64), np.int64), np.zeros(n, np.int64)
    for doc, values in hashes:
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        count[doc[cut]] += np.diff(np.append(cut, len(doc)))
        for w in range(words):
            bits = np.unpackbits(mixed(values, w).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[doc[cut], w] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > count[:, None, None], axis=2, bitorder="little").view("<u8").reshape(n, words).astype(np.uint64)


def names(words: int) -> list[str]:
    return [f"f{w}" for w in range(words)]


def fingerprint_table(docs: DataFrame, shingle: int, words: int = 1) -> DataFrame:
    """doc_id and the words of the fingerprint as signed longs f0, f1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            parts = [fingerprints(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle, words) for i, j in blocks(offsets)]
            fp = np.concatenate(parts) if parts else np.zeros((0, words), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fp.T)], ["doc_id", *names(words)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{f} long" for f in names(words)))


#: Hash of 128 bits of a text's set of shingles.
SET = ["s0", "s1"]


#: Texts with so many distinct shingles or fewer are compared by their shingles alone: their
#: fingerprints, of few hashes, vary more than those of longer texts.
SHORT = 32


def set_table(docs: DataFrame, shingle: int, words: int, most: int) -> DataFrame:
    """doc_id, the words of the fingerprint over each text's distinct shingles, the hash of their
    set, their count n, and their hashes in order if they are `most` or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j in blocks(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                fp = set_fingerprints(sets, words)
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
                few = pa.array([x.tobytes() if len(x) <= most else None for x in sets], pa.binary())
                longs = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (*fp.T, *whole.T, np.array([len(x) for x in sets], np.int64))]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *longs, few], ["doc_id", *names(words), *SET, "n", "few"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{f} long" for f in (*names(words), *SET, "n")) + ", few binary")


def at_least(similarity: float, n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n must share with any that is so similar."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def prefixes(few: DataFrame, similarity: float, most: int) -> DataFrame:
    """key, the hashes as words, rep: a row for each of a set's least hashes, so many that a set
    without any of them shares too few of its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("few")]
            size = np.array([len(x) for x in sets], np.int64)
            padded = np.zeros((len(sets), most), np.uint64)
            padded[np.arange(most) < size[:, None]] = np.concatenate([np.zeros(0, np.uint64), *sets])
            row, place = np.nonzero(np.arange(most) < (size - at_least(similarity, size) + (size > 0))[:, None])
            columns = [padded[row, place], *padded[row].T, batch.column("rep").to_numpy()[row]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], ["key", *names(most), "rep"])

    return few.select("few", "rep").mapInArrow(run, "key long, " + ", ".join(f"{f} long" for f in (*names(most), "rep")))


Segments = list[tuple[int, int, int]]  # (word, lowest bit, bits)


def segments(max_bits: int) -> Segments:
    """Of a fingerprint of 64 bits with max_bits differing, some segment has one of them at most."""
    count = max(1, -(-(max_bits + 1) // 2))
    cuts = [64 * i // count for i in range(count + 1)]
    return [(0, a, b - a) for a, b in itertools.pairwise(cuts)]


def share_of_bits(similarity: float) -> float:
    """Share of bits that differ between sets of this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


#: Bits of a segment of likely_segments, for tables of any size: what links mustn't depend on it.
WIDTH = 16


def likely_segments(similarity: float, width: int = WIDTH) -> tuple[Segments, int, int]:
    """(segments, words, differing bits that verification allows) for texts of this similarity:
    as many segments as RECALL needs."""
    p = share_of_bits(similarity)
    meets = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    count = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meets)))
    per = 64 // width
    words = -(-count // per)
    count = words * per
    allowed = math.floor(64 * words * p + 2.5 * math.sqrt(64 * words * p * (1 - p)))
    return [(k // per, k % per * width, width) for k in range(count)], words, allowed


def variants(distinct: DataFrame, cut: Segments, words: int) -> DataFrame:
    """key, fingerprint, rep: one row for each segment and each bit of it left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 8192) for i in range(0, batch.num_rows, 8192)):
                columns = [part.column(f).to_numpy() for f in names(words)]
                rep = part.column("rep").to_numpy()
                for number, (word, low, bits) in enumerate(cut):
                    own = (columns[word].view(np.uint64) >> np.uint64(low)) & np.uint64((1 << bits) - 1)
                    wild = np.arange(bits, dtype=np.uint64)
                    key = own[:, None] & ~(np.uint64(1) << wild)[None, :]
                    name = np.uint64(number * 64) + wild
                    # The segment's and the bit's number stand above the rest, or are mixed in.
                    key = key | name[None, :] << np.uint64(48) if bits <= 48 else (key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ mixed(name, 1)[None, :]
                    again = [pa.array(np.repeat(c, bits)) for c in (*columns, rep)]
                    yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), *again], ["key", *names(words), "rep"])

    return distinct.select(*names(words), "rep").mapInArrow(run, "key long, " + ", ".join(f"{f} long" for f in (*names(words), "rep")))


Links = tuple[np.ndarray, np.ndarray, np.ndarray]  # a, b, differing bits


def lightest(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> Links:
    use = spanning_links(a, b, bits)
    return a[use], b[use], bits[use]


class Near:
    """Which rows of one key link, by differing bits: (pairs that link, bits)."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits

    def __call__(self, key: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
        return bits <= self.max_bits, bits


class NearSets(Near):
    """Sets of hashes, padded with zeros, of that Jaccard similarity."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def __call__(self, key: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q = (x != 0).sum(axis=-1), (y != 0).sum(axis=-1)
        found = np.minimum(p, q) >= at_least(self.similarity, np.maximum(p, q))
        at = np.nonzero(found)
        x, y = (np.broadcast_to(z, (*found.shape, z.shape[-1]))[at] for z in (x, y))
        both = np.zeros(len(x), np.int64)
        for i in range(x.shape[-1]):
            both += ((x[:, i, None] == y) & (y != 0)).any(axis=1)
        either = (p + q)[at] - both
        found[at] = both >= self.similarity * either - 1e-12
        bits = np.zeros(found.shape, np.int64)  # no link of these is closer than another: all hold
        return found, bits


def pairs_within(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, near: Near) -> Iterator[Links]:
    """A forest of the links among rows that share a key; rows are sorted by key."""
    out: list[Links] = [(np.zeros(0, np.int64),) * 3]
    rows, d, held = np.arange(len(key)), 0, 0
    while len(rows):
        d += 1
        rows = rows[rows + d < len(key)]
        rows = rows[key[rows] == key[rows + d]]
        found, bits = near(key[rows], fp[rows], fp[rows + d])
        out.append((rep[rows[found]], rep[rows[found] + d], bits[found]))
        held += int(found.sum())
        if held > 1 << 18:
            out = [lightest(*(np.concatenate(x) for x in zip(*out)))]
            held = len(out[0][0])
    yield lightest(*(np.concatenate(x) for x in zip(*out)))


def pairs_between(key: int, x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, near: Near) -> Iterator[Links]:
    """The links between two blocks of a key, or inside one (if they are equal)."""
    out: list[Links] = [(np.zeros(0, np.int64),) * 3]
    same = np.array_equal(a, b)
    step = max(1, 512 // x.shape[1])
    for i in range(0, len(x), step):
        found, bits = near(np.array([[key]], np.int64), x[i : i + step, None, :], y[None, :, :])
        p, q = np.nonzero(found)
        use = a[p + i] < b[q] if same else a[p + i] != b[q]
        p, q = p[use], q[use]
        out.append((a[p + i], b[q], bits[p, q]))
        if len(out) > 4:
            out = [lightest(*(np.concatenate(z) for z in zip(*out)))]
    yield lightest(*(np.concatenate(z) for z in zip(*out)))


def compare(sorted_variants: DataFrame, words: int, near: Near, crowd: int) -> DataFrame:
    """block -1: a link (a, b) of representatives, with its differing bits. Otherwise a row of a
    crowded key, with its block's number: key in a, representative in b, and the fingerprint."""
    fields = ["block", "a", "b", "bits", *names(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(a), -1, np.int64), a, b, bits, *[np.zeros(len(a), np.int64)] * words)], fields)

        def rows(block: int, key: np.ndarray, rep: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(key), block, np.int64), key, rep, np.zeros(len(key), np.int64), *np.ascontiguousarray(fp.T).view(np.int64))], fields)

        def take(batch: pa.RecordBatch) -> list[np.ndarray]:
            fp = np.column_stack([batch.column(f).to_numpy() for f in names(words)]).view(np.uint64)
            return [batch.column("key").to_numpy(), batch.column("rep").to_numpy(), fp]

        held, block, crowded = None, 0, None  # rows of the last key; blocks of it passed on
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = take(batch)
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held is None:
                continue
            key = held[0]
            full = int(np.searchsorted(key, key[-1])) if batch is not None else len(key)
            done, held = [x[:full] for x in held], [x[full:] for x in held] if full < len(key) else None
            if full:
                key, rep, fp = done
                cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                size = np.diff(np.append(cut, full))
                many = size > crowd
                if crowded is not None and key[0] == crowded:
                    many[0] = True
                for k in np.flatnonzero(many):
                    number = block if key[cut[k]] == crowded else 0
                    for i in range(cut[k], cut[k] + size[k], crowd):
                        j = min(i + crowd, cut[k] + size[k])
                        yield rows(number, key[i:j], rep[i:j], fp[i:j])
                        number += 1
                use = np.repeat(~many & (size > 1), size)
                for found in pairs_within(key[use], fp[use], rep[use], near):
                    yield links(*found)
            if held is not None:
                if held[0][0] != crowded:
                    block = 0
                while held is not None and (len(held[0]) > crowd):
                    crowded = held[0][0]
                    yield rows(block, *(held[i][:crowd] for i in (0, 1, 2)))
                    block += 1
                    held = [x[crowd:] for x in held]

    return sorted_variants.mapInArrow(run, ", ".join(f"{f} long" for f in fields))


def compare_blocks(rows: DataFrame, words: int, near: Near) -> DataFrame:
    """Links (a, b, bits) among the rows of crowded keys, one pair of blocks at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fp = [np.array([[r[f] for f in names(words)] for r in row["rows"]], np.int64), np.array([r["b"] for r in row["rows"]], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([row["a"]]), pa.array([row["block"]]), pa.array([fp[0].tobytes()], pa.binary()), pa.array([fp[1].tobytes()], pa.binary())], ["a", "block", "fps", "reps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (np.frombuffer(row[f"fps{k}"], np.uint64).reshape(-1, words) for k in (1, 2))
                a, b = (np.frombuffer(row[f"reps{k}"], np.int64) for k in (1, 2))
                for found in pairs_between(row["key"], x, a, y, b, near):
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in found], ["a", "b", "bits"])

    # A block has at most `crowd` rows, so collecting one is bounded.
    grouped = rows.groupBy("a", "block").agg(F.collect_list(F.struct("b", *names(words))).alias("rows"))
    made = written(grouped.mapInArrow(pack, "a long, block long, fps binary, reps binary"))
    left, right = (made.select(F.col("a").alias("key"), F.col("block").alias(f"block{k}"), F.col("fps").alias(f"fps{k}"), F.col("reps").alias(f"reps{k}")) for k in (1, 2))
    pairs = left.select("key", "block1").join(right.select("key", "block2"), "key").filter("block1 <= block2").repartition("key", "block1", "block2")
    return pairs.join(left, ["key", "block1"]).join(right, ["key", "block2"]).mapInArrow(run, "a long, b long, bits long")


def met(keyed: DataFrame, words: int, near: Near, crowd: int) -> DataFrame:
    """Links (a, b, bits) of representatives whose rows (key, words, rep) meet under a key."""
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keyed.repartition(partitions, "key").sortWithinPartitions("key", "rep")  # the same links in every run
    found = written(compare(sorted_, words, near, crowd))
    links, rest = found.filter("block = -1").select("a", "b", "bits"), found.filter("block >= 0")
    if not rest.isEmpty():
        links = links.unionByName(compare_blocks(rest, words, near))
    return links


def links_of(distinct: DataFrame, cut: Segments, words: int, max_bits: int, crowd: int) -> DataFrame:
    """Links (a, b, bits) of representatives, those of a spanning forest for each key."""
    return met(variants(distinct, cut, words), words, Near(max_bits), crowd)


def distinct_nodes(prints: DataFrame, node: list[str], other: list[str] = []) -> DataFrame:
    """One row for each value of the columns `node`, with its least doc_id as rep and what that
    row has in the columns `other`."""
    return prints.filter("doc_id is not null").groupBy(*node).agg(F.min("doc_id").alias("rep"), *(F.min_by(c, "doc_id").alias(c) for c in other))


def with_components(prints: DataFrame, distinct: DataFrame, links: DataFrame, node: list[str]) -> DataFrame:
    """prints with component_id: the least doc_id that a row's node reaches."""
    joined = components(links)
    classes = written(distinct.join(joined, distinct["rep"] == joined["id"], "left").select(*node, F.coalesce("component", "rep").alias("component_id")))
    return prints.join(classes, node, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = 5, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, component_id of every row: the least doc_id reachable by links of fingerprints."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be from 0 to 7")
    prints = written(fingerprint_table(docs, shingle))
    distinct = distinct_nodes(prints, names(1))
    found = with_components(prints, distinct, links_of(distinct, segments(max_bits), 1, max_bits, crowd), names(1))
    return found.select("doc_id", F.col("f0").alias("fp"), "component_id")


class IdFilter:
    """A Bloom filter of ids, of bounded size: it may let others through, but never holds one back.

    As many probes as its load makes best: with 16 bits an id (up to 16 million ids) it lets 1 in
    1,000 others through, with 4 bits 1 in 7, with 2 bits 2 in 5. Beyond that it lets all through,
    as a plain join has to move nearly all rows then anyway.
    """

    #: Bits at most, bits for each id where there is room, and below which it holds nothing back.
    MOST, EACH, LEAST = 1 << 28, 16, 2

    def __init__(self, words: np.ndarray, probes: int):
        self.words, self.probes = words, probes

    @staticmethod
    def places(ids: np.ndarray, bits: int, probes: int) -> np.ndarray:
        """Places for each id, one column a probe."""
        h = mixed(ids.astype(np.int64).view(np.uint64), 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(probes)], axis=1)

    @staticmethod
    def of(ids: DataFrame) -> IdFilter:
        """From a column of ids, which may repeat, read twice. Only the filter's words, MOST / 64 of
        them at most, come to the driver."""
        count = ids.count()
        bits = min(IdFilter.MOST, 1 << max(10, (IdFilter.EACH * count - 1).bit_length()))
        if bits < IdFilter.LEAST * count:
            return IdFilter(np.zeros(0, np.uint64), 0)
        probes = min(4, max(1, round(math.log(2) * bits / max(count, 1))))
        name = ids.columns[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(IdFilter.places(batch.column(name).to_numpy(), bits, probes))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

        got = ids.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
        words = np.zeros(bits // 64, np.int64)
        words[got["word"].to_numpy(np.int64)] = got["value"].to_numpy(np.int64)
        return IdFilter(words.view(np.uint64), probes)

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        if not self.probes:
            return np.ones(len(ids), bool)
        at = IdFilter.places(ids, 64 * len(self.words), self.probes)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def verified(links: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts' sets of shingles are that similar.

    Texts don't move: the sets of the linked ones, as hashes of 8 bytes a shingle, come to the links.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                either = len(p) + len(q) - both
                keep.append(not either or both >= similarity * either - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    made = sets_of(links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))), docs, shingle)
    left, right = (made.select(F.col("id").alias(c), F.col("shingles").alias(n)).hint("merge") for c, n in (("a", "x"), ("b", "y")))
    return links.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def sets_of(wanted: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """id, shingles of the documents whose ids are in the column `wanted`, and of a few others: a
    filter of the ids goes to the texts, which stay where they are."""
    sent = docs.sparkSession.sparkContext.broadcast(IdFilter.of(wanted))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = np.flatnonzero(sent.value.may_hold(batch.column("id").to_numpy()))
            batch = batch.take(pa.array(use))
            ids = batch.column("id")
            raw, offsets = text_buffers(batch.column("text"))
            for i, j in blocks(offsets):
                rows = [x.tobytes() for x in shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(rows, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    return written(texts.mapInArrow(sets, "id long, shingles binary"))


#: Rounds in which each component has its closest link verified, before all that are left are.
ROUNDS = 2


def placed(links: DataFrame, good: DataFrame | None) -> DataFrame:
    """The links between different components x and y of the links `good`; without those each id is
    its own component."""
    if good is None:
        return links.select("a", "b", "bits", F.col("a").alias("x"), F.col("b").alias("y"))
    label = components(good)
    at = [label.select(F.col("id").alias(c), F.col("component").alias(n)) for c, n in (("a", "x"), ("b", "y"))]
    found = links.join(at[0], "a", "left").join(at[1], "b", "left").select("a", "b", "bits", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    return written(found.filter("x <> y"))


def connecting(links: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified links that connect what the verified ones of `links` connect.

    Of a large group of near copies most links are superfluous. So the closest link of each
    component is verified first, and links inside of what is connected then are left out: they
    couldn't change a component, whether they hold or not.
    """
    good, left = None, placed(links, None)
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            ends = left.select(F.col("x").alias("node"), "bits", "a", "b").unionByName(left.select(F.col("y").alias("node"), "bits", "a", "b"))
            closest = ends.groupBy("node").agg(F.min(F.struct("bits", "a", "b")).alias("link"))
            tried = written(closest.select("link.a", "link.b").distinct())
        else:
            tried = written(left.select("a", "b"))
        if tried.isEmpty():
            break
        held = written(verified(tried, docs, shingle, similarity))
        good = held if good is None else written(good.unionByName(held))
        if turn == ROUNDS:
            break
        left = placed(left.join(tried, ["a", "b"], "left_anti").select("a", "b", "bits"), good)
    return good if good is not None else left.select("a", "b")


def in_order(links: DataFrame) -> DataFrame:
    """Each link once, its lesser end as a."""
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return written(links.filter("a <> b").select(low, high, "bits").groupBy("a", "b").agg(F.min("bits").alias("bits")))


def set_links(p: list[np.ndarray], a: np.ndarray, la: np.ndarray, q: list[np.ndarray], b: np.ndarray, lb: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two blocks of sets with ids a, b and labels la, lb, or inside one
    (if the ids are equal): pairs of that Jaccard similarity whose labels differ."""
    size = np.array([len(x) for x in q])
    flat, begin = np.concatenate([np.zeros(0, np.uint64), *q]), np.cumsum(size) - size
    names, flat = np.unique(flat, return_inverse=True)
    mark, same = np.zeros(len(names), np.int32), np.array_equal(a, b)
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for i, own in enumerate(p):
        if not len(own) or not len(names) or (lb == la[i]).all():
            continue
        at = np.searchsorted(names, own)
        at = at[names[np.minimum(at, len(names) - 1)] == own]
        mark[at] = 1
        # Sets aren't empty, so every one begins at its own place.
        both = np.add.reduceat(mark[flat], begin)
        mark[at] = 0
        near = (both >= similarity * (len(own) + size - both) - 1e-12) & (lb != la[i])
        if same:
            near &= np.arange(len(q)) > i
        j = np.flatnonzero(near)
        out.append((np.full(len(j), a[i]), b[j]))
        if len(out) > 64:
            out = [local_forest(*(np.concatenate(x) for x in zip(*out)))]
    return local_forest(*(np.concatenate(x) for x in zip(*out)))


#: Bytes of the sets in a block, about, and sets in it at most.
SET_BYTES, SETS = 1 << 20, 1024


def all_links(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between the nodes (id, component, label) of one component with different labels,
    verified: a forest of them for each pair of blocks.

    Sets of a size class meet with those of the same and the next one, as others are too unlike.
    Blocks hold a bounded number of sets, and those that have the component's commonest label have
    blocks of their own, which needn't be compared with each other.
    """
    step = math.log(1 / similarity) + 1e-9 if similarity < 1 else 1.0
    top = nodes.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    made = sets_of(nodes.select("id"), docs, shingle).filter("octet_length(shingles) > 0")
    rows = made.hint("merge").join(nodes, "id").join(top, "component")
    rows = rows.withColumn("kind", (F.col("label") == F.col("top")).cast("int")).withColumn("class", F.floor(F.log(F.octet_length("shingles") / 8) / step).cast("int"))
    rows = written(rows.select("component", "kind", "class", "id", "label", "shingles"))
    block = ["component", "kind", "class"]
    each = F.greatest(F.lit(1.0), F.least(F.lit(float(SETS)), F.lit(float(SET_BYTES)) / F.max(F.octet_length("shingles"))))
    counts = rows.groupBy(*block).agg(F.ceil(F.count("*") / each).alias("salts"))
    salted = rows.join(counts, block).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    # Dealt by salt too, or Spark would leave all blocks of a class in the task of its count.
    salted = salted.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *block, "salt")
    # `each` bounds what a group collects.
    grouped = salted.groupBy(*block, "salt").agg(F.collect_list(F.struct("id", "label", "shingles")).alias("sets"))
    grouped = written(grouped)
    keys = grouped.select(*block, "salt")
    left = keys.select("component", *(F.col(c).alias(f"{c}1") for c in (*block[1:], "salt")))
    right = keys.select("component", *(F.col(c).alias(f"{c}2") for c in (*block[1:], "salt"))).withColumn("class1", F.explode(F.array(F.col("class2"), F.col("class2") - 1)))
    first, second = F.struct("kind1", "salt1"), F.struct("kind2", "salt2")
    pairs = left.join(right, ["component", "class1"]).filter(((F.col("class1") < F.col("class2")) | (first <= second)) & ~((F.col("kind1") == 1) & (F.col("kind2") == 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = [batch.column(f"sets{k}")[row].values for k in (1, 2)]
                ids, labels = ([np.asarray(x.field(f)) for x in own] for f in ("id", "label"))
                sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in x.field("shingles")] for x in own]
                found = set_links(sets[0], ids[0], labels[0], sets[1], ids[1], labels[1], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

    for k in (1, 2):
        blocks_ = grouped.select("component", *(F.col(c).alias(f"{c}{k}") for c in (*block[1:], "salt")), F.col("sets").alias(f"sets{k}")).hint("merge")
        pairs = pairs.join(blocks_, ["component", f"kind{k}", f"class{k}", f"salt{k}"])
    return written(pairs.select("sets1", "sets2").mapInArrow(run, "a long, b long"))


def all_connecting(distinct: DataFrame, cut: Segments, words: int, max_bits: int, crowd: int, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified links that connect what the verified ones among all candidates would connect.

    A forest of each key's candidates comes first. Where all of a group of candidates is connected
    once they are verified, its other candidates are superfluous. In the groups that aren't, sets
    themselves are compared.
    """
    first = in_order(links_of(distinct, cut, words, max_bits, crowd))
    good = connecting(first, docs, shingle, similarity)
    label = components(good).withColumnRenamed("component", "label")
    nodes = written(components(first).join(label, "id", "left").select("id", "component", F.coalesce("label", "id").alias("label")))
    broken = nodes.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("component")
    apart = written(nodes.join(broken, "component"))
    if apart.isEmpty():
        return good
    return good.unionByName(all_links(apart, docs, shingle, similarity))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """doc_id, component_id of every row: texts with that Jaccard similarity link."""
    cut, words, allowed = likely_segments(similarity)
    most = int(SHORT / similarity + 1e-9)  # shingles of a text that is similar to a short one
    prints = written(set_table(docs, shingle, words, most))
    # Fingerprints of different sets can be equal, so the set is the node.
    distinct = written(distinct_nodes(prints, SET, [*names(words), "n", "few"]))
    links = all_connecting(distinct.filter(F.col("n") > SHORT), cut, words, allowed, crowd, docs, shingle, similarity)
    short = met(prefixes(distinct.filter("n > 0 and few is not null"), similarity, most), most, NearSets(similarity), crowd)
    links = links.unionByName(short.select("a", "b"))
    return with_components(prints.select("doc_id", *SET), distinct, links, SET).select("doc_id", "component_id")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among the ids of `gone` (doc_id, without nulls).

    A filter of the ids decides for nearly all rows that stay; only rows that it may hold move to
    the exact anti-join, so texts of the others aren't shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(IdFilter.of(gone.select(F.col("doc_id").cast("long").alias("doc_id"))))

    @F.pandas_udf("boolean")
    def may_be_gone(ids: pd.Series) -> pd.Series:
        return pd.Series(sent.value.may_hold(ids.to_numpy(np.int64)))

    own, name = column_name("_maybe", docs.columns), column_name("_gone", docs.columns)
    # A series with nulls would be floating point, which can't tell large ids apart.
    flagged = docs.withColumn(own, F.col("doc_id").isNotNull() & may_be_gone(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))))
    stays = flagged.filter(~F.col(own)).drop(own)
    unsure = flagged.filter(F.col(own)).drop(own)
    ids = gone.select(F.col("doc_id").alias(name)).hint("merge")
    return stays.unionByName(unsure.join(ids, unsure["doc_id"] == ids[name], "left_anti"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that are first of their group by doc_id.

    Rows with a null doc_id stay, and repeated rows are one. A doc_id that several texts have names
    no document: its rows aren't compared with others, and one of each of its texts stays.
    """
    again = written(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    odd = None
    if not again.isEmpty():
        own = column_name("_again", docs.columns)
        among = lambda rows, ids, how: rows.join(ids.select(F.col("doc_id").alias(own)).hint("merge"), F.col("doc_id") == F.col(own), how)
        once = written(among(docs, again, "left_semi").dropDuplicates(["doc_id", "text"]))
        texts = written(once.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
        docs, odd = without(docs, again).unionByName(among(once, texts, "left_anti")), among(once, texts, "left_semi")
    found = written(similar_groups(docs, shingle, similarity))
    out = without(docs, written(found.filter("doc_id <> component_id").select("doc_id")))
    return out if odd is None else out.unionByName(odd)


def as_hex(column: str):
    """16 lower-case hexadecimal digits of a signed long."""
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
