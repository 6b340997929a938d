"""Benchmark decontamination with suffix arrays of the training text.

Each shard of whole documents gets a suffix array over its words, sorted by as many words as a
test window has (rounded up to a power of two). Every test suffix is searched in it by binary
search, word by word; the interval that is left holds all places where the window occurs.
Overlapping windows on one diagonal are one longest verbatim match, whose text is then compared
byte for byte.

Documents are never split over shards, so nothing is shuffled. The test set is sent out in
blocks of bounded size that executors keep on their disks. Where there are several, a worker holds
one at a time, and searches it in the shard's one suffix array before it loads the next.

Defined results: null and empty texts have no words; an item of fewer words than a window, but
not none, is one window; items with equal item_id count once; a null item_id is written as an
empty string; rows of the input are judged each for itself, with a null doc_id as well; empty
tables give no rows, or no hits; other columns pass unread.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Words, blocks, text_buffers

#: Bytes of training text in one suffix array.
SHARD_BYTES = 4 << 20
#: Bytes of test text in one block that is sent to the executors.
TEST_BYTES = 4 << 20

class TestItems:
    """Windows of the test items: each distinct one once, with the items that have it."""

    def __init__(self, items: list[tuple], window: int):
        self.ids = ["" if i is None else str(i) for i, _ in items]
        raw, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
        self.words = Words(raw, offsets)
        self.window = window
        cuts, count = self.words.cuts, self.words.count
        many = np.where(count >= window, count - window + 1, np.minimum(count, 1))
        item = np.repeat(np.arange(len(items)), many)
        start = cuts[:-1][item] + np.arange(len(item)) - (np.cumsum(many) - many)[item]
        size = np.minimum(window, count)[item]
        # Equal windows are one pattern, told by their words' hashes; shard_matches compares the text.
        wide = int(size.max()) if len(size) else 0
        inside = np.arange(wide)[None, :] < size[:, None]
        grid = np.where(inside, self.words.hash[np.minimum(start[:, None] + np.arange(wide), max(len(self.words.hash) - 1, 0))], 0) if wide else np.zeros((0, 0), np.uint64)
        _, first, which = np.unique(np.column_stack([size.astype(np.uint64), grid]), axis=0, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        #: Of each pattern its first window's place, its words, and all windows that are equal.
        self.start, self.size = start[first], size[first]
        self.windows, self.begin = order, np.searchsorted(which[order], np.arange(len(first) + 1))
        self.all_starts, self.item = start, item

    def items_of(self, patterns: np.ndarray) -> set[str]:
        """Ids of the items that have one of these patterns."""
        rows = np.concatenate([self.windows[self.begin[p] : self.begin[p + 1]] for p in patterns.tolist()])
        return {self.ids[i] for i in np.unique(self.item[rows]).tolist()}


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids sorted by the `depth` ids from there on (depth: a power of two).

    Prefix doubling; places that are told apart already keep their rank and aren't sorted again.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    new = np.ones(n, bool)
    new[1:] = sorted_ids[1:] != sorted_ids[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = head
    step = 1
    while step < depth:
        # Slots whose group has more than one member.
        follows = np.append(~new[1:], False)
        open_ = np.flatnonzero(~new | follows)
        if not len(open_):
            break
        place = order[open_]
        key = (head[open_] << 32) | (rank[np.minimum(place + step, n)] + 1)
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[open_] = place
        fresh = np.ones(len(open_), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[open_] = fresh
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[open_]] = head[open_]
        step *= 2
    return order


def search(ids: np.ndarray, order: np.ndarray, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) in the suffix array of the places that begin with each pattern's words."""
    n, m = len(order), len(patterns)
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    padded = np.append(ids, np.full(patterns.shape[1] if m else 0, -1))
    for d in range(patterns.shape[1] if m else 0):
        at = np.flatnonzero((sizes > d) & (lo < hi))
        if not len(at):
            break
        want = patterns[at, d]
        bounds = []
        for right in (False, True):
            a, b = lo[at].copy(), hi[at].copy()
            while (go := a < b).any():
                mid = (a + b) >> 1
                have = padded[order[np.minimum(mid, n - 1)] + d]
                below = (have <= want) if right else (have < want)
                a, b = np.where(go & below, mid + 1, a), np.where(go & ~below, mid, b)
            bounds.append(a)
        lo[at], hi[at] = bounds
    return lo, hi


class Shard:
    """The words of some documents, and their suffix array once a pattern needs it."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        doc = self.words = Words(raw, offsets)
        # Ids by the order of the hashes, from 1; after each document a 0 that no pattern has.
        self.names, inverse = np.unique(doc.hash, return_inverse=True)
        at_word = np.arange(len(doc.hash)) + np.repeat(np.arange(len(doc.count)), doc.count)
        self.ids = np.zeros(len(doc.hash) + len(doc.count), np.int64)
        self.ids[at_word] = inverse + 1
        self.word_of = np.zeros(len(self.ids), np.int64)
        self.word_of[at_word] = np.arange(len(doc.hash))
        self._orders: dict[int, np.ndarray] = {}

    def order(self, wide: int) -> np.ndarray:
        depth = 1 << max(0, math.ceil(math.log2(wide)))
        if depth not in self._orders:
            self._orders = {depth: suffix_array(self.ids, depth)}
        return self._orders[depth]


def shard_matches(shard: Shard, test: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of patterns in a shard: first word there, pattern, and the number of the longest
    verbatim match that the occurrence is part of. Sorted by match and place."""
    none = np.zeros(0, np.int64)
    doc, names = shard.words, shard.names
    if not len(doc.hash) or not len(test.start):
        return none, none, none
    at = np.searchsorted(names, test.words.hash)
    known = names[np.minimum(at, len(names) - 1)] == test.words.hash
    test_ids = np.where(known, at + 1, -2)
    wide = int(test.size.max())
    grid = np.minimum(test.start[:, None] + np.arange(wide), len(test_ids) - 1)
    patterns = np.where(np.arange(wide)[None, :] < test.size[:, None], test_ids[grid], -3)
    use = np.flatnonzero((patterns != -2).all(axis=1))
    if not len(use):
        return none, none, none
    order = shard.order(test.window)
    lo, hi = search(shard.ids, order, patterns[use], test.size[use])
    many = hi - lo
    pattern = np.repeat(use, many)
    slot = np.repeat(lo, many) + np.arange(len(pattern)) - np.repeat(np.cumsum(many) - many, many)
    place, start, size = shard.word_of[order[slot]], test.start[pattern], test.size[pattern]
    # Windows that follow each other in the document and in the test set are one match.
    by = np.lexsort((place, place - start))
    place, start, size, pattern = place[by], start[by], size[by], pattern[by]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1] + 1) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(fresh)
    run = np.diff(np.append(head, len(place)))
    same = np.array([doc.phrase(p, n) == test.words.phrase(s, n) for p, s, n in zip(place[head].tolist(), start[head].tolist(), (size[head] + run - 1).tolist())], bool)
    keep = np.repeat(same, run)
    return place[keep], pattern[keep], np.repeat(np.arange(len(head)), run)[keep]


def each(tests: list) -> Iterator[TestItems]:
    """The blocks of the test set; of several, which stay on disk, one is in memory at a time."""
    for test in tests:
        if isinstance(test, TestItems):
            yield test
        elif len(tests) == 1:
            yield test.value
        else:
            yield test.load_from_path(test._path)


def judge(raw: np.ndarray, offsets: np.ndarray, tests: list) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Words, hit words, and (items found, digest of their ids) of each text."""
    n = len(offsets) - 1
    shard = Shard(raw, offsets)
    doc = shard.words
    cover = np.zeros(len(doc.hash) + 1, np.int64)
    found: dict[int, list[frozenset[str]]] = {}
    for test in each(tests):
        place, pattern, _ = shard_matches(shard, test)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + test.size[pattern], -1)
        which = np.searchsorted(doc.cuts, place, side="right") - 1
        pairs = np.unique(np.column_stack([which, pattern]), axis=0)
        docs, begin = np.unique(pairs[:, 0], return_index=True)
        known: dict[bytes, frozenset[str]] = {}  # documents with the same patterns have the same items
        for d, patterns in zip(docs.tolist(), np.split(pairs[:, 1], begin[1:])):
            if (key := patterns.tobytes()) not in known:
                known[key] = frozenset(test.items_of(patterns))
            found.setdefault(d, []).append(known[key])
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    digests: dict[frozenset[frozenset[str]], tuple[int, str]] = {}

    def digest(d: int) -> tuple[int, str]:
        key = frozenset(found.get(d, ()))
        if key not in digests:
            items = set().union(*key)
            digests[key] = len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        return digests[key]

    return doc.count, hit[doc.cuts[1:]] - hit[doc.cuts[:-1]], [digest(d) for d in range(n)]


def longest(raw: np.ndarray, offsets: np.ndarray, tests: list) -> Iterator[tuple[int, int, str, int, int]]:
    """(document, first word there, item, first word there, words) of the longest matches with
    each item."""
    shard = Shard(raw, offsets)
    doc = shard.words
    for test in each(tests):
        place, pattern, _ = shard_matches(shard, test)
        if not len(place):
            continue
        many = test.begin[pattern + 1] - test.begin[pattern]
        at = np.repeat(test.begin[pattern], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        window = test.windows[at]
        place, start, item, size = np.repeat(place, many), test.all_starts[window], test.item[window], np.repeat(test.size[pattern], many)
        by = np.lexsort((place, place - start, item))
        place, start, item, size = place[by], start[by], item[by], size[by]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(fresh)
        run = np.diff(np.append(head, len(place)))
        which = np.searchsorted(doc.cuts, place[head], side="right") - 1
        for d, p, i, s, m in zip(which.tolist(), place[head].tolist(), item[head].tolist(), start[head].tolist(), (size[head] + run - 1).tolist()):
            yield d, p - int(doc.cuts[d]), test.ids[i], s - int(test.words.cuts[i]), m


def test_blocks(benchmark: DataFrame, window: int, test_bytes: int = TEST_BYTES) -> list:
    """Broadcasts of the test set, each of bounded size."""
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", "text").filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // test_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    out = []
    for k in range(count):
        part = [tuple(r) for r in (rows if count == 1 else rows.filter(block == k)).collect()]
        out.append(spark.sparkContext.broadcast(TestItems(part, window)))
    return out


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCHES = "doc_id long, doc_word long, item_id string, item_word long, n_words long"


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row a document: words, hit words, items that occur, digest of their ids."""
    tests = test_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for i, j in blocks(offsets, SHARD_BYTES):
                count, hit, items = judge(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tests)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(count), pa.array(hit), pa.array([k for k, _ in items], pa.int64()), pa.array([d for _, d in items], pa.string()), pa.array(hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select("doc_id", "text").mapInArrow(run, REPORT)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The longest verbatim matches and where they are, counted in words from 0."""
    tests = test_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            raw, offsets = text_buffers(batch.column("text"))
            for i, j in blocks(offsets, SHARD_BYTES):
                found = longest(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tests)
                columns = list(zip(*((names[i + d], *rest) for d, *rest in found))) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "doc_word", "item_id", "item_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no test window."""
    tests = test_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for i, j in blocks(offsets, SHARD_BYTES):
                hit = judge(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tests)[1]
                yield batch.slice(i, j - i).filter(pa.array(hit == 0))

    return docs.mapInArrow(run, docs.schema)
