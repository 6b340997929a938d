"""Packing: shortest-pack-first over the histogram of lengths.

Documents are encoded once and cut into pieces of at most `size` ids. The plan works on the
histogram of piece lengths alone, which has `size` entries however many documents there are:
lengths are placed longest first, always into the packs with most room left (the shortest
ones), and packs with equal content are one pattern with a count. Patterns are joined back to
the pieces by each piece's rank among the pieces of its length. Ranks come from counts of
(length, bucket), so that a length which a third of all rows share is split as well.

Defined results: a null text is empty (it has the end id alone); a null doc_id is kept as it is; an
empty table gives no rows; repeated rows are packed each for itself; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import blocks, text_buffers, written
from quillon.llm.tokens import TEXT_BYTES, encoder

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Buckets that the pieces of one length are dealt to for ranking, at least, and pieces for which
#: one more is added: the most frequent length has a bounded number of rows in each task.
BUCKETS, PER_BUCKET = 64, 2_000_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Encode and cut: pieces of `size` ids, and what is left at a document's end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            raw, offsets = text_buffers(batch.column("text"))
            for i, j in blocks(offsets, TEXT_BYTES):
                ids, cuts = enc.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows: list[tuple] = []
                for d, name in enumerate(names[i:j]):
                    own = np.append(ids[cuts[d] : cuts[d + 1]], np.uint32(end_id)).astype("<u4")
                    view, n = memoryview(own.tobytes()), len(own)
                    for a in range(0, n, size):
                        b = min(a + size, n)
                        rows.append((name, a, b - a, zlib.crc32(view[4 * a : 4 * b]), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SCHEMA)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pattern, how many packs have it). Deterministic for a histogram.

    A pattern is kept as (the pattern it grew from, the length added), so that equal ones meet.
    """
    grown: dict[tuple[int, int], int] = {}
    parent: list[tuple[int, int]] = [(-1, 0)]  # pattern 0 is the empty pack
    count = [0]
    room: list[tuple[int, int]] = []  # (minus the room left, pattern)

    def add(pattern: int, length: int, packs: int, left: int) -> None:
        key = (pattern, length)
        if key not in grown:
            grown[key] = len(parent)
            parent.append(key)
            count.append(0)
        child = grown[key]
        if not count[child]:
            heapq.heappush(room, (-left, child))
        count[child] += packs

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        todo = histogram[length]
        while todo and room and -room[0][0] >= length:
            left, pattern = -room[0][0], room[0][1]
            packs = min(todo, count[pattern])
            count[pattern] -= packs
            if not count[pattern]:
                heapq.heappop(room)
            add(pattern, length, packs, left - length)
            todo -= packs
        each = size // length
        for packs, k in ((todo // each, each), (int(todo % each > 0), todo % each)):
            pattern = 0
            for i in range(k if packs else 0):
                if i == k - 1:
                    add(pattern, length, packs, size - k * length)
                else:
                    key = (pattern, length)
                    if key not in grown:
                        grown[key] = len(parent)
                        parent.append(key)
                        count.append(0)
                    pattern = grown[key]
    out = []
    for pattern, packs in enumerate(count):
        if packs:
            lengths, at = [], pattern
            while at:
                at, n = parent[at]
                lengths.append(n)
            out.append((tuple(reversed(lengths)), packs))
    return sorted(out, key=lambda x: tuple(-n for n in x[0]))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, times in a pack, first sequence, offset), sorted: the pieces of
    that length from that rank on fill the packs from that sequence on, so many in each.
    Sequences are numbered without gaps."""
    given: dict[int, int] = {}
    out, first = [], 0
    for lengths, count in patterns:
        offset = 0
        for n, run in itertools.groupby(lengths):
            times, rank = len(list(run)), given.get(n, 0)
            out.append((n, rank, times, first, offset))
            given[n] = rank + times * count
            offset += n * times
        first += count
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """Rank of each piece among those of its length, from 0, in order of (bucket, doc_id, start).
    The window works on (length, bucket); only counts meet by length. most: the pieces of the
    most frequent length."""
    buckets = max(BUCKETS, most // PER_BUCKET)
    # Rows come from files, so their numbers are the same in every reading; they spread equal rows.
    order = ["doc_id", "start", "ids_crc32", "_number"]
    dealt = rows.withColumn("_number", F.monotonically_increasing_id()).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("length", "_bucket").orderBy(*order)
    # As few as BUCKETS for each length may be broadcast; more are joined as the window deals them.
    counts = F.broadcast(counts) if buckets == BUCKETS else counts
    return dealt.withColumn("_row", F.row_number().over(local) - 1).join(counts, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row")).drop("_bucket", "_before", "_row", "_number")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = written(pieces(docs, tokenizer, end_id, size))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # A pattern has fewer than sqrt(2 * size) different lengths, and patterns follow the
    # histogram's entries: this table's size follows `size`, not the documents.
    plan = slots(shortest_pack_first(histogram, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] * (1 << 40) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            _, begin, times, first, offset = plan[np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1].T
            turn = rank - begin
            kept = [batch.column(f.name) for f in batch.schema if f.name != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first + turn // times), pa.array(offset + turn % times * length)], [f.name for f in batch.schema if f.name != "_rank"] + ["sequence_id", "offset"])

    return ranked(rows, max(histogram.values(), default=0)).select(*rows.columns, "_rank").mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")
