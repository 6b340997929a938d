"""Token-ID output: one wavelet matrix per shard.

A shard holds the ids of whole documents in a row. Each bit of the ids, from the highest, is
one succinct bit-plane; after each plane the ids are dealt stably, zeros first. A directory in the
file has the ones before every STEP bits of each plane, so rank and select need no pass over a
plane: a shard answers access(i), rank, count, select and occurrences(token) without unpacking the
ids. Planes and directory are compressed, so one file holds everything.

Documents are dealt by ranges of doc_id and written in ascending order through Spark's own
writer (one row holds the bytes of one shard file), so that any store works and a lost
executor's task is simply run again.

Defined results: a null text is empty, so it has the end id alone; rows with equal doc_id are
written next to each other, ordered by a hash of their text; null doc_ids come first; an empty
table gives no shards; further columns are ignored, whatever their names. A document lies
whole in one shard, which may then be larger than `shard_tokens`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import blocks, shared_dir, text_buffers
from quillon.llm.tokens import TEXT_BYTES, encoder

MAGIC = b"QWM2"
#: Bits per entry of the rank directory.
STEP = 512
#: Ids per shard: small enough that its planes are dealt within a core's cache.
SHARD_TOKENS = 1 << 18

SHARD_SCHEMA = "part int, seq int, start long, n_docs long, n_tokens long, payload binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def directory(packed: bytes) -> np.ndarray:
    """Ones of a plane before every STEP bits, and all of them."""
    per = STEP // 8
    blocks_ = np.zeros(-(-max(len(packed), 1) // per) * per, np.uint8)
    blocks_[: len(packed)] = np.frombuffer(packed, np.uint8)
    ones = np.bitwise_count(blocks_.view(np.uint64)).reshape(-1, STEP // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")


class BitVector:
    """Packed bits (little-endian) and their directory. Places may be one number or an array."""

    def __init__(self, packed: bytes, ones_before: np.ndarray, n: int):
        self.n, self.ones_before = n, ones_before.astype(np.int64)
        words = np.zeros((len(ones_before) - 1) * (STEP // 8), np.uint8)
        words[: len(packed)] = np.frombuffer(packed, np.uint8)
        self.words = words.view(np.uint64)

    def get(self, i):
        i = np.asarray(i, np.int64)
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1

    def rank1(self, i):
        """Ones among the first i bits."""
        i = np.asarray(i, np.int64)
        count, first, last = self.ones_before[i // STEP], i // STEP * (STEP // 64), i >> 6
        for k in range(STEP // 64):
            at = np.minimum(first + k, len(self.words) - 1)
            count = count + np.where(first + k < last, np.bitwise_count(self.words[at]), 0)
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return count + np.bitwise_count(self.words[np.minimum(last, len(self.words) - 1)] & below)

    def rank(self, bit: int, i):
        return self.rank1(i) if bit else np.asarray(i, np.int64) - self.rank1(i)

    def select(self, bit: int, k):
        """Place of the k-th such bit, counted from 0: the directory names the block, counts of its
        words the word, and halving the bit."""
        k = np.asarray(k, np.int64)
        before = self.ones_before if bit else STEP * np.arange(len(self.ones_before)) - self.ones_before
        block = np.searchsorted(before, k, side="right") - 1
        left, word = k - before[block], block * (STEP // 64)
        full = np.uint64(0) if bit else np.uint64(0xFFFFFFFFFFFFFFFF)
        done = np.zeros(k.shape, bool)
        for _ in range(STEP // 64 - 1):
            here = np.bitwise_count(self.words[word] ^ full).astype(np.int64)
            done |= left < here
            left, word = np.where(done, left, left - here), np.where(done, word, word + 1)
        x, at = self.words[word] ^ full, np.zeros(k.shape, np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left, at = np.where(up, left - low, left), np.where(up, at + half, at)
            x = np.where(up, x >> np.uint64(half), x)
        return word * 64 + at


def pack_planes(ids: np.ndarray, bits: int) -> tuple[list[bytes], list[int]]:
    """Bit-planes from the highest bit and the zeros of each."""
    current = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, zeros = [], []
    for b in range(bits - 1, -1, -1):
        bit = (current & current.dtype.type(1 << b)) != 0
        planes.append(np.packbits(bit, bitorder="little").tobytes())
        # Taking by places is faster than by a mask.
        low = np.flatnonzero(~bit)
        zeros.append(len(low))
        current = np.concatenate([current.take(low), current.take(np.flatnonzero(bit))])
    return planes, zeros


def unpack_planes(planes: list[bytes], zeros: list[int], n: int) -> np.ndarray:
    """All ids in order, from the lowest plane up."""
    bits = len(planes)
    current = np.zeros(n, np.uint16 if bits <= 16 else np.uint32)
    for b in range(bits):
        plane = planes[bits - 1 - b]
        bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").view(bool)
        z = zeros[bits - 1 - b]
        above = np.empty_like(current)
        above[np.flatnonzero(~bit)] = current[:z]
        above[np.flatnonzero(bit)] = current[z:] | current.dtype.type(1 << b)
        current = above
    return current


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The shard file: header, documents, then each plane compressed."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    planes, zeros = pack_planes(ids, bits)
    press = zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<i8").tobytes()
    counts = np.concatenate([directory(p) for p in planes]).tobytes()
    parts = [press.compress(docs), press.compress(counts), *(press.compress(p) for p in planes)]
    head = struct.pack("<4sBQQ", MAGIC, bits, len(ids), len(doc_ids)) + np.array(zeros, "<u8").tobytes()
    return head + np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)


class Shard:
    """One shard file, opened: documents, and the wavelet matrix of their ids."""

    def __init__(self, data: bytes):
        magic, bits, self.n, docs = struct.unpack_from("<4sBQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<4sBQQ")
        self.zeros = np.frombuffer(data, "<u8", bits, at).astype(np.int64).tolist()
        at += 8 * bits
        sizes = np.frombuffer(data, "<u8", bits + 2, at).astype(np.int64).tolist()
        at += 8 * (bits + 2)
        parts, unpress = [], zstandard.ZstdDecompressor()
        for s in sizes:
            parts.append(unpress.decompress(data[at : at + s]))
            at += s
        table, counts, self.planes = parts[0], parts[1], parts[2:]
        self.directories = np.frombuffer(counts, "<u4").reshape(bits, -1)
        known = np.frombuffer(table, np.uint8, docs, 8 * docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(table, "<i8", docs), known)]
        self.lengths = np.frombuffer(table, "<i8", docs, 9 * docs)
        self._vectors: list[BitVector] | None = None

    @property
    def vectors(self) -> list[BitVector]:
        if self._vectors is None:
            self._vectors = [BitVector(p, d, self.n) for p, d in zip(self.planes, self.directories)]
        return self._vectors

    def ids(self) -> np.ndarray:
        return unpack_planes(self.planes, self.zeros, self.n)

    def access(self, i):
        """The id at a place, or the ids at an array of places."""
        i = np.asarray(i, np.int64)
        token = np.zeros(i.shape, np.int64)
        for v, z in zip(self.vectors, self.zeros):
            bit, ones = v.get(i), v.rank1(i)
            token = token << 1 | bit
            i = np.where(bit == 1, z + ones, i - ones)
        return token if token.ndim else int(token)

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """The token's places among the first i ids, on the lowest level."""
        lo, hi, bits = 0, i, len(self.zeros)
        if token >> bits:
            return 0, 0
        for k, (v, z) in enumerate(zip(self.vectors, self.zeros)):
            bit = token >> (bits - 1 - k) & 1
            lo, hi = (z * bit) + v.rank(bit, lo), (z * bit) + v.rank(bit, hi)
        return int(lo), int(hi)

    def rank(self, token: int, i: int) -> int:
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        return int(self._up(token, np.int64(lo + k)))

    def _up(self, token: int, place):
        """Places among the ids, from places on the lowest level."""
        bits = len(self.zeros)
        for level in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - level) & 1
            place = self.vectors[level].select(bit, place - self.zeros[level] * bit)
        return place

    def places(self, token: int) -> np.ndarray:
        """All places of a token, in order: all of them climb the planes together."""
        lo, hi = self._range(token, self.n)
        return self._up(token, np.arange(lo, hi))

    def occurrences(self, token: int) -> list[int]:
        return self.places(token).tolist()


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text), write the shards under path and return them reread."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seq, start, held, held_docs, held_len = 0, 0, [], [], []
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, held, held_docs, held_len
            ids = np.concatenate(held)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([len(held_docs)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([to_bytes(ids, held_docs, held_len)], pa.binary())], ["part", "seq", "start", "n_docs", "n_tokens", "payload"])
            seq, start, held, held_docs, held_len = seq + 1, start + len(ids), [], [], []
            return row

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            raw, offsets = text_buffers(batch.column("text"))
            for i, j in blocks(offsets, TEXT_BYTES):
                ids, cuts = enc.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = sum(held_len)
                for d in range(i, j):
                    own = ids[cuts[d - i] : cuts[d - i + 1]]
                    if held_docs and size + len(own) + len(tail) > shard_tokens:
                        yield flush()
                        size = 0
                    held += [own, tail]
                    held_docs.append(names[d])
                    held_len.append(len(own) + len(tail))
                    size += held_len[-1]
        if held_docs:
            yield flush()

    dealt = docs.select("doc_id", "text").repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt.mapInArrow(shards, SHARD_SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def with_start(shards: DataFrame) -> DataFrame:
    """Each shard's first place among all ids. Sums of the parts, as many as write_shards was
    told to make, are the only thing that meets in one place."""
    spark = shards.sparkSession
    rows = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    total, begins = 0, []
    for r in rows:
        begins.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(begins, "part int, base long")
    return shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("start")).alias("start"), "payload")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
                shard = Shard(payload.as_buffer().to_pybytes())
                ids = shard.ids().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crc = [zlib.crc32(memoryview(ids)[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_start(shards).mapInArrow(read, DOC_SCHEMA)


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """Every place of a token id over all shards, by occurrence lookup on the planes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
                places = Shard(payload.as_buffer().to_pybytes()).places(token)
                yield pa.RecordBatch.from_arrays([pa.array(start + places, pa.int64())], ["place"])

    return with_start(shards).mapInArrow(find, "place long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int | None, path: str | None = None) -> DataFrame:
    """Write all documents as shards and return what the shards say of each document."""
    return read_documents(write_shards(docs, path or shared_dir(docs.sparkSession), tokenizer, end_id))
