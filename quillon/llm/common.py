"""Helpers shared by the operators: shared scratch folder, Arrow text buffers."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text is worked on in blocks of whole documents of about this many bytes, so
#: that temporary arrays stay small next to an executor's memory.
BLOCK_BYTES = 2 << 20

#: Bytes of a space for the word definitions with ``[^\x20\x09-\x0D]``.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])


def shared_dir(spark: SparkSession) -> str:
    """A new, empty path in the cluster's shared folder (spark.checkpoint.dir).

    Where that setting is missing, a session on one machine (tests) gets a local folder; on a
    cluster it is an error, as executors wouldn't see each other's files.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_quillon_scratch", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillon-")
        sc._quillon_scratch = base
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"
    sc._quillon_paths = [*getattr(sc, "_quillon_paths", []), path]
    return path


def clean(spark: SparkSession) -> int:
    """Delete what this session has written to the shared folder; returns how many folders. Call
    it when the results that were read from there have been stored elsewhere."""
    sc = spark.sparkContext
    paths = getattr(sc, "_quillon_paths", [])
    sc._quillon_paths = []
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and return it reread: later steps start from files,
    which survive the loss of any executor, and nothing is computed twice."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Digits, letters a-z and all bytes of characters beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words of some texts, which are runs of bytes of one kind: places and 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = IS_WORD, fold: np.ndarray = LOWER):
        self.text = fold[raw]
        inside = kind[self.text]
        begins = np.zeros(len(raw) + 1, bool)
        begins[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | begins[1:-1]
        last[:-1] &= ~inside[1:] | begins[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.cuts = np.searchsorted(self.starts, offsets)  # where each text's words begin
        self.count = np.diff(self.cuts)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        padded = np.concatenate([self.text, np.zeros(16, np.uint8)])
        wide = np.ndarray(shape=(len(self.text) + 9,), dtype="<u8", buffer=padded.data, strides=(1,))
        length = self.ends - self.starts
        out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rows, at = slice(None), 0
        while True:
            left = length[rows] - at
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8))
            x = (out[rows] ^ (wide[self.starts[rows] + at] & mask)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            out[rows] = x ^ (x >> np.uint64(29))
            at += 8
            rows = np.flatnonzero(length > at)
            if not len(rows):
                return out

    def phrase(self, a: int, n: int) -> list[bytes]:
        raw = self.text[self.starts[a] : self.ends[a + n - 1]].tobytes()
        base = int(self.starts[a])
        return [raw[s - base : e - base] for s, e in zip(self.starts[a : a + n].tolist(), self.ends[a : a + n].tolist())]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give memory that was freed back to the system: workers live on between tasks, and the next
    one of another operator may need it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps its own books
            pass


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES, trim: bool = True) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `size` bytes together, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
    if trim:
        release()


def remainder(column: str, mod: int):
    """crc32 of an id as text, modulo mod."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str, mod: int, held_out: int, limit: int) -> DataFrame:
    """doc_id, text, label of at most `limit` labelled rows to learn from, those with the least
    hash of their id. Rows whose remainder is `held_out` aren't among them. An id counts once: with
    its greatest label, and of several texts the one with the least hash."""
    from pyspark.sql import functions as F

    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (remainder("doc_id", mod) != held_out))
    chosen = rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # The limit bounds what is broadcast; a much repeated id is one row of each task before it moves.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    text = F.struct(F.xxhash64("text").alias("h"), "text")
    return found.groupBy("doc_id").agg(F.min(text).alias("_t"), F.max("label").alias("label")).select("doc_id", F.col("_t.text").alias("text"), "label")


def column_name(wanted: str, taken: list[str]) -> str:
    """`wanted`, or `wanted` with underscores where an input column has that name already."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def must_be_new(names: list[str], taken: list[str]) -> None:
    """ValueError if a result column has an input column's name."""
    if again := {n.lower() for n in names} & {c.lower() for c in taken}:
        raise ValueError(f"the input has a column {sorted(again)} already; name the result otherwise")
