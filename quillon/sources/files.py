"""Small files on any store that Spark reads: metadata, logs and artifacts."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import SparkSession


class Files:
    """Hadoop's file system API, for the driver's own small files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        path = self._path(name)
        return self._fs(path).exists(path)

    def names(self, name: str = "") -> list[str]:
        """Sorted names inside a folder; none if it doesn't exist."""
        path = self._path(name)
        fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def ages(self, name: str) -> dict[str, float]:
        """Names inside a folder and when each was changed last, in seconds."""
        path = self._path(name)
        fs = self._fs(path)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(path)} if fs.exists(path) else {}

    def read(self, name: str) -> bytes:
        path = self._path(name)
        stream = self._fs(path).open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes, overwrite: bool = True) -> bool:
        """False if the file exists and may not be overwritten. Readers see all of it or nothing."""
        path = self._path(name)
        fs = self._fs(path)
        if not overwrite and fs.exists(path):
            return False
        part = self._path(f"{name}.{hashlib.sha256(data).hexdigest()[:12]}.tmp")
        stream = fs.create(part, True)
        try:
            stream.write(data)
        finally:
            stream.close()
        if overwrite and fs.exists(path):
            fs.delete(path, False)
        done = fs.rename(part, path)
        if not done:
            fs.delete(part, False)
        return bool(done)

    def copy_in(self, local: str, name: str) -> None:
        """A local file of any size, whole or not at all."""
        path, part = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        fs = self._fs(path)
        fs.copyFromLocalFile(False, True, self._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), part)
        if not fs.rename(part, path):
            fs.delete(part, False)

    def delete(self, name: str) -> None:
        path = self._path(name)
        self._fs(path).delete(path, True)


class Artifacts:
    """Content-addressed blobs and files next to the tables; rows hold their references."""

    BLOB, FILE = "&:blob:", "&:file:"

    def __init__(self, files: Files, folder: str = "artifacts"):
        self.files, self.folder = files, folder

    def put_bytes(self, data: bytes, name: str | None = None) -> str:
        name = name or hashlib.sha256(data).hexdigest()
        if not self.files.exists(f"{self.folder}/{name}"):
            self.files.write(f"{self.folder}/{name}", data)
        return self.BLOB + name

    def put_file(self, path: str) -> str:
        """Copy a local file, part by part; the reference is made of its name and content."""
        sha = hashlib.sha256(path.rsplit("/", 1)[-1].encode() + b":")
        with open(path, "rb") as f:
            while part := f.read(1 << 20):
                sha.update(part)
        name = sha.hexdigest()
        if not self.files.exists(f"{self.folder}/{name}"):
            self.files.copy_in(path, f"{self.folder}/{name}")
        return self.FILE + name

    def get(self, reference: str) -> bytes:
        return self.files.read(f"{self.folder}/{reference.rsplit(':', 1)[-1]}")

    def delete(self, reference: str) -> None:
        self.files.delete(f"{self.folder}/{reference.rsplit(':', 1)[-1]}")

    def names(self) -> list[str]:
        return self.files.names(self.folder)

    def collect_garbage(self, used: set[str]) -> list[str]:
        """Delete artifacts that no reference in `used` names; returns them."""
        keep = {r.rsplit(":", 1)[-1] for r in used}
        gone = [n for n in self.names() if n not in keep]
        for n in gone:
            self.files.delete(f"{self.folder}/{n}")
        return gone
