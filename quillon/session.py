"""Making the package's own code available to the executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession



def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it isn't set,
    a session on one machine (tests) gets a local folder; on a cluster that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_quillon_shared", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = sc._quillon_shared = tempfile.mkdtemp(prefix="quillon-")
    return base.rstrip("/")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of the session, once; returns the session.

    Functions that run in Python workers refer to the package's modules by name, and workers
    need not share the driver's working directory or its import path.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_quillon_shipped", False):
        root = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="quillon-ship-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        copy = folder / "copy"
        shutil.copytree(root, copy / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(folder / "quillon"), "zip", copy))
        shutil.rmtree(copy)
        sc._quillon_shipped = True
    return spark
