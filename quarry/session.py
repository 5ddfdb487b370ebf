"""What every query needs of the session: the code on the executors and a shared folder."""

from __future__ import annotations

import json
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once a SparkContext)."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="quarry"), "quarry_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._quarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Only where driver and executors are one process can that be a folder of this machine; elsewhere it must be set.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(sc, "_quarry_shared", None) or tempfile.mkdtemp(prefix="quarry-shared")
        sc._quarry_shared = at
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_written = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What stored() writes inside is deleted at the end: for answers and runs that leave with plain values or their own tables."""
    outer = getattr(_written, "paths", None)
    _written.paths = []
    try:
        yield
    finally:
        for path in _written.paths:
            remove_path(spark, path)
        _written.paths = outer


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written to the shared folder with the writer's options and read from there: lineage ends here and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    if getattr(_written, "paths", None) is not None:
        _written.paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_small(spark: SparkSession, path: str, value: dict, new: bool = False) -> bool:
    """Write a file of a few bytes; with new only where there is none yet, which one of many writers wins."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(p, not new)
    except Exception:  # noqa: BLE001 - the store's own error: the file exists
        if new and fs.exists(p):
            return False
        raise
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    return True


def read_small(spark: SparkSession, path: str) -> dict | None:
    """A small file's value; None where it isn't there or isn't whole."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
    except Exception:  # noqa: BLE001 - the store's own errors, and what isn't JSON yet
        return None


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table of ours."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
