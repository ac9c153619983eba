"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex[:12]}"
    _written[path] = spark
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back.

    The written table outlives executors, so nothing upstream is computed again when one is lost. Tables stay until
    drop() or the end of the application, as later results may read them lazily.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._loomgraph_path = path
    return back


def drop(*tables: DataFrame | None) -> None:
    """Delete the files behind tables made by cut()."""
    for t in tables:
        path = getattr(t, "_loomgraph_path", None)
        if path:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.pop(path, None)


def write_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """A small file (a compiled automaton, a model) in the shared folder; its path. Read it with read_bytes or SparkFiles."""
    path = new_path(spark, name)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            if path.startswith("file:"):
                import shutil

                local = Path(path.removeprefix("file://"))
                shutil.rmtree(local, ignore_errors=True) if local.is_dir() else local.unlink(missing_ok=True)
            elif spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass
