"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # application -> folder, where the session names none
_open = threading.local()  # lists of the paths taken inside ``released`` blocks of this thread


def remove(spark: SparkSession, path: str) -> None:
    """The folder at ``path`` removed, on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Without ``spark.checkpoint.dir`` this works on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for taken in getattr(_open, "lists", []):
        taken.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: lineage is cut, and all that read it share one
    computation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """All tables ``written`` inside the block are removed at its end, so a stream that runs for
    long leaves none behind."""
    taken: list[str] = []
    _open.lists = [*getattr(_open, "lists", []), taken]
    try:
        yield
    finally:
        _open.lists = _open.lists[:-1]
        for path in taken:
            remove(spark, path)
