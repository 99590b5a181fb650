"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}  # application -> folder, where the session names none
_open = threading.local()  # lists of the paths taken inside ``condensed`` of this thread


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where it names none and all runs on one machine, as
    in tests, a temporary folder is taken for the application; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        found = _own[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for taken in getattr(_open, "lists", []):
        taken.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage is cut, a lost
    executor costs nothing that was finished, and several readers share one computation."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written with a number of its own for each row, so that rows with equal, repeated or
    null ids stay apart, and the name of that column: one that ``df`` does not have."""
    column = _free(df)
    return written(df.withColumn(column, F.monotonically_increasing_id()), name), column


def dealt(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``numbered``, in as many buckets of the number as there are shuffle partitions: one
    shuffle, after which joins on the number leave these rows where they are."""
    spark, column = df.sparkSession, _free(df)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, label = fresh_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    rows = df.withColumn(column, F.monotonically_increasing_id()).repartition(parts, column)
    rows.write.option("compression", "zstd").option("path", path).bucketBy(parts, column).saveAsTable(label, format="parquet")
    out = spark.table(label)
    spark.sql(f"DROP TABLE {label}")  # its name only: the files are the folder's
    return out, column


def _free(df: DataFrame) -> str:
    column = "_n"
    while column in (c.lower() for c in df.columns):
        column += "_"
    return column


def joined_by_weight(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key; ``weight``: how many of ``rows`` have it).
    Keys that hold over 1 / (4 x shuffle partitions) of all rows, of which there are fewer than
    4 x partitions, come by broadcast, so their rows stay where they are; all other keys are
    shuffled. Where there are frequent keys, both tables are read twice: they should be written
    ones. ``weight`` is dropped."""
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum(weight)).first()[0] or 0
    limit = max(1000, -(-total // parts))
    hashed = F.xxhash64(*keys)  # of two keys with one hash both count as frequent
    frequent = [r[0] for r in table.filter(F.col(weight) > limit).select(hashed).distinct().collect()]
    if not frequent:
        return rows.join(table.drop(weight), keys, how)
    hot = hashed.isin(frequent)
    some = rows.filter(hot).join(F.broadcast(table.filter(hot).drop(weight)), keys, how)
    return some.unionByName(rows.filter(~hot).join(table.filter(~hot).drop(weight), keys, how))


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by ``written`` (no other reader may be left)."""
    spark = df.sparkSession
    jvm = spark._jvm
    folder = shared_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def condensed(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, ``written``; the tables written on the way to it are deleted."""
    taken: list[str] = []
    _open.lists = [*getattr(_open, "lists", []), taken]
    try:
        out = written(build(), name)
    finally:
        _open.lists = _open.lists[:-1]
    spark = out.sparkSession
    for path in taken[:-1]:  # the last is the result's
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
