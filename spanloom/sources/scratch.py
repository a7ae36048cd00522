"""Tables that a job writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: Counter[int] = Counter()
_before: dict[int, str] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go once a query has ended, as long as any thread of the session is within this."""
    key = id(spark)
    with _lock:
        _writing[key] += 1
        if _writing[key] == 1:
            _before[key] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writing[key] -= 1
            if not _writing[key]:
                spark.conf.set(_CLEANUP, _before.pop(key))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without one gets a folder of its own: on a cluster no
    folder of one machine will do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write(df: DataFrame, label: str, compression: str = "snappy") -> str:
    """The path of df, written once as Parquet. Lineage ends there, and a lost executor costs no more than its own tasks. The
    files go when the driver exits; the shuffle files that led to them go at once, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path, compression=compression)
    atexit.register(delete, spark, path)
    return path


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df, read from where it has been written."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, label, compression))


def delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder's owner removes it
        pass
