"""Tables written between the stages of a job, in a folder every executor can reach."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the largest method that the JVM compiles. Fixed value.
HUGE_METHOD = 8000

_own_root: str | None = None
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a folder of its own under
    ``spark.sql.warehouse.dir``, removed when the process ends. On a cluster that fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    global _own_root
    if _own_root is None:
        _own_root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/vigilog-{uuid.uuid4().hex}"
        atexit.register(_remove_own)
    return _own_root


def _remove_own() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        remove(spark, _own_root)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on the file system that it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on the file system that it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Tables written by steps inside are removed at the end, however it comes.

    For jobs that run again and again, such as a micro-batch; their results must be written before.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/vigilog-{name}-{uuid.uuid4().hex}"
    written = _written.get()
    if written is not None:
        written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the table to the shared folder and read it back.

    Used where a result is read more than once or must not change when a task is run again. A
    written table survives the loss of executors and is columnar, so readers prune columns.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_methods(spark: SparkSession) -> None:
    """Let Spark make several methods of a long projection, where the session does not already.

    By default it may make one of up to 65,535 bytes; the JVM compiles none of more than 8000, and such a
    projection then runs interpreted, several times slower."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, "65535")) > HUGE_METHOD:
        spark.conf.set(name, str(HUGE_METHOD))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when the input has fewer splits than the session has cores.

    For small files that feed heavy work per row. Large inputs have splits enough and pass
    through unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
