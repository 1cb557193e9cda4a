"""Intermediate tables in the folder all executors share.

A written table cuts the lineage as a checkpoint does, but computes its input
once; a lost executor costs nothing because the files outlive it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="trailmark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = own_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, to be deleted at the end."""
    path = f"{shared_folder(spark)}/trailmark-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def intermediate() -> Iterator[None]:
    """Deletes at its end what was written inside: for long sessions, once a result is stored or collected."""
    first = len(_written)
    try:
        yield
    finally:
        _delete(first)


@atexit.register
def _delete(first: int = 0) -> None:
    own = _written[first:]
    del _written[first:]
    for spark, path in own:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone; the folder's owner cleans it
            return
