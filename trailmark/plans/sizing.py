"""Broadcasts behind a check of the side's size, and scans in enough tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What the optimizer may estimate of a side that is broadcast without being counted.
MAX_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``broadcast(df)`` if it is small, else ``df`` itself.

    Small is what the optimizer estimates at MAX_BYTES at most, from the files'
    sizes and without a job, or else what has at most ``max_rows`` rows; that
    check reads ``max_rows + 1`` rows. Beyond both the join is left to Catalyst,
    which shuffles both sides.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if estimate <= MAX_BYTES or df.limit(max_rows + 1).count() <= max_rows else df


def spread(scan: DataFrame) -> DataFrame:
    """A scan in at least as many tasks as there are cores, for work that costs far more than moving its rows.

    A table of many files or splits is left as it is; one of few is dealt out.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
