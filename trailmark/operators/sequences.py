"""Prefix computations along ordered sequences of which one may hold a large part of all rows.

Positions are cut into chunks; each chunk computes alone, and only a row per
chunk meets in the window over the whole sequence. A sequence within one
chunk has nothing to carry over, and a plain window gives the same; so long
sequences are told from short ones first (:func:`in_parts`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.plans.shared import write_shared
from trailmark.plans.sizing import broadcast_if_small

#: Positions in a chunk.
CHUNK = 65_536


def by_length(df: DataFrame, seq: str, order: str, *, chunk: int = CHUNK) -> list[tuple[DataFrame, bool]]:
    """The rows of sequences within one chunk, and those of longer ones, if there are any; with whether it is the former.

    Found by a combining aggregate over two columns. The long sequences are at
    most the rows by ``chunk`` where positions follow each other, so they are few.
    """
    at = F.floor(F.col(order) / chunk)
    wide = df.groupBy(F.col(seq).alias("__seq")).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).filter("lo < hi").select("__seq")
    wide = write_shared(wide, "long")
    if wide.isEmpty():
        return [(df, True)]
    few, same = broadcast_if_small(wide, 1_000_000), F.col(seq) == F.col("__seq")
    return [(df.join(few, same, "left_anti"), True), (df.join(few, same, "left_semi"), False)]


def in_parts(df: DataFrame, seq: str, order: str, use: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """What ``use`` (rows, whether all their sequences lie within one chunk) makes of short sequences and of long ones."""
    return reduce(DataFrame.unionByName, [use(rows, single) for rows, single in by_length(df, seq, order)])


def with_previous(df: DataFrame, seq: str, order: str, columns: list[str], *, chunk: int = CHUNK, single: bool = False) -> DataFrame:
    """Add ``prev_<c>`` for each column: its value in the row before, in ``order`` within ``seq``; and ``has_prev``.

    ``single`` says that every sequence lies within one chunk.
    """
    if single:
        before = F.lag(F.struct(*[F.col(c) for c in columns])).over(Window.partitionBy(seq).orderBy(order))
        out = df.withColumn("__p", before)
        return out.withColumns({f"prev_{c}": F.col("__p")[c] for c in columns} | {"has_prev": F.col("__p").isNotNull()}).drop("__p")
    cut = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    w = Window.partitionBy(seq, "__chunk").orderBy(order)
    whole = F.struct(*[F.col(c) for c in columns])
    local = cut.withColumn("__lag", F.lag(whole).over(w))
    last = cut.groupBy(F.col(seq).alias("__seq"), F.col("__chunk").alias("__c")).agg(F.max_by(whole, F.col(order)).alias("__last"))
    along = Window.partitionBy("__seq").orderBy("__c")
    before = last.withColumn("__carry", F.lag("__last").over(along)).filter("__carry is not null").select("__seq", "__c", "__carry")
    joined = local.join(before, (F.col(seq) == F.col("__seq")) & (F.col("__chunk") == F.col("__c")), "left")
    got = F.when(F.col("__lag").isNotNull(), F.col("__lag")).otherwise(F.col("__carry"))
    out = joined.withColumn("__p", got)
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.col("__p")[c])
    return out.withColumn("has_prev", F.col("__p").isNotNull()).drop("__chunk", "__lag", "__seq", "__c", "__carry", "__p")


def running(df: DataFrame, keys: list[str], order: str, name: str, kind: str, value: Column, *, chunk: float = CHUNK, single: bool = False) -> DataFrame:
    """Add ``name``: the running sum or maximum (``kind``) of ``value`` up to and including each row.

    ``single`` says that every sequence lies within one chunk.
    """
    if kind not in ("sum", "max"):
        raise ValueError("kind must be 'sum' or 'max'")
    agg, join = (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))) if kind == "sum" else (F.max, lambda a, b: F.greatest(a, b))
    if single:
        return df.withColumn(name, agg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    cut = df.withColumn("__chunk", F.floor(F.col(order) / chunk)).withColumn("__v", value)
    w = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = cut.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__chunk").alias("__c")).agg(agg("__v").alias("__t"))
    along = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    before = total.withColumn("__off", agg("__t").over(along)).filter("__off is not null").drop("__t")
    on = F.col("__chunk") == F.col("__c")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = cut.withColumn("__l", agg("__v").over(w)).join(before, on, "left")
    return joined.withColumn(name, join(F.col("__l"), F.col("__off"))).drop("__chunk", "__v", "__c", "__off", "__l", *[f"__k{i}" for i in range(len(keys))])
