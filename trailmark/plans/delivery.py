"""Redelivered rows: the latest delivery of a key counts, once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.plans.shared import write_shared

#: Keys that came more than once, up to which they are broadcast.
FEW = 500_000


def latest_delivery(df: DataFrame, keys: list[str], delivered: str, *, few: int = FEW) -> DataFrame:
    """One row per ``keys``: the one with the largest ``delivered``.

    Ties are settled by the hash of the whole row, so that the result does not
    depend on the order of the input. Nulls in a key equal each other; a null
    ``delivered`` is older than any other. An empty table gives an empty table.

    Only keys and times are read and shuffled to find the keys that came more
    than once. Up to ``few`` of them are broadcast to the rows, which stay where
    they are; only rows of one key and time meet. Beyond it whole rows are
    shuffled, once.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    own = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    time = F.col(f"`{delivered}`")
    counted = df.select(*own, time.alias("__t")).groupBy(*names, "__t").agg(F.count(F.lit(1)).alias("__n"))
    repeated = counted.groupBy(*names).agg(F.sum("__n").alias("__rows"), F.max(F.struct("__t", "__n")).alias("__top")).filter("__rows > 1")
    repeated = write_shared(repeated.select(*names, "__top.__t", "__top.__n"), "repeated")
    size, tied = repeated.agg(F.count(F.lit(1)), F.count(F.when(F.col("__n") > 1, 1))).first()
    if not size:
        return df

    def best(rows: DataFrame) -> DataFrame:
        top = F.max_by(F.struct(*cols), F.struct(time, F.xxhash64(*cols)))
        return rows.groupBy(*own).agg(top.alias("__x")).select("__x.*")

    if size > few:
        return best(df)
    on = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))
    marked = df.join(F.broadcast(repeated), on, "left")
    latest = time.eqNullSafe(F.col("__t"))
    settled = marked.filter(F.col("__n").isNull() | ((F.col("__n") == 1) & latest)).select(*cols)
    return settled.unionByName(best(marked.filter((F.col("__n") > 1) & latest).select(*cols))) if tied else settled
