"""Problem 4: runs of the same event collapse into one, by associative summaries.

Events are sorted by range over all sequences at once, so a sequence of a third
of all rows is so many tasks' work, however its positions are spread. Each task
encodes the runs of its stretch; only its first and its last run can go on in
a neighbouring task. These edges, at most two a task, are merged by prefix over
the tasks: neighbours are joined where they are compatible, and what is joined
adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.plans.shared import write_shared

#: A run: where it lies, what it is, and the occurrences at its two ends.
_RUN = T.StructType(
    [T.StructField("traj_id", T.StringType()), T.StructField("first_ord", T.LongType()), T.StructField("last_ord", T.LongType()), T.StructField("n_events", T.LongType()),
     T.StructField("number", T.StringType()), T.StructField("node", T.StringType()), T.StructField("occ", T.LongType()), T.StructField("first_occ", T.LongType()),
     T.StructField("last_occ", T.LongType()), T.StructField("started", T.LongType()), T.StructField("ended", T.LongType()), T.StructField("task", T.IntegerType()),
     T.StructField("edge", T.BooleanType())]
)
_ARROW = pa.schema(
    [("traj_id", pa.string()), ("first_ord", pa.int64()), ("last_ord", pa.int64()), ("n_events", pa.int64()), ("number", pa.string()), ("node", pa.string()), ("occ", pa.int64()),
     ("first_occ", pa.int64()), ("last_occ", pa.int64()), ("started", pa.int64()), ("ended", pa.int64()), ("task", pa.int32()), ("edge", pa.bool_())]
)
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def event_number(event_id: Column) -> Column:
    """The first group of digits without leading zeros; null if there is none."""
    digits = F.regexp_extract(event_id, r"(\d+)", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", ""))


def node_key(node_id: Column) -> Column:
    """Spelling-free node: lower case, no outer blanks, one separator between words."""
    return F.lower(F.regexp_replace(F.regexp_replace(node_id, r"(?U)^\s+|\s+$", ""), r"(?U)[\s_-]+", "_"))


def _compatible(number: Column, node: Column, occ: Column, n2: Column, d2: Column, o2: Column) -> Column:
    same = (number == n2) & node.eqNullSafe(d2) & (occ.isNull() | o2.isNull() | (occ == o2))
    return F.coalesce(same, F.lit(False))


def _same(column: pa.Array, nulls: bool) -> np.ndarray:
    """Whether each value but the first equals the one before; ``nulls`` says whether two nulls do."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    equal = pc.fill_null(pc.equal(a, b), False)
    if nulls:
        equal = pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b)))
    return equal.to_numpy(zero_copy_only=False)


def _filled(column: pa.Array, value: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), value).to_numpy(zero_copy_only=False)


def _nullable(values: np.ndarray, null: int) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == null)


def encoded(batches: Iterator[pa.RecordBatch], task: int) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ``traj_id, ord, number, node, occ, ts``; the first and last of all are edges.

    Of rows with one place the first counts. A run that reaches the end of a
    batch is held back and put before the next one as a row of its own.
    """
    names = ["traj_id", "ord", "number", "node", "occ", "ts"]
    held: pa.RecordBatch | None = None  # the open run, in the columns of the result
    place: tuple[str, int] | None = None
    fresh = True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.RecordBatch.from_arrays([batch.column(i) for i in range(6)], names=names)
        again = np.concatenate(([place == (rows.column(0)[0].as_py(), rows.column(1)[0].as_py())], _same(rows.column(0), False) & _same(rows.column(1), False)))
        place = (rows.column(0)[-1].as_py(), rows.column(1)[-1].as_py())
        rows = rows.filter(pa.array(~again))
        if not rows.num_rows:
            continue
        seq, at, number, node, occ, ts = rows.columns
        each = pa.RecordBatch.from_arrays(
            [seq, at.cast(pa.int64()), at.cast(pa.int64()), pa.array(np.ones(rows.num_rows, dtype=np.int64)), number, node, *[occ.cast(pa.int64())] * 3, ts, ts], names=_ARROW.names[:11]
        )
        if held is not None:
            each = pa.Table.from_batches([held, each]).combine_chunks().to_batches()[0]
        col = {n: each.column(i) for i, n in enumerate(each.schema.names)}
        ahead, behind = col["first_occ"].slice(1), col["last_occ"].slice(0, each.num_rows - 1)
        agree = pc.fill_null(pc.equal(ahead, behind), True).to_numpy(zero_copy_only=False)
        joined = _same(col["traj_id"], False) & _same(col["number"], False) & _same(col["node"], True) & agree
        starts = np.concatenate(([0], np.flatnonzero(~joined) + 1))
        ends = np.concatenate((starts[1:], [each.num_rows])) - 1
        least = lambda n: _nullable(np.minimum.reduceat(_filled(col[n], _MOST), starts), _MOST)
        most = lambda n: _nullable(np.maximum.reduceat(_filled(col[n], _LEAST), starts), _LEAST)
        first, last = pa.array(starts), pa.array(ends)
        made = pa.RecordBatch.from_arrays(
            [col["traj_id"].take(first), col["first_ord"].take(first), col["last_ord"].take(last), pa.array(np.add.reduceat(_filled(col["n_events"], 0), starts)),
             col["number"].take(first), col["node"].take(first), most("occ"), col["first_occ"].take(first), col["last_occ"].take(last), least("started"), most("ended")],
            names=_ARROW.names[:11],
        )
        held, done = made.slice(made.num_rows - 1), made.slice(0, made.num_rows - 1)
        if done.num_rows:
            yield _marked(done, task, fresh, False)
            fresh = False
    if held is not None:
        yield _marked(held, task, fresh, True)


def _marked(runs: pa.RecordBatch, task: int, first: bool, last: bool) -> pa.RecordBatch:
    edge = np.zeros(runs.num_rows, dtype=bool)
    edge[0] |= first
    edge[-1] |= last
    return pa.RecordBatch.from_arrays([*runs.columns, pa.array(np.full(runs.num_rows, task, dtype=np.int32)), pa.array(edge)], schema=_ARROW)


def collapse_runs(
    df: DataFrame,
    *,
    seq_col: str = "traj_id",
    ord_col: str = "ord",
    event_col: str = "event_id",
    node_col: str = "node_id",
    occurrence_col: str = "occurrence",
    ts_col: str = "ts",
    delivered_col: str = "ingested_at",
    tasks: int | None = None,
) -> DataFrame:
    """One row per maximal run of the same event, runs of one event included.

    Returns ``traj_id, first_ord, last_ord, n_events, event_number, node,
    occurrence, started, ended, duration_seconds``. Two neighbours in order
    belong to one run if they have the same event number, the same node but for
    spelling (null equals null) and equal occurrences or a null one on either
    side. ``occurrence`` is the largest of the run. The duration spans the
    earliest and the latest time of the run and is null if it has no time.

    A place (``seq_col``, ``ord_col``) that came again counts once, by its
    latest delivery. Rows without a sequence or a place are in no sequence and
    give no row; an event without a number is a run alone. An empty table
    gives an empty table; other columns do not matter. The events are sorted
    into ``tasks`` ranges, by default as many as the session shuffles into.
    """
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    ev = df.select(
        F.col(seq_col).cast("string").alias("traj_id"),
        F.col(ord_col).cast("long").alias("ord"),
        F.col(event_col).alias("event"),
        F.col(node_col).alias("node"),
        F.col(occurrence_col).cast("long").alias("occ"),
        micros.alias("ts"),
        F.col(delivered_col).alias("delivered"),
    ).filter(F.col("traj_id").isNotNull() & F.col("ord").isNotNull())
    ranged = ev.repartitionByRange(*([tasks] if tasks else []), "traj_id", "ord")
    # spellings are settled behind the sort's sampling
    tidy = ranged.select("traj_id", "ord", event_number(F.col("event")).alias("number"), node_key(F.col("node")).alias("node"), "occ", "ts", "delivered")
    ordered = tidy.sortWithinPartitions("traj_id", "ord", F.desc_nulls_last("delivered"), "number", "node", "occ", "ts").drop("delivered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, TaskContext.get().partitionId())

    local = write_shared(ordered.mapInArrow(run, _RUN), "runs")
    along = Window.partitionBy("traj_id").orderBy("first_ord")
    edges = local.filter("edge").withColumn(
        "joined",
        (F.lag("task").over(along) != F.col("task"))
        & _compatible(
            F.col("number"), F.col("node"), F.col("first_occ"),
            F.lag("number").over(along), F.lag("node").over(along), F.lag("last_occ").over(along),
        ),
    )
    merged = (
        edges.withColumn("group", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("traj_id", "group")
        .agg(
            F.min("first_ord").alias("first_ord"),
            F.max("last_ord").alias("last_ord"),
            F.sum("n_events").alias("n_events"),
            F.min("number").alias("number"),
            F.min("node").alias("node"),
            F.max("occ").alias("occ"),
            F.min("started").alias("started"),
            F.max("ended").alias("ended"),
        )
    )
    columns = ["traj_id", "first_ord", "last_ord", "n_events", "number", "node", "occ", "started", "ended"]
    runs = local.filter("not edge").select(*columns).unionByName(merged.select(*columns))
    return runs.select(
        "traj_id",
        F.col("first_ord").cast("int").alias("first_ord"),
        F.col("last_ord").cast("int").alias("last_ord"),
        "n_events",
        F.col("number").alias("event_number"),
        "node",
        F.col("occ").cast("int").alias("occurrence"),
        F.timestamp_micros("started").alias("started"),
        F.timestamp_micros("ended").alias("ended"),
        ((F.col("ended") - F.col("started")) / F.lit(1e6)).alias("duration_seconds"),
    )
