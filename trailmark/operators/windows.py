"""Overlapping text windows that end at natural places, keeping head and tail when capped."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters behind which a window may end.
DELIMITERS = "。，；\n "
_CODES = np.array([ord(c) for c in DELIMITERS], dtype=np.uint32)


def check_window(window: int, stride: int, max_windows: int) -> None:
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    if stride >= window:
        raise ValueError("stride must be smaller than window")
    if max_windows <= 0:
        raise ValueError("max_windows must be positive")


def spans(text: str, window: int, stride: int) -> list[tuple[int, int]]:
    """All windows of a stripped text as offsets, before any cap."""
    n = len(text)
    if n == 0:
        return []
    if n <= window:
        return [(0, n)]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stops = np.flatnonzero(np.isin(code, _CODES)).tolist()
    out, start = [], 0
    while True:
        end = min(start + window, n)
        if end < n:
            k = bisect_left(stops, end) - 1
            # a cut in the first half would make the window too short
            if k >= 0 and stops[k] > start + window // 2:
                end = stops[k] + 1
        out.append((start, end))
        if end >= n:
            return out
        start = max(end - stride, start + 1)


def kept(n: int, cap: int) -> list[int]:
    """Evenly spread indexes of at most ``cap`` of ``n`` windows; a cap of one keeps the tail."""
    if n <= cap:
        return list(range(n))
    if cap == 1:
        return [n - 1]
    return [round(i * (n - 1) / (cap - 1)) for i in range(cap)]


def covered(chosen: list[tuple[int, int]]) -> int:
    """Characters that lie in at least one window; windows come in order of their starts."""
    total = reach = 0
    for start, end in chosen:
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


STATS = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("input_chars", "candidate_windows", "num_windows")]
    + [T.StructField("windows_downsampled", T.BooleanType()), T.StructField("covered_chars", T.IntegerType())]
    + [T.StructField("coverage_rate", T.DoubleType()), T.StructField("tail_covered", T.BooleanType())]
)
WINDOWS = T.ArrayType(
    T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])
)


def windows_of(text: str | None, window: int, stride: int, cap: int) -> tuple[list[tuple[int, int, int, str]], tuple]:
    """Kept windows (index before the cap, start, end, text) and their statistics."""
    text = (text or "").strip()
    found = spans(text, window, stride)
    chosen = [(i, *found[i], text[found[i][0] : found[i][1]]) for i in kept(len(found), cap)]
    n, some = len(text), covered([(s, e) for _, s, e, _ in chosen])
    return chosen, (n, len(found), len(chosen), len(found) > len(chosen), some, some / n if n else 0.0, bool(chosen and chosen[-1][2] == n))


def with_windows(df: DataFrame, text_col: str, keep: list[str], *, window: int = 48, stride: int = 24, max_windows: int = 256) -> DataFrame:
    """``keep``, ``windows`` (array of idx, start, end, text) and ``stats`` of every text.

    Offsets count characters of the stripped text. Null and blank texts have no
    windows. One row in, one row out; nothing is shuffled.
    """
    check_window(window, stride, max_windows)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("windows", WINDOWS), T.StructField("stats", STATS)])
    window_type, stats_type = (pa.list_(pa.struct([("idx", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])), None)
    names = [f.name for f in STATS.fields]
    stats_type = pa.struct([(n, pa.int32()) for n in names[:3]] + [(names[3], pa.bool_()), (names[4], pa.int32()), (names[5], pa.float64()), (names[6], pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [windows_of(t, window, stride, max_windows) for t in batch.column(len(keep)).to_pylist()]
            rows = [[{"idx": i, "start": s, "end": e, "text": x} for i, s, e, x in w] for w, _ in made]
            stats = [dict(zip(names, s, strict=True)) for _, s in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(rows, window_type), pa.array(stats, stats_type)], names=schema.names
            )

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def passages(df: DataFrame, id_col: str, turns: Column) -> DataFrame:
    """A window per non-blank turn: ``id_col, turn, start, end``; offsets run on over blank turns."""
    rows = df.select(id_col, F.posexplode(turns).alias("turn", "text"))
    before = Window.partitionBy(id_col).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    placed = rows.withColumn("size", size).withColumn("start", F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).cast("int"))
    return placed.filter("size > 0").select(id_col, "turn", "start", (F.col("start") + F.col("size")).cast("int").alias("end"))
