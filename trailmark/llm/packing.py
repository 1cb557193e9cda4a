"""Problem 6: texts go into containers of fixed capacity by pattern packing.

Sizes are counted in tokens. A text over the capacity alone is cut into full
containers and a tail. Then only the histogram of sizes comes to one place. A
container is divided into cells by halving, level by level: at each level the
patterns of at most three texts that fill a cell exactly are enumerated, their
repeat counts fitted to the histogram by non-negative least squares and rounded
so that the sums over neighbouring patterns stay, and what they take leaves the
histogram. Texts of up to half a cell may be left to the next level, which is one
more pattern each. The residual is packed largest first at its exact sizes. Cells
lie one behind the other, larger ones first, so none crosses the border of a
container. The plan (size, rank range) -> container is joined back to the texts,
ranked within their size; no step sees a text again after counting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.tokens import with_tokens
from trailmark.plans.shared import write_shared

#: Sizes that a level distinguishes at most, and tokens of the smallest cell.
UNITS, LEAST_CELL = 512, 16
#: Steps of the fit.
STEPS = 400
#: Texts of one size in a task, about.
RANK_ROWS = 50_000


def enumerate_patterns(units: int) -> np.ndarray:
    """Multisets of at most three sizes that sum to ``units``, one per row, largest first, 0 for none."""
    a, b = np.meshgrid(np.arange(1, units + 1), np.arange(units + 1), indexing="ij")
    c = units - a - b
    ok = (b <= a) & (c >= 0) & (c <= b)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fit_repeats(hist: np.ndarray, patterns: np.ndarray, *, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts that minimise the squared misfit of patterns to histogram, by accelerated projected gradients.

    A size weighs as much as it takes up. Sizes of up to half the largest have a
    pattern each for being left over, whose counts are fitted too but not returned.
    """
    units = len(hist) - 1
    weight = np.arange(units + 1) / units
    some, left = len(patterns), np.arange(1, units // 2 + 1)

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, k], weights=x[:some], minlength=units + 1) for k in range(3))
        out[left] += x[some:]
        return out * weight

    def back(r: np.ndarray) -> np.ndarray:
        r = r * weight  # nothing weighs for "no text"
        return np.concatenate([r[patterns].sum(axis=1), r[left]])

    x = np.ones(some + len(left))
    for _ in range(30):
        x = back(used(x))
        norm = np.linalg.norm(x)
        x /= norm or 1.0
    wanted, rate = hist * weight, 0.98 / (norm or 1.0)
    x = np.zeros(some + len(left))
    ahead, pace = x, 1.0
    for _ in range(steps):
        new = np.maximum(ahead + rate * back(wanted - used(ahead)), 0.0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / faster * (new - x)
        x, pace = new, faster
    return x[:some]


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers whose running sums are those of ``x``, rounded."""
    sums = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
    return np.diff(sums, prepend=0)


@dataclass
class Slot:
    """Texts of one size, ranks ``lo`` to ``hi``: ``n`` to a cell, the first of them the ``skip``-th of its pattern's run."""

    size: int
    lo: int
    hi: int
    n: int
    skip: int
    start: int  # of the run's first cell, in least cells
    width: int  # of a cell
    fitted: bool


def plan_containers(hist: np.ndarray, capacity: int) -> tuple[list[Slot], int, int]:
    """Slots that use the histogram of sizes (0 to ``capacity``) up, least cells of a container, and containers."""
    levels = max(0, (capacity // LEAST_CELL).bit_length() - 1)
    room = 1 << levels
    left, taken = hist.astype(np.int64).copy(), np.zeros(len(hist), dtype=np.int64)
    slots: list[Slot] = []
    at = 0

    def take(size: int, many: int, n: int, skip: int, start: int, width: int, fitted: bool) -> None:
        slots.append(Slot(size, int(taken[size]), int(taken[size] + many), n, skip, start, width, fitted))
        taken[size] += many
        left[size] -= many

    for level in range(levels + 1):
        cell, width = capacity >> level, room >> level
        unit = -(-cell // UNITS)
        units = cell // unit
        bins = -(-np.arange(units * unit + 1) // unit)
        h = np.bincount(bins, weights=left[: len(bins)], minlength=units + 1).astype(np.int64)
        h[0] = 0
        patterns = enumerate_patterns(units)
        patterns = patterns[((h[patterns] > 0) | (patterns == 0)).all(axis=1)]
        if not len(patterns):
            continue
        repeats = rounded(fit_repeats(h, patterns))
        for i in np.flatnonzero(repeats):
            need = [(int(b), int(n)) for b, n in zip(*np.unique(patterns[i], return_counts=True), strict=True) if b]
            times = min([int(repeats[i]), *(int(h[b]) // n for b, n in need)])
            if times <= 0:
                continue
            for b, n in need:
                h[b] -= n * times
                done = 0
                # the largest sizes of a bin first
                for size in range(b * unit, (b - 1) * unit, -1):
                    many = min(int(left[size]), n * times - done)
                    if many:
                        take(size, many, n, done, at, width, True)
                        done += many
            at += times * width
    containers = -(-at // room)
    # the last container may have room for the first of the residual
    spare = (room - at % room) % room * (capacity >> levels)
    while left.any():
        counts: dict[int, int] = {}
        free = spare or capacity
        for size in np.flatnonzero(left)[::-1]:
            fit = min(int(left[size]), free // int(size))
            if fit:
                counts[int(size)] = fit
                free -= fit * int(size)
        if counts:
            base, times = (containers - 1, 1) if spare else (containers, min(int(left[s] // n) for s, n in counts.items()))
            for size, n in counts.items():
                take(size, n * times, n, 0, base * room, room, False)
            containers = max(containers, base + times)
        spare = 0
    return slots, room, containers


def _ranked(items: DataFrame, hist: np.ndarray) -> DataFrame:
    """``rank`` from 0 within ``tokens``, by two levels so that one size may hold most rows."""
    spark = items.sparkSession
    # at most a row per size
    parts = spark.createDataFrame([(int(s), 1 + int(hist[s]) // RANK_ROWS) for s in np.flatnonzero(hist)], "__s long, __parts long")
    cut = items.join(F.broadcast(parts), F.col("tokens") == F.col("__s")).withColumn("__h", F.xxhash64("doc_id", "part"))
    cut = cut.withColumn("__b", F.pmod(F.col("__h"), F.col("__parts"))).drop("__s", "__parts")
    counts = cut.groupBy("tokens", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("tokens").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("tokens").alias("__k"), F.col("__b").alias("__bb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inner = Window.partitionBy("tokens", "__b").orderBy("__h", "doc_id", "part")
    local = cut.withColumn("__r", F.row_number().over(inner) - 1)
    joined = local.join(offsets, (F.col("tokens") == F.col("__k")) & (F.col("__b") == F.col("__bb")))
    return joined.withColumn("rank", F.col("__off") + F.col("__r")).drop("__b", "__bb", "__k", "__r", "__off", "__h")


def pack(docs: DataFrame, capacity: int, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Contents and fill of every container.

    Returns ``container_id BIGINT, doc_id, part INT, n_parts INT, tokens
    BIGINT, placed STRING, fill DOUBLE``: one row per text and container; the
    rows of one container sum up to ``fill`` x ``capacity`` <= ``capacity``.
    ``placed`` tells whether a fitted pattern (``pattern``), the packing of the
    residual (``residual``) or the cut of an oversized text (``whole``) put it
    there. A text is cut (``n_parts > 1``) only if it alone exceeds the
    capacity: its parts but the last are containers by themselves. Null and
    empty texts have no tokens and are in no container. A repeated id is packed
    as often as it comes.
    """
    if capacity < LEAST_CELL:
        raise ValueError(f"capacity must be at least {LEAST_CELL} tokens")
    sized = write_shared(
        with_tokens(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", ["doc_id"], path=path).filter("tokens > 0"),
        "sizes",
    )
    return pack_sized(sized, capacity)


def pack_sized(sized: DataFrame, capacity: int) -> DataFrame:
    """:func:`pack` for rows ``doc_id, tokens``."""
    spark, cap = sized.sparkSession, F.lit(capacity)
    n_parts = F.ceil(F.col("tokens") / cap).cast("int")
    sized = sized.select("doc_id", F.col("tokens").cast("long").alias("tokens"), n_parts.alias("n_parts"))
    whole = sized.filter("n_parts > 1").select("doc_id", "n_parts", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 2)).alias("part"))
    tails = sized.select(
        "doc_id", "n_parts", (F.col("n_parts") - 1).alias("part"), (F.col("tokens") - (F.col("n_parts") - 1) * cap).alias("tokens")
    )
    # at most a row per size comes to the driver
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for row in tails.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        hist[row["tokens"]] = row["n"]
    slots, room, containers = plan_containers(hist, capacity)
    schema = T.StructType(
        [T.StructField(f"s_{n}", T.BooleanType() if n == "fitted" else T.LongType()) for n in Slot.__dataclass_fields__]
    )
    # slots are bounded by the patterns of the levels, whatever the corpus
    table = F.broadcast(spark.createDataFrame([tuple(vars(s).values()) for s in slots], schema))
    on = (F.col("tokens") == F.col("s_size")) & (F.col("rank") >= F.col("s_lo")) & (F.col("rank") < F.col("s_hi"))
    cell = F.floor((F.col("s_skip") + F.col("rank") - F.col("s_lo")) / F.col("s_n"))
    packed = _ranked(tails, hist).join(table, on).select(
        F.floor((F.col("s_start") + cell * F.col("s_width")) / room).alias("container_id"), "doc_id", "part", "n_parts", "tokens",
        F.when(F.col("s_fitted"), "pattern").otherwise("residual").alias("placed"),
    )
    filled = packed.withColumn("fill", F.sum("tokens").over(Window.partitionBy("container_id")) / cap)
    full = whole.select(
        (F.lit(containers) + F.monotonically_increasing_id()).alias("container_id"),
        "doc_id",
        "part",
        "n_parts",
        cap.cast("long").alias("tokens"),
        F.lit("whole").alias("placed"),
        F.lit(1.0).alias("fill"),
    )
    return filled.unionByName(full.select(*filled.columns))
