"""Problem 1: oversized texts become pieces that end at natural boundaries.

A piece may end after a blank, a line feed or an ideographic mark. Dynamic
programming over these positions picks the cuts: a layer per piece, and in each
layer only the positions from which the rest can still be covered. The cost of
a cut is the penalty of its kind (paragraph, line, sentence, clause, word) plus
the squared deviation of the piece from the mean length. Only where a stretch
without any natural position is longer than a piece may grow are extra
positions laid into that stretch, and a cut there is called ``forced``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.plans.sizing import broadcast_if_small

#: The characters after which a piece may end.
NATURAL = " \n。，；"
KINDS = ["paragraph", "line", "sentence", "clause", "space", "forced", "end"]
PENALTY = np.array([0.0, 0.5, 1.0, 2.0, 4.0, 60.0, 0.0], dtype=np.float32)
#: Weight of (length / mean - 1) squared against the penalties.
BALANCE = np.float32(4.0)
_NATURAL = np.array([ord(c) for c in NATURAL], dtype=np.uint32)
_STOPS = np.array([ord(c) for c in ".!?:。！？"], dtype=np.uint32)
_COMMAS = np.array([ord(c) for c in ",;，；、"], dtype=np.uint32)
_FULL_STOP = ord("。")


def natural_positions(code: np.ndarray) -> np.ndarray:
    """Offsets just behind each natural character."""
    mask = code == _NATURAL[0]
    for c in _NATURAL[1:]:
        mask |= code == c
    return np.flatnonzero(mask) + 1


def longest_stretch(n: int, natural: np.ndarray) -> int:
    """Characters in the longest run without a natural character."""
    edges = np.concatenate(([0], natural, [n + 1]))
    return int(np.diff(edges).max() - 1) if len(natural) else n


def candidates(code: np.ndarray, natural: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts inside the text and the kind (index into KINDS) of each."""
    n = len(code)
    at = natural[natural < n]
    if len(at):
        # of a run of natural characters only its end is a candidate
        following = np.isin(code[at], _NATURAL)
        at = at[~following]
    if len(at):
        last = code[at - 1]
        before = np.where(at >= 2, code[np.maximum(at - 2, 0)], 0)
        kind = np.full(len(at), 4, dtype=np.int8)
        blank = last == 32
        kind[np.isin(last, _COMMAS) | (blank & np.isin(before, _COMMAS))] = 3
        kind[(last == _FULL_STOP) | (blank & np.isin(before, _STOPS))] = 2
        line = last == 10
        kind[line] = 1
        kind[line & (before == 10)] = 0
    else:
        kind = np.zeros(0, dtype=np.int8)
    edges = np.concatenate(([0], at, [n]))
    gaps = np.diff(edges)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        apart = max(1, step // 8)
        extra = np.concatenate([np.arange(edges[i] + apart, edges[i + 1], apart) for i in wide])
        kinds = np.where(np.isin(code[extra - 1], _NATURAL), 4, 5).astype(np.int8)
        at, kind = np.concatenate((at, extra)), np.concatenate((kind, kinds))
        order = np.argsort(at, kind="stable")
        at, kind = at[order], kind[order]
    return at, kind


def plan_cuts(n: int, at: np.ndarray, kind: np.ndarray, limit: int, overlap: int) -> tuple[list[int], list[int]]:
    """Ends of the pieces and their kinds: fewest pieces, then least cost."""
    step = limit - overlap
    ends = np.concatenate((at, [n])).astype(np.int64)
    pen = PENALTY[np.concatenate((kind, [6]))]
    forward: list[int] = []  # index of the furthest end that j pieces can reach
    reach = limit
    while True:
        i = int(np.searchsorted(ends, reach, side="right")) - 1
        forward.append(i)
        if ends[i] >= n:
            break
        reach = int(ends[i]) + step
    pieces = len(forward)
    backward = [len(ends) - 1] * pieces  # index of the nearest end from which the rest is covered
    for j in range(pieces - 2, -1, -1):
        backward[j] = int(np.searchsorted(ends, ends[backward[j + 1]] - step, side="left"))
    mean = np.float32(n / pieces)
    previous, cost, back = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.float32), []
    for j in range(pieces):
        lo, hi = backward[j], forward[j]
        here = ends[lo : hi + 1]
        grown = here[None, :] - previous[:, None]
        total = (grown.astype(np.float32) / mean - 1) ** 2 * BALANCE + cost[:, None]
        total[(grown <= 0) | (grown > (limit if j == 0 else step))] = np.inf
        best = total.argmin(axis=0)
        cost = total[best, np.arange(len(here))] + pen[lo : hi + 1]
        back.append((lo, best))
        previous = here
    chosen, k = [], int(cost.argmin())
    for lo, best in reversed(back):
        chosen.append(lo + k)
        k = int(best[k])
    chosen.reverse()
    kinds = np.concatenate((kind, [6]))
    return [int(ends[i]) for i in chosen], [int(kinds[i]) for i in chosen]


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, str]], int]:
    """Pieces as (start, end, kind of cut) and the longest stretch without a natural place."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(code)
    natural = natural_positions(code)
    stretch = longest_stretch(n, natural)
    if n <= limit:
        return [(0, n, "end")], stretch
    overlap = min(max(overlap, 0), limit - 1)
    at, kind = candidates(code, natural, limit - overlap)
    ends, kinds = plan_cuts(n, at, kind, limit, overlap)
    starts = [0] + [max(0, e - overlap) for e in ends[:-1]]
    return [(s, e, KINDS[k]) for s, e, k in zip(starts, ends, kinds, strict=True)], stretch


def split_oversized(
    df: DataFrame,
    limits: DataFrame,
    *,
    id_col: str = "id",
    text_col: str = "response",
    kind_col: str = "subtype",
    default_kind: str = "default",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Pieces of every text longer than the limit of its kind.

    ``limits`` has ``subtype, max_chars, overlap_chars``; its row ``default_kind``
    serves a null or unlisted kind. Returns ``id_col``, the columns ``keep`` and
    ``piece_index, n_pieces, start_char, end_char, piece, cut, longest_stretch,
    max_chars``, characters being code points. Consecutive pieces share exactly
    the overlap (all of the piece before, if that is shorter); no piece exceeds
    the limit, and the pieces without their overlaps give the text again.

    Null and empty texts, texts within the limit and texts without any limit
    (no row, null, or below 1) give no row; a null or negative overlap counts
    as 0, one of at least the limit as the limit less 1. Repeated rows give
    their pieces again; other columns are ignored.
    """
    rules = limits.select(
        F.coalesce(F.col("subtype"), F.lit(default_kind)).alias("__kind"),
        F.col("max_chars").cast("int").alias("__limit"),
        F.coalesce(F.col("overlap_chars").cast("int"), F.lit(0)).alias("__overlap"),
    ).dropDuplicates(["__kind"])
    other = rules.filter(F.col("__kind") == default_kind).first()  # one row, of what serves the kinds that are not listed
    most, shared = (other["__limit"], other["__overlap"]) if other else (None, 0)
    text = df.select(
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
        F.col(kind_col).alias("__of"),
        *[F.col(c).alias(f"__x{i}") for i, c in enumerate(keep)],
    ).filter(F.col("__text").isNotNull())
    ruled = text.join(broadcast_if_small(rules), F.col("__of") == F.col("__kind"), "left")
    listed = F.col("__limit").isNotNull()
    long = (
        ruled.withColumn("__overlap", F.when(listed, F.col("__overlap")).otherwise(F.lit(shared)))
        .withColumn("__limit", F.coalesce("__limit", F.lit(most).cast("int")))
        .filter((F.col("__limit") >= 1) & (F.length("__text") > F.col("__limit")))
        .select("__id", *[f"__x{i}" for i in range(len(keep))], "__text", "__limit", "__overlap")
    )
    carried = [T.StructField("__id", df.schema[id_col].dataType)]
    carried += [T.StructField(f"__x{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType(
        carried
        + [
            T.StructField("piece_index", T.IntegerType()),
            T.StructField("n_pieces", T.IntegerType()),
            T.StructField("start_char", T.IntegerType()),
            T.StructField("end_char", T.IntegerType()),
            T.StructField("piece", T.StringType()),
            T.StructField("cut", T.StringType()),
            T.StructField("longest_stretch", T.IntegerType()),
            T.StructField("max_chars", T.IntegerType()),
        ]
    )
    width = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            out: list[list] = [[] for _ in range(8)]
            texts, limit, overlap = (batch.column(width + i).to_pylist() for i in range(3))
            for r, (t, m, o) in enumerate(zip(texts, limit, overlap, strict=True)):
                parts, stretch = split_text(t, m, o)
                for k, (s, e, cut) in enumerate(parts):
                    rows.append(r)
                    for column, v in zip(out, (k, len(parts), s, e, t[s:e], cut, stretch, m), strict=True):
                        column.append(v)
            take = pa.array(rows, pa.int32())
            kinds = [pa.int32()] * 4 + [pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(take) for i in range(width)]
                + [pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                names=schema.names,
            )

    pieces = long.mapInArrow(run, schema)
    return pieces.withColumnsRenamed({"__id": id_col} | {f"__x{i}": c for i, c in enumerate(keep)})
