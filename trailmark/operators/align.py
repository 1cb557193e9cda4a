"""Order-preserving alignment of steps with text windows, and the scores built on it."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions import text as X
from trailmark.operators.embed import Cached, ConceptEncoder, Encoder, load_encoder
from trailmark.operators.windows import windows_of


#: What the environment may set.
_ENV: dict[str, Any] = {
    "threshold": float, "max_score": float, "max_windows": int, "cache_size": int, "require_trace": lambda v: v.lower() in ("1", "true", "yes"),
    "model": str, "pooling": str, "query_instruction": str, "passage_instruction": str, "max_length": int, "batch": int,
}


@dataclass(frozen=True)
class ScorerConfig:
    """Thresholds and window sizes; the coarse pass uses nine tenths of the threshold."""

    threshold: float = 0.65
    max_score: float = 1.0
    coarse: tuple[int, int] = (128, 64)
    fine: tuple[int, int] = (48, 24)
    max_windows: int = 256
    require_trace: bool = False
    coarse_to_fine: bool = True
    cache_size: int = 8192
    encoder: Encoder = field(default_factory=ConceptEncoder)
    #: Own patterns of evidence for the gate; None for the built-in ones.
    tool_patterns: tuple[str, ...] | None = None
    reasoning_patterns: tuple[str, ...] | None = None

    @property
    def patterns(self) -> dict[str, tuple[str, ...]]:
        """What :func:`trailmark.functions.text.has_trace` takes of them."""
        given = {"tools": self.tool_patterns, "reasoning": self.reasoning_patterns}
        return {k: v for k, v in given.items() if v is not None}

    @classmethod
    def from_env(cls, prefix: str = "TRAILMARK_", legacy: tuple[str, ...] = (), **own: Any) -> ScorerConfig:
        """Defaults from the environment (THRESHOLD, MAX_SCORE, MAX_WINDOWS, REQUIRE_TRACE, CACHE_SIZE, and for an encoder MODEL,
        POOLING, QUERY_INSTRUCTION, PASSAGE_INSTRUCTION, MAX_LENGTH, BATCH); older prefixes serve what the first lacks, arguments win."""
        env = {k: os.environ[p + k.upper()] for p in (*reversed(legacy), prefix) for k in _ENV if p + k.upper() in os.environ}
        got = {k: f(env[k]) for k, f in _ENV.items() if k in env and k in cls.__dataclass_fields__}
        if "model" in env and "encoder" not in own:
            names = {"pooling": "pooling", "query_instruction": "query", "passage_instruction": "passage", "max_length": "max_length", "batch": "batch"}
            encoder = load_encoder(env["model"], **{to: _ENV[k](env[k]) for k, to in names.items() if k in env})
            got |= {"encoder": encoder} if encoder else {}
        return cls(**got | own)


@dataclass
class Alignment:
    path: list[tuple[int, int]]
    match_rate: float
    order_rate: float
    score: float


def align(sim: np.ndarray, threshold: float) -> Alignment:
    """The step-window path of largest summed similarity that keeps the order of both.

    A row of the table is the running maximum over windows of "skip the step" and
    "match it", so it is computed at once; the moves are read off the finished
    rows. A match goes before skipping a window, that before skipping a step.
    """
    steps, windows = sim.shape
    if not steps or not windows:
        return Alignment([], 0.0, 0.0, 0.0)
    sim = sim.astype(np.float32, copy=False)
    gain = np.where(sim >= np.float32(threshold), sim, np.float32(0))
    table = np.zeros((steps + 1, windows + 1), dtype=np.float32)
    for i in range(steps):
        g, above = gain[i], table[i]
        matched = above[:-1] + g
        best = np.where((g > 0) & (matched > above[1:]), matched, above[1:])
        np.maximum.accumulate(best, out=table[i + 1, 1:])
    path, i, j = [], steps, windows
    while i and j:
        g, up, left = gain[i - 1, j - 1], table[i - 1, j], table[i, j - 1]
        diagonal = table[i - 1, j - 1] + g
        if g > 0 and diagonal >= left and diagonal >= up:
            path.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif left >= up:
            j -= 1
        else:
            i -= 1
    path.reverse()
    return Alignment(path, len(path) / steps, pair_order(sim.argmax(1)[sim.max(1) >= np.float32(threshold)]), float(table[-1, -1]))


def pair_order(positions: Any) -> float:
    """Share of pairs in order, ties counting half; 0 for none, 1 for a single position."""
    p = np.asarray(positions)
    if len(p) < 2:
        return float(len(p))
    i, j = np.triu_indices(len(p), 1)
    return float(((p[i] < p[j]) + 0.5 * (p[i] == p[j])).mean())


def similarities(encode, steps: list[list[str]], texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Steps x windows, the best candidate of each step counting; and the candidates' rows."""
    flat = [c for s in steps for c in s]
    vectors = encode([*flat, *texts], ["query"] * len(flat) + ["passage"] * len(texts))
    every = vectors[: len(flat)] @ vectors[len(flat) :].T
    rows, at = [], 0
    for s in steps:
        rows.append(every[at : at + len(s)])
        at += len(s)
    return np.stack([r.max(0) for r in rows]) if rows else np.zeros((0, len(texts)), np.float32), rows


def score_once(encode, response: str, steps: list[list[str]], size: tuple[int, int], threshold: float, config: ScorerConfig) -> dict[str, Any]:
    """One pass at one window size."""
    windows, stats = windows_of(response, *size, config.max_windows)
    out: dict[str, Any] = {
        "score": 0.0, "match_rate": 0.0, "order_rate": 0.0, "matched_steps": [], "unmatched_steps": [" | ".join(s) for s in steps], "path": [],
        "num_windows": stats[2], "windows_downsampled": stats[3], "tail_covered": stats[6], "mean_matched_sim": 0.0, "min_matched_sim": 0.0,
        "mean_margin": 0.0, "alignment_score": 0.0, "threshold": threshold,
    }
    if not steps or not windows:
        return out
    sim, rows = similarities(encode, steps, [w[3] for w in windows])
    a = align(sim, threshold)
    sims, margins, matched = [], [], []
    for i, j in a.path:
        others = np.delete(sim[i], j)
        sims.append(float(sim[i, j]))
        margins.append(max(float(sim[i, j]) - (max(float(others.max()), -1.0) if len(others) else 0.0), 0.0))
        matched.append(steps[i][int(rows[i][:, j].argmax())])
    hit = {i for i, _ in a.path}
    mean = lambda v: sum(v) / len(v) if v else 0.0
    return out | {
        "score": a.match_rate * a.order_rate * config.max_score, "match_rate": a.match_rate, "order_rate": a.order_rate, "matched_steps": matched,
        "unmatched_steps": [" | ".join(s) for i, s in enumerate(steps) if i not in hit], "path": [{"step": i, "win": j} for i, j in a.path],
        "mean_matched_sim": mean(sims), "min_matched_sim": min(sims, default=0.0), "mean_margin": mean(margins), "alignment_score": a.score,
        "best_sims": sim.max(1), "best_windows": sim.argmax(1),
    }


def score_response(encode, response: str, steps: list[list[str]], config: ScorerConfig) -> dict[str, Any]:
    """Coarse windows first; fine ones only where steps are missing, kept if they match no fewer."""
    if not config.coarse_to_fine:
        return score_once(encode, response, steps, config.fine, config.threshold, config) | {"method": "fine"}
    coarse = score_once(encode, response, steps, config.coarse, config.threshold * 0.9, config)
    if coarse["match_rate"] >= 1.0:
        return coarse | {"method": "coarse"}
    fine = score_once(encode, response, steps, config.fine, config.threshold, config)
    return (fine if fine["match_rate"] >= coarse["match_rate"] else coarse) | {"method": "coarse_to_fine"}


def warmed(config: ScorerConfig, responses: list[str], steps: list[list[list[str]]], denied: list[bool]):
    """An encode that has the vectors of all texts of a batch: the encoder sees full micro-batches, each text once."""
    pairs: dict[tuple[str, str], None] = {}
    for r, s, d in zip(responses, steps, denied, strict=True):
        if s and not d:
            pairs |= {("query", c): None for x in s for c in x}
            sizes = [config.coarse, config.fine] if config.coarse_to_fine else [config.fine]
            pairs |= {("passage", w[3]): None for size in sizes for w in windows_of(r, *size, config.max_windows)[0]}
    cached = Cached(config.encoder, max(config.cache_size, len(pairs)))
    cached.encode([t for _, t in pairs], [r for r, _ in pairs])
    return cached.encode


RESULT = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("score", "match_rate", "order_rate")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("matched_steps", "unmatched_steps")]
    + [T.StructField("path", T.ArrayType(T.StructType([T.StructField("step", T.IntegerType()), T.StructField("win", T.IntegerType())])))]
    + [T.StructField("num_windows", T.IntegerType()), T.StructField("windows_downsampled", T.BooleanType()), T.StructField("tail_covered", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in ("mean_matched_sim", "min_matched_sim", "mean_margin", "alignment_score", "threshold")]
    + [T.StructField("method", T.StringType()), T.StructField("trace_denied", T.BooleanType()), T.StructField("encoder", T.StringType())]
)
_ARROW = pa.struct(
    [(n, pa.float64()) for n in ("score", "match_rate", "order_rate")]
    + [(n, pa.list_(pa.string())) for n in ("matched_steps", "unmatched_steps")]
    + [("path", pa.list_(pa.struct([("step", pa.int32()), ("win", pa.int32())])))]
    + [("num_windows", pa.int32()), ("windows_downsampled", pa.bool_()), ("tail_covered", pa.bool_())]
    + [(n, pa.float64()) for n in ("mean_matched_sim", "min_matched_sim", "mean_margin", "alignment_score", "threshold")]
    + [("method", pa.string()), ("trace_denied", pa.bool_()), ("encoder", pa.string())]
)


def score_samples(df: DataFrame, keep: list[str], response: Column, steps: Column, config: ScorerConfig | None = None) -> DataFrame:
    """``keep`` and the struct ``result`` of each row, in one pass without a shuffle.

    ``steps`` are raw steps (arrays of candidates). Null responses count as
    empty; rows without steps or text score 0. With ``require_trace`` a response
    without evidence scores 0 before anything is encoded. Windows, vectors and
    the table exist only inside the batch; texts are encoded once per worker.
    """
    config = config or ScorerConfig()
    clean = X.normalized_steps(steps)
    ready = df.select(*keep, F.coalesce(response, F.lit("")).alias("__r"), clean.alias("__s"))
    denied = ~X.has_trace(F.col("__r"), F.col("__s"), **config.patterns) if config.require_trace else F.lit(False)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("result", RESULT)])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Cached(config.encoder, config.cache_size).encode
        blank = {f: None for f in RESULT.names}
        for batch in batches:
            out = []
            if getattr(config.encoder, "batched", False):
                encode = warmed(config, *(batch.column(k + i).to_pylist() for i in range(3)))
            for r, s, d in zip(*(batch.column(k + i).to_pylist() for i in range(3)), strict=True):
                if d:
                    got = score_once(encode, "", s, config.fine, config.threshold, config) | {"method": "denied"}
                else:
                    got = score_response(encode, r, s, config)
                out.append(blank | {n: got[n] for n in RESULT.names if n in got} | {"trace_denied": d, "encoder": config.encoder.name})
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(k)] + [pa.array(out, _ARROW)], names=schema.names)

    return ready.withColumn("__d", denied).mapInArrow(run, schema)


def best_trajectory(scored: DataFrame, key: str, index: str) -> DataFrame:
    """Per ``key`` the trajectory of best score, match and order; the smaller index wins ties. With all scores' count."""
    rank = F.struct(F.col("result.score"), F.col("result.match_rate"), F.col("result.order_rate"), -F.col(index))
    return scored.groupBy(key).agg(F.max_by(F.col(index), rank).alias("best_index"), F.max("result.score").alias("score"), F.count(F.lit(1)).alias("n_trajectories"))
