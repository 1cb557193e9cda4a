"""How far a score can be trusted, and when a judge should decide: columns only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import text as X


@dataclass(frozen=True)
class RoutingConfig:
    """The default limits of routing."""

    min_match_rate: float = 0.5
    min_order_rate: float = 0.25
    min_mean_matched_sim: float = 0.58
    min_margin: float = 0.0
    max_unmatched_steps: int = 1
    min_confidence: float = 0.5
    proxy_step_fraction: float = 0.6
    max_intention_recitation_fraction: float = 0.5
    high_match_rate: float = 0.95
    require_trace_when_high_match: bool = True
    #: Own patterns of evidence, as arguments of :func:`trailmark.functions.text.has_trace`.
    patterns: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def assess(df: DataFrame, result: str, response: str, raw_steps: str, out: str, config: RoutingConfig | None = None) -> DataFrame:
    """Add the struct ``out``: ``confidence, fallback, reasons, proxy_fraction, intention_fraction, has_trace``.

    ``result`` is the struct of :func:`trailmark.operators.align.score_samples`
    (or one with its rates, matched similarities and unmatched steps);
    ``raw_steps`` are the row's steps as given. Expensive parts are columns of
    their own, so that no pattern is searched twice.
    """
    c = config or RoutingConfig()
    text = F.coalesce(F.col(response), F.lit(""))
    staged = df.withColumn("__steps", X.normalized_steps(F.col(raw_steps))).withColumn(
        "__tiers", F.transform(F.coalesce(F.col(raw_steps), F.array().cast("array<array<string>>")), X.candidates_tier)
    )
    staged = staged.withColumn("__told", X.intention_fraction(F.col(response), F.col("__steps"))).withColumn(
        "__traced", F.when((text != "") & F.lit(c.require_trace_when_high_match), X.has_trace(F.col(response), F.col("__steps"), **c.patterns))
    )
    staged = staged.withColumn("__proxy", F.size(F.filter("__tiers", lambda t: t == "proxy")) / F.greatest(F.size("__steps"), F.lit(1)))
    r, told, traced, proxy = F.col(result), F.col("__told"), F.col("__traced"), F.col("__proxy")
    match, order = r["match_rate"], r["order_rate"]
    sim, margin, missing = r["mean_matched_sim"], r["mean_margin"], F.size(r["unmatched_steps"])
    bonus = F.when(traced, 0.08).when((~traced) & (match >= 0.8), -0.15).otherwise(0.0)
    staged = staged.withColumn(
        "__conf",
        X.clamp01(0.35 * match + 0.20 * order + 0.25 * X.clamp01(sim) + 0.10 * X.clamp01(margin / 0.05) + 0.10 * (1.0 - proxy) + bonus - 0.25 * told),
    )
    confidence = F.col("__conf")
    reasons = [
        F.when(match < c.min_match_rate, F.concat(F.lit("low_match_rate ("), _two(match), F.lit(f" < {c.min_match_rate})"))),
        F.when(order < c.min_order_rate, F.concat(F.lit("low_order_rate ("), _two(order), F.lit(f" < {c.min_order_rate})"))),
        F.when(missing > c.max_unmatched_steps, F.concat(F.lit("too_many_unmatched ("), missing.cast("string"), F.lit(f" > {c.max_unmatched_steps})"))),
        F.when((sim != 0) & (sim < c.min_mean_matched_sim), F.concat(F.lit("weak_mean_sim ("), _two(sim), F.lit(f" < {c.min_mean_matched_sim})"))),
        F.when(F.lit(c.min_margin > 0) & (margin != 0) & (margin < c.min_margin), F.concat(F.lit("low_margin ("), F.format_string("%.3f", margin), F.lit(f" < {c.min_margin})"))),
        F.when(proxy >= c.proxy_step_fraction, F.concat(F.lit("high_proxy_step_fraction ("), _two(proxy), F.lit(")"))),
        F.when(told >= c.max_intention_recitation_fraction, F.concat(F.lit("intention_step_recitation ("), _two(told), F.lit(f" >= {c.max_intention_recitation_fraction:.2f})"))),
        F.when((match >= c.high_match_rate) & F.coalesce(~traced, F.lit(False)), F.lit("high_match_without_execution_trace")),
        F.when(confidence < c.min_confidence, F.concat(F.lit("low_confidence ("), _two(confidence), F.lit(f" < {c.min_confidence})"))),
    ]
    denied = F.coalesce(r["trace_denied"], F.lit(False))
    staged = staged.withColumn("__found", F.when(denied, F.array(F.lit("trace_gate_denied"))).otherwise(F.array_compact(F.array(*reasons))))
    whole = F.struct(
        F.when(denied, 0.0).otherwise(confidence).alias("confidence"), (F.size("__found") > 0).alias("fallback"), F.col("__found").alias("reasons"),
        proxy.alias("proxy_fraction"), told.alias("intention_fraction"), traced.alias("has_trace"),
    )
    return staged.withColumn(out, whole).drop("__steps", "__tiers", "__told", "__traced", "__proxy", "__conf", "__found")
