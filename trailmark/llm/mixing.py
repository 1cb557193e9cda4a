"""Problem 7: sources are mixed to target shares of a token budget.

The weights of a mix lie on the line from its targets to the sources' own token
shares: w(e) is proportional to target^(1 - e) x share^e. At e = 0 the targets
hold exactly, and a mix whose targets are all within the repetition limits is
drawn with them. Otherwise the exponent is bisected until every source is
within its limit, so that the mix still reaches its total. If even the sources'
own shares ask for too much, what is beyond a limit goes to the sources that
have room, by their weights. Weights become budgets, budgets become whole passes
over a source's permutation of blocks plus its beginning up to the remaining
tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.tokens import with_tokens
from trailmark.plans.shared import write_shared
from trailmark.plans.sizing import broadcast_if_small

#: Rows of a mix table that may come to the driver.
MAX_TARGETS = 10_000
#: Documents in a block of a source's permutation, about.
BLOCK_ROWS = 50_000


def tempered(targets: list[float], shares: list[float], e: float) -> list[float]:
    """Normalised weights target^(1-e) x share^e; sources without tokens get none."""
    raw = [t ** (1 - e) * s**e if t > 0 and s > 0 else 0.0 for t, s in zip(targets, shares, strict=True)]
    total = sum(raw)
    return [r / total if total else 0.0 for r in raw]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect_exponent(ok, *, steps: int = 50) -> float | None:
    """Least e in [0, 1] for which ``ok(e)`` holds, if it holds at 1 and is monotone."""
    if ok(0.0):
        return 0.0
    if not ok(1.0):
        return None
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def temperature_for_entropy(shares: list[float], wanted: float) -> float:
    """Exponent a in [0, 8] for which shares^a, normalised, have the wanted entropy."""
    lo, hi = 0.0, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        raw = [s**mid if s > 0 else 0.0 for s in shares]
        total = sum(raw) or 1.0
        if entropy([r / total for r in raw]) > wanted:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def within_limits(weights: list[float], total: float, limits: list[float]) -> list[float]:
    """Tokens per source: ``total`` by weight, what is beyond a limit going to the others by their weights.

    Less than ``total`` comes out only if all sources with a weight are at their limits.
    """
    got, free = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0]
    left = total
    while free and left > 1e-9:
        scale = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * scale > limits[i]]
        for i in full or free:
            got[i] = limits[i] if full else weights[i] * scale
            left -= got[i]
        free = [i for i in free if i not in full] if full else []
    return got


def plan_mix(rows: list[tuple[str, float, float, int]], sizes: dict[str, int], total: int) -> list[dict]:
    """Budgets of one mix; rows are (source, total_ratio, target_share, max_repeats)."""
    targets = [max(0.0, share or 0.0) for _, _, share, _ in rows]
    own = [float(sizes.get(source, 0)) for source, *_ in rows]
    mix = [(ratio or 0.0) * total for _, ratio, _, _ in rows]
    limits = [max(0, repeats or 0) * n for (_, _, _, repeats), n in zip(rows, own, strict=True)]
    share_sum, asked = sum(own) or 1.0, sum(t * b for t, b in zip(targets, mix, strict=True))
    shares = [n / share_sum for n in own]
    within = lambda e: all(w * asked <= m + 1e-6 for w, m in zip(tempered(targets, shares, e), limits, strict=True))
    reachable = [m >= t * b for t, b, m in zip(targets, mix, limits, strict=True)]
    exponent = 0.0 if all(reachable) else bisect_exponent(within)
    weights = [t * b / (asked or 1.0) for t, b in zip(targets, mix, strict=True)] if exponent == 0.0 else tempered(targets, shares, 1.0 if exponent is None else exponent)
    budgets = within_limits(weights, asked, limits)
    warm = temperature_for_entropy(shares, entropy([t / (sum(targets) or 1.0) for t in targets]))
    return [
        {
            "source": source, "target_share": t, "source_tokens": int(n), "mix_tokens": b, "wanted_tokens": t * b,
            "limit_tokens": float(m), "reachable": ok, "planned_share": got / b if b else 0.0, "budget": got, "max_repeats": int(r or 0),
            "limit_exponent": exponent, "entropy_exponent": warm,
        }
        for (source, _, _, r), t, n, b, m, ok, got in zip(rows, targets, own, mix, limits, reachable, budgets, strict=True)
    ]


def _planned(sized: DataFrame, targets: DataFrame) -> list[dict]:
    per = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.when(F.col("tokens") > 0, 1)).alias("docs"))
    per = write_shared(per, "totals")
    total = per.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    rows = targets.select("mix_id", "source", "total_ratio", "target_share", "max_repeats").distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    # at most as many sources as there are targets
    known = {r["source"]: r for r in per.join(broadcast_if_small(targets.select("source").distinct()), "source", "left_semi").collect()}
    sizes = {source: r["tokens"] for source, r in known.items()}
    out = []
    for mix in sorted({r["mix_id"] for r in rows if r["mix_id"] is not None}):
        own = sorted((r["source"], r["total_ratio"], r["target_share"], r["max_repeats"]) for r in rows if r["mix_id"] == mix and r["source"] is not None)
        blocks = lambda source: 1 + known[source]["docs"] // BLOCK_ROWS if source in known else 1
        out += [{"mix_id": mix, "blocks": blocks(p["source"])} | p for p in plan_mix(own, sizes, total)]
    return out


_PLAN = T.StructType(
    [T.StructField("mix_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()),
     T.StructField("source_tokens", T.LongType()), T.StructField("mix_tokens", T.DoubleType()), T.StructField("wanted_tokens", T.DoubleType()),
     T.StructField("limit_tokens", T.DoubleType()), T.StructField("reachable", T.BooleanType()), T.StructField("planned_share", T.DoubleType()),
     T.StructField("budget", T.DoubleType()), T.StructField("max_repeats", T.IntegerType()), T.StructField("limit_exponent", T.DoubleType()),
     T.StructField("entropy_exponent", T.DoubleType()), T.StructField("blocks", T.LongType())]
)


def sized_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str | None = None) -> DataFrame:
    """``doc_id, source, tokens`` of every document, written once to the shared folder."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return write_shared(with_tokens(named, "text", ["doc_id", "source"], path=path), "sources")


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: sizes, whether it is reachable, the planned share and budget, and the exponents.

    ``sized`` is :func:`sized_sources`; ``targets`` has ``mix_id, total_ratio,
    source, target_share, max_repeats``. A mix's total is ``total_ratio`` times
    the tokens of all documents, those without a source included. A source
    without documents is unreachable unless its target is 0; null shares,
    ratios and repeats count as 0, targets without a mix or source give no row.
    ``limit_exponent`` is 0 where the targets hold, null where no exponent
    keeps all sources within their limits.
    """
    return sized.sparkSession.createDataFrame(_planned(sized, targets), _PLAN)


def draw_mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``mix_id, source, doc_id, repeats, tokens`` of every chosen document; ``plan`` is :func:`mix_plan`.

    A source's documents are in an order fixed by their hash. Its budget is
    spent on whole passes, then on the documents from the beginning up to the
    one after which the tokens are nearest to the budget. Prefix sums run over
    blocks of the permutation first and rows within their block, blocks being
    as many as the source's documents need, so a source of a third of all rows
    is many tasks' work. Documents without tokens are not drawn.
    """
    plan = plan.filter("budget > 0 and source_tokens > 0").select("mix_id", F.col("source").alias("ps"), "budget", "source_tokens", "max_repeats", "blocks")
    own = F.broadcast(plan.select("ps", "blocks").distinct())  # at most MAX_TARGETS rows
    docs = sized.filter("tokens > 0").join(own, F.col("source") == F.col("ps")).drop("ps")
    docs = docs.withColumn("h", F.xxhash64("doc_id")).withColumn("block", F.pmod(F.shiftright("h", 16), F.col("blocks"))).drop("blocks")
    sums = docs.groupBy("source", "block").agg(F.sum("tokens").alias("bt"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        docs.withColumn("inner", F.sum("tokens").over(within))
        .join(starts, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b")))
        .select("doc_id", "source", "tokens", (F.col("start") + F.col("inner")).alias("end"))
    )
    passes = F.floor(F.col("budget") / F.col("source_tokens"))
    rest = F.col("budget") - passes * F.col("source_tokens")
    repeats = F.least(passes + F.when(F.col("end") - F.col("tokens") / 2 <= rest, 1).otherwise(0), F.col("max_repeats")).cast("int")
    return (
        placed.join(F.broadcast(plan.drop("blocks")), F.col("source") == F.col("ps"))
        .select("mix_id", "source", "doc_id", repeats.alias("repeats"), "tokens")
        .filter("repeats > 0")
    )


def reached_shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """``mix_id, source, target_share, planned_share, reached_share, drawn_tokens, n_docs, max_repeats_used, reachable, limit_exponent, entropy_exponent``."""
    got = drawn.groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("max_repeats_used")
    )
    out = plan.join(got, ["mix_id", "source"], "left")
    share = F.coalesce(F.col("drawn_tokens") / F.col("mix_tokens"), F.lit(0.0))
    return out.select(
        "mix_id", "source", "target_share", "planned_share", share.alias("reached_share"), F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("max_repeats_used", F.lit(0)).alias("max_repeats_used"),
        "reachable", "limit_exponent", "entropy_exponent",
    )
