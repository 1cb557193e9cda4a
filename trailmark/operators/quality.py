"""Quality of scores on labelled rows: ranking, threshold, pairs, subtypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.sequences import running

#: Width of the ranges of scores in which prefix sums run first.
RANGE = 1 / 65_536


def _histogram(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score: the only rows that ranking metrics need."""
    rows = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    return rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))


def ranking(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``count, positives, negatives, auroc, average_precision``; equal scores count half or share a precision.

    The pairs of positives and negatives are counted from prefix sums over the
    distinct scores, by ranges of scores first, so no pair is formed and no
    task sees all scores.
    """
    hist = _histogram(df, score, label)
    per = hist.withColumn("all", F.lit(0))
    below = running(running(per, ["all"], "s", "n_upto", "sum", F.col("n"), chunk=RANGE), ["all"], "s", "p_upto", "sum", F.col("p"), chunk=RANGE)
    total = per.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    joined = below.join(F.broadcast(total))  # one row
    above_p, above = F.col("all_p") - F.col("p_upto") + F.col("p"), F.col("all_p") + F.col("all_n") - F.col("p_upto") - F.col("n_upto") + F.col("p") + F.col("n")
    out = joined.agg(
        F.max("all_p").alias("positives"),
        F.max("all_n").alias("negatives"),
        F.sum(F.col("p") * (F.col("n_upto") - F.col("n") + F.col("n") / 2)).alias("wins"),
        F.sum(F.col("p") * above_p / above).alias("precision"),
    )
    positives, negatives = F.coalesce("positives", F.lit(0)), F.coalesce("negatives", F.lit(0))
    return out.select(
        (positives + negatives).alias("count"), positives.alias("positives"), negatives.alias("negatives"),
        F.when((positives > 0) & (negatives > 0), F.col("wins") / (positives.cast("double") * negatives)).alias("auroc"),
        F.when(positives > 0, F.col("precision") / positives).alias("average_precision"),
    )


def threshold_metrics(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Means, separation, accuracy and rates at a threshold; means of an empty class are 0, rates null."""
    s, pos, neg = F.col(score).cast("double"), F.col(label) == 1, F.col(label) == 0
    hit = (s >= threshold).cast("double")
    rows = df.filter(F.col(label).isin(0, 1))
    mean = lambda c: F.coalesce(F.avg(F.when(c, s)), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("count"), mean(pos).alias("positive_mean"), mean(neg).alias("negative_mean"), (mean(pos) - mean(neg)).alias("mean_separation"),
        F.avg(((s >= threshold) == pos).cast("double")).alias("accuracy"), F.avg(F.when(pos, hit)).alias("true_positive_rate"), F.avg(F.when(neg, hit)).alias("false_positive_rate"),
    )


def pairwise(df: DataFrame, group: str = "pair_id", score: str = "score", label: str = "label") -> DataFrame:
    """``groups, comparisons, accuracy`` over the positive-negative pairs within a group; ties count half.

    Pairs are counted from the distinct scores of a group, positives against the
    negatives below, so a group of any size forms no pairs.
    """
    rows = df.filter(F.col(label).isin(0, 1) & F.col(group).isNotNull() & (F.col(group) != ""))
    hist = rows.groupBy(F.col(group).alias("g"), F.col(score).cast("double").alias("s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n")
    )
    below = running(hist, ["g"], "s", "n_upto", "sum", F.col("n"), chunk=RANGE)
    per = below.groupBy("g").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("n_upto") - F.col("n") / 2)).alias("wins")).filter("p > 0 and n > 0")
    done = per.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("p") * F.col("n")), F.lit(0)).alias("comparisons"), F.sum("wins").alias("wins"))
    return done.select("groups", "comparisons", F.when(F.col("comparisons") > 0, F.col("wins") / F.col("comparisons")).alias("accuracy"))


def by_subtype(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Nine measures per subtype of rows with ``score, trusted_score, confidence, fallback, label``; null subtypes are ``unspecified``."""
    pos, neg = F.col("label") == 1, F.col("label") == 0
    rate = lambda who, c: F.avg(F.when(who, c.cast("double")))
    return df.groupBy(F.coalesce("subtype", F.lit("unspecified")).alias("subtype")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("score").alias("mean_score"), F.avg("trusted_score").alias("mean_trusted_score"), F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("fallback").cast("double")).alias("fallback_rate"),
        rate(neg, F.col("score") >= threshold).alias("semantic_false_accept_rate"), rate(neg, F.col("trusted_score") >= threshold).alias("routed_false_accept_rate"),
        rate(pos, F.col("score") < threshold).alias("semantic_false_reject_rate"), rate(pos, F.col("trusted_score") < threshold).alias("routed_false_reject_rate"),
    )


def report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``block, metric, value``: the whole report, in order.

    ``df`` has ``score, trusted_score, lexical_score, fallback, trace_denied,
    label, subtype, pair_id, confidence``. Blocks: the dataset, ranking and
    threshold measures and pairwise accuracy of the three scores, the routing
    rates, and each subtype.
    """
    def long(block: Column, row: DataFrame, names: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        return row.select(block.alias("block"), F.explode(pairs).alias("x")).select("block", "x.*")

    pos, neg = F.col("label") == 1, F.col("label") == 0
    rate = lambda who, c: F.coalesce(F.avg(F.when(who, F.col(c).cast("double"))), F.lit(0.0))
    dataset = df.agg(F.count(F.lit(1)).alias("count"), F.count(F.when(pos | neg, 1)).alias("labeled"), F.count(F.when(pos, 1)).alias("positives"), F.count(F.when(neg, 1)).alias("negatives"))
    routing = df.agg(
        rate(pos, "fallback").alias("positive_fallback_rate"), rate(neg, "fallback").alias("negative_fallback_rate"),
        rate(pos, "trace_denied").alias("positive_trace_denial_rate"), rate(neg, "trace_denied").alias("negative_trace_denial_rate"),
    )
    parts = [long(F.lit("dataset"), dataset, dataset.columns), long(F.lit("routing"), routing, routing.columns)]
    for name, score in (("semantic", "score"), ("routed", "trusted_score"), ("lexical", "lexical_score")):
        ranked, at = ranking(df, score), threshold_metrics(df, score, threshold=threshold)
        parts += [long(F.lit(name), ranked, ["auroc", "average_precision"]), long(F.lit(name), at, at.columns[1:])]
        pairs = pairwise(df, score=score)
        parts.append(long(F.lit(f"{name}_pairwise"), pairs, pairs.columns))
    per = by_subtype(df, threshold)
    parts.append(long(F.concat(F.lit("subtype:"), F.col("subtype")), per, per.columns[1:]))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.orderBy("block", "metric")


def denied_steps(free: Column, gated: Column, steps: Column) -> Column:
    """``step, label`` of the steps on the path of one result that are not on that of another."""
    on = lambda result: F.transform(result["path"], lambda p: p["step"])
    lost = F.array_sort(F.array_except(on(free), on(gated)))
    return F.transform(lost, lambda i: F.struct(i.alias("step"), F.array_join(F.get(steps, i), " | ").alias("label")))
