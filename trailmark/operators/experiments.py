"""Experiment tables: run matrix, token rewards, episode summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default suite of domains, reward variants and seeds.
DOMAINS = [
    ("code", "SWE-Gym", "SWE-Gym train", "SWE-bench Verified", "resolved_rate", 40),
    ("browser", "BrowserGym", "WebArena train", "WebArena Verified", "task_success_rate", 30),
    ("tool", "BFCL executable sandbox", "BFCL multi-turn train", "BFCL V4 agentic", "overall_accuracy", 20),
]
VARIANTS = [
    ("outcome_only", "none", False, 1.0, 0.0),
    ("linear_terminal", "enumerate", False, 0.5, 0.5),
    ("graph_terminal", "graph", False, 0.5, 0.5),
    ("graph_turn_potential", "graph", True, 0.5, 0.5),
]
SEEDS = [1, 2, 3]


def run_matrix(domains: DataFrame, variants: DataFrame, seeds: DataFrame) -> DataFrame:
    """``domain, ablation, seed``: every planned run; the three tables hold a handful of rows each."""
    if domains.count() != 3 or domains.select("domain").distinct().count() != 3:
        raise ValueError("a suite has three different domains")
    if not seeds.limit(1).count():
        raise ValueError("a suite has at least one seed")
    one = lambda df, c: df.select(c).coalesce(1)
    return one(domains, "domain").crossJoin(one(variants, "ablation")).crossJoin(one(seeds, "seed"))


def default_suite(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        spark.createDataFrame(DOMAINS, "domain string, environment string, train_split string, evaluation_split string, primary_metric string, max_turns int"),
        spark.createDataFrame(VARIANTS, "ablation string, alignment_mode string, turn_potential boolean, outcome_weight double, process_weight double"),
        spark.createDataFrame([(s,) for s in SEEDS], "seed int"),
    )


def token_rewards(length: Column, ends: Column, rewards: Column) -> Column:
    """An array of ``length`` zeros with each turn's reward on the turn's last token.

    Ends must be as many as rewards, strictly increasing and within the length.
    """
    n = F.size(ends)
    rising = F.forall(F.zip_with(F.slice(ends, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ends, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] < x["b"])
    fits = (length > 0) & (n == F.size(rewards)) & F.forall(ends, lambda e: (e >= 0) & (e < length)) & rising
    at = F.map_from_arrays(ends.cast("array<int>"), rewards.cast("array<double>"))
    return F.when(fits, F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.coalesce(at[i], F.lit(0.0)))).otherwise(F.raise_error("turn boundaries do not fit").cast("array<double>"))


def episode_summary(episodes: DataFrame) -> DataFrame:
    """Eight statistics per domain, ablation and seed."""
    return episodes.groupBy("domain", "ablation", "seed").agg(
        F.count(F.lit(1)).alias("episodes"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("outcome_reward").alias("mean_outcome_reward"),
        F.avg("process_reward").alias("mean_process_reward"), F.avg("total_reward").alias("mean_total_reward"), F.avg("turns").alias("mean_turns"),
        F.avg((F.col("invalid_transitions") > 0).cast("double")).alias("invalid_transition_rate"), F.avg("wall_time_seconds").alias("mean_wall_time_seconds"),
    )


#: What the nodes of a layered workflow ask for: on the path that is taken, and beside it.
TAKEN = ["reproduce the reported crash", "narrow the search to one module", "rewrite the guilty branch", "run the regression suite", "compare both traces"]
BESIDE = ["translate the manual", "rotate the access keys", "plan the next sprint", "resize the cluster", "archive old tickets"]


def layered_workflow(branches: int, layers: int, name: str = "layered") -> tuple[dict, str]:
    """A workflow of full layers between a start and an end, and a response that follows its first branch.

    It has branches ** layers terminal paths; benchmarks hold alignment along
    the graph against trying them all.
    """
    if branches < 2 or layers < 1:
        raise ValueError("a layered workflow has at least two branches and one layer")
    node = lambda i, action: {"id": i, "action": [action], "stage": "default", "required": True, "evidence": None, "outcome": None, "weight": 1.0, "max_visits": 1,
                              "preconditions": None, "postconditions": None}
    grid = [[f"l{y}b{x}" for x in range(branches)] for y in range(layers)]
    levels = [["start"], *grid, ["done"]]
    text = {"start": "read the report", "done": "close the report"}
    text |= {i: f"{(BESIDE if x else TAKEN)[(x + y) % 5]} in round {y}" for y, row in enumerate(grid) for x, i in enumerate(row)}
    edges = [{"source": a, "target": b, "kind": "alternative" if b != "done" else "forward", "max_traversals": 1} for up, down in zip(levels, levels[1:], strict=False) for a in up for b in down]
    spec = {"name": name, "nodes": [node(i, text[i]) for row in levels for i in row], "edges": edges, "start": "start", "terminals": ["done"], "stage_weights": {}}
    return spec, " Some other words stand here and tell nothing. ".join(f"{text[row[0]]}." for row in levels)


def stage_timings(steps: int = 5, repeats: int = 128, rounds: int = 20) -> dict[str, float]:
    """Milliseconds of each stage of scoring one long response: windows, vectors (first time and kept), product, path; and of graph against paths."""
    import json
    import time

    from trailmark.operators import align, embed, windows, workflow

    text = "the module was patched and its checks pass again. " * repeats
    asked = [[f"check the module {i}"] for i in range(steps)]
    config, out = align.ScorerConfig(), {}

    def timed(name: str, call):
        began = time.perf_counter()
        for _ in range(rounds):
            got = call()
        out[name] = round((time.perf_counter() - began) * 1000 / rounds, 3)
        return got

    found, _ = timed("ms_windows", lambda: windows.windows_of(text, *config.coarse, config.max_windows))
    texts, cached = [w[3] for w in found], embed.Cached(embed.NgramEncoder())
    timed("ms_encode_cold", lambda: embed.Cached(embed.NgramEncoder()).encode(texts))
    cached.encode(texts)
    timed("ms_encode_warm", lambda: cached.encode(texts))
    sim, _ = timed("ms_product", lambda: align.similarities(cached.encode, asked, texts))
    timed("ms_path", lambda: align.align(sim, config.threshold))
    spec, response = layered_workflow(2, 5)
    for mode in ("graph", "enumerate"):
        own = workflow.WorkflowConfig(mode=mode)
        timed(f"ms_{mode}", lambda own=own: workflow.score_workflow(cached.encode, json.dumps(spec), response, {}, config, own))
    return out
