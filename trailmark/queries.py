"""The queries over the project tables. Their SQL is in :mod:`trailmark.sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.api import compute_scores
from trailmark.functions import text as X
from trailmark.functions.payloads import DIRECT_PATHS, NESTED_PATHS, redact_json, resolver
from trailmark.functions.tools import Call, handler_name, semantics
from trailmark.operators import align, embed, events, experiments, quality, traces, windows
from trailmark.operators import workflow as wf
from trailmark.operators.confidence import assess
from trailmark.operators.sequences import in_parts, running
from trailmark.plans.delivery import latest_delivery
from trailmark.plans.shared import write_shared
from trailmark.plans.sizing import broadcast_if_small, spread
from trailmark.sources.readers import read_rlvr
from trailmark.sql import SQL as _SQL
from trailmark.streaming import traces as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CONCEPT_SCORER = align.ScorerConfig(threshold=0.45)
#: The workflow that the samples of a domain follow.
DOMAIN_WORKFLOW = {"defect": "defect_loop", "browser": "web_booking", "research": "literature_scan", "datafix": "table_repair", "release": "release_train"}
#: More windows than any text has.
NO_CAP = 2**31 - 1
#: For rendered attempts, which may be long.
ATTEMPT_SCORER = align.ScorerConfig(threshold=0.6, max_windows=NO_CAP, encoder=embed.NgramEncoder())


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return latest_delivery(spread(read(spark, folder, "demo_samples")), ["id"], "ingested_at")


def with_steps(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder).withColumn("steps", X.normalized_steps(F.col("reference_steps")))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# -------------------------------------------------------------------- steps


@query
def normalize_steps(spark, folder):
    rows = with_steps(spark, folder).select("id", F.posexplode("steps").alias("step_index", "step"))
    return rows.select("id", "step_index", X.step_label(F.col("step")).alias("label"), F.size("step").alias("n_candidates"))


@query
def resolve_steps(spark, folder):
    rows = read_rlvr(spark, f"{folder}/rlvr_rows.parquet")
    got = rows.select("row_id", resolver()(F.col("extra_info"), F.col("ground_truth")).alias("r"))
    labels = F.array_join(F.transform("r.steps", X.step_label), " || ")
    return got.select("row_id", F.col("r.source").alias("source"), F.size("r.steps").cast("long").alias("n_steps"), labels.alias("labels"))


@query
def classify_steps(spark, folder):
    rows = samples(spark, folder).select("id", F.posexplode("reference_steps").alias("step_index", "step"))
    kept = F.filter(F.coalesce("step", F.array().cast("array<string>")), lambda c: X.strip(c) != "")
    return rows.select("id", "step_index", X.candidates_tier(kept).alias("tier"))


@query
def label_coercion(spark, folder):
    """Labels in all their spellings, read back."""
    spelled = F.array(*map(F.lit, ["1", "true", "Positive", "GENUINE"])), F.array(*map(F.lit, ["0", "False", "negative", "hard_negative"]))
    at = F.pmod(F.crc32("id"), F.lit(4)).cast("int") + 1
    text = F.when(F.col("label") == 1, F.element_at(spelled[0], at)).when(F.col("label") == 0, F.element_at(spelled[1], at))
    return samples(spark, folder).select("id", X.coerced_label(text).alias("label"))


@query
def resolve_paths(spark, folder):
    """Steps at each place where a row may hold them, one place to a row in turn."""
    rows = read_rlvr(spark, f"{folder}/rlvr_rows.parquet").select("row_id")
    steps = F.format_string('["open %d", {"action": "close %d"}]', "row_id", "row_id")
    extra = F.lit(None).cast("string")
    for k, path in enumerate([*DIRECT_PATHS, *NESTED_PATHS]):
        parts = path.split(".")
        text = F.concat(F.lit("".join(f'{{"{p}": ' for p in parts)), steps, F.lit("}" * len(parts)))
        extra = F.when(F.col("row_id") % 11 == k, text).otherwise(extra)
    got = rows.select("row_id", resolver()(extra, F.lit("a plain answer")).alias("r"))
    return got.select("row_id", F.col("r.source").alias("source"), F.array_join(F.transform("r.steps", X.step_label), " || ").alias("labels"))


# ------------------------------------------------------------------ windows


def _windows(spark, folder, window=48, stride=24, cap=256):
    return windows.with_windows(samples(spark, folder), "response", ["id"], window=window, stride=stride, max_windows=cap)


@query
def sliding_windows(spark, folder):
    w = _windows(spark, folder).select("id", F.explode("windows").alias("w"))
    return w.select("id", F.col("w.idx").alias("win"), F.col("w.start").alias("start_char"), F.col("w.end").alias("end_char"), F.md5("w.text").alias("text_md5"))


@query
def window_coverage(spark, folder):
    w = _windows(spark, folder, 128, 64, 32)
    return w.select("id", "stats.input_chars", "stats.candidate_windows", "stats.num_windows", "stats.windows_downsampled", "stats.covered_chars",
                    r6("stats.coverage_rate").alias("coverage_rate"), "stats.tail_covered")


@query
def window_downsample(spark, folder):
    w = _windows(spark, folder, cap=8).select("id", F.posexplode("windows").alias("slot", "w"))
    return w.select("id", "slot", F.col("w.idx").alias("win"))


@query
def passage_windows(spark, folder):
    return windows.passages(samples(spark, folder).filter("response is not null"), "id", F.split("response", "\n"))


# ------------------------------------------------------------- similarities


@query
def cosine_matrix(spark, folder):
    """The query vectors, of which the id is divisible by 100, against all vectors."""
    rows = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return embed.cosines(rows.filter("vec_id % 100 = 0"), rows).withColumn("cosine", F.round("cosine", 5))


def _asked_texts(spark, folder):
    """All texts by role: steps are queries; all coarse and fine windows of the responses, none thinned out, are passages."""
    rows = with_steps(spark, folder).select("steps", "response")
    for name, (window, stride) in (("coarse", CONCEPT_SCORER.coarse), ("fine", CONCEPT_SCORER.fine)):
        rows = windows.with_windows(rows, "response", rows.columns, window=window, stride=stride, max_windows=NO_CAP).withColumnRenamed("windows", name).drop("stats")
    of = lambda role, texts: F.transform(texts, lambda t: F.struct(F.lit(role).alias("role"), t.alias("text")))
    every = F.concat(of("query", F.flatten("steps")), of("passage", F.col("coarse.text")), of("passage", F.col("fine.text")))
    return rows.select(F.explode(every).alias("x")).select("x.*")


@query
def embed_distinct(spark, folder):
    """Distinct texts by role, encoded once: what a model would have to encode."""
    encoded = embed.encode_texts(_asked_texts(spark, folder), embed.ConceptEncoder())
    return encoded.select("role", F.md5("text").alias("text_md5"), F.round(embed.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared_norm"))


@query
def encoding_stats(spark, folder):
    """What deduplication saves the encoder."""
    return embed.cache_stats(_asked_texts(spark, folder)).withColumn("hit_rate", r6("hit_rate"))


@query
def embedding_lookup(spark, folder):
    """Every candidate of every step with its vector, which is encoded once per different text."""
    rows = with_steps(spark, folder).select("id", F.posexplode("steps").alias("step", "c")).select("id", "step", F.posexplode("c").alias("candidate", "text"), F.lit("query").alias("role"))
    found = embed.looked_up(rows, embed.encode_texts(rows, embed.ConceptEncoder()))
    return found.select("id", "step", "candidate", F.size(F.filter("embedding", lambda x: x != 0)).alias("n_concepts"))


def _sims(spark, folder):
    """Per sample the windows' concept masks, and each step's candidates' masks; no shuffle beyond deduplication."""
    e = embed.ConceptEncoder()
    rows = windows.with_windows(with_steps(spark, folder), "response", ["id", "steps"])
    masked = rows.select(
        "id",
        F.transform("windows", lambda w: e.mask(w["text"])).alias("wm"),
        F.transform("windows", lambda w: w["idx"]).alias("wi"),
        F.transform("steps", lambda s: F.transform(s, e.mask)).alias("sm"),
    )
    best = lambda cands, w: F.aggregate(F.transform(cands, lambda c: embed.mask_cosine(c, w)), F.lit(-1.0), lambda a, b: F.greatest(a, b))
    return masked.select("id", "wi", F.posexplode("sm").alias("step", "cands"), "wm").select(
        "id", "step", "wi", F.transform("wm", lambda w: best(F.col("cands"), w)).alias("sims")
    )


@query
def candidate_max(spark, folder):
    return _sims(spark, folder).select("id", "step", F.posexplode("sims").alias("win", "sim")).select("id", "step", "win", r6("sim").alias("sim"))


def _best(spark, folder):
    """Best and second best window of each step."""
    s = _sims(spark, folder).filter(F.size("sims") > 0)
    top = F.array_max("sims")
    at = F.array_position("sims", top) - 1
    rest = F.filter("sims", lambda x, i: i != F.array_position("sims", F.array_max("sims")) - 1)
    second = F.when(F.size("sims") > 1, F.array_max(rest)).otherwise(0.0)
    return s.select("id", "step", at.cast("int").alias("win"), top.alias("sim"), second.alias("second"))


@query
def best_window(spark, folder):
    return _best(spark, folder).select("id", "step", "win", r6("sim").alias("sim"))


@query
def match_margin(spark, folder):
    return _best(spark, folder).select("id", "step", r6(F.greatest(F.col("sim") - F.col("second"), F.lit(0.0))).alias("margin"))


@query
def order_rate(spark, folder):
    """Order of the best windows over all pairs of steps above the threshold."""
    up = _best(spark, folder).withColumn("ok", F.col("sim") >= 0.45)
    per = up.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("step", "win")))).alias("w"))
    credit = F.aggregate(
        F.transform("w", lambda a, i: F.aggregate(F.slice("w", i + 2, F.size("w")), F.lit(0.0), lambda s, b: s + F.when(a["win"] < b["win"], 1.0).when(a["win"] == b["win"], 0.5).otherwise(0.0))),
        F.lit(0.0), lambda s, x: s + x,
    )
    n = F.size("w")
    return per.select("id", r6(F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(credit / (n * (n - 1) / 2))).alias("order_rate"))


def _scored(spark, folder, **kw):
    rows = samples(spark, folder)
    config = align.ScorerConfig(**{"threshold": 0.45, **kw})
    return align.score_samples(rows, ["id", "label", "subtype", "pair_id", "response", "reference_steps"], F.col("response"), F.col("reference_steps"), config)


@query
def monotonic_score(spark, folder):
    """Summed similarity along the best order-preserving path on fine windows."""
    return _scored(spark, folder, coarse_to_fine=False, threshold=0.45).select("id", F.round("result.alignment_score", 3).alias("alignment_score"))


@query
def linear_score(spark, folder):
    r = _scored(spark, folder)
    return r.select("id", r6("result.score").alias("score"), r6("result.match_rate").alias("match_rate"), r6("result.order_rate").alias("order_rate"), F.array_join("result.matched_steps", " | ").alias("matched_steps"),
                    F.size("result.unmatched_steps").alias("n_unmatched"), "result.method", r6("result.mean_margin").alias("mean_margin"))


@query
def coarse_to_fine(spark, folder):
    """Which pass decides each score, and what it matches."""
    r = _scored(spark, folder)
    return r.select("id", "result.method", F.size("result.path").alias("n_matched"), r6("result.mean_matched_sim").alias("mean_matched_sim"), r6("result.min_matched_sim").alias("min_matched_sim"))


@query
def ngram_score(spark, folder):
    """The linear score with the hashed n-gram encoder."""
    return _scored(spark, folder, encoder=embed.NgramEncoder(), threshold=0.5).select("id", r6("result.score").alias("score"), "result.encoder")


@query
def best_trajectory(spark, folder):
    """Of the steps as given, reversed, and without the first, the order that the response follows best."""
    rows = with_steps(spark, folder).filter(F.size("steps") > 1)
    three = F.array(F.col("steps"), F.reverse("steps"), F.slice("steps", F.lit(2), F.size("steps")))
    each = rows.select("id", "response", F.posexplode(three).alias("index", "trajectory"))
    scored = align.score_samples(each, ["id", "index"], F.col("response"), F.col("trajectory"), CONCEPT_SCORER)
    return align.best_trajectory(scored, "id", "index").withColumn("score", r6("score"))


# ------------------------------------------------------- evidence and routing


@query
def trace_gate(spark, folder):
    return with_steps(spark, folder).select("id", X.has_trace(F.col("response"), F.col("steps")).alias("has_trace"))


@query
def intention_recitation(spark, folder):
    return with_steps(spark, folder).select("id", r6(X.intention_fraction(F.col("response"), F.col("steps"))).alias("fraction"))


def _lexical(spark, folder):
    """A result struct from word-for-word matching, so that routing can be stated in SQL."""
    s = with_steps(spark, folder)
    hit = F.filter("steps", lambda x: F.contains(F.coalesce(F.col("response"), F.lit("")), X.step_label(x)))
    rate = F.when(F.size("steps") > 0, F.size(hit) / F.size("steps")).otherwise(0.0)
    missing = F.filter("steps", lambda x: ~F.contains(F.coalesce(F.col("response"), F.lit("")), X.step_label(x)))
    result = F.struct(
        rate.alias("score"), rate.alias("match_rate"), rate.alias("order_rate"), F.lit(0.0).alias("mean_matched_sim"), F.lit(0.0).alias("mean_margin"),
        F.transform(missing, X.step_label).alias("unmatched_steps"), F.transform(hit, X.step_label).alias("matched_steps"), F.lit(False).alias("trace_denied"),
    )
    return s.withColumn("result", result)


@query
def confidence_routing(spark, folder):
    rows = assess(_lexical(spark, folder), "result", "response", "steps", "j")
    return rows.select("id", r6("j.confidence").alias("confidence"), F.col("j.fallback").alias("fallback"), F.array_join("j.reasons", "; ").alias("reasons"))


@query
def linear_routing(spark, folder):
    """Routing of the encoder's scores."""
    rows = assess(_scored(spark, folder), "result", "response", "reference_steps", "j")
    return rows.select("id", r6("result.score").alias("score"), r6("j.confidence").alias("confidence"), F.col("j.fallback").alias("fallback"), F.array_join("j.reasons", "; ").alias("reasons"))


@query
def think_split(spark, folder):
    rows = read_rlvr(spark, f"{folder}/rlvr_rows.parquet").select("row_id", X.split_think(F.col("solution_str")).alias("t"))
    return rows.select("row_id", F.length("t.think").alias("think_len"), F.md5("t.answer").alias("answer_md5"))


@query
def repetition_penalty(spark, folder):
    rows = samples(spark, folder).withColumn("pieces", X.long_pieces(F.col("response"))).withColumn("x", X.repetition(F.col("pieces")))
    return rows.select("id", r6("x.rate").alias("rate"), r6("x.penalty").alias("penalty"))


@query
def lexical_coverage(spark, folder):
    steps = F.coalesce("reference_steps", F.array().cast("array<array<string>>"))
    return samples(spark, folder).select("id", r6(X.lexical_coverage(F.col("response"), steps)).alias("coverage"))


@query
def lexical_fallback(spark, folder):
    return with_steps(spark, folder).select("id", r6(X.label_share(X.strip(F.coalesce("response", F.lit(""))), F.col("steps"))).alias("share"))


def _final(got: DataFrame) -> DataFrame:
    """The flat columns of compute_scores, rounded, lists as text."""
    lists = {c: F.array_join(c, "; ") for c in ("reasons", "matched_steps", "unmatched_steps", "step_tiers")}
    return got.withColumns(lists | {c: r6(c) for c in ("score", "semantic_score", "match_rate", "order_rate", "repetition_rate", "penalty", "confidence")})


@query
def final_scores(spark, folder):
    """Training rows end to end."""
    return _final(compute_scores(spread(read_rlvr(spark, f"{folder}/rlvr_rows.parquet")), scorer=CONCEPT_SCORER)).drop("workflow")


@query
def final_scores_lexical(spark, folder):
    """The same without an encoder."""
    got = compute_scores(read_rlvr(spark, f"{folder}/rlvr_rows.parquet"), encoder=False)
    return got.select("row_id", r6("score").alias("score"), r6("match_rate").alias("match_rate"), "fallback", F.array_join("reasons", "; ").alias("reasons"))


def _workflow_of(identifier: Column) -> Column:
    """The workflow that the samples of a domain follow; the domain is what an id begins with."""
    named = F.when(F.lit(False), "")
    for domain, workflow in DOMAIN_WORKFLOW.items():
        named = named.when(F.substring_index(identifier, "-", 1) == domain, workflow)
    return named


def _flow(got: DataFrame, key: str) -> DataFrame:
    w = F.col("workflow")
    return got.select(
        key, r6("score").alias("score"), r6("semantic_score").alias("semantic_score"), r6("match_rate").alias("coverage"), r6("order_rate").alias("order_rate"), r6("confidence").alias("confidence"),
        "fallback", F.array_join("reasons", "; ").alias("reasons"), F.array_join(w["best_path"], ">").alias("path"), w["state_gate_passed"].alias("state_gate_passed"), w["trace"]["valid"].alias("trace_valid"),
    )


@query
def workflow_final_scores(spark, folder):
    """Training rows that carry the workflow of their domain."""
    rows = spread(read_rlvr(spark, f"{folder}/rlvr_rows.parquet")).withColumn("w", _workflow_of(F.get_json_object("extra_info", "$.sample_id")))
    specs = _specs(spark, folder).select(F.col("workflow").alias("w"), "spec")
    carried = rows.join(F.broadcast(specs), "w", "left")  # a row per workflow
    extra = F.when(F.col("spec").isNull(), F.col("extra_info")).otherwise(F.concat(F.lit('{"workflow_ground_truth": '), "spec", F.lit("}")))
    return _flow(compute_scores(carried.withColumn("extra_info", extra), scorer=CONCEPT_SCORER), "row_id")


@query
def tool_call_scores(spark, folder):
    """Tool calls as training rows carry them, fifty places of a trajectory to a row, along the workflow they name."""
    calls = _calls(spark, folder).withColumn("block", F.floor(F.col("ord") / 50))
    record = F.struct("ord", "call_id", "tool_name", "arguments", "output", "error", "exit_code", "node_id", "occurrence", "transition_kind", "state_before", "state_after", "metadata")
    # a call of a place comes once or twice, so a row has a bounded number of calls
    per = calls.groupBy("traj_id", "block").agg(F.array_sort(F.collect_list(record)).alias("calls"), F.min(F.get_json_object("metadata", "$.workflow")).alias("w"))
    specs = _specs(spark, folder).select(F.col("workflow").alias("w"), "spec")
    named = per.join(F.broadcast(specs), "w")
    extra = F.concat(F.lit('{"tool_adapter_config": {"trusted_runtime": true}, "workflow_ground_truth": '), "spec", F.lit(', "tool_calls": '), F.to_json("calls"), F.lit("}"))
    rows = named.select(F.concat_ws("#", "traj_id", F.col("block").cast("string")).alias("row_id"), extra.alias("extra_info"), F.lit(None).cast("string").alias("ground_truth"), F.lit("").alias("solution_str"))
    return _flow(compute_scores(rows.repartition(spark.sparkContext.defaultParallelism), scorer=CONCEPT_SCORER), "row_id")


# --------------------------------------------------------------- tool calls


def _calls(spark, folder):
    return read(spark, folder, "tool_calls").distinct()


@query
def tool_dispatch(spark, folder):
    rows, call = Call.parsed(_calls(spark, folder))
    return rows.select("traj_id", "ord", "call_id", handler_name(call).alias("handler"))


def _family(name):
    def run(spark, folder):
        rows, call = Call.parsed(_calls(spark, folder))
        rows = rows.withColumn("handler", handler_name(call)).filter(F.col("handler") == name)
        return rows.withColumn("x", semantics(call, F.lit(name))).select("traj_id", "ord", "call_id", "x.action", "x.evidence", "x.outcome", "x.status")

    return run


for _name in ("pytest", "shell", "file_read", "file_write", "browser", "http", "generic"):
    QUERIES[f"{_name}_semantics"] = _family(_name)


@query
def redact(spark, folder):
    rows = _calls(spark, folder)
    return rows.select("traj_id", "ord", "call_id", redact_json(F.col("arguments")).alias("arguments"))


@query
def adapted_events(spark, folder):
    """Tool calls as runtime events with redacted payloads."""
    e = events.adapted(_calls(spark, folder), trusted=True)
    return e.select("traj_id", "ord", "event_id", "handler", "action", "evidence", "outcome", "status", "source", "trusted", "node_id", "occurrence", "transition_kind", "tool_input", "state_after")


# ------------------------------------------------------------------- events


#: What the checks read of an event.
CHECKED = ["traj_id", "ord", "event_id", "node_id", "occurrence", "transition_kind", "trusted", "source", "metadata", "ingested_at"]


def _events(spark, folder, *, payloads=False):
    raw = read(spark, folder, "trace_events")
    return events.current_events(raw if payloads else raw.select(*CHECKED))


def _graph(spark, folder):
    return [read(spark, folder, t) for t in ("workflow_nodes", "workflow_edges", "workflow_defs")]


@query
def event_trust(spark, folder):
    e = _events(spark, folder)
    ok = F.coalesce(F.col("trusted") & F.col("source").isin("runtime", "external"), F.lit(False))
    return e.select("traj_id", "ord", ok.alias("trusted"))


@query
def render_events(spark, folder):
    return events.rendered(_events(spark, folder, payloads=True)).select("traj_id", "ord", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def _walked(spark, folder, use, *, payloads=False):
    """What ``use`` (events, events of known nodes, whether no trajectory is long) makes of short trajectories and of long ones."""
    nodes = read(spark, folder, "workflow_nodes")
    raw = _events(spark, folder, payloads=payloads)
    return in_parts(raw, "traj_id", "ord", lambda rows, single: use(rows, events.known_events(rows, nodes, single=single), single))


def _visits(spark, folder, use=lambda seen, single: seen):
    return _walked(spark, folder, lambda _, known, single: use(events.visits(known, single=single), single))


def _moves(spark, folder):
    edges = read(spark, folder, "workflow_edges")
    return _visits(spark, folder, lambda seen, single: events.transitions(seen, edges, single=single))


@query
def occurrence_infer(spark, folder):
    return _walked(spark, folder, lambda _, known, single: known).select("traj_id", "ord", "node_id", F.col("occ").cast("long").alias("occ"))


@query
def visit_islands(spark, folder):
    v = _visits(spark, folder)
    return v.select("traj_id", F.col("visit").cast("long").alias("visit"), "node_id", F.col("occ").cast("long").alias("occ"), "first_ord", "n_events")


@query
def edge_lookup(spark, folder):
    t = _moves(spark, folder)
    return t.select("traj_id", F.col("visit").cast("long").alias("visit"), F.col("prev_node_id").alias("source"), F.col("node_id").alias("target"), "edge_index", F.col("n_edges").cast("long").alias("n_edges"),
                    F.col("taken").cast("long").alias("taken"))


@query
def transition_counts(spark, folder):
    t = _moves(spark, folder)
    return t.filter("edge_index is not null").groupBy("workflow", F.col("edge_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def ambiguous_transitions(spark, folder):
    return events.ambiguous(_moves(spark, folder)).select("traj_id", F.col("visit").cast("long").alias("visit"), "warning")


@query
def visit_limits(spark, folder):
    v = _visits(spark, folder).groupBy("traj_id", "workflow", "node_id").agg(F.count(F.lit(1)).alias("visits"))
    n = read(spark, folder, "workflow_nodes").select("workflow", F.col("id").alias("node_id"), "max_visits")
    return v.join(n, ["workflow", "node_id"]).filter("visits > max_visits").select("traj_id", "node_id", "visits", "max_visits")


@query
def state_observations(spark, folder):
    s = _walked(spark, folder, lambda raw, known, single: events.state_observations(known, raw, single=single), payloads=True)
    return s.select("traj_id", "node_id", F.col("occ").cast("long").alias("occ"), "before", "after")


@query
def trace_violations(spark, folder):
    return events.violations(events.checks(_events(spark, folder), *_graph(spark, folder)))


@query
def trace_validity(spark, folder):
    v = events.validity(events.checks(_events(spark, folder), *_graph(spark, folder)))
    return v.select("traj_id", "checks_passed", "checks_total", r6("validity").alias("validity"), "valid")


@query
def potential_shaping(spark, folder):
    """Share of a workflow's nodes seen so far as potential, and its shaped increments."""
    total = read(spark, folder, "workflow_nodes").groupBy(F.col("workflow").alias("w")).agg(F.count(F.lit(1)).alias("nodes"))

    def potentials(_, known, single):
        known = write_shared(known, "known")  # read for the nodes' first events and for all
        first = known.groupBy(F.col("traj_id").alias("t"), F.col("node_id").alias("n")).agg(F.min("ord").alias("o"))
        here = (F.col("traj_id") == F.col("t")) & (F.col("node_id") == F.col("n")) & (F.col("ord") == F.col("o"))
        marked = known.join(first, here, "left").withColumn("new", F.col("o").isNotNull().cast("long")).drop("t", "n", "o")
        seen = running(marked, ["traj_id"], "ord", "seen", "sum", F.col("new"), single=single).join(broadcast_if_small(total), F.col("workflow") == F.col("w"))
        return wf.shaped(seen.withColumn("potential", F.col("seen") / F.col("nodes")), "traj_id", "ord", gamma=0.9, single=single)

    out = _walked(spark, folder, potentials)
    return out.select("traj_id", "ord", r6("potential").alias("potential"), r6("shaped_reward").alias("shaped_reward"))


@query
def attempts(spark, folder):
    """Trajectories cut where their workflow starts again: the unit in which long ones are scored."""
    starts = broadcast_if_small(read(spark, folder, "workflow_defs").select(F.col("name").alias("w"), "start"))

    def numbered(seen, single):
        marked = seen.join(starts, F.col("workflow") == F.col("w"))
        return running(marked, ["traj_id"], "visit", "attempt", "sum", (F.col("node_id") == F.col("start")).cast("long"), single=single)

    cut = _visits(spark, folder, numbered)
    return cut.groupBy("traj_id", "attempt").agg(F.count(F.lit(1)).alias("visits"), F.sum("n_events").alias("events"), F.min("first_ord").alias("first_ord"))


# ---------------------------------------------------------------- workflows


@query
def schema_problems(spark, folder):
    return wf.schema_problems(*_graph(spark, folder))


@query
def schema_faults(spark, folder):
    """What is found in the workflows once each rule is broken somewhere."""
    nodes, edges, defs = _graph(spark, folder)
    at = lambda c, k, bad: F.when(F.col(f"{'edge' if c in ('kind', 'max_traversals', 'source', 'target') else 'node'}_index") == k, bad).otherwise(F.col(c))
    nodes = nodes.withColumns({
        "weight": at("weight", 1, F.lit(-1.0)), "max_visits": at("max_visits", 2, F.lit(0)), "action": at("action", 3, F.array(F.lit(" "))), "id": at("id", 4, F.concat(F.lit("gone-"), "id")),
        "required": F.when(F.col("workflow") == "defect_loop", F.lit(False)).otherwise(F.col("required")),
    })
    nodes = nodes.unionByName(nodes.filter("node_index = 0"))
    edges = edges.withColumns({"kind": at("kind", 0, F.lit("jump")), "max_traversals": at("max_traversals", 1, F.lit(0)), "target": at("target", 2, F.lit("nowhere"))})
    named = F.col("name") == "web_booking"
    defs = defs.withColumns({"start": F.when(named, "nowhere").otherwise(F.col("start")), "terminals": F.when(named, F.array().cast("array<string>")).otherwise(F.col("terminals"))})
    return wf.schema_problems(nodes, edges, defs)


@query
def reachability(spark, folder):
    _, edges, defs = _graph(spark, folder)
    return wf.reachable(edges, defs.select(F.col("name").alias("workflow"), F.col("start").alias("seed"))).select("workflow", "node")


@query
def dead_ends(spark, folder):
    """Per workflow: nodes the start does not reach, nodes that reach no terminal, and all nodes."""
    nodes, edges, defs = _graph(spark, folder)
    seeds = defs.select(F.col("name").alias("workflow"), F.explode("terminals").alias("seed"))
    ids = nodes.select("workflow", F.col("id").alias("node"))
    back = wf.reachable(edges, seeds, backward=True).select("workflow", "node").distinct().withColumn("ends", F.lit(1))
    ahead = reachability(spark, folder).distinct().withColumn("met", F.lit(1))
    joined = ids.join(ahead, ["workflow", "node"], "left").join(back, ["workflow", "node"], "left")
    return joined.groupBy("workflow").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum(F.col("met").isNull().cast("long")).alias("unreachable"), F.sum(F.col("ends").isNull().cast("long")).alias("dead_ends")
    )


def _specs(spark, folder):
    return wf.packed(*_graph(spark, folder))


@query
def path_enumeration(spark, folder):
    p = wf.paths_table(_specs(spark, folder))
    return p.select("workflow", "path_index", F.array_join("nodes", ">").alias("path"), F.size("nodes").alias("n_nodes"), "truncated")


@query
def graph_unrolling(spark, folder):
    return wf.graph_table(_specs(spark, folder))


@query
def contract_weights(spark, folder):
    return wf.contract_weights(read(spark, folder, "workflow_nodes")).withColumn("weight", r6("weight"))


def _rewards(spark, folder):
    rows = samples(spark, folder).withColumn("domain", F.substring_index("id", "-", 1))
    return wf.score_workflows(rows, ["id", "domain"], F.col("response"), _workflow_of(F.col("id")), _specs(spark, folder), scorer=CONCEPT_SCORER)


@query
def workflow_score(spark, folder):
    r = _rewards(spark, folder).filter("reward is not null")
    return r.select("id", r6("reward.score").alias("score"), r6("reward.required_coverage").alias("required_coverage"), r6("reward.order_rate").alias("order_rate"), F.array_join("reward.best_path", ">").alias("path"))


@query
def node_rewards(spark, folder):
    """The reward of every visit on the best path of a sample."""
    n = _rewards(spark, folder).select("id", F.posexplode("reward.node_scores").alias("place", "x"))
    return n.select("id", "place", "x.visit", r6("x.score").alias("score"), r6("x.state").alias("state"))


@query
def stage_rewards(spark, folder):
    s = _rewards(spark, folder).select("id", F.explode("reward.stages").alias("x"))
    return s.select("id", "x.stage", r6("x.required").alias("required"), r6("x.optional").alias("optional"))


def _attempts(spark, folder):
    """The events of every attempt as JSON; a trajectory of any length is many of them.

    Short trajectories are cut in one shuffle, long ones (and all, if there are many nodes) by prefix computations.
    """
    nodes, defs = read(spark, folder, "workflow_nodes"), read(spark, folder, "workflow_defs")
    ids = broadcast_if_small(nodes.select(F.col("workflow").alias("w"), F.col("id").alias("i")).distinct())

    def walked(raw, single):
        if single and (cut := traces.cut_events(raw, nodes, defs)) is not None:
            return cut
        current = events.current_events(raw)
        known = current.join(ids, (F.col("workflow") == F.col("w")) & (F.col("node_id") == F.col("i")), "left_semi")
        whole = traces.collected_events(current, traces.attempts(current, known, defs, single=single))
        return whole.withColumn("trace", F.to_json("trace"))

    return in_parts(read(spark, folder, "trace_events").filter("traj_id is not null and ord is not null"), "traj_id", "ord", walked)


@query
def trace_walks(spark, folder):
    """How every attempt fares in its workflow."""
    w = traces.validate_traces(_attempts(spark, folder), ["traj_id", "attempt", "part"], _specs(spark, folder))
    t = F.col("trace")
    return w.select("traj_id", "attempt", "part", *[t[c].alias(c) for c in ("total_events", "trusted_events", "checks_passed", "checks_total", "valid", "terminal_reached")],
                    F.array_join(t["occurrence_path"], ">").alias("path"), F.size(t["warnings"]).alias("n_warnings"))


@query
def trace_rewards(spark, folder):
    """Attempts validated, rendered, scored along their workflow on all their windows, and gated."""
    scored = traces.score_traces(_attempts(spark, folder), ["traj_id", "attempt", "part"], _specs(spark, folder), scorer=ATTEMPT_SCORER, config=wf.WorkflowConfig(hard_trace_gate=False),
                                 fields=["score", "required_coverage", "order_rate", "state_score"])
    r = F.col("reward")
    return scored.select("traj_id", "attempt", "part", r6(r["score"]).alias("score"), r6(r["required_coverage"]).alias("required_coverage"), r6(r["order_rate"]).alias("order_rate"),
                         r6(r["state_score"]).alias("state_score"), r["trace"]["valid"].alias("valid"), r6(r["trace"]["validity"]).alias("validity"),
                         F.array_join(r["trace"]["violations"], "; ").alias("violations"))


@query
def event_potentials(spark, folder):
    """How far each event carries its attempt along the workflow."""
    out = traces.event_potentials(_attempts(spark, folder), ["traj_id", "attempt"], _specs(spark, folder), scorer=ATTEMPT_SCORER, gamma=0.9)
    return out.select("traj_id", "attempt", "ord", r6("potential").alias("potential"), r6("shaped_reward").alias("shaped_reward"), "valid", r6("validity").alias("validity"))


@query
def turn_potentials(spark, folder):
    """Potentials of the paragraphs of a response as turns."""
    rows = samples(spark, folder).filter("response is not null")
    turns = F.filter(F.split("response", "\n\n+"), lambda t: X.strip(t) != "")
    out = wf.turn_potentials(rows, ["id"], turns, _workflow_of(F.col("id")), _specs(spark, folder), scorer=CONCEPT_SCORER)
    return out.select("id", "turn", r6("potential").alias("potential"), r6("shaped_reward").alias("shaped_reward"))


# ------------------------------------------------------------------ quality


def _labelled(spark, folder):
    rows = assess(_lexical(spark, folder), "result", "response", "steps", "j")
    score = X.lexical_coverage(F.col("response"), F.col("steps"))
    out = rows.select("id", "label", "subtype", "pair_id", score.alias("score"), F.col("j.confidence").alias("confidence"), F.col("j.fallback").alias("fallback"))
    return out.withColumn("trusted_score", F.when(F.col("fallback"), 0.0).otherwise(F.col("score")))


@query
def auroc(spark, folder):
    return quality.ranking(_labelled(spark, folder)).select("count", "positives", "negatives", r6("auroc").alias("auroc"))


@query
def average_precision(spark, folder):
    return quality.ranking(_labelled(spark, folder)).select("count", r6("average_precision").alias("average_precision"))


@query
def threshold_metrics(spark, folder):
    m = quality.threshold_metrics(_labelled(spark, folder))
    return m.select("count", *[r6(c).alias(c) for c in m.columns if c != "count"])


@query
def pairwise_accuracy(spark, folder):
    return quality.pairwise(_labelled(spark, folder)).withColumn("accuracy", r6("accuracy"))


@query
def subtype_report(spark, folder):
    r = quality.by_subtype(_labelled(spark, folder))
    return r.select("subtype", "count", *[r6(c).alias(c) for c in r.columns if c not in ("subtype", "count")])


@query
def quality_report(spark, folder):
    """The whole report: word matches as scores, their routing, folded words as the lexical baseline."""
    rows = assess(_lexical(spark, folder), "result", "response", "steps", "j")
    out = rows.select(
        "label", "subtype", "pair_id", F.col("result.match_rate").alias("score"), X.lexical_coverage(F.col("response"), F.col("steps")).alias("lexical_score"),
        F.col("j.confidence").alias("confidence"), F.col("j.fallback").alias("fallback"), (~F.coalesce("j.has_trace", F.lit(False))).alias("trace_denied"),
    )
    # every block reads the same few columns
    narrow = write_shared(out.withColumn("trusted_score", F.when(F.col("fallback"), 0.0).otherwise(F.col("score"))), "report")
    return quality.report(narrow).withColumn("value", r6("value"))


@query
def top_n_scores(spark, folder):
    """The twenty best samples; the limit is the report."""
    return _labelled(spark, folder).orderBy(F.desc("score"), "id").limit(20).select("id", r6("score").alias("score"))


@query
def denied_steps(spark, folder):
    """Steps that match word for word in responses the gate denies."""
    rows = _lexical(spark, folder).filter(~X.has_trace(F.col("response"), F.col("steps")))
    return rows.select("id", F.explode("result.matched_steps").alias("step"))


@query
def gated_paths(spark, folder):
    """Steps that the path without the evidence gate matches and the one with it doesn't."""
    keep = ["id", "response", "reference_steps"]
    rows = samples(spark, folder)
    free = align.score_samples(rows, keep, F.col("response"), F.col("reference_steps"), CONCEPT_SCORER)
    gated = align.ScorerConfig(threshold=0.45, require_trace=True)
    both = align.score_samples(free.withColumnRenamed("result", "free"), ["id", "reference_steps", "free"], F.col("response"), F.col("reference_steps"), gated)
    return both.select("id", F.explode(quality.denied_steps(F.col("free"), F.col("result"), X.normalized_steps(F.col("reference_steps")))).alias("x")).select("id", "x.step", "x.label")


# -------------------------------------------------------------- experiments


@query
def layered_workflows(spark, folder):
    """Alignment along the graph against all paths, on layered workflows."""
    import json

    rows, encode = [], embed.Cached(embed.NgramEncoder()).encode
    for branches, layers in ((2, 2), (2, 5), (3, 3), (4, 2)):
        spec, text = experiments.layered_workflow(branches, layers)
        got = [wf.score_workflow(encode, json.dumps(spec), text, {}, ATTEMPT_SCORER, wf.WorkflowConfig(mode=mode)) for mode in ("graph", "enumerate")]
        rows.append((branches, layers, got[1]["candidate_paths"], got[0]["graph_states"], got[0]["graph_transitions"], got[0]["best_path"] == got[1]["best_path"]))
    return spark.createDataFrame(rows, "branches int, layers int, paths int, states int, transitions int, agree boolean")


@query
def episode_summary(spark, folder):
    s = experiments.episode_summary(read(spark, folder, "episodes"))
    return s.select("domain", "ablation", "seed", "episodes", *[r6(c).alias(c) for c in s.columns[4:]])


@query
def run_matrix(spark, folder):
    return experiments.run_matrix(*experiments.default_suite(spark))


@query
def token_rewards(spark, folder):
    """An episode's process reward, shared out to the last token of each of its turns of ten tokens."""
    e = read(spark, folder, "episodes").filter("turns > 0")
    ends = F.transform(F.sequence(F.lit(1), F.col("turns")), lambda i: i * 10 - 1)
    each = F.transform(F.sequence(F.lit(1), F.col("turns")), lambda i: F.col("process_reward") / F.col("turns"))
    vector = experiments.token_rewards(F.col("turns") * 10, ends, each)
    rows = e.select("episode_id", F.posexplode(vector).alias("token", "reward"))
    return rows.filter("reward <> 0").select("episode_id", "token", r6("reward").alias("reward"))


# ---------------------------------------------------------------- streaming


@query
def stream_counts(spark, folder):
    """Different places per hour and workflow, by Structured Streaming."""
    out = streams.counts(streams.event_stream(spark, f"{folder}/trace_events.parquet"))
    return streams.drained(spark, out, "counts").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "workflow", "n")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Order-preserving scores of all samples with their routing."""
    return linear_routing(spark, folder)


SQL: dict[str, str] = _SQL
